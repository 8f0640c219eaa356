from dataclasses import replace

import numpy as np
import pytest

from codeloom.llm.nn_descent import Settings, both_ways, entries, greedy, nearest


def brute(ids, x, query, top):
    score = x @ x[ids.index(query)]
    order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-score[i], ids[i]))[:top]
    return [(ids[i], score[i]) for i in order]


def frame(spark, ids, x, odd=()):
    return spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in zip(ids, x, strict=True)] + list(odd), "vec_id long, embedding array<double>")


ODD = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [float("inf")] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [1.0, 2.0]), (None, [1.0] * 8), (906, [])]


def test_small_shards_find_all_with_ties_norms_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8)) * rng.uniform(0.2, 3, (300, 1))
    x[40:75] = x[3]  # more copies than a result has rows
    x[80] = x[81]
    ids = list(range(300))
    df = frame(spark, ids, x, ODD)
    got = nearest(df, df.where("vec_id % 20 = 0 or vec_id in (40, 900, 901)"), 20, replace(Settings(), shard=80, degree=12, pool=64)).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {*range(0, 300, 20), 40}
    hit = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        want = brute(ids, x, q, 20)
        assert [r["rank"] for r in rows] == list(range(1, 21))
        hit += len({r.vec_id for r in rows} & {i for i, _ in want})
        for r in rows:
            assert r.score == pytest.approx(float(x[ids.index(q)] @ x[ids.index(r.vec_id)]), rel=1e-12)
        assert rows == sorted(rows, key=lambda r: (-r.score, r.vec_id))
    assert hit / (20 * len(by)) >= 0.98
    want40 = [i for i, _ in brute(ids, x, 40, 20)]
    assert [r.vec_id for r in by[40]] == want40


def test_few_and_no_rows(spark):
    df = frame(spark, [0, 1, 2], np.eye(3))
    got = nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def recall(spark, x, settings=Settings(), every=20):
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    by = {}
    for r in nearest(df, df.where(f"vec_id % {every} = 0"), 20, settings).collect():
        by.setdefault(r.query_id, []).append(r.score)
    x, hit = x.astype(float), 0
    for q in range(0, len(x), every):
        score = np.delete(x @ x[q], q)
        least = np.sort(score)[-20]
        assert len(by[q]) == 20
        hit += sum(s >= least - 1e-9 for s in by[q])
    return hit / 20 / len(by)


@pytest.mark.parametrize("clusters", [20, 100, 400])
def test_clusters_larger_and_smaller_than_a_node_s_neighbours(spark, clusters):
    rng = np.random.default_rng(clusters)
    x = rng.standard_normal((clusters, 32))[rng.integers(0, clusters, 4000)] + 0.05 * rng.standard_normal((4000, 32))
    assert recall(spark, x) >= 0.95


def test_heavy_tailed_norms_over_several_levels_of_cells(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 32)) * (rng.pareto(1, (4000, 1)) + 0.1)
    assert recall(spark, x, replace(Settings(), shard=1000)) >= 0.95


def test_hubs(spark):
    x = np.random.default_rng(5).standard_normal((2000, 16))
    x[3:] += 2  # all lie to one side, and the first three are near everything
    x[:3] = x[3:].mean(0) * [[1.0], [0.9], [0.8]]
    assert recall(spark, x) >= 0.95


def test_cells_are_bounded_and_routes_lead_to_few(spark, tmp_path):
    from codeloom.llm.nn_descent import deal, route

    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 8))[rng.integers(0, 60, 3000)] + 0.02 * rng.standard_normal((3000, 8))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "id long, v array<double>")
    s = replace(Settings(), shard=20, probes=4)
    dealt, levels = deal(df, 3000, s, f"file://{tmp_path}/d")
    home = {r.id: r.cell for r in dealt.collect()}
    sizes = np.unique(list(home.values()), return_counts=True)[1]
    assert len(home) == 3000 and sizes.max() <= 20 and len(levels) > 1
    ways = {}
    for r in route(df.where("id % 50 = 0"), levels, s).collect():
        ways.setdefault(r.qid, set()).add(r.cell)
    assert len(ways) == 60 and max(map(len, ways.values())) < 60
    assert set().union(*ways.values()) <= set(home.values())


def test_greedy_search_reaches_the_nearest_of_random_vectors():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    score = x @ x.T
    np.fill_diagonal(score, -2)
    near = np.argsort(-score, 1)[:, :16]
    bounds, ends = both_ways(np.repeat(np.arange(3000), 16), near.ravel(), 3000)
    assert len(entries(bounds, ends, rng, 10)) >= 10
    q = rng.standard_normal((50, 32)).astype(np.float32)
    found = greedy(x, bounds, ends, entries(bounds, ends, rng), q, 10, Settings())
    want = np.argsort(-(q @ x.T), 1)[:, :10]
    assert np.mean([len(set(f) & set(w)) for f, w in zip(found.tolist(), want.tolist(), strict=True)]) >= 9.3


def test_entries_reach_every_component():
    row, other = np.array([0, 1, 3, 4, 6, 7, 8]), np.array([1, 2, 4, 5, 7, 8, 9])
    bounds, ends = both_ways(row, other, 11)
    assert {0, 3, 6, 10} <= set(entries(bounds, ends, np.random.default_rng(0), 1).tolist())


def test_an_id_with_several_vectors_counts_once(spark):
    df = frame(spark, [0, 1, 1, 2, 2], np.array([[1.0, 0], [0.5, 0], [0.4, 0.1], [0.2, 0], [0.2, 0]]))
    got = nearest(df, df.where("vec_id = 0"), 20).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1, 2]
    again = nearest(df.repartition(3), df.where("vec_id = 0"), 20).collect()
    assert sorted(got) == sorted(again)
