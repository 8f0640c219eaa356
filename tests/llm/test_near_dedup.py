import random
from collections import defaultdict
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm.components import components, union_find
from codeloom.llm.near_dedup import Settings, near_duplicates, superminhash


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, k, percent=80):
    sets = defaultdict(set)
    for r in rows:
        if r["doc_id"] is not None:
            sets[r["doc_id"]] |= {frozenset(shingles(r["text"], k))}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            for g in s:
                by[g].add(i)
    for i in ids:
        for j in {j for s in sets[i] for g in s for j in by[g]}:
            if j > i and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def check(found, rows, k):
    want = brute(rows, k)
    found = found.collect()
    assert len(found) == len(rows)
    n = {(r["doc_id"], r["text"]): len(shingles(r["text"], k)) for r in rows}
    assert sorted(x.n_shingles for x in found) == sorted(n[(r["doc_id"], r["text"])] for r in rows)
    for x in found:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert x.component_id == want[x.doc_id], x
            assert x.kept == (x.component_id == x.doc_id)


def test_signatures_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 300, 3000):
        common = rng.integers(0, 1 << 63, 8 * n, dtype=np.uint64)
        errors = []
        for t in range(12):
            own = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.unique(np.append(common, own[:n])), np.unique(np.append(common, own[n:]))
            h = superminhash(np.append(a, b), np.array([0, len(a), len(a) + len(b)]), 200)
            assert (h < np.iinfo(np.uint64).max).all()
            errors.append((h[0] == h[1]).mean() - 0.8)
        assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.06
    h = superminhash(np.zeros(0, np.uint64), np.array([0, 0]), 8)
    assert (h == np.iinfo(np.uint64).max).all()


def test_components_of_chains_stars_and_cliques(spark, tmp_path):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(10, 600)] + [(2000, 2000 + i) for i in range(1, 300)] + [(5000 + rng.randrange(40), 5000 + rng.randrange(40)) for _ in range(200)] + [(7, 7)]
    rng.shuffle(edges)
    a, b = np.array(edges, np.int64).T
    want = dict(zip(*map(np.ndarray.tolist, union_find(a, b)), strict=True))
    for n, one_task in (("c", 1 << 18), ("e", 100)):
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7), f"file://{tmp_path}/{n}", one_task).collect()}
        assert {k: v for k, v in got.items() if k != v} == want
    assert components(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}/d").count() == 0


def test_documents_match_brute_force(docs, rows):
    clash = docs.withColumn("id", F.lit(1)).withColumn("key", F.lit("k")).withColumn("component_id", F.lit(2))
    for k in (4, 5):
        check(near_duplicates(clash, replace(Settings(), words=k)), rows, k)


def test_large_groups_of_near_copies_and_a_shared_passage(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(160)], [word() for _ in range(60)]
    rows = []
    for i in range(150):  # around the bound: many pairs are linked only through others
        t = list(base)
        for _ in range(rng.choice([1, 2, 4, 5, 6])):
            t[rng.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    for i in range(150, 260):
        rows.append((i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])))
    rows += [(i, rows[3][1].upper()) for i in range(260, 330)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for s in (Settings(), replace(Settings(), block=16)):
        check(near_duplicates(df, s), [{"doc_id": d, "text": t} for d, t in rows], 4)


def test_empty_table(no_docs):
    got = near_duplicates(no_docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == 0
