"""Operators 1, 2, 6, 8, 9 and 10 against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from codeloom.llm import arrow_tokens, packing, quality_ledger, sentencepiece_offsets, shuffle_shards, token_attribution
from codeloom.llm.queries import BYTE_BPE, PIECE_BPE
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def bag(found):
    return Counter(map(tuple, found))


@pytest.mark.parametrize("rule", token_attribution.RULES)
def test_attribution_matches_offsets_of_the_library(docs, rows, bpe, rule):
    want = Counter()
    for r in rows:
        text = r.text or ""
        e = bpe.encode(text, add_special_tokens=False)
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        start = 0
        if not text.isascii():  # the library's offsets are characters; bytes decide inside one
            continue
        for k, line in enumerate(lines):
            end, n, crossing = start + len(line), 0.0, 0
            for a, b in e.offsets:
                if rule == "proportional":
                    n += max(0, min(b, end) - max(a, start)) / (b - a)
                else:
                    n += start <= {"first": a, "last": b - 1, "middle": (a + b - 1) // 2}[rule] < end
                crossing += a < end and b > start and (a < start or b > end)
            want[(r.doc_id, k, start, end, round(n, 6), crossing)] += 1
            start = end
    keys = {(r.doc_id) for r in rows if (r.text or "").isascii()}
    few = docs.where(F.length("text") < 9000)
    got = Counter((x.doc_id, x.section, x.start_char, x.end_char, round(x.n_tokens, 6), x.n_crossing) for x in token_attribution.attribute_tokens(few, BYTE_BPE, rule).collect() if x.doc_id in keys)
    short = {r.doc_id for r in rows if len(r.text or "") < 9000}
    assert got == Counter({k: v for k, v in want.items() if k[0] in short})


def test_attribution_of_given_spans_and_totals(spark, docs, rows, bpe):
    total = {(x.doc_id): x.n for x in token_attribution.attribute_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), BYTE_BPE, "proportional").groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    for r in rows:
        if r.text and r.doc_id is not None:
            assert total[r.doc_id] == pytest.approx(len(bpe.encode(r.text, add_special_tokens=False).ids))
    given = spark.createDataFrame([(1, "héllo wörld", [(0, 5), (5, 11), (3, 99), (7, 7)]), (2, None, [(0, 4)]), (3, "x", None)], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = {(x.doc_id, x.section): (x.start_char, x.end_char, x.n_tokens) for x in token_attribution.attribute_tokens(given, BYTE_BPE, "first", "parts").collect()}
    n = len(bpe.encode("héllo", add_special_tokens=False).ids)
    assert got[(1, 0)] == (0, 5, n) and got[(1, 1)][:2] == (5, 11) and got[(1, 2)][:2] == (3, 11) and got[(1, 3)] == (7, 7, 0)
    assert got[(2, 0)] == (0, 0, 0) and len(got) == 5
    with pytest.raises(ValueError):
        token_attribution.attribute_tokens(given, BYTE_BPE, "nearest")


def test_arrow_files_round_trip(spark, docs, rows, no_docs, bpe, tmp_path):
    manifest = arrow_tokens.write_tokens(docs, BYTE_BPE, f"file://{tmp_path}/t", width=64, rows_per_batch=4)
    got = arrow_tokens.read_tokens(spark, manifest).collect()
    ids = [(r.doc_id, bpe.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in rows]
    assert bag((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == bag((d, len(x), crc(x)) for d, x in ids)
    got.sort(key=lambda g: g.start)
    assert [g.doc_id for g in got] == sorted((d for d, _ in ids), key=lambda d: (d is not None, d))
    assert [g.start for g in got] == np.concatenate([[0], np.cumsum([g.n_tokens for g in got])[:-1]]).tolist()
    m = manifest.orderBy("file_no").first()
    f = arrow_tokens.TokenFile(f"{m.path}.ids.arrow")
    whole = np.concatenate(list(f.stream()))
    assert len(whole) == m.n_tokens
    for i in (0, 5, m.n_rows - 1):
        row, mask = f.row(i)
        assert len(row) == len(mask) == 64 and (row[mask] == whole[i * 64 : i * 64 + 64]).all()
    assert arrow_tokens.read_tokens(spark, arrow_tokens.write_tokens(no_docs, BYTE_BPE, f"file://{tmp_path}/e")).count() == 0


def test_packing_places_every_id_once(docs, rows, no_docs, bpe):
    got = packing.pack(docs.repartition(3), BYTE_BPE, end_id=1, block_tokens=60_000).collect()
    want = Counter()
    for r in rows:
        want[(r.doc_id, tuple(bpe.encode(r.text or "", add_special_tokens=False).ids + [1]))] += 1
    seqs, docs_of = defaultdict(list), defaultdict(list)
    for g in got:
        assert len(g.ids) == 4 * g.length and 0 < g.length <= 2048
        seqs[g.sequence_id].append(g)
        docs_of[(g.doc_id, g.doc_tokens)].append(g)
    used = 0
    for pieces in seqs.values():
        pieces.sort(key=lambda g: g.offset)
        assert [p.offset for p in pieces] == np.concatenate([[0], np.cumsum([p.length for p in pieces])[:-1]]).tolist()
        used += sum(p.length for p in pieces)
        assert sum(p.length for p in pieces) <= 2048
    assert used == sum(len(k[1]) * v for k, v in want.items())
    for (d, ids), n in want.items():
        if n == 1 and sum(k[0] == d for k in want) == 1:
            pieces = sorted(docs_of[(d, len(ids))], key=lambda g: g.start)
            assert b"".join(p.ids for p in pieces) == np.array(ids, "<u4").tobytes()
            assert [p.start for p in pieces] == np.concatenate([[0], np.cumsum([p.length for p in pieces])[:-1]]).tolist()
    assert packing.pack(no_docs, BYTE_BPE).count() == 0


def test_assignment_balances_cost_and_leaves_less_than_one_sequence():
    rng = np.random.default_rng(3)
    lengths = (rng.pareto(1.2, 3000) * 200).astype(int) + 1
    pieces, many = packing.assign(lengths, 2048)
    assert pieces[:, 2].sum() == lengths.sum() and many * 2048 - lengths.sum() < 2 * 2048
    whole = np.bincount(pieces[:, 0], pieces[:, 2], len(lengths))
    assert (whole == lengths).all()
    cost = np.bincount(pieces[:, 3], pieces[:, 2] + pieces[:, 2] ** 2 / 1024)
    mixed = cost[np.bincount(pieces[:, 3]) > 1]
    assert mixed.std() / mixed.mean() < 0.35
    assert packing.assign(np.zeros(0, int), 2048)[1] == 0


def test_sentencepiece_ids_spans_and_text(docs, rows, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = bag((g.doc_id, g.n_tokens, bytes(g.ids), g.decoded) for g in sentencepiece_offsets.encode_decode(docs, PIECE_BPE).collect())
    want = Counter()
    for r in rows:
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        want[(r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), sp.decode(ids))] += 1
    assert got == want
    m = sentencepiece_offsets.model(PIECE_BPE)
    for text in [r.text or "" for r in rows[:40]] + ["日本 x  y", " a b "]:
        ids = np.array(sp.encode(text, add_bos=True, add_eos=True))
        lo, hi = m.spans(text.encode(), ids)
        raw = text.encode()
        assert (lo[1:] >= lo[:-1]).all() and (hi[1:-1] >= lo[2:]).all() and lo[0] == hi[0] == 0
        for i, s, e in zip(ids[1:-1].tolist(), lo[1:-1], hi[1:-1], strict=True):
            piece = sp.id_to_piece(i)
            plain = bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()
            assert raw[s:e] == plain or (s == 0 and b" " + raw[s:e] == plain)
    assert sentencepiece_offsets.encode_decode(no_docs, PIECE_BPE).count() == 0


def test_compiled_character_map_is_applied_by_longest_prefix():
    import struct

    def trie(words):
        """A double array for a few one- and two-byte keys, by hand: units at offset ^ byte."""
        units = [0] * 2048
        units[0] = 256 << 10
        at = {b"": 256}
        free = 512
        for key, value in sorted(words.items()):
            node = 256
            for i, c in enumerate(key):
                pos = node ^ c
                if key[: i + 1] not in at:
                    at[key[: i + 1]] = free
                    units[pos] = ((free ^ pos) << 10) | c
                    free += 256
                node = at[key[: i + 1]]
                if i + 1 == len(key):
                    units[pos] |= 1 << 8
                    units[node] = value | 1 << 31
        return units

    texts = b"X\0yz\0"
    units = trie({b"a": 0, b"ab": 2})
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + texts
    m = object.__new__(sentencepiece_offsets.Model)
    m.map, m.prefix, m.squeeze, m.escape = sentencepiece_offsets.CharMap(blob), True, True, True
    out, start, end = m.normalise(b"  ab  c a ")
    assert out == "▁yz▁c▁X".encode()
    assert list(zip(start, end, strict=True)) == [(0, 0)] * 3 + [(2, 4)] * 2 + [(4, 5)] * 3 + [(6, 7)] + [(7, 8)] * 3 + [(8, 9)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_quality_measurements(docs, rows, no_docs):
    want = Counter()
    for r in rows:
        t = r.text or ""
        w = words(t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))] += 1
    q = quality_ledger.ledger(docs.withColumn("quality", F.lit(3)))
    assert q.columns == [*docs.columns, "quality"]
    base = F.col("quality.failures").bitwiseAND(F.lit(3).cast("long")) != 0
    got = bag(q.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base).collect())
    assert got == want
    assert quality_ledger.ledger(no_docs).count() == 0


def test_policies_and_ablation_agree_with_the_bits(docs):
    q = quality_ledger.ledger(docs)
    fails = [x.f for x in q.select(F.col("quality.failures").alias("f")).collect()]
    for version, rules in quality_ledger.POLICIES.items():
        m = quality_ledger.mask(rules)
        assert q.where(quality_ledger.keeps(F.col("quality.failures"), version)).count() == sum(not f & m for f in fails)
        for x in quality_ledger.ablation(q, version).collect():
            b = 1 << quality_ledger.BITS[x.rule]
            assert (x.n_failed, x.n_only, x.n_dropped) == (sum(bool(f & b) for f in fails), sum(f & m == b for f in fails), sum(bool(f & m) for f in fails))


def test_shards_hold_every_row_once_in_equal_numbers(spark, docs, rows, no_docs, tmp_path):
    odd = docs.withColumn("k", F.lit(1)).withColumn("bucket", F.lit("x"))
    got = shuffle_shards.shard_rows(odd, 16, bucket_bytes=50_000, folder=f"file://{tmp_path}/s")
    again = shuffle_shards.shard_rows(odd.repartition(5), 16, bucket_bytes=50_000, folder=f"file://{tmp_path}/r")
    assert got.columns == [*odd.columns, "slot", "shard"]
    found = got.collect()
    assert bag((x.doc_id, x.text) for x in found) == bag((r.doc_id, r.text) for r in rows)
    by = defaultdict(list)
    for x in found:
        by[x.shard].append(x.slot)
    assert set(by) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert bag((x.doc_id, x.text, x.shard, x.slot) for x in found) == bag((x.doc_id, x.text, x.shard, x.slot) for x in again.collect())
    order = [x.doc_id for x in sorted(found, key=lambda x: (x.shard, x.slot)) if x.doc_id is not None and x.doc_id < 900_000]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.25
    assert shuffle_shards.shard_rows(no_docs, 4, folder=f"file://{tmp_path}/e").count() == 0
    few = shuffle_shards.shard_rows(docs.limit(3), 16, folder=f"file://{tmp_path}/f").collect()
    assert sorted((x.shard, x.slot) for x in few) == [(0, 0), (1, 0), (2, 0)]


def test_added_tokens_have_their_own_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    from codeloom.llm.bytebpe import ByteBpe

    library, end = Tokenizer.from_file(BYTE_BPE), "<|endoftext|>"
    texts = [f"a{end}b", end, end * 3, f"  {end}  x", f"it's{end}'s \n {end}\n", f"日本{end}語 {end[:-1]}", "a<|endof", "text|>b", f"<|{end}|>", f"plain  {end}s", "", "no token"]
    ids, bounds = ByteBpe(BYTE_BPE).encode_step(np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t.encode()) for t in texts])))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == want and want[0] == [64, 50256, 65]
    rng = np.random.default_rng(5)
    parts = [end, end[:4], end[4:], " ", "\n", "'s", "'", "ab", "é", "7", "!"]
    texts = ["".join(rng.choice(parts, 12)) + "." for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: library.encode(t, add_special_tokens=False) for i, t in enumerate(texts)}
    got = {r.doc_id: r.ids_crc32 for r in arrow_tokens.read_tokens(spark, arrow_tokens.write_tokens(docs, BYTE_BPE, f"file://{tmp_path}/t")).collect()}
    assert got == {i: crc([*e.ids, 2]) for i, e in want.items()}
    assert {r.doc_id: r.doc_tokens for r in packing.pack(docs, BYTE_BPE, end_id=1).collect()} == {i: len(e.ids) + 1 for i, e in want.items()}
    total = {r.doc_id: r.n for r in token_attribution.attribute_tokens(docs, BYTE_BPE, "first").groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert total == {i: len(e.ids) for i, e in want.items()}


def _alone(bpe, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return bpe.encode_step(data, np.array([0, len(data)]))[0].tolist()


def test_documents_alone_are_encoded_as_by_the_library(bpe):
    from codeloom.llm.bytebpe import ByteBpe

    own, rng = ByteBpe(BYTE_BPE), np.random.default_rng(1)
    bits = ["'s", "'t", "'d", "'m", "'re", "'ve", "'ll", "'", " ", "  ", "\n", "\t", "ab", "é", "日本", "7", "!", "<|endoftext|>", "<|", "\u00a0", "\u3000", "S", "ſ", "😀", "½", "_"]
    texts = [f"this is the cat{x}" for x in bits] + ["".join(rng.choice(bits, rng.integers(0, 9))) for _ in range(5000)]
    for text, e in zip(texts, bpe.encode_batch(texts, add_special_tokens=False), strict=True):
        assert _alone(own, text) == e.ids, text


def test_words_built_to_collide_in_polynomial_hashes_differ(bpe):
    from codeloom.llm.bytebpe import ByteBpe
    from codeloom.llm.textkernel import word_hashes

    for n in (1024, 2048, 4096):
        one = "".join("ab"[i.bit_count() & 1] for i in range(n))
        text = one + "\n" + one.translate(str.maketrans("ab", "ba"))
        assert _alone(ByteBpe(BYTE_BPE), text) == bpe.encode(text, add_special_tokens=False).ids
        a, b = word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
        assert a != b


def test_very_long_texts_are_taken_in_parts(bpe, monkeypatch):
    from codeloom.llm import bytebpe, textkernel

    rng, own = np.random.default_rng(2), bytebpe.ByteBpe(BYTE_BPE)
    bits = ["'s", " ", "\n", "  ", "ab", "é", "日本", "7", "!", "<|endoftext|>", " word", " the", "\t", "\u00a0"]
    texts = ["".join(rng.choice(bits, 150)) for _ in range(200)] + ["x" * 500, " " * 500, "日" * 300]
    whole = [textkernel.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist() for t in texts]
    cut = textkernel.parts
    for module in (bytebpe, textkernel):
        monkeypatch.setattr(module, "PART_BYTES", 64)
        monkeypatch.setattr(module, "parts", lambda data: cut(data, 64))
    for text, want in zip(texts, whole, strict=True):
        assert _alone(own, text) == bpe.encode(text, add_special_tokens=False).ids
        assert textkernel.word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0].tolist() == want


def test_many_rows_of_one_id_fill_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(2000)] + [(None, "x"), (3, "y")], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = arrow_tokens.write_tokens(docs, BYTE_BPE, f"file://{tmp_path}/h")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 2 and manifest.agg(F.max("n_docs")).first()[0] < 1500
    got = sorted(arrow_tokens.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 3] + [7] * 2000


def test_a_piece_goes_where_it_fits_whole():
    rng = np.random.default_rng(8)
    for _ in range(30):
        lengths = rng.integers(1, 90, 200)
        pieces, many = packing.assign(lengths, 100)
        free, cost = np.full(many, 100), np.zeros(many)
        for d, start, n, b, at in pieces.tolist():
            left = lengths[d] - start
            room = [(cost[k], k) for k in range(many) if free[k] >= left]
            assert (cost[b], b) == (min(room) if room else min((cost[k], k) for k in range(many) if free[k]))
            assert at == 100 - free[b] and n == min(left, free[b])
            free[b] -= n
            cost[b] += n + n * n / 1024


def test_very_many_equal_rows_spread_over_buckets(spark, tmp_path):
    rows = [(1, "same")] * 3000 + [(None, None)] * 2000 + [(i, f"text {i}") for i in range(2, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shuffle_shards.shard_rows(docs, 4, bucket_bytes=20_000, folder=f"file://{tmp_path}/q", equal_rows=100).collect()
    assert bag((x.doc_id, x.text) for x in got) == bag(rows)
    by = defaultdict(list)
    for x in got:
        by[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = [x.doc_id for x in sorted(got, key=lambda x: (x.shard, x.slot))]
    longest = max(len(list(g)) for k, g in __import__("itertools").groupby(order) if k == 1)
    assert longest < 200  # equal rows don't stand together


def test_shards_do_not_depend_on_how_rows_come_unless_very_many_are_equal(spark, docs, tmp_path):
    a = shuffle_shards.shard_rows(docs, 4, folder=f"file://{tmp_path}/a")
    assert a.exceptAll(shuffle_shards.shard_rows(docs.repartition(7), 4, folder=f"file://{tmp_path}/b")).count() == 0


def test_spans_are_null_where_ids_do_not_tell_them():
    m = object.__new__(sentencepiece_offsets.Model)
    m.map, m.prefix, m.squeeze, m.escape, m.unknown, m.lengths = None, False, False, False, 0, np.array([0, 1])
    assert m.spans(b"abc", np.array([0, 1, 0])) is None
    lo, hi = m.spans(b"abc", np.array([0, 1]))
    assert lo.tolist() == [0, 2] and hi.tolist() == [2, 3]
