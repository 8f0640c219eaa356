import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import language_id, toxicity
from codeloom.llm.queries import PIECE_BPE, fold

SF = "/root/testdata/sf0.01"


def test_forward_pass_sums_all_segmentations():
    pieces = language_id.Pieces(PIECE_BPE)
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(pieces.size), 3).T
    table = dict(zip(pieces.hashes.tolist(), range(len(pieces.hashes)), strict=True))

    def number(s):
        from codeloom.llm.textkernel import PrefixHash

        chars = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        return table.get(int(PrefixHash(pieces.codes[chars]).of(np.array([0]), np.array([len(chars)]))[0]), pieces.size - 1 if len(s) == 1 else None)

    def total(s, lang):
        return 1.0 if not s else sum(p[k, lang] * total(s[n:], lang) for n in range(1, len(s) + 1) if (k := number(s[:n])) is not None)

    words = ["the", "étions", "x日", "", "straße"]
    got = language_id.forward(pieces, words, p)
    for w, row in zip(words, got, strict=True):
        for lang in range(3):
            assert row[lang] == pytest.approx(np.log(total("▁" + w, lang)))


def test_long_words_are_read_whole():
    pieces = language_id.Pieces(PIECE_BPE)
    p = np.full((pieces.size, 1), 1 / pieces.size)
    a, b = language_id.forward(pieces, ["ab" * 500, "ab" * 400], p)[:, 0]
    assert np.isfinite([a, b]).all() and a < b


def _pieces_at(pieces, word):
    """For each end position of the marked word (piece length, piece)."""
    from codeloom.llm.textkernel import PrefixHash

    x = "▁" + word
    table = dict(zip(pieces.hashes.tolist(), range(len(pieces.hashes)), strict=True))
    h = PrefixHash(pieces.codes[np.frombuffer(x.encode("utf-32-le"), np.uint32)])
    one = lambda i, k: table.get(int(h.of(np.array([i - k]), np.array([i]))[0]), pieces.size - 1 if k == 1 else None)
    return [[(k, q) for k in range(1, min(i, pieces.longest) + 1) if (q := one(i, k)) is not None] for i in range(len(x) + 1)]


def _long_words():
    words = ["straightforwardrepresentations" * 3, "中文没有空格的句子很长" * 9, "recommendations" * 40, "addeventlistener" * 2, "the", "e" * 31, "e" * 32, "e" * 63, "e" * 64, "ab" * 2000]
    return words + ["x" * n + "characteristics" * 2 for n in range(9, 25)]


def test_long_words_sum_all_segmentations_across_positions_of_rescaling():
    pieces = language_id.Pieces(PIECE_BPE)
    p = np.random.default_rng(3).dirichlet(np.ones(pieces.size), 2).T
    words = _long_words()
    for word, row in zip(words, language_id.forward(pieces, words, p), strict=True):
        for lang in range(2):
            log = [0.0]
            for here in _pieces_at(pieces, word)[1:]:
                log.append(np.logaddexp.reduce([log[len(log) - k] + np.log(p[q, lang]) for k, q in here]))
            assert row[lang] == pytest.approx(log[-1], rel=1e-9)


def test_training_counts_pieces_across_positions_of_rescaling():
    pieces = language_id.Pieces(PIECE_BPE)
    words = _long_words()
    counts = np.random.default_rng(4).integers(1, 5, (len(words), 2)).astype(float)
    p = np.full((pieces.size, 2), 1 / pieces.size)
    for _ in range(2):
        used = np.full(p.shape, 0.01)
        for word, many in zip(words, counts, strict=True):
            at = _pieces_at(pieces, word)
            for c in range(2):
                log, back = [0.0], [-np.inf] * (len(at) - 1) + [0.0]
                for here in at[1:]:
                    log.append(np.logaddexp.reduce([log[len(log) - k] + np.log(p[q, c]) for k, q in here]))
                for i in range(len(at) - 1, 0, -1):
                    for k, q in at[i]:
                        flow = back[i] + np.log(p[q, c])
                        back[i - k] = np.logaddexp(back[i - k], flow)
                        used[q, c] += many[c] * np.exp(flow + log[i - k] - log[-1])
        p = used / used.sum(0)
    assert language_id.expectation_maximisation(pieces, words, counts, rounds=2) == pytest.approx(p, rel=1e-6)


def test_language_held_out_accuracy_and_odd_rows(spark, docs, rows, no_docs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    langs, p = language_id.train(language_id.sample(d, fold(4) != 2), PIECE_BPE)
    assert langs == ["de", "en", "es", "fr"]
    held = {r.doc_id: r.lang for r in d.where(fold(4) == 2).collect()}
    got = {r.doc_id: r for r in language_id.predict(d, langs, p, PIECE_BPE).collect()}
    assert len(got) == d.count() and np.mean([got[i].lang_pred == v for i, v in held.items()]) > 0.96
    clash = docs.withColumns({"lang_pred": F.lit("x"), "Score": F.lit(1), "__text": F.lit(2)}).drop("__text")
    odd = language_id.predict(clash, langs, p, PIECE_BPE, keep_columns=True)
    assert odd.columns == [*docs.columns, "lang_pred", "score"]
    for r in odd.collect():
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1 and (lettered or r.score == 0)
    assert language_id.predict(no_docs, langs, p, PIECE_BPE).count() == 0
    assert language_id.sample(no_docs, F.lit(True)) == []
    none = language_id.predict(docs, *language_id.train([], PIECE_BPE), PIECE_BPE)
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_toxicity_held_out_and_unseen_spellings(spark, docs, no_docs):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = toxicity.sample(d, labels, fold(5) != 0)
    number, bias = toxicity.train(train)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in [r.doc_id for r in labels.where(fold(5) == 0).collect()])
    got = {r.doc_id: r.score for r in toxicity.score(d.where(fold(5) == 0), number, bias).collect()}
    y, z = (np.array(x) for x in zip(*((truth[i], s >= 0.5) for i, s in got.items() if i in truth), strict=True))
    assert (y == z).mean() > 0.95 and z[y == 1].mean() > 0.75
    plain, misspelt = "the and of is on " * 6, "the and of is on " * 6 + "idiiot stupidd clownn loserr worthlesss"
    few = spark.createDataFrame([(1, plain), (2, misspelt)], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(few, number, bias).collect()}
    assert s[2] > s[1] and s[2] > 0.5
    odd = toxicity.score(docs.withColumn("SCORE", F.lit("x")), number, bias, keep_columns=True)
    assert odd.columns == [*docs.columns, "score"]
    base = 1 / (1 + np.exp(-bias))
    for r in odd.collect():
        assert 0 <= r.score <= 1 and (r.text not in (None, "") or r.score == pytest.approx(base))
    assert toxicity.score(no_docs, number, bias).count() == 0
    assert toxicity.sample(docs, labels.limit(0), F.lit(True)) == []
    assert toxicity.train([])[1] < 0


def test_samples_take_one_row_of_an_id_and_bounded_bytes(spark):
    rows = [(i, f"text {i} " * 20, "en" if i % 2 else "fr") for i in range(30)] + [(3, "another text of three", "en")] * 500
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 0)] * 50, "doc_id long, toxic int")
    got = toxicity.sample(d, labels, F.lit(True))
    assert len(got) == 30 and sum(y for _, y in got) == 15
    few = toxicity.sample(d, labels, F.lit(True), most_bytes=1000)
    assert 0 < len(few) < 30 and sum(len(t) for t, _ in few) <= 1000 and set(few) <= set(got)
    got = language_id.sample(d, F.lit(True))
    assert sorted(y for _, y in got) == ["en"] * 15 + ["fr"] * 15
    few = language_id.sample(d, F.lit(True), most_bytes=1000)
    assert all(sum(len(t) for t, y in few if y == x) <= 1000 for x in ("en", "fr")) and {y for _, y in few} == {"en", "fr"}


def test_many_languages_are_taken_in_blocks(monkeypatch):
    pieces, rng = language_id.Pieces(PIECE_BPE), np.random.default_rng(1)
    words = [w for w in _long_words() if len(w) < 200] + ["house", "maison", "casa"]
    counts = rng.integers(0, 4, (len(words), 5)).astype(float)
    whole = language_id.expectation_maximisation(pieces, words, counts)
    table = language_id.forward(pieces, words, whole)
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    monkeypatch.setattr(language_id, "SHORT_WORDS", 3)
    assert language_id.expectation_maximisation(pieces, words, counts) == pytest.approx(whole)
    assert language_id.forward(pieces, words, whole) == pytest.approx(table)


def test_toxicity_scores_are_means_of_subwords(spark):
    """Every score against words and n-grams taken one by one from the text."""
    import re

    from codeloom.llm.textkernel import BYTE_CODE, PrefixHash

    number, bias = np.random.default_rng(2).standard_normal(toxicity.BUCKETS).astype(np.float32), 0.25
    texts = ["The the, cat-sat don't ÉTÉ x", "", None, "1234 !?", "a" * 300 + " bb", "日本 stupid stupidd"]

    def bucket(x):
        return int(PrefixHash(BYTE_CODE[np.frombuffer(x, np.uint8)]).of(np.array([0]), np.array([len(x)]))[0] & np.uint64(toxicity.BUCKETS - 1))

    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), number, bias).collect()}
    for i, t in enumerate(texts):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
        all_of = []
        for w in re.findall(rb"[a-z\x80-\xff]+", low):
            x = b"<" + w + b">"
            all_of += [x] + [x[k : k + n] for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1) for k in range(len(x) - n + 1)]
        logit = toxicity.SCALE * sum(float(number[bucket(x)]) for x in all_of) / (len(all_of) + toxicity.BLANKS) + bias
        assert got[i] == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-9)


def test_training_lowers_the_loss_of_its_rows():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    rows = [(" ".join(rng.choice(words[:280], 30)) + (" " + " ".join(rng.choice(words[280:], 3)) if y else ""), y) for y in [0, 1] * 150]
    number, bias = toxicity.train(rows, updates=300)

    def loss(n, b):
        out = 0
        for t, y in rows:
            found, many, total = toxicity.bag(t)
            logit = toxicity.SCALE * float((n[found] * many).sum()) / (total + toxicity.BLANKS) + b
            out += np.logaddexp(0, -logit if y else logit)
        return out / len(rows)

    assert loss(number, bias) < 0.2 < loss(np.zeros_like(number), 0.0)
    assert toxicity.bag("ab " * 70_000)[1].max() == 140_000  # the word itself is one of its n-grams
