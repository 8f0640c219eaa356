"""Near-duplicates by SuperMinHash, banding, exact verification and union-find.

SuperMinHash gives each shingle the ranks of a random permutation of the signature's
slots, one after another; in a slot the smallest (rank, fraction) wins.  A document is
done as soon as no later rank can win a slot.  Signatures have a lower variance than
those of independent hashes.

Documents with equal shingle sets are one class from the start.  Classes that agree in
a band share a bucket, and each is compared with the bucket's smallest class: as many
pairs as members.  Where a bucket then still holds several components, its members are
compared across them inside blocks of bounded size, so that no link is lost.  Pairs
whose signatures allow the similarity are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import give_back, release, remove, shared_dir, small_batches, text_steps, written
from codeloom.llm.components import components
from codeloom.llm.textkernel import mix64, shingle_sets, word_hashes

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """Links: documents whose sets of ``words``-word shingles have 100 * intersection >= percent * union.

    With 40 bands of 5 slots a pair at 0.8 shares no band once in 7 million.  ``slack``:
    an estimate this far below the bound (5.5 standard deviations at 200 slots) rules a
    pair out.  ``block``: the most members of a side that are compared at once.
    """

    words: int = 4
    percent: int = 80
    bands: int = 40
    band_rows: int = 5
    slack: float = 0.16
    block: int = 512

    @property
    def slots(self) -> int:
        return self.bands * self.band_rows


def superminhash(elements: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (documents by slots) of sets of hashed elements; all ones for empty sets."""
    docs = len(bounds) - 1
    out = np.full((docs, slots), np.iinfo(np.uint64).max, _U)
    if not len(elements):
        return out
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    own = mix64(elements ^ _U(0xA0761D6478BD642F))
    live, order = np.arange(len(elements)), None
    low = _U(0xFFFFFFFF)
    for j in range(slots):
        draw = mix64(own[live] + _U((j * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF))
        at = j + (((draw >> _U(32)) * _U(slots - j)) >> _U(32)).astype(np.int64)
        value = (draw & low) | _U(j << 32)
        if order is None:
            slot = at
        else:
            row = place[live]
            slot = order[row, at].astype(np.int64)
            order[row, at] = order[row, j]
        np.minimum.at(flat, doc[live] * slots + slot, value)
        full = out.max(1) < _U((j + 1) << 32)
        more = ~full[doc[live]]
        if order is None and more.any():  # only now the permutations must be kept
            kept, first = live[more], at[more]
            place = np.zeros(len(elements), np.int64)
            place[kept] = np.arange(len(kept))
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(kept), 1))
            order[np.arange(len(kept)), first] = 0
        live = live[more]
        if not len(live):
            break
    return out


def _binary(block: np.ndarray) -> pa.Array:
    """Rows of a two-dimensional array as binary values."""
    block = np.ascontiguousarray(block)
    n, width = len(block), block.shape[1] * block.itemsize
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(block)])


def _matrix(col: pa.Array, slots: int) -> np.ndarray:
    if not len(col):
        return np.zeros((0, slots), np.uint16)
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint16, (offsets[-1] - offsets[0]) // 2, offsets[0]).reshape(len(col), slots)


def sketch(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (a 128-bit fingerprint of the set) and sig (16 bits a slot; null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i, j, data, offsets in text_steps(batch.column(1)):
                sets, bounds = shingle_sets(*word_hashes(data, offsets), s.words)
                n = np.diff(bounds)
                prints = []
                for c in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
                    sums = np.zeros(len(sets) + 1, _U)
                    np.cumsum(mix64(sets ^ _U(c)), out=sums[1:])
                    prints.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
                sig = mix64(superminhash(sets, bounds, s.slots)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].cast(pa.int64()), pa.array(n), *map(pa.array, prints), _binary(sig)], ["doc_id", "n_shingles", "f1", "f2", "sig"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def set_table(docs: DataFrame, ids: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """id and its whole set (sorted 64-bit hashes) for the ids asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_steps(batch.column(1)):
                sets, bounds = shingle_sets(*word_hashes(data, offsets), s.words)
                raw = [sets[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].cast(pa.int64()), pa.array(raw, pa.binary())], ["id", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(ids.hint("shuffle_hash"), "id", "left_semi").mapInArrow(run, "id long, shingles binary")


def _estimated(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """The pairs a, b whose sizes and signatures allow a link."""
    side = lambda k: nodes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"sig{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * s.percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_matrix(batch.column(2), s.slots) == _matrix(batch.column(3), s.slots)).mean(1)
            keep = pa.array(same >= s.percent / 100 - s.slack)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    return both.select("a", "b", "siga", "sigb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs that are links, by their full sets."""
    side = lambda k: sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= s.percent * (len(both) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _across(left: dict, right: dict, band: int, s: Settings) -> list[tuple[int, int]]:
    """Links of a block between different components, as few as join all that its links join.

    A pair is looked at in the first band it shares; signatures and sizes rule most out,
    the others are compared on their full sets, unless links found before join them.
    """
    names, back = np.unique(np.concatenate([left["c"], right["c"]]), return_inverse=True)
    home = np.arange(len(names))
    lc, rc = back[: len(left["c"])], back[len(left["c"]) :]
    out = []
    rights = [np.frombuffer(x, np.uint32) for x in right["shingles"]]
    for k in range(0, len(left["id"]), 16):
        same = left["sig"][k : k + 16, None, :] == right["sig"][None, :, :]
        good = (same.mean(2) >= s.percent / 100 - s.slack) & (lc[k : k + 16, None] != rc[None, :])
        good &= ~(right["minor"][None, :] & (left["id"][k : k + 16, None] > right["id"][None, :]))  # two of the left side meet twice
        small, large = np.minimum(left["n"][k : k + 16, None], right["n"][None, :]), np.maximum(left["n"][k : k + 16, None], right["n"][None, :])
        good &= small * 100 >= large * s.percent
        x, y = np.nonzero(good)
        good[x, y] = same[x, y].reshape(len(x), s.bands, s.band_rows).all(2).argmax(1) == band
        for x in np.flatnonzero(good.any(1)):
            own = np.frombuffer(left["shingles"][k + x], np.uint32)
            ys = np.flatnonzero(good[x] & (home[lc[k + x]] != home[rc]))
            for part in np.array_split(ys, -(-len(ys) // 256) or 1):
                part = part[home[lc[k + x]] != home[rc[part]]]
                if not len(part):
                    continue
                n = right["n"][part]
                flat = np.concatenate([rights[j] for j in part])
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                common = np.add.reduceat(hit, np.cumsum(n) - n)
                for j in part[100 * common >= s.percent * (len(own) + n - common)]:
                    if home[lc[k + x]] != home[rc[j]]:
                        out.append((int(left["id"][k + x]), int(right["id"][j])))
                        home[home == home[rc[j]]] = home[lc[k + x]]
    return out


def _rest(members: DataFrame, nodes: DataFrame, sets: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) across the components of buckets of three and more that hold several.

    ``members`` has key, band, id, hub and many (members of the bucket).  Those outside the component of the bucket's smallest
    member (the minor ones) form blocks against blocks of all members.  Sets travel as the
    upper halves of their hashes; what is found is confirmed on the whole ones after.
    """
    c = found.select("id", F.col("component").alias("c"))
    r = members.where("many > 2").join(c, "id", "left").withColumn("c", F.coalesce("c", "id"))
    r = r.join(c.select(F.col("id").alias("hub"), F.col("c").alias("hc")), "hub", "left").withColumn("minor", F.col("c") != F.coalesce("hc", "hub"))
    # members of a large bucket go to several tasks, each with its own copy of the bucket's one row
    salts = F.ceil(F.col("many") / s.block).cast("int")
    minors = r.where("minor").groupBy("key", "many").agg(F.ceil(F.count("*") / s.block).cast("int").alias("mb"))
    minors = minors.select("key", "mb", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    r = r.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).join(minors, ["key", "salt"]).withColumn("ab", salts)
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = r.where("minor").select("key", "band", "id", "c", "minor", F.lit(True).alias("left"), block("mb").alias("i"), F.explode(span("ab")).alias("j"))
    theirs = r.select("key", "band", "id", "c", "minor", F.lit(False).alias("left"), F.explode(span("mb")).alias("i"), block("ab").alias("j"))

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = [(np.frombuffer(x.as_buffer(), _U) >> _U(32)).astype(np.uint32).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(half, pa.binary()), batch.column(3)], ["id", "n", "shingles", "sig"])

    asked = r.select("id").distinct()
    full = nodes.join(asked, "id", "left_semi").join(sets, "id").select("id", "n", "shingles", "sig").mapInArrow(halve, "id long, n long, shingles binary, sig binary")
    rows = mine.union(theirs).join(full, "id").select("key", "i", "j", "left", "id", "c", "minor", "n", "band", "sig", "shingles")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None

        def solve() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            flag = t["left"].to_numpy(zero_copy_only=False)
            cols = {k: t[k].to_numpy(zero_copy_only=False) for k in ("id", "c", "minor", "n", "shingles")} | {"sig": _matrix(t["sig"].chunk(0), s.slots)}
            pick = lambda f: {k: v[f] for k, v in cols.items()}
            if pairs := _across(pick(flag), pick(~flag), t["band"][0].as_py(), s):
                a, b = np.array(pairs, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(k).to_numpy().astype(np.int64) for k in (0, 1, 2)])
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                if held and tuple(keys[a]) != name:
                    yield from solve()
                    held = []
                name = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve()

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  A document with fewer words
    than a shingle has its whole sequence as the one shingle.  Documents without words or
    text have the empty set and are linked with nothing.  component_id is the smallest
    id reachable by links; kept tells that it is the row's own.  Rows of one id count as
    one document; rows with a null id take no part (component null, kept).  Only text and
    id are read, an empty table gives no rows.
    """
    spark, s = docs.sparkSession, settings
    small_batches(spark)
    folder = shared_dir(spark)
    sketched = written(sketch(docs, s, id_col, text_col), f"{folder}/sketch")
    some = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = written(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), f"{folder}/classes")

    nodes = some.join(classes.select(F.col("rep").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi")
    nodes = written(nodes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig"), f"{folder}/nodes")
    width = 2 * s.band_rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(s.bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * width + 1, F.lit(width))))
    banded = nodes.select("id", F.posexplode(keys).alias("band", "key"))
    hubs = banded.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count("*").alias("many")).where("hub < top").select("key", "hub", "many")
    members = written(banded.join(hubs, "key").select("key", "band", "id", "hub", "many"), f"{folder}/members")

    sets = written(set_table(docs, members.select("id").distinct(), s, id_col, text_col), f"{folder}/sets")
    pairs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    likely = written(_estimated(pairs, nodes, s), f"{folder}/pairs")
    links = written(_confirmed(likely, sets, s), f"{folder}/links")
    found = components(links, f"{folder}/first")
    more = written(_rest(members, nodes, sets, found, s), f"{folder}/rest")
    more = written(_confirmed(more, sets, s), f"{folder}/more")
    if not more.isEmpty():
        found = components(links.union(more), f"{folder}/second")
    for name in ("nodes", "members", "sets", "pairs", "links", "rest", "more"):
        remove(spark, f"{folder}/{name}")

    twins = classes.where("copies > 1").select("f1", "f2", "rep")
    rows = sketched.select("doc_id", "n_shingles", "f1", "f2").join(twins, ["f1", "f2"], "left")
    rep = F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), rep).alias("rep"))
    rows = rows.join(found, F.col("rep") == F.col("id"), "left")
    component = F.coalesce("component", "rep")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
