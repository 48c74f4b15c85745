"""Near-duplicate documents by HyperMinHash.

Each text's set of word shingles is hashed once. The leading bits choose one of 128 buckets; a bucket keeps its smallest
hash as the number of leading zeros and ten mantissa bits (16 bits in all). Bands of four registers give candidate
buckets, the share of equal registers, corrected for chance collisions, estimates the Jaccard similarity, and links are
confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm import bytehash as bh
from answerlens.llm.components import components, spanning
from answerlens.llm.scratch import Scratch

REGISTERS, ROWS, MANTISSA = 128, 4, 10
#: Chance that the registers of two different smallest hashes are equal, for sets of like size.
COLLISION = 0.169919487 * 2.0**-MANTISSA
#: Standard errors by which an estimate may fall short of the threshold before a candidate is dropped.
SLACK = 6.0
#: Members of one block when a bucket is compared all against all.
BLOCK = 512

# For each register, the order in which an empty one looks for a full one.
_PROBE = np.stack([np.random.default_rng(1000 + i).permutation(REGISTERS) for i in range(REGISTERS)])


def registers(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One row of 128 registers per set; each set's hashes are sorted and unique. Empty sets give zeros."""
    n = len(begin) - 1
    row = np.repeat(np.arange(n), np.diff(begin))
    slot = row * REGISTERS + (hashes >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(slot), dtype=bool)
    first[1:] = slot[1:] != slot[:-1]
    rest = ((hashes[first] & np.uint64((1 << 57) - 1)) >> np.uint64(4)).astype(np.float64)
    fraction, exponent = np.frexp(np.maximum(rest, 1))
    zeros = 53 - exponent
    value = (zeros << MANTISSA) | ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    out = np.zeros(n * REGISTERS, dtype=np.uint16)
    full = np.zeros(n * REGISTERS, dtype=bool)
    out[slot[first]], full[slot[first]] = value, True
    out, full = out.reshape(n, REGISTERS), full.reshape(n, REGISTERS)
    some = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    for part in np.array_split(some, len(some) // 256 + 1):
        if len(part):
            take = np.argmax(full[part][:, _PROBE], axis=2)
            donor = np.take_along_axis(np.broadcast_to(_PROBE, (len(part), *_PROBE.shape)), take[:, :, None], axis=2)[:, :, 0]
            out[part] = np.where(full[part], out[part], np.take_along_axis(out[part], donor, axis=1))
    return out


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, begin = bh.shingle_hashes(*bh.word_hashes(data, offsets), k)
    each = [np.unique(hashes[i:j]) for i, j in zip(begin[:-1], begin[1:], strict=True)]
    return np.concatenate([*each, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bh.text_bytes(batch.column(1))
            for i, j in bh.chunks(offsets):
                hashes, begin = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(bh.mix(hashes + np.uint64(s)))]) for s in (11, 29)]
                sums = [(s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums]
                sig = registers(hashes, begin).view(np.int64).reshape(-1)
                width = REGISTERS // ROWS
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) + 1, width, dtype=np.int32)), pa.array(sig))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(begin)), pa.array(sums[0]), pa.array(sums[1]), lists], ["id", "n", "f1", "f2", "sig"])

    return run


#: Bits of the set of ids that picks texts while they are scanned: 4 MB at most, whatever the number of ids; and the share of
#: its places that may be taken, beyond which it would pick too many other texts.
ID_BITS, ID_FILL = 25, 0.25


def _slots(ids: np.ndarray) -> np.ndarray:
    """A place among 2**ID_BITS for each id, evenly dealt whatever the ids look like."""
    return (bh.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - ID_BITS)).astype(np.int64)


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_slots(batch.column(0).to_numpy(zero_copy_only=False)))], ["at"])


def _id_bits(ids: DataFrame, bits: int) -> np.ndarray | None:
    """A bit per id's place, None where so many are taken that it says little; other ids may share a place."""
    at = ids.select("id").filter("id IS NOT NULL").mapInArrow(_slot_rows, "at long").select(F.shiftright("at", ID_BITS - bits).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 31 AS INT))")).alias("bits"))
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    found = words.toPandas()  # at most 2**20 rows of two numbers
    out[found["word"]] = found["bits"]
    return out if np.bitwise_count(out).sum() <= ID_FILL * (1 << bits) else None


def _set_rows(ids: pa.Array, texts: pa.Array, k: int) -> Iterator[pa.RecordBatch]:
    data, offsets = bh.text_bytes(texts)
    for i, j in bh.chunks(offsets):
        hashes, begin = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
        lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([ids[i:j], lists], ["id", "items"])


def _full_sets(k: int, held=None, bits: int = ID_BITS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held is not None:
                at = _slots(batch.column(0).fill_null(-1).to_numpy()) >> (ID_BITS - bits)
                seen = (held.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)
                batch = batch.filter(pa.array((seen == 1) & np.asarray(batch.column(0).is_valid())))
            yield from _set_rows(batch.column(0), batch.column(1), k)

    return run


def _sets_of(docs: DataFrame, ids: DataFrame, spark: SparkSession, scratch: Scratch, k: int, *, bits: int = ID_BITS) -> DataFrame:
    """(id, items): the full sets of the texts with these ids, and of no others.

    While the ids take up to a quarter of the bit set's places, texts are picked as they are scanned: at most a quarter of
    the others is picked too, and goes in a join before anything else. More ids are joined with the texts first, so
    that a set is only made of a text that is asked for, at any number of ids.
    """
    schema = "id long, items array<long>"
    picked = _id_bits(ids, bits)
    if picked is None:
        found = docs.join(ids.select("id"), "id", "left_semi").select("id", "text").mapInArrow(_full_sets(k), schema)
        return scratch.save(found.filter("size(items) > 0"), "sets")
    found = scratch.save(docs.mapInArrow(_full_sets(k, spark.sparkContext.broadcast(picked), bits), schema).filter("size(items) > 0"), "picked", scan=True)
    sets = scratch.save(found.join(ids, "id", "left_semi"), "sets")
    scratch.drop(found)
    return sets


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of register rows (uint16), less the registers expected to agree by chance."""
    same = (a == b).mean(axis=-1)
    return np.maximum(0.0, (same - COLLISION) / (1 - COLLISION))


def floor_of(n: np.ndarray, threshold: float) -> np.ndarray:
    """The least estimate that a pair at the threshold may have; n is the smaller set's size."""
    return threshold - SLACK * np.sqrt(threshold * (1 - threshold) * (1 / REGISTERS + 1 / np.maximum(n, 1)))


def _stack(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).view(np.uint16).reshape(len(column), REGISTERS)


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            near = estimate(_stack(x.column("sa")), _stack(x.column("sb"))) >= floor_of(x.column("n").to_numpy(), threshold)
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(near))

    return run


def _compare(threshold: float):
    """Of a block pair: connects rows of different components whose estimate is high enough."""

    def run(t: pa.Table) -> pa.Table:
        p, q, block = t.column("p")[0].as_py(), t.column("q")[0].as_py(), t.column("block").to_numpy()
        ids, comp, n, sig = t.column("id").to_numpy(), t.column("comp").to_numpy(), t.column("n").to_numpy(), _stack(t.column("sig"))
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        u, w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in left:
            other = right[(comp[right] != comp[i]) & ((p != q) | (ids[right] > ids[i]))]
            small, large = np.minimum(n[other], n[i]), np.maximum(n[other], n[i])
            other = other[(small >= threshold * large) & (estimate(sig[other], sig[i]) >= floor_of(small, threshold))]
            u.append(np.full(len(other), i))
            w.append(other)
        return _joined(ids, np.concatenate(u), np.concatenate(w))

    return run


def _joined(ids: np.ndarray, u: np.ndarray, w: np.ndarray) -> pa.Table:
    root = spanning(ids, u, w)
    own = root != ids
    return pa.table({"src": ids[own].astype(np.int64), "dst": root[own].astype(np.int64)})


def _confirm(threshold: float):
    """Of a block pair: connects what the full sets link. Counts come from a product over the shingles that repeat."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        p, q, block = t.column("p")[0].as_py(), t.column("q")[0].as_py(), t.column("block").to_numpy()
        ids, items = t.column("id").to_numpy(), t.column("items").combine_chunks()
        n = np.diff(np.asarray(items.offsets)).astype(np.int64)
        values, slot, times = np.unique(items.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), n)
        shared = times[slot] > 1
        number = np.cumsum(times > 1) - 1
        row, slot = row[shared], number[slot[shared]]
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        order = np.argsort(slot, kind="stable")
        row, slot = row[order], slot[order]
        for first in range(0, int((times > 1).sum()), 2048):
            i, j = np.searchsorted(slot, [first, first + 2048])
            x = np.zeros((len(ids), 2048), dtype=np.float32)
            x[row[i:j], slot[i:j] - first] = 1
            both += x[left] @ x[right].T
        linked = round(threshold * 100) * (n[left][:, None] + n[right][None, :] - both) <= 100 * both
        linked &= ids[left][:, None] < ids[right][None, :] if p == q else True
        r, c = np.nonzero(linked)
        return _joined(ids, left[r], right[c])

    return run


def _block_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``blocks``, dealt to pairs of blocks (p, q) of their group."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).groupBy(*keys, "p", "q")


def minhash_near_duplicates(documents: DataFrame, spark: SparkSession, *, threshold: float = 0.75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id, kept.

    Two texts are linked when their sets of ``shingle``-word shingles have a Jaccard similarity of ``threshold`` or more;
    component_id is the smallest doc_id that links reach and kept marks the row that carries it. Candidates come from
    32 bands of 4 registers: a pair at similarity 0.75 is missed with a chance below 1e-5, one at 0.85 below 1e-10;
    every reported link is exact.

    Copies with equal sets meet in an aggregate and go on as one row. Buckets first try each member against the
    bucket's smallest id. Rows of buckets that still hold several components are then compared by estimate and, where
    that is high enough, on their full sets, all against all in blocks of 512 rows; block pairs are tasks and return
    what they connect, so a group of copies never meets in one task and its pairs are never listed.

    Null or empty texts and texts without words have no shingles and link with nothing (their component is their own
    id); texts of fewer words than a shingle have one shingle of all their words. Rows that repeat a doc_id and
    its text get equal results; texts that share a doc_id are one document where it stands for their groups. A null
    doc_id joins the group of its own set, but is never the smallest id; alone it has a null component_id, and kept is
    false. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    feats = scratch.save(docs.mapInArrow(_features(shingle), "id long, n long, f1 long, f2 long, sig array<long>"), "features", scan=True)
    reps = feats.filter("n > 0 AND id IS NOT NULL").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.any_value("sig").alias("sig"))
    reps = scratch.save(reps, "texts")
    bands = reps.select("id", F.posexplode("sig").alias("band", "key"))
    buckets = scratch.save(bands.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = scratch.save(bands.join(buckets, ["band", "key"]), "members")

    first = members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    sides = reps.select("id", "n", "sig")
    first = first.join(sides.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a").join(sides.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")
    first = first.select("a", "b", "sa", "sb", F.least("na", "nb").alias("n")).mapInArrow(_likely(threshold), "a long, b long")
    candidates = scratch.save(first, "candidates")
    links = _verified(docs, candidates, spark, scratch, shingle, threshold)
    scratch.drop(candidates, buckets)
    # the smallest id linked, and what that is linked to: rows of one label are connected, rows of two may be
    label = scratch.save(links.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("label")), "labels")
    label = label.join(label.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", "left").select("id", F.coalesce("next", "label").alias("comp"))

    others = members.filter("id <> hub AND size > 2").join(scratch.save(label, "labels"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    others = scratch.save(others.select("band", "key", "id", "comp"), "others")
    scratch.drop(members)
    mixed = others.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
    mixed = scratch.save(mixed.select("band", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "mixed")
    rows = others.join(mixed, ["band", "key"]).join(sides, "id")
    likely = scratch.save(_block_pairs(rows, ["band", "key"]).applyInArrow(_compare(threshold), "src long, dst long").distinct(), "likely")
    scratch.drop(others, mixed)
    groups = components(likely, scratch)
    sizes = scratch.save(groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    sets = _sets_of(docs, groups.select(F.col("node").alias("id")), spark, scratch, shingle)
    rows = groups.join(sizes, "component").withColumnRenamed("node", "id").join(sets, "id")
    second = scratch.save(_block_pairs(rows, ["component"]).applyInArrow(_confirm(threshold), "src long, dst long").distinct(), "second")
    scratch.drop(sets)
    comps = components(links.unionByName(second), scratch)

    rep = reps.select("f1", "f2", F.col("id").alias("rep")).join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    rep = scratch.save(rep.select("f1", "f2", F.coalesce("component", "rep").alias("component")), "groups")
    scratch.keep(feats, rep)
    found = feats.filter("n > 0").join(rep, ["f1", "f2"], "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    out = found.unionByName(feats.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def _verified(docs: DataFrame, pairs: DataFrame, spark: SparkSession, scratch: Scratch, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as (src, dst)."""
    sets = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), spark, scratch, shingle)
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("xb")), "b")
    both = F.size(F.array_intersect("xa", "xb")).cast("long")
    x = x.select("a", "b", both.alias("both"), (F.size("xa") + F.size("xb")).cast("long").alias("all"))
    hundredths = round(threshold * 100)
    links = scratch.save(x.filter(f"100 * both >= {hundredths} * (all - both)").select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    scratch.drop(sets)
    return links


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark)
