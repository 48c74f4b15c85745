"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside cells.

The number of cells follows the root of the largest label at every size (two at least). A vector is compared in its home cell, and is a guest in every cell where a vector within the angle could live: y is at
home in cell d, not in cell c, only if y.(d - c) >= 0, and |x - y| is at most delta for linked unit vectors, so x is a
guest of d unless x.(c - d) > delta * |c - d|. That makes the cells exact, whatever the centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlens.llm.components import components, spanning
from answerlens.llm.scratch import Scratch

#: Vectors that k-means is fitted on (those with the smallest hash), the root's share that gives the number of cells, block
#: size.
SAMPLE, ROOT_SHARE, BLOCK = 16_384, 8, 2048
#: Numbers of a product that is held at once.
HELD = 1 << 22


def _unit(rows: list) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Arrow lists of one length as a matrix, without Python numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def cell_count(n: int, sample: int = SAMPLE) -> int:
    """Cells for labels of up to n distinct vectors: an eighth of the root, from 2 to a quarter of the sample."""
    return max(2, min(sample // 4, round(n**0.5 / ROOT_SHARE)))


def _steps(n: int, width: int) -> Iterator[slice]:
    """Ranges of n rows so that a product with ``width`` columns stays within HELD numbers."""
    size = max(1, HELD // max(1, width))
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def fit_cells(sample: np.ndarray, cells: int, steps: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means."""
    rng = np.random.default_rng(5)
    centre = sample[rng.choice(len(sample), size=min(cells, len(sample)), replace=False)]
    for _ in range(steps):
        home = np.concatenate([np.argmax(sample[k] @ centre.T, axis=1) for k in _steps(len(sample), len(centre))])
        sums = np.zeros_like(centre)
        np.add.at(sums, home, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        centre = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centre)
    return centre


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1])))) if x.shape[1] < width else x


def _cells(held, delta: float):
    """Rows (cell, home) of each vector: its own cell and those where it is a guest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            at, cell, home = [], [], []
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                width = max(int(dim), centres.shape[1])
                c = _padded(centres, width)
                apart = np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T)))
                every = _padded(_unit(_rows(batch.column("v").take(pa.array(rows)), int(dim))), width)
                for k in _steps(len(rows), len(c)):
                    near = every[k] @ c.T
                    own, each = np.argmax(near, axis=1), np.arange(len(near))
                    far = near[each, own][:, None] - near > (delta + 1e-7) * apart[own] + 1e-9
                    far[each, own] = False
                    r, d = np.nonzero(~far)
                    at.append(rows[k][r])
                    cell.append(d)
                    home.append(own[r] == d)
            at = pa.array(np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("id", "label", "dim", "copies", "v")], pa.array(np.concatenate([*cell, np.zeros(0, np.int64)]).astype(np.int32)), pa.array(np.concatenate([*home, np.zeros(0, bool)]).astype(bool))], ["id", "label", "dim", "copies", "v", "cell", "home"])

    return run


def _block_pair(threshold: float):
    """Of the home vectors of one block against another block: links, and edges that connect what is linked."""

    def run(t: pa.Table) -> pa.Table:
        part, copies, ids = t.column("part").to_numpy(), t.column("copies").to_numpy(), t.column("id").to_numpy()
        mine, other = np.flatnonzero(part != 1), np.flatnonzero(part != 0)
        x = _unit(_rows(t.column("v"), t.column("dim")[0].as_py()))
        linked = x[mine] @ x[other].T >= threshold
        linked[ids[mine][:, None] == ids[other][None, :]] = False
        links = linked @ copies[other].astype(np.int64)
        r, c = np.nonzero(linked)
        root = spanning(ids, mine[r], other[c])
        to = root[mine]
        out = pa.table({"id": ids[mine], "links": links, "root": to})
        extra = other[root[other] != ids[other]]
        return pa.concat_tables([out, pa.table({"id": ids[extra], "links": np.zeros(len(extra), np.int64), "root": root[extra]})])

    return run


def embedding_near_duplicates(embeddings: DataFrame, spark: SparkSession, *, threshold: float = 0.98, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row of embeddings: vec_id, n_links, component_id, kept.

    Vectors of one label and length are linked when their cosine in double precision is ``threshold`` or more (any pair
    once; n_links counts other rows); component_id is the smallest vec_id that links reach and kept marks it. All links
    are found: centroids only decide where work is done. They are fitted on a bounded sample; every vector is indexed.

    Equal vectors of a label are compared once and counted as often as they occur. A cell is cut into blocks of 2048
    and block pairs are tasks, so neither a large cell nor a hot label meets in one task and no pair is listed.
    Null, zero or empty vectors, vectors with null, infinite or NaN components and those with a null label link with
    nothing. Rows that share a vec_id (or have none) and have different vectors count as rows of their own; a null id
    is never the smallest, and alone it has a null component_id with kept false. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    scratch = Scratch(spark)
    # floats travel as floats, which is exact, and are compared as doubles
    kind = "array<float>" if embeddings.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("v"))
    fine = F.col("v").isNotNull() & F.col("label").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("dim", F.size("v")).withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.sha2(F.concat_ws(",", F.col("label"), F.col("v").cast("array<string>")), 256)))
    plain = rows.select("id", "key")
    reps = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("dim").alias("dim"), F.any_value("v").alias("v"))
    reps = scratch.save(reps.withColumn("id", F.monotonically_increasing_id()), "vectors")  # written, so that a vector keeps its number

    n = reps.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    some = reps.orderBy(F.xxhash64("key"), "key").limit(sample).select("v", "dim").toPandas() if n else pd.DataFrame({"v": [], "dim": []})
    width = int(some["dim"].max()) if n else 1
    unit = np.concatenate([_padded(_unit(list(g["v"])), width) for _, g in some.groupby("dim")]) if n else np.ones((1, 1))
    held = spark.sparkContext.broadcast(fit_cells(unit, cell_count(n, sample)))
    delta = float(np.sqrt(2 - 2 * threshold)) if threshold < 1 else 0.0
    at = scratch.save(reps.select("id", "label", "dim", "copies", "v").mapInArrow(_cells(held, delta), "id long, label string, dim int, copies long, v " + kind + ", cell int, home boolean"), "cells")

    sizes = scratch.save(at.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    at = at.join(sizes, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block pair (p, q): home rows of p against all rows of q; part 0 is p's, 1 is q's, 2 both (p = q)
    pairs = at.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    as_p = pairs.filter("home").select("label", "dim", "cell", F.col("block").alias("p"), F.col("o").alias("q"), F.when(F.col("block") == F.col("o"), 2).otherwise(0).alias("part"), "id", "copies", "v")
    as_q = pairs.filter("NOT (home AND block = o)").select("label", "dim", "cell", F.col("o").alias("p"), F.col("block").alias("q"), F.lit(1).alias("part"), "id", "copies", "v")
    found = as_p.unionByName(as_q).groupBy("label", "dim", "cell", "p", "q").applyInArrow(_block_pair(threshold), "id long, links long, root long")
    found = scratch.save(found.groupBy("id", "root").agg(F.sum("links").alias("links")), "links")
    comps = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")), scratch)

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = reps.select("key", "id", "low", "copies").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = scratch.save(named, "named")
    lows = scratch.save(named.groupBy("component").agg(F.min("low").alias("component_id")), "lows")
    named = scratch.save(named.join(lows, "component").join(links, "id", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "groups")
    scratch.keep(named)
    out = plain.filter("key IS NOT NULL").join(named, "key").select("id", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    out = out.unionByName(plain.filter("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), spark)
