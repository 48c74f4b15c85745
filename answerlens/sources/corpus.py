"""Reading corpora, suites and concept files, embedding chunks and writing reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "heading string, content array<string>, source_excerpt string, clean_explanation string, sample_questions array<string>, sample_answer string, chunk_key string, keywords array<string>"
CORPUS = f"title string, lectures array<struct<lecture_number:int,title:string,sections:array<struct<{', '.join(x.replace(' ', ':', 1) for x in SECTION.split(', '))}>>>>"
SUITE = "name string, version string, cases array<struct<id:string,category:string,intent:string,critical:boolean,query:string,expected_mode:string,must_include:array<string>,must_not_include:array<string>>>"
CONCEPTS = "concepts array<struct<id:string,name:string,aliases:array<string>,lecture_scope:array<int>,prerequisites:array<string>,related:array<string>>>"
PAYLOAD = "confidence double, mode string, chunk_hits array<struct<chunk_id:bigint,score:double>>, variant struct<provider:string,model:string,boost_used:boolean>"


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """One row per section of nested corpus JSON, with its place in its lecture. Malformed files give no rows."""
    c = spark.read.schema(CORPUS).option("multiLine", True).json(path)
    x = c.select(F.col("title").alias("corpus"), F.explode("lectures").alias("l")).select("corpus", "l.lecture_number", F.col("l.title").alias("lecture_title"), F.posexplode("l.sections").alias("section_index", "s"))
    return x.select("corpus", "lecture_number", "lecture_title", "section_index", "s.*")


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) cases of a suite: id and query must be there and the mode known."""
    c = spark.read.schema(SUITE).option("multiLine", True).json(path).select("name", F.explode("cases").alias("c")).select("name", "c.*")
    mode = F.lower(F.trim(F.coalesce("expected_mode", F.lit("chat"))))
    c = c.withColumn("expected_mode", mode)
    ok = F.coalesce((F.trim("id") != "") & (F.trim("query") != "") & mode.isin("chat", "quiz", "compare", "summary"), F.lit(False))
    return c.filter(ok), c.filter(~ok)


def read_concepts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Concept, alias, lecture and edge tables of a concept file."""
    c = spark.read.schema(CONCEPTS).option("multiLine", True).json(path).select(F.explode("concepts").alias("c")).select("c.*")
    edges = [c.select(F.col("id").alias("src"), F.lit(k).alias("kind"), F.explode(k).alias("dst")) for k in ("prerequisites", "related")]
    return {"concepts": c.select("id", "name"), "aliases": c.select("id", F.explode("aliases").alias("alias")), "lectures": c.select("id", F.explode("lecture_scope").alias("lecture_number")), "edges": edges[0].unionByName(edges[1])}


def flatten_payloads(messages: DataFrame) -> dict[str, DataFrame]:
    """Log, hit and variant tables of assistant payloads, parsed once each; bad JSON gives a row of nulls."""
    p = messages.filter("role = 'assistant'").select("id", F.from_json("payload_json", PAYLOAD).alias("p"))
    return {
        "logs": p.select(F.col("id").alias("message_id"), "p.confidence", "p.mode"),
        "hits": p.select(F.col("id").alias("message_id"), F.posexplode("p.chunk_hits").alias("pos", "h")).select("message_id", (F.col("pos") + 1).alias("rank"), "h.chunk_id", "h.score"),
        "variants": p.filter("p.variant IS NOT NULL").select(F.col("id").alias("message_id"), "p.variant.*"),
    }


def hashing_vectors(texts: list[str], dim: int = 64) -> np.ndarray:
    """Signed hashed word counts: a stand-in for an embedding model that needs no network."""
    import xxhash

    out = np.zeros((len(texts), dim), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = xxhash.xxh64_intdigest(w)
            out[i, h % dim] += 1.0 if h >> 63 else -1.0
    return out


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashing_vectors, *, batch: int = 32, model: str = "hashing") -> DataFrame:
    """(id, embedding, model, dim): explanation and excerpt, cut to 4000 and 1500 characters, embedded in batches."""
    text = F.concat_ws("\n---\n", F.substring("clean_explanation", 1, 4000), F.substring("source_excerpt", 1, 1500))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                v = np.asarray(embed(part.column(1).to_pylist()), dtype=np.float32)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), rows, pa.array([model] * len(v)), pa.array([v.shape[1]] * len(v), pa.int32())], ["id", "embedding", "model", "dim"])

    return chunks.select(F.col("id").cast("long").alias("id"), text.alias("t")).mapInArrow(run, "id long, embedding array<float>, model string, dim int")


def write_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder with a header per report."""
    for name, df in reports.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
