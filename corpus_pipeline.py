"""Five stages from raw documents to packed sequences. Each is written as Parquet and read again by the next one.

quality        rows whose fertility measures or base counts fail go
line_dedup     boilerplate lines of a source leave the text; ``n_chars`` follows
near_dedup     of each group of SimHash near-duplicates the smallest id stays
decontaminate  rows that hold a benchmark window go
pack           what is left, as pieces of sequences of 2048 tokens

All stages but the last return the columns of ``documents``. Null and empty texts fail the quality stage, so later stages see
none unless line dedup empties a text; such a text stays, as a document without words. Empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm import decontaminate as decon, lines, packing, quality as fertility, simhash
from gleaner.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks, pieces = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"))
    return fertility.keep_good(docs, "text", "lang", ranks, pieces)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.drop_boilerplate(docs, "source", "text", percent=10, min_pages=5)
    if "n_chars" not in docs.columns:
        return kept
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, "doc_id", "text", shingle=4, radius=4, seed=42)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decon.drop_contaminated(docs, "doc_id", "text", bench, "item_id", "text", window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return found.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: SQL can express neither the tokenisers nor the fingerprints; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
