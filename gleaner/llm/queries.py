"""One query per operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut
from . import (
    decontaminate as decon, licenses, lines, packing, quality, secrets, simhash, substring, suffix, tokens, toxicity, trie,
    variants,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decon.matches(docs, "doc_id", "text", bench, "item_id", "text")
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    hit = decon.n_covered("spans")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        "spans",
    )


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = lines.drop_boilerplate(docs, "source", "text", percent=10, min_pages=5, counts=("n_lines", "n_dropped"))
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", length=400)
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary, capacity=2048, end_id=0)
    return found.withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))
    texts = toxicity.sample(docs, "doc_id", "text", labels.filter(~out("doc_id")), "toxic", toxicity.TRAIN_DOCS)
    found = toxicity.score(docs, "doc_id", "text", toxicity.train(texts))
    return found.select(
        F.col("id").alias("doc_id"), out("id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs, "doc_id", "text", shingle=4, radius=4, seed=42)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", length=20)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.by_document(docs, "doc_id", "text", licenses.train(docs, "doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "n_paragraphs", "n_predicted", "n_confirmed", F.array_join("families", ",").alias("families")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.measures(
        table(spark, sf_dir, "documents"), "doc_id", "text", "lang",
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"),
    )
    return found.withColumnRenamed("id", "doc_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), "doc_id", "text")
    base = ("assign", "access", "hex")
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    return found.select(
        F.col("id").alias("doc_id"), *[of(k) for k in base],
        F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocabulary = cut(variants.words(docs, "doc_id", "text").filter((F.length("word") >= 6) & (F.col("n") >= 5)))
    return variants.variants(vocabulary, factor=5).select("word", "form", "root", "n", "n_near", "form_n")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tables = tokens.prefix_tables(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    found = tokens.budget(tables, limit=1024)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit", "n_chars", "fit_chars")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return trie.conversation_trie(
        table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text",
        base=conv - conv % 5, head=F.crc32(conv.cast("string").cast("binary")) % 9, most=8,
    )


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lines": op2_lines,
    "op3_suffix": op3_suffix,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_substring": op7_substring,
    "op8_licenses": op8_licenses,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "op11_variants": op11_variants,
    "op12_token_counts": op12_token_counts,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {"op2_lines": lines.SQL}
