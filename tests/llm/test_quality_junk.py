"""Junk goes and clean texts stay."""

import public_tokenizers

from gleaner.llm import quality

RANKS, PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def test_tables_of_cells_are_rejected(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = quality.measures(docs, "doc_id", "text", "lang", RANKS, PIECES).collect()
    sizes = {b: sum(r.band == b and not r.base_failed for r in got) for b in {r.band for r in got}}
    own = [r for r in got if not r.base_failed and sizes[r.band] > 2 * quality.LEAST]
    junk = [r.kept for r in own if labels.get(r.id) == 0]
    clean = [r.kept for r in own if labels.get(r.id) == 1]
    assert len(junk) >= 10 and not any(junk)
    assert sum(clean) >= 0.98 * len(clean)
    assert quality.keep_good(docs, "text", "lang", RANKS, PIECES).count() == sum(r.kept for r in got)
