"""Rows that share an id, columns that are named like the operators' own, and functions that run once per row."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as cp
from gleaner.llm import lines, quality, repeats, simhash, substring, suffix
from tests.llm.conftest import sentence

RANKS, PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def test_texts_of_one_id_with_equal_short_hashes(spark, monkeypatch):
    """Two texts under one id whose 32-bit hashes are equal: only the text that occurs before loses words."""
    import random

    rng = random.Random(11)
    shared = sentence(rng, 40)
    found = spark.range(600_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("tail"))
    hashed = found.withColumn("text", F.concat(F.lit(sentence(rng, 30) + " "), F.col("tail"))).withColumn("h", F.hash("text"))
    twin = hashed.groupBy("h").agg(F.collect_list("text").alias("t")).filter(F.size("t") > 1).first()
    assert twin is not None
    first, second = twin["t"][:2]
    docs = spark.createDataFrame([(1, shared), (5, first), (5, second), (9, shared)], "doc_id long, text string")
    rows = repeats.keyed(docs, "doc_id", "text").select("_row").distinct().count()
    assert rows == 3
    got = sorted((r.id, r.n_removed) for r in substring.remove_repeats(docs, "doc_id", "text", length=20).collect())
    # The two twins share their first 30 words, so one of them loses these; neither loses its last word.
    assert got == [(1, 0), (5, 0), (5, 30), (9, 40)]
    kept = suffix.remove_repeats(docs, "doc_id", "text", length=400).collect()
    assert len(kept) == 4


def test_columns_named_like_inner_ones(spark):
    pages = [("h", f"own {i}\nmenu", 1, 2, 3, 4, 5, 6) for i in range(20)]
    names = "source string, text string, __listed int, __host int, __salt int, __own int, __row int, __id int"
    df = spark.createDataFrame(pages, names)
    kept = lines.drop_boilerplate(df, "source", "text")
    assert kept.columns == df.columns and all("menu" not in r.text and r["__listed"] == 1 for r in kept.collect())
    docs = df.withColumn("doc_id", F.monotonically_increasing_id()).withColumn("text", F.lit("one text for all"))
    first = simhash.keep_first(docs, "doc_id", "text")
    assert first.columns == docs.columns and [(r["__id"], r["__row"]) for r in first.collect()] == [(6, 5)]


def test_spread_lists_with_inner_names(spark, monkeypatch):
    monkeypatch.setattr(lines, "MAX_LISTED", 0)
    test_columns_named_like_inner_ones(spark)


def test_line_dedup_without_a_length_column(spark):
    df = spark.createDataFrame([(i, "h", f"own {i}\nmenu") for i in range(20)], "doc_id long, source string, text string")
    assert all("menu" not in r.text for r in cp.line_dedup(spark, df, "").collect())


def test_quality_measures_a_text_once(edge, capsys):
    """The rows with their measures are written before they are filtered; the plan that is returned calls no function."""
    kept = quality.keep_good(edge, "text", "lang", RANKS, PIECES)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert kept.columns == edge.columns


def test_every_byte_of_a_long_token_is_read():
    from gleaner.llm import toxicity

    glued = b"river_over_the_green_stone_" * 40
    for at in (0, 70, 333, len(glued)):
        text = glued[:at] + b"clown" + glued[at:]
        pieces = toxicity.tokens_of(text)
        assert any(b"clown" in p for p in pieces) and max(map(len, pieces)) <= toxicity.PIECE
        assert b"".join([pieces[0]] + [p[toxicity.OVERLAP :] for p in pieces[1:]]) == text
    assert toxicity.tokens_of(b" a  bc ") == [b"a", b"bc"] and toxicity.tokens_of(b"") == []
    edge = b"x" * toxicity.PIECE
    assert toxicity.tokens_of(edge) == [edge] and len(toxicity.tokens_of(edge + b"y")) == 2


def test_words_behind_byte_64_change_the_score(spark):
    from gleaner.llm import toxicity

    calm, rude = b"the river runs over the green stone ", b"you are a stupid clown and it shows "
    p = toxicity.train([(rude * 3, 1), (calm * 3, 0)] * 60)
    long = "_".join(["the_river_runs_over_the_green_stone"] * 12)
    rows = [(1, long), (2, long + "_you_are_a_stupid_clown_and_it_shows" * 6)]
    got = {r.id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", p).collect()}
    assert got[2] > got[1]
