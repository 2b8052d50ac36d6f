"""The registered queries on the smallest tables, against plain Python."""

from collections import defaultdict

import public_tokenizers
import pytest

import __spark_entry__ as entry
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


def run(spark, sf, name):
    return {r["doc_id"]: r for r in entry.queries()[name](spark, sf).collect()}


def test_eleven_queries_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_op1(spark, sf, docs):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = run(spark, sf, "op1_decontaminate")
    assert len(got) == len(docs)
    for key, n, hit, items in brute.items_in(docs, bench):
        r = got[key]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(items), brute.sha(",".join(items)))
        assert r.contaminated == (hit > 0)
    assert any(r.contaminated for r in got.values())


def test_op3(spark, sf, docs):
    got = run(spark, sf, "op3_suffix")
    for (key, _), (n, gone, spans, kept) in zip(docs, brute.byte_repeats([t for _, t in docs]), strict=True):
        r = got[key]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, brute.sha(kept))


def test_op4(spark, sf, docs):
    rows = entry.queries()["op4_packing"](spark, sf).collect()
    want = brute.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_packed(rows)


def check_packed(rows, capacity=2048):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in rows) // capacity)
    assert least <= len(bins) <= least * 1.02 + 1


def test_op5(spark, sf):
    import zlib

    got = run(spark, "/root/testdata/sf0.01", "op5_toxicity")
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 for k, r in got.items())
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    seen = [(got[x.doc_id].score, x.toxic) for x in labels if got[x.doc_id].held_out]
    good, bad = [s for s, y in seen if y], [s for s, y in seen if not y]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.85


def test_op6(spark, sf, docs):
    got = run(spark, sf, "op6_simhash")
    for key, fp, comp in brute.near(docs):
        assert (got[key].fingerprint, got[key].component_id) == (f"{fp:016x}", comp)


def test_op7(spark, sf, docs):
    got = run(spark, sf, "op7_substring")
    for (key, _), (n, gone, kept) in brute.word_repeats(docs).items():
        assert (got[key].n_words, got[key].n_removed, got[key].kept_sha256) == (n, gone, brute.sha(kept))


def test_op8(spark, sf, docs):
    got = run(spark, sf, "op8_licenses")
    planted = {"General Public License, version 3": "gpl", "CC BY-NC 4.0": "cc-by-nc", "the MIT License": "mit",
               "Apache License, Version 2.0": "apache"}
    want = {k: ",".join(sorted({f for x, f in planted.items() if x in (t or "")})) for k, t in docs}
    assert {k: r.families for k, r in got.items()} == want and any(want.values())


def test_op9(spark, sf, docs):
    got = run(spark, sf, "op9_quality")
    for key, text in docs:
        r = got[key]
        base = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert base == brute.base_quality(text) and not (r.base_failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    assert all(got[k].kept for k in good if not got[k].base_failed)


def test_op10(spark, sf, docs):
    got = run(spark, sf, "op10_secrets")
    for key, text in docs:
        found, r = brute.base_secrets(text), got[key]
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in found) for k in ("assign", "access", "hex"))


def test_pipeline(spark, sf):
    """Each stage on what the plain versions of the stages before it keep."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in entry.queries()["op9_quality"](spark, sf).filter("kept").collect()}
    rows = [r for r in docs.orderBy("doc_id").collect() if r.doc_id in kept]
    texts = brute.boilerplate([(r.source, r.text) for r in rows])
    left = [(r.doc_id, t) for r, (_, _, t) in zip(rows, texts, strict=True)]
    left = [(k, t) for (k, t), (_, _, comp) in zip(left, brute.near(left), strict=True) if comp == k]
    left = [(k, t) for (k, t), (_, _, hit, _) in zip(left, brute.items_in(left, bench), strict=True) if not hit]
    got = cp.run(spark, sf).collect()
    want = brute.token_pieces(left, public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_packed(got)
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
