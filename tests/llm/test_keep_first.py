"""One row stays for every group of near-duplicates, whatever ids repeat or are missing."""

from gleaner.llm import simhash
from tests.llm import brute
from tests.llm.conftest import sentence


def kept_texts(df):
    return sorted((repr(r.doc_id), r.text or "") for r in simhash.keep_first(df, "doc_id", "text").collect())


def test_every_component_keeps_one_row(edge, edge_rows):
    groups = {}
    fingerprints = {(k, t): fp for (k, t), (_, fp, _) in zip(edge_rows, brute.near(edge_rows), strict=True)}
    for row in edge_rows:  # links of at most 4 bits, closed by hand
        near = [g for g in groups if any(bin((fingerprints[row] ^ fingerprints[x]) & (2**64 - 1)).count("1") <= 4 for x in groups[g])]
        groups[row] = [row] + [x for g in near for x in groups.pop(g)]
    got = [(r.doc_id, r.text) for r in simhash.keep_first(edge, "doc_id", "text").collect()]
    assert len(got) == len(groups) and all(sum(x in set(own) for x in got) == 1 for own in groups.values())
    for own in groups.values():
        ids = [k for k, _ in own if k is not None]
        assert next(k for k, t in got if (k, t) in own) == min(ids, default=None)


def test_ids_repeat_across_components(spark):
    import random

    rng = random.Random(9)
    a, b, c, d = (sentence(rng, 120) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (4, d), (None, a), (None, sentence(rng, 120)), (2, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, a), (2, b), (3, c), (3, d), rows[7]]
    assert kept_texts(df) == sorted((repr(k), t) for k, t in want)
