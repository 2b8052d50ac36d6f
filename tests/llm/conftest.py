import random

import pytest

SF = "/root/testdata/sf0.001"


def sentence(rng, n, words=("the of and ration ting ble house river stone over under with from lamp green wheel"
                            " paper cloud train seven music garden window table letter winter").split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing", str(rng.randrange(9))]) for _ in range(n))


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, blanks, long texts, copies, shared passages, repeated rows and ids, non-ASCII text."""
    rng = random.Random(5)
    passage, other = sentence(rng, 90), sentence(rng, 60)
    long = sentence(rng, 9000)
    rows = [
        (1, None), (2, ""), (3, " \n\t  \r\n"), (4, "a"), (5, sentence(rng, 30) + "\n" + passage),
        (6, passage + " " + sentence(rng, 40)), (7, passage), (7, passage), (8, long),
        (9, long[:20_000] + " changed " + long[20_000:]), (10, sentence(rng, 10) + " " + other + " " + other),
        (11, "x " * 3000), (12, "ab" * 1500), (13, "Über größe façade naïve   señor İstanbul ſ K " * 30),
        (14, "Über größe façade naïve   señor İstanbul ſ K " * 30 + "end"), (15, sentence(rng, 200)),
        (15, sentence(rng, 180)), (None, sentence(rng, 70)), (None, None), (16, "| # * $ % & < > " * 40),
    ]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The same rows with columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(k, t, "en" if k != 13 else None, "src" if k != 4 else None, 0, "x", 1, "y", 2, "z") for k, t in edge_rows],
        "doc_id long, text string, lang string, source string, n_chars long, id string, _row int, _text string, "
        "anchor int, spans string",
    )


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
