"""Spelling variants, token counts of prefixes and the conversation trie, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from gleaner.llm import common, queries, tokens, trie, variants
from gleaner.session import cut

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
order = lambda rows: sorted(rows, key=repr)


# ---------------------------------------------------------------- variants


def counted(docs):
    import re

    out = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += bool(run)
    return {w: n for w, n in out.items() if w}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(vocabulary, factor=5):
    """Near words by deletion signatures, forms and roots."""
    signs = defaultdict(set)
    for w in vocabulary:
        signs[w].add(w)
        for i in range(len(w)):
            signs[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for own in signs.values():
        for a in own:
            near[a].update(b for b in own if a != b and one_edit(a, b))
    form = {}
    for w in vocabulary:
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= factor * vocabulary[w] else None
    rows = []
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, n, form[w], vocabulary[form[w]] if form[w] else None, len(near[w]), root))
    return rows


def of(df):
    return order((r.word, r.n, r.form, r.form_n, r.n_near, r.root) for r in df.collect())


def test_words_at_edges(edge, edge_rows, nothing):
    got = {r.word: r.n for r in variants.words(edge, "doc_id", "text").collect()}
    assert got == counted(edge_rows)
    assert variants.words(nothing, "doc_id", "text").count() == 0


def test_words_flush_in_parts(edge, edge_rows, monkeypatch):
    monkeypatch.setattr(variants, "CACHE", 3)
    assert {r.word: r.n for r in variants.words(edge, "doc_id", "text").collect()} == counted(edge_rows)


@pytest.mark.parametrize("leaf,most,sample", [(20_000, 100_000, 200_000), (4, 3, 60)])
def test_variants_of_any_vocabulary(spark, leaf, most, sample, monkeypatch):
    rng = random.Random(3)
    words = {"".join(rng.choice("abéÿ") for _ in range(rng.randrange(1, 7))) for _ in range(400)}
    words |= {"x" * k for k in range(1, 40)} | {"colour", "color", "colours", "colr", "stone", "notes", "onset", "tones"}
    vocabulary = {w: rng.choice([5, 5, 25, 125, 625]) for w in words}
    table = cut(spark.createDataFrame(list(vocabulary.items()), "word string, n long"))
    real = variants.near_pairs
    monkeypatch.setattr(variants, "near_pairs", lambda v: real(v, sample, leaf, most))
    assert of(variants.variants(table)) == order(grouped(vocabulary))


def test_no_words(spark):
    empty = cut(spark.createDataFrame([], "word string, n long"))
    assert variants.variants(empty).count() == 0
    one = cut(spark.createDataFrame([("alone", 7)], "word string, n long"))
    assert of(variants.variants(one)) == [("alone", 7, None, None, 0, "alone")]


def test_op11(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    vocabulary = {w: n for w, n in counted(docs).items() if len(w) >= 6 and n >= 5}
    got = of(entry.queries()["op11_variants"](spark, sf))
    assert got == order(grouped(vocabulary)) and sum(r[2] is not None for r in got) > 0


# ---------------------------------------------------------------- token counts

PARTS = [
    "a", "b", "the", " ", "  ", "\n", "\t", " ", "'", "'s", "'re", "'ve", "r", "l", "ll", "é", "中", "𝒳", "ह", "1", "23", "!",
    "<|endoftext|>", "<|endof", "|>", "́", "ǅ", "ꞎ", "　", "hello", " World", "====", "    ", "\x1c", " ",
    "\U0001f600", "\x01", "\x85", "ſ", "²", " \n\n're",
]


def test_every_prefix_has_the_count_of_the_library():
    known, library, rng = tokens.PrefixSteps(VOCABULARY), Tokenizer.from_file(VOCABULARY), random.Random(1)
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    for _ in range(1_500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14)))
        steps = known.of(text)
        assert len(steps) == len(text)
        assert [int(steps[:k].sum()) for k in range(len(text) + 1)] == [count(text[:k]) for k in range(len(text) + 1)], text


def test_splitting_rule_of_all_near_characters():
    known = tokens.PrefixSteps(VOCABULARY)
    for c in range(0x250):
        text = f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}? {chr(c)}{chr(c)}x"
        want = "".join(text[a:b] + "|" for _, (a, b) in known.split(text))
        got = "".join(text[a:b] + "|" for u, at in _placed(known._units(text)) for a, b in _inside(known, u, at))
        assert got == want, hex(c)


def _placed(units):
    at = 0
    for u in units:
        yield u, at
        at += len(u)


def _inside(known, unit, at):
    return [(at + a, at + b) for _, (a, b) in known.split(unit)]


def test_merges_across_a_border():
    rules, rng = tokens.MergeRules(VOCABULARY), random.Random(2)
    library = Tokenizer.from_file(VOCABULARY)
    ids = [t for t in rng.sample(sorted(rules.parts), 400)]
    for a, b in zip(ids[::2], ids[1::2]):
        joint = library.model.tokenize(library.id_to_token(a) + library.id_to_token(b))
        assert rules._apart(a, b) == ([t.id for t in joint] == [a, b]) or not (rules.own(a) and rules.own(b))


def test_tables_answer_budget_questions(edge, edge_rows, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    tables = tokens.prefix_tables(edge, "doc_id", "text", VOCABULARY)
    for limit in (0, 7, 1024):
        rows = tokens.budget(tables, limit).collect()
        want = order((k, len((t or "").encode()), count(t or ""), count(t or "") > limit) for k, t in edge_rows)
        assert order((r.id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    texts = {len(t): t for _, t in edge_rows if t}
    for r in rows:
        if text := texts.get(r.n_chars):
            assert count(text[: r.fit_chars]) <= 1024
            assert r.fit_chars == len(text) or all(count(text[:k]) > 1024 for k in range(r.fit_chars + 1, r.fit_chars + 40))
    part = tables.select("n_chars", tokens.tokens_of_prefix("steps", F.lit(5).cast("bigint")).alias("five")).collect()
    assert all(r.five == count(texts[r.n_chars][:5]) for r in part if r.n_chars in texts)
    assert tokens.budget(tokens.prefix_tables(nothing, "doc_id", "text", VOCABULARY)).count() == 0


def test_op12(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    library = Tokenizer.from_file(VOCABULARY)
    want = [(k, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for k, t in docs]
    got = entry.queries()["op12_token_counts"](spark, sf).collect()
    assert order((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == order(want)


# ---------------------------------------------------------------- trie


def nodes(rows, base=lambda c: c - c % 5, head=lambda c: zlib.crc32(str(c).encode()) % 9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, f"{digest}:{len(text.encode())}"), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {c: tuple(own.get(base(c), [])[: head(c)] + own[c][head(c) :]) for c in own}
    members, kids, below, out = defaultdict(list), defaultdict(list), {}, []
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    for n in sorted(members, key=len, reverse=True):
        saved = (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        below[n] = (sum(below[k][0] for k in kids[n]) or 1, saved + sum(below[k][1] for k in kids[n]))
        ends = ",".join(str(c) for c in sorted(members[n]) if built[c] == n)
        parent = min(members[n[:-1]]) if n else None
        row = (min(members[n]), len(n), parent, len(members[n]), len(kids[n]), *below[n], hashlib.sha256(ends.encode()).hexdigest())
        out.append(row)
    return order(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def grown(df, **how):
    conv = F.col("conv_id")
    how = how or dict(base=conv - conv % 5, head=F.crc32(conv.cast("string").cast("binary")) % 9, most=8)
    return order(tuple(r[c] for c in COLUMNS) for r in trie.conversation_trie(df, "conv_id", "turn", "role", "text", **how).collect())


def talks(rng, convs):
    says = ["", None, "hi", "hi", "stone", "größe", "x" * 300, " "]
    rows = []
    for c in convs:
        for t in range(rng.choice([1, 2, 3, 7, 8, 9, 16, 17, 40])):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "user", None]), rng.choice(says)))
    return rows


def test_trie(spark, monkeypatch):
    rng = random.Random(4)
    rows = talks(rng, [*range(40), 10**12, 10**12 + 3, None])
    rows += [(c, t, "user", f"same {t}") for c in range(100, 150) for t in range(30)]
    rows += [(7, 3, "user", "again")] * 2
    df = spark.createDataFrame([(c, t, r, x, 1, 2, 3) for c, t, r, x in rows],
                               "conv_id long, turn int, role string, text string, pos int, block int, depth int")
    for span, share in ((4096, 1000), (3, 2)):
        monkeypatch.setattr(trie, "SPAN", span)
        monkeypatch.setattr(trie, "join_unique", lambda a, b, k, s=share: common.join_unique(a, b, k, s))
        assert grown(df) == nodes(rows)
    plain = dict(base=None, head=None)
    assert grown(df, **plain) == nodes(rows, head=lambda c: 0)
    assert grown(df.limit(0)) == []


def test_turnless_conversations(spark):
    """A conversation that takes its head from one that does not exist, or is shorter than its head, loses its own head."""
    rows = [(c, t, "user", f"{c} {t}") for c in (1, 2, 3, 4, 6, 8) for t in range(2)] + [(5, 0, "user", "one")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = grown(df)
    assert got == nodes(rows) and next(r for r in got if r[1] == 0)[3] == 7


def test_op13(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = entry.queries()["op13_prefix_trie"](spark, sf)
    assert order(tuple(r[c] for c in COLUMNS) for r in got.collect()) == nodes(rows)


def test_three_more_queries():
    assert {"op11_variants", "op12_token_counts", "op13_prefix_trie"} <= set(queries.QUERIES)
