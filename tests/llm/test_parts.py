"""Parts of operators that are plain functions."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st

from gleaner.llm import gru, packing, suffix
from gleaner.llm.common import Ranges, WordHashes, gram_hashes, runs_of, sliding_min, union_spans, winnow

TOKENS = packing.TokenIds(public_tokenizers.path("word_bpe_49k.json"))
texts = st.lists(st.text("ab", min_size=24, max_size=60).map(str.encode), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts, st.sampled_from([8, 16]))
def test_deep_shallow_sort(contexts, shallow):
    length = 24
    starts = np.array([len(c) - length + 1 for c in contexts])
    groups = np.arange(len(contexts)) // 3
    context, offset, leader = suffix.repeated_suffixes(contexts, groups, starts, length, shallow)
    seen = {}
    for i, (c, o) in enumerate(zip(context, offset, strict=True)):
        key = (groups[c], contexts[c][o : o + length])
        assert leader[i] == seen.setdefault(key, i)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=9, max_size=9).map(str.encode), min_size=1, max_size=40))
def test_blind_trie_orders(strings):
    trie = suffix.BlindTrie(strings[0], 0)
    for i, s in enumerate(strings[1:], 1):
        trie.insert(s, i)
    leaves = list(trie.leaves())
    assert [strings[m[0]] for m in leaves] == sorted(set(strings))
    assert all(len({strings[i] for i in m}) == 1 for m in leaves) and sum(map(len, leaves)) == len(strings)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 12))
def test_hashes(values, k):
    h = np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    grams = gram_hashes(h, k)
    assert len(grams) == max(0, len(h) - k + 1)
    windows = [tuple(values[i : i + k]) for i in range(len(grams))]
    assert len(set(windows)) == len(set(grams.tolist())) and len(set(zip(windows, grams.tolist(), strict=True))) == len(set(windows))
    if len(grams):
        start = np.arange(len(grams))
        ranges = Ranges(h)(start, start + k)
        assert len(set(zip(windows, ranges.tolist(), strict=True))) == len(set(windows)) == len(set(ranges.tolist()))
    assert sliding_min(h, k).tolist() == [min(h[i : i + k].tolist()) for i in range(len(grams))]
    picked = winnow(h, k)
    top = (h >> np.uint64(32)).tolist()
    assert picked.tolist() == [max(range(i, i + k), key=lambda j: (-top[j], j)) for i in range(len(grams))]


def test_small_helpers():
    first, last = runs_of(np.array([1, 1, 2, 1]))
    assert first.tolist() == [0, 2, 3] and last.tolist() == [1, 2, 3]
    assert union_spans([(5, 6), (0, 2), (2, 3), (1, 2)]) == [(0, 3), (5, 6)]
    words = WordHashes()
    assert words.array([b"a", b"b" * 100, b"a"]).tolist()[0] == words[b"a"] and b"b" * 100 not in dict(words)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 30), min_size=1))
def test_plan_places_every_piece_once(counts):
    ranks, bins = {}, {}
    for length, a, b, first, offset in packing.plan(counts, 32):
        for r in range(a, b):
            assert r == ranks.get(length, 0)
            ranks[length] = r + 1
            bins.setdefault(first + r - a, []).append((offset, length))
    assert ranks == counts
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 32


def test_two_pieces_replace_the_smallest():
    # Greedy takes 6 then 3 of 10; 2 + 2 fill the gap of 4 exactly.
    left = np.zeros(11, np.int64)
    left[[6, 3]] = 1
    left[2] = 2
    assert packing._fill(left, 10) == [6, 2, 2]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.fresh(3).items()}
    words, grams, sizes = np.array([3, 5, 9]), np.array([1, 2, 2, 7, 8, 9]), np.array([2, 1, 3])
    at = rng.integers(0, 3, (6, 4))
    valid = np.arange(6)[:, None] < np.array([6, 3, 1, 5])
    y = np.array([1, 0, 1, 0])

    def loss():
        z = gru.forward(p, gru.inputs(p, words, grams, sizes)[1][at], valid)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = gru.gradients(p, words, grams, sizes, at, valid, y)
    for name in ("win", "bin", "uf", "ub", "wa", "va", "out", "bias", "word", "char"):
        flat = p[name].reshape(-1)
        if isinstance(g[name], tuple):
            full = np.zeros_like(p[name])
            np.add.at(full, g[name][0], g[name][1])
            i = int(np.abs(full).argmax())
            want = full.reshape(-1)[i]
        else:
            i = int(np.abs(g[name]).argmax())
            want = np.asarray(g[name]).reshape(-1)[i]
        keep, e = flat[i], 1e-3
        flat[i] = keep + e
        up = loss()
        flat[i] = keep - e
        down = loss()
        flat[i] = keep
        assert abs((up - down) / (2 * e) - want) < 2e-3 * max(1, abs(want) * 20), name


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x250), st.sampled_from("'sStTreRvmlLd .,<|>\n\u0130\u0131\u0301\u03a3漢\u2003\u00a0\u1e9e"))))
def test_token_ids_are_the_tokenizers(text):
    ids = TOKENS.of(text)
    want = TOKENS.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want


def test_special_token_texts():
    for text in ("a<|endoftext|>b", "<|startoftext|> It's <|", "It'LL 'store ''s ½2² \x1c\x85x"):
        assert np.frombuffer(TOKENS.of(text), "<u4").tolist() == TOKENS.tokenizer.encode(text, add_special_tokens=False).ids
