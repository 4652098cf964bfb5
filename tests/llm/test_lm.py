"""The trie against dictionaries, and the sequences against plain arrays."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldlore.llm import eliasfano as ef
from fieldlore.llm import lm, queries
from fieldlore.llm.words import lower_hashes

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=200), st.lists(st.integers(0, 2**40), max_size=50))
def test_sequence(values, asked):
    x = np.sort(np.array(values, "u8"))
    s = ef.EliasFano(ef.build(x))
    assert s.get(np.arange(len(x))).tolist() == x.tolist()
    if len(x) > 1:
        assert [v.tolist() for v in s.get_two(np.arange(len(x) - 1))] == [x[:-1].tolist(), x[1:].tolist()]
    q = np.array(asked + values, "u8")
    at, hit = s.lower_bound(q)
    assert at.tolist() == np.searchsorted(x, q).tolist()
    assert hit.tolist() == np.isin(q, x).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3000), min_size=1, max_size=20, unique=True), min_size=1, max_size=20), st.integers(0, 3000))
def test_search_within_a_context(ranges, asked):
    """Sums make the ranges one monotone sequence, in which each range is searched alone."""
    x, before, bounds = [], 0, [0]
    for r in map(sorted, ranges):
        x += [v + before for v in r]
        before = x[-1]
        bounds.append(len(x))
    s = ef.EliasFano(ef.build(np.array(x, "u8")))
    for k, r in enumerate(map(sorted, ranges)):
        start = int(s.get(np.array([bounds[k] - 1]))[0]) if k else 0
        q = np.array([*r, asked], "u8")
        at, hit = s.lower_bound(q + np.uint64(start), np.full(len(q), bounds[k]), np.full(len(q), bounds[k + 1]))
        assert hit.tolist() == [True] * len(r) + [asked in r] and (at[:-1] - bounds[k]).tolist() == list(range(len(r)))


def test_pairs_beyond_64_bits():
    rng = np.random.default_rng(3)
    c, t = rng.integers(0, 40, 500) << 33, rng.integers(0, 30, 500) << 30
    want = sorted(set(zip(c.tolist(), t.tolist(), strict=True)))
    a, b, back = lm.distinct_pairs(c, t, 36)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == want and (a[back] == c).all() and (b[back] == t).all()
    assert lm.packed(c, t, 36) is None and lm.packed(c >> 33, t, 36) is not None


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 2**64 - 1))
def test_bits(word):
    places = [i for i in range(64) if word >> i & 1]
    assert ef.nth_bit(np.full(len(places), word, "u8"), np.arange(len(places))).tolist() == places
    words = np.array([word, 0, word, 2**64 - 1, 1 << 63], "u8")
    bits = [bool(int(words[i // 64]) >> (i % 64) & 1) for i in range(320)]
    at = np.arange(250)
    for zeros in (False, True):
        want = [bits.index(not zeros, i + 1) for i in at]
        assert ef.bit_after(words, at, zeros).tolist() == [x if x // 64 == i // 64 else -1 for i, x in zip(at.tolist(), want, strict=True)]


def test_sequence_file(tmp_path):
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype("u8")) | np.uint64(1 << 63)
    (tmp_path / "f").write_bytes(ef.pack(ef.build(x) | {"more": np.arange(7, dtype="u2")}))
    a = ef.unpack(str(tmp_path / "f"))
    assert a["more"].tolist() == list(range(7)) and ef.EliasFano(a).get(np.arange(5000)).tolist() == x.tolist()
    assert sum(v.nbytes for k, v in a.items() if k in ("high", "low")) < 5000 * 8


def brute(train, texts, order):
    """Interpolated absolute discounting with dictionaries. The trie may differ by half a step of its quantised logarithms for each token."""
    def toks(t):
        return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (t or "").encode().split()] + [None]

    grams = [Counter() for _ in range(order)]
    for t in train:
        x = toks(t)
        for i in range(len(x)):
            for k in range(min(order, i + 1)):
                grams[k][tuple(x[i - k : i + 1])] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    follow = Counter(g[:-1] for level in grams[1:] for g in level)

    def p(w, ctx):
        if not ctx:
            return (grams[0][(w,)] + 0.1) / (n + 0.1 * (v + 1))
        lower = p(w, ctx[1:])
        c, t = grams[len(ctx) - 1][ctx], follow[ctx]
        if not t:
            return lower
        return max(grams[len(ctx)][(*ctx, w)] - lm.DISCOUNT, 0) / c + lm.DISCOUNT * t / c * lower

    out = []
    for t in texts:
        x = toks(t)
        base = sum(math.log10(p(w, ())) for w in x)
        s = 0.0
        for i, w in enumerate(x):
            s += math.log10(p(w, tuple(x[max(0, i - order + 1) : i])))
        out.append((len(x), sum(grams[0][(w,)] > 0 for w in x), n, base, s))
    return out


@pytest.mark.parametrize("order,parts,run", [(1, 3, 10**6), (2, 1, 10**6), (2, 7, 300), (3, 5, 500)])
def test_trie(spark, monkeypatch, order, parts, run):
    monkeypatch.setattr(lm, "RUN", run)
    monkeypatch.setattr(lm, "CHARS", 4000)
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id limit 60").fetchall()]
    texts += [None, "", "the the the the", "Zz É é", "the " * 500]
    train, rows = texts[:40] + texts[-5:], list(enumerate(texts)) + [(3, texts[3]), (None, "new words")]
    levels = lm.train(spark.createDataFrame([(t, 1) for t in train], "text string, file int").repartition(4), order=order, parts=parts)
    got = {(r.doc_id, r.n_tokens): (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), levels).collect()}
    want = dict(zip([i for i, _ in rows], brute(train, [t for _, t in rows], order), strict=True))
    for (i, _), g in got.items():
        assert g[:3] == want[i][:3]
        assert g[3] == pytest.approx(want[i][3], rel=1e-12) and abs(g[4] - want[i][4]) <= g[0] * lm.STEP / 2 + 1e-9


def test_shared_contexts_and_empty(spark):
    train = ["the " + f"w{i}" for i in range(900)]
    levels = lm.train(spark.createDataFrame([(t,) for t in train], "text string"), parts=40)
    assert len(set(levels[1].context.tolist())) < len(levels[1].paths) and 900 in levels[1].after  # one context fills several files
    got = lm.score(spark.createDataFrame([(1, "the w5"), (2, "the zz")], "doc_id bigint, text string"), levels).collect()
    for r, w in zip(sorted(got), brute(train, ["the w5", "the zz"], 2), strict=True):
        assert r.score == pytest.approx(w[4], rel=3e-4)
    none = lm.train(spark.createDataFrame([], "text string"))
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in lm.score(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), none).collect()] == [(3, 0, 0, 0.0)]


def test_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    want = dict(zip([i for i, _ in rows], brute([t for i, t in rows if not held[i]], [t for _, t in rows], lm.ORDER), strict=True))
    got = queries.op9_ngram_trie(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], *w[:3])
        assert r.base_score == pytest.approx(w[3], rel=1e-12) and abs(r.score - w[4]) <= r.n_tokens * lm.STEP / 2 + 1e-9
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_query_uses_trigrams(spark, tmp_path):
    """After b, the word before it alone tells c from e."""
    rows = [(i, "a b c" if i % 2 else "d b e") for i in range(60)] + [(i, "a b e") for i in range(60, 90) if zlib.crc32(str(i).encode()) % 10 == 0]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    got = {r.doc_id: r.score for r in queries.op9_ngram_trie(spark, str(tmp_path)).collect()}
    want = brute(train, [t for _, t in rows], 3)
    assert len(rows) > 60 and len(got) == len(rows)
    assert all(abs(got[i] - w[4]) <= w[0] * lm.STEP / 2 + 1e-9 for (i, _), w in zip(rows, want, strict=True))
    assert got[1] > got[rows[-1][0]] + 0.5


def test_hashes_of_words():
    """A word's hash is its own, wherever it stands, in lower-case ASCII; lengths, bytes of 0 and places beyond a number count."""
    words = ["a", "a\0", "a\0\0", "b", "é", "É", "x" * 8, "x" * 9, "x" * 16, "x" * 63, "x" * 64, "x" * 65, "x" * 64 + "y", "日本語", "日本" * 30, "ab\x1cc", "a　b"]
    h, first = lower_hashes(words)
    assert first.tolist() == list(range(len(words) + 1)) and len(set(h.tolist())) == len(words)
    again, first = lower_hashes([None, "", " \t" + "\x0b \r".join(words).upper().replace("É", "é", 1) + "\n", " ", "A"])
    assert first.tolist() == [0, 0, 0, len(words), len(words), len(words) + 1]
    assert again.tolist() == [*h.tolist(), h[0]]


def test_contexts_of_one_successor_are_not_searched(spark, monkeypatch):
    """They are read with the sum that they begin with."""
    text = " ".join(f"w{k}" for k in range(500))
    levels = lm.train(spark.createDataFrame([(text,)], "text string"), order=3, parts=1)
    searched, plain = [], ef.EliasFano.lower_bound
    monkeypatch.setattr(ef.EliasFano, "lower_bound", lambda self, x, *a: searched.append(len(x)) or plain(self, x, *a))
    h, first = lm.tokens([text, text.replace("w250 ", "w3 ")])
    _, two, three = lm.walk(levels, h, first)
    # a word that is missing breaks two nodes of a level, and one more of the next
    assert (two[0] < 0).sum() == 2 + 2 and (three[0] < 0).sum() == 4 + 3
    assert sum(searched[1:]) < 10
