"""Near-duplicates and mixing against brute force."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlore.llm import minhash, mixing, queries
from fieldlore.llm.graph import components, joined_by

SF = "/root/testdata/sf0.01"


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def bag(text):
    words = re.split("[\x20\x09-\x0d]+", (text or "").strip(" \t\n\v\f\r"))
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words != [""] else Counter()


def brute(rows):
    """Component of each id: all pairs that share a shingle."""
    by, bags = defaultdict(list), {}
    for i, t in rows:
        bags[i] = bag(t)
        for s in bags[i]:
            by[s].append(i)
    seen, edges = set(), []
    for ids in by.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = sum((bags[a] & bags[b]).values())
                    if both >= 0.8 * sum((bags[a] | bags[b]).values()):
                        edges.append((a, b))
    comp = union_find(edges)
    return {i: comp.get(i, i) for i, _ in rows}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(90)] + [(5000, 5000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = union_find([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_signatures_are_unbiased():
    rng = np.random.default_rng(4)
    texts = []
    for k in range(40):
        a = [f"w{rng.integers(60)}" for _ in range(300)]
        b = list(a)
        for i in rng.integers(0, 300, k):
            b[i] = "x"
        texts += [" ".join(a * 2), " ".join(b * 2)]
    h, c, first = minhash.shingles(texts)
    sig = minhash.signatures(h, c, first)
    true = np.array([minhash.similarity(texts[i], texts[i + 1]) for i in range(0, 80, 2)])
    est = (sig[0::2] == sig[1::2]).mean(1)
    assert c.max() > 1 and np.abs(est - true).max() < 5 * math.sqrt(0.25 / minhash.REGISTERS) and abs((est - true).mean()) < 0.012
    alone = minhash.signatures(*minhash.shingles(texts[7:8]))
    assert (alone[0] == sig[7]).all()


def test_near_duplicates(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
    got = {r.doc_id: r for r in queries.op4_minhash(spark, SF).collect()}
    want = brute(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items()) and len(got) == len(rows)


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicates_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    base = [f"word{i}" for i in range(120)]
    near = [base[:k] + ["changed"] + base[k + 1 :] for k in range(3, 118, 3)]
    # copies that are near the base's own copies or near none: several edits at random places
    rng = np.random.default_rng(12)
    near += [[w if rng.random() > 0.035 else f"e{rng.integers(9)}" for w in base] for _ in range(60)]
    rows = [(1000 + i, " ".join(w)) for i, w in enumerate([base, *near])]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "one"), (105, "one two"), (106, "a b c d"), (107, "a  b\tc d"), (106, "a b c d"), (None, "one"), (None, None), (300, "x " * 4000), (301, "x " * 3999)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, class_id string")
    got = minhash.near_duplicates(df).collect()
    want = brute([(i, t) for i, t in dict(r for r in rows if r[0] is not None).items()])
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert want[104] == 103 and want[107] == 106 and want[301] == 300 and want[102] == 102
    kept = minhash.deduplicate(df.withColumn("_gone", F.lit(1)).withColumn("doc.id", F.lit(2)).withColumn("n", F.lit(3))).drop("_gone", "doc.id", "n")
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns
    assert sorted(i for i in ids if i is not None) == sorted({c for c in want.values()}) and ids.count(None) == 2
    assert minhash.near_duplicates(df.limit(0)).collect() == [] and minhash.deduplicate(df.limit(0)).collect() == []


def test_several_rows_of_one_id(spark):
    """Rows of one id are linked, whatever they say; one of them stays."""
    long = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(5, long[0]), (5, long[1]), (9, long[1]), (3, long[2]), (9, long[2]), (9, None), (7, None), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {(5, 3, False), (9, 3, False), (3, 3, True), (7, 7, True)}
    assert sorted(r.doc_id for r in minhash.deduplicate(df).collect()) == [3, 7]


def test_long_text(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 3000, 400_000)]
    other = list(words)
    for i in rng.integers(0, len(words), 9000):
        other[i] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "w " * 900_000), (4, "w " * 760_000), (5, "w " * 950_000)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute(rows[:2]) | {3: 3, 4: 3, 5: 3}
    assert got == want


def test_hot_groups(spark):
    """A third of the rows in one group of near copies, and a passage that very many share."""
    rng = np.random.default_rng(21)
    base, passage = [f"b{i}" for i in range(60)], [f"p{i}" for i in range(30)]
    rows = []
    for i in range(700):
        edit = [w if rng.random() > 0.02 else f"e{rng.integers(50)}" for w in base]
        rows.append((i, " ".join(edit)))
    rows += [(1000 + i, " ".join([*passage, *(f"o{i}x{k}" for k in range(int(rng.integers(2, 30))))])) for i in range(500)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)


def test_more_links(spark):
    found = spark.createDataFrame([(2, 1), (1, 1), (5, 4), (4, 4), (9, 8), (8, 8)], "node bigint, component bigint")
    got = joined_by(found, spark.createDataFrame([(2, 5), (20, 21), (9, 9)], "a bigint, b bigint"))
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (4, 1), (5, 1), (8, 8), (9, 8), (20, 20), (21, 20)}


def best_exponent(tokens, target, limit, budget):
    """The exponent on a fine grid: the largest that reaches the entropy, or less where a source would be used too often."""
    total = {s: n for s, n in tokens.items() if n}

    def weights(a):
        raw = {s: float(n) ** a for s, n in total.items()}
        return {s: r / sum(raw.values()) for s, r in raw.items()}

    def most(a):
        w = weights(a)
        whole = budget or max(n / w[s] for s, n in total.items())
        return max(w[s] * whole / n for s, n in total.items())

    want = target * math.log(len(total)) if len(total) > 1 else 0.0
    grid = np.linspace(0, 1, 20001)
    wide = [a for a in grid if -sum(w * math.log(w) for w in weights(a).values()) >= want]
    fit = [a for a in grid if most(a) <= limit]
    # the limit wins over the entropy; where nothing keeps it, shares stay as they are
    return max(max(wide, default=1.0), min(fit, default=1.0)), weights


@pytest.mark.parametrize("target,limit,budget", [(0.95, 2.0, None), (0.99, 50.0, None), (0.9, 4.0, 30_000), (0.5, 1.5, None), (0.97, 2.0, None)])
def test_exponent(target, limit, budget):
    for tokens in ({"a": 90_000, "b": 9_000, "c": 1_000}, {"a": 5, "b": 5, "c": 5}, {"a": 70, "b": 0}, {"a": 10**12, "b": 3, "c": 10**6, "d": 10**6}):
        exponent, weights, epochs = mixing.solve(tokens, target, limit, budget)
        want, of = best_exponent(tokens, target, limit, budget)
        assert abs(exponent - want) < 2e-4, tokens
        assert all(abs(weights[s] - of(exponent).get(s, 0.0)) < 1e-9 for s in tokens)
        whole = budget or max(n / weights[s] for s, n in tokens.items() if n)
        assert all(abs(epochs[s] - (weights[s] * whole / n if n else 1.0)) < 1e-6 * max(1, epochs[s]) for s, n in tokens.items())


def test_mixing_query(spark):
    """The query against plain sums: each source gets its weight's tokens, whole passes first, and each document as often as the next."""
    rows = duckdb.sql(f"select doc_id, source, text from '{SF}/documents.parquet'").fetchall()
    n = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, _, t in rows}
    tokens = Counter()
    for i, s, _ in rows:
        tokens[s] += n[i]
    exponent, of = best_exponent(tokens, mixing.ENTROPY, mixing.REPEATS, None)
    got = queries.op2_mixing(spark, SF).collect()
    used, times = Counter(), Counter()
    for r in got:
        used[r.source] += n[r.doc_id]
        times[r.doc_id] += 1
    w = of(exponent)
    whole = max(t / w[s] for s, t in tokens.items() if t)
    longest = max(n.values())
    for s, t in tokens.items():
        assert abs(used[s] - w[s] * whole) <= 2 * longest + 1e-3 * w[s] * whole, s
        each = {times[i] for i, x, _ in rows if x == s}
        assert min(each) >= 1 and max(each) - min(each) <= 1
    assert len({(r.doc_id, r.mix_epoch) for r in got}) == len(got)
    # within an epoch the documents of a block come together, and a later epoch after an earlier one
    for s in tokens:
        mine = [r for r in got if r.source == s]
        at = {}
        for r in mine:
            at.setdefault((r.mix_epoch, r.mix_block), set()).add(r.mix_at)
        assert all(len(x) == 1 for x in at.values())
        top = {e: (min(r.mix_at for r in mine if r.mix_epoch == e), max(r.mix_at for r in mine if r.mix_epoch == e)) for e in {r.mix_epoch for r in mine}}
        assert all(top[e][1] <= top[e + 1][0] + 1e-12 for e in top if e + 1 in top)


def test_mixing_clashing_names(spark):
    names = ["_s", "_key", "_whole", "_turn", "_k", "_b", "_name", "s", "b", "k", "n", "a.b", "MIX_EPOCH", "mix_at"]
    df = spark.createDataFrame([(i, "w " * (i + 1), "xy"[i % 2], *range(len(names))) for i in range(40)], "doc_id bigint, text string, source string, " + ", ".join(f"`{x}` int" for x in names))
    out = mixing.mix_sources(df)
    assert out.columns == ["doc_id", "text", "source", *names[:-2], "mix_epoch", "mix_block", "mix_at"]
    for r in out.collect():
        assert [r[x] for x in names[:-2]] == list(range(len(names) - 2)) and len(r.text.split()) == r.doc_id + 1


def test_mixing_odd_rows(spark):
    rows = [(1, None, None), (None, "a b", "s"), (None, "a b", "s"), (2, "w " * 800_000, "long"), (3, "", ""), (4, "\u3000x\x1cy", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = Counter((r.doc_id, r.source) for r in mixing.mix_sources(df, limit=3.0).collect())
    assert set(got) == {(i, s) for i, _, s in rows} and got[1, None] == 1 and got[3, ""] == 1 and got[None, "s"] % 2 == 0


@pytest.mark.parametrize("target,limit,budget", [(0.95, 2.0, None), (0.99, 50.0, None), (0.9, 4.0, 30_000), (0.5, 1.5, None)])
def test_mixing(spark, target, limit, budget):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(1, 40)), ["big"] * 6 + ["mid", "mid", "small"], "z") for i in range(900)]
    rows = [(i, t, s[int(rng.integers(9))], z) for i, t, s, z in rows] + [(1000, "w " * 30, None, "z"), (1001, None, "empty", "z"), (1002, "", "empty", "z"), (1003, "w w", "big", "z"), (1003, "w w", "big", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, b string")
    tokens = Counter()
    for _, t, s, _ in rows:
        tokens[s] += len((t or "").split())
    exponent, weights, epochs = mixing.solve(dict(tokens), target, limit, budget)
    n = sum(1 for x in tokens.values() if x)
    assert abs(sum(weights.values()) - 1) < 1e-9
    h = mixing.entropy(list(weights.values()))
    reach = h >= target * math.log(n) - 1e-6
    assert reach or abs(max(epochs.values()) - limit) < 1e-6 or exponent == 1.0
    got = mixing.mix_sources(df, target=target, limit=limit, budget=budget, blocks=16).collect()
    used = Counter()
    for r in got:
        used[r.source] += len((r.text or "").split())
    longest = 2 * max(len((t or "").split()) for _, t, _, _ in rows)
    for s, want in epochs.items():
        assert want * tokens[s] - 1e-6 <= used[s] <= want * tokens[s] + longest, s
    times = Counter((r.doc_id, r.source) for r in got)
    for s in tokens:
        each = [times[(i, s)] for i, _, x, _ in rows if x == s and i != 1003]
        assert max(each) - min(each) <= 1
    if budget is None:
        assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert all(0 <= r.mix_at <= 1 for r in got)
    half = Counter()
    for r in got:
        half[r.source] += (r.mix_at < 0.5) * len((r.text or "").split())
    assert abs(half["big"] / used["big"] - 0.5) < 0.25
    assert mixing.mix_sources(df.limit(0)).collect() == []
