"""Quality rules, language identification and toxicity: brute force, held-out accuracy, odd rows."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlore.llm import language, queries, rules, toxicity
from fieldlore.llm.words import BASE as toxicity_base
from fieldlore.llm.words import WEIGHT as toxicity_weight
from fieldlore.llm.words import mix

SF = "/root/testdata/sf0.01"


def brute(text):
    t = text or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    cover = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_rules(spark):
    texts = [None, "", "   \n", "a b c a b c", "x " * 60, "a\x1cb c\x85d e f", "l\nl\nm\n\nl ", "# $ %|", "word " * 3 + "\nword word word\nq", "ÄÖ Ü " * 30]
    texts += [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' limit 200").fetchall()]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "x", "y")], "doc_id bigint, text string, kept string")
    got = {r.doc_id: r for r in rules.cascade(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), repr(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    names = [r.name for r in rules.RULES]
    assert rules.cascade(df, keep=["doc_id", "kept"]).columns == ["doc_id", *rules.COUNTS, "base_failed", "kept"]
    for order in (names, names[::-1]):
        assert {r.doc_id: r.kept for r in rules.cascade(df, order=order).collect()} == {k: r.kept for k, r in got.items()}
    good = rules.keep_good(df, order=names)
    assert good.columns == df.columns and {r.doc_id for r in good.collect()} == {k for k, r in got.items() if r.kept}
    assert rules.cascade(df.limit(0)).collect() == [] == rules.keep_good(df.limit(0)).collect()
    assert sorted(x[0] for x in rules.arrange(rules.measure(df))) == sorted(names)
    twice = rules.keep_good(df.union(df).withColumn("a.b", F.lit(1)), order=names)
    assert len(twice.collect()) == 2 * len(good.collect()) and twice.columns[-1] == "a.b"


def test_order_of_rules():
    """The order is the best next one by rejections per marginal cost among the pages left, tried by hand."""
    named = tuple(rules.Rule(n, needs, lambda p: False) for n, needs in (("a", ("x", "y")), ("b", ("y",)), ("c", ("z",)), ("d", ("x",))))
    costs = rules.Costs({"x": 5.0, "y": 1.0, "z": 2.0}, {"a": 0.5, "b": 0.5, "c": 0.5, "d": 0.5}, {frozenset("ad"): 40, frozenset("b"): 10, frozenset("bc"): 20, frozenset(): 30})
    # b: 30 of 100 for 1.5; then of 70 pages a 40 for 5.5, d 40 for 5.5, c none; then of 30 nobody: by name
    assert rules.arrange(costs, named) == [("b", 1.5, 0.3), ("a", 5.5, 40 / 70), ("c", 2.5, 0.0), ("d", 0.5, 0.0)]
    # what is paid for costs nothing
    assert [x[0] for x in rules.arrange(costs, named, paid=["x"])][0] == "d"
    assert [x[1:] for x in rules.arrange(rules.Costs({}, dict.fromkeys("abcd", 0.0), {}), named)] == [(0.0, 0.0)] * 4


def test_cascade_stops():
    """A page is done at the first rule that rejects it, and no feature of a later rule is computed."""
    page = rules.Page("word " * 20)
    ordered = [rules.RULES[0], rules.RULES[1]]
    assert any(r.rejects(page) for r in ordered) and "n_repeat_words" not in page.__dict__


def test_capital_letters(spark):
    """Letters and capitals are those of the Unicode categories, in code and in SQL."""
    texts = ["Ⅷ7z " * 60, "ⒶⒷ a " * 60, "ǅz " * 60, "ÄB c " * 60, "𝐀𝐁 c " * 60, "一B " * 60, "ªA " * 60, "\u0345B c " * 60, "X y! " * 60, "𐐀A b " * 60]
    df = spark.createDataFrame([(i, " ".join(f"{t}{k}" for k, t in enumerate(x.split()))) for i, x in enumerate(texts)], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in rules.cascade(df).collect())
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert got == sorted(con.sql(rules.ORACLE_SQL).fetchall())
    assert [r[-1] for r in got[:4]] == [True, True, True, False]


def test_very_long_texts(spark):
    text = " ".join(f"word{i % 9000} Other{i}" for i in range(300_000)) + "\n" + "x" * 400_000
    df = spark.createDataFrame([(1, text), (2, text + " y")], "doc_id bigint, text string")
    r = rules.cascade(df).orderBy("doc_id").collect()[0]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text) and r.kept
    train = spark.createDataFrame([(1, "the quick brown fox " * 9, "en"), (2, "der schnelle braune fuchs " * 9, "de"), (3, text, "en")], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in language.predict(df, *language.train(train)).collect()} == {"en"}
    slot, m = toxicity.train(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int"), support=1, gain=-1.0)
    assert all(0 <= r.score <= 1 for r in toxicity.score(df, slot, m).collect())


def test_rules_match_sql_and_labels(spark):
    got = sorted(tuple(r) for r in queries.op7_rules(spark, SF).collect())
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(duckdb.sql(rules.ORACLE_SQL).fetchall())
    quality = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    rows = [r for r in got if r[0] in quality and not r[6]]
    assert np.mean([r[7] == bool(quality[r[0]]) for r in rows]) > 0.99


def test_language(spark):
    rows = queries.op6_language(spark, SF).collect()
    true = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(rows) == len(true) and np.mean([r.lang_pred == true[r.doc_id] for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def plain_trigrams(text):
    """Hashed trigrams in plain integers."""
    x = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
    out = []
    for a, b, c in zip(x, x[1:], x[2:], strict=False):
        if b != 32:
            h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
            out.append((h * 0x27D4EB2F & 0xFFFFFFFF) >> 16)
    return Counter(out)


def plain_mixture(counts, like):
    """Expectation-maximisation in loops: proportions and the log-likelihood."""
    k = len(next(iter(like.values())))
    p, n = [1 / k] * k, sum(counts.values())
    for _ in range(2000):
        q = [0.0] * k
        for g, c in counts.items():
            total = sum(a * b for a, b in zip(p, like[g], strict=True))
            for i in range(k):
                q[i] += c / n * p[i] * like[g][i] / total
        moved = max(abs(a - b) for a, b in zip(p, q, strict=True))
        p = q
        if moved < 1e-5:
            break
    return p, sum(c * math.log(sum(a * b for a, b in zip(p, like[g], strict=True))) for g, c in counts.items())


def test_language_query_by_brute_force(spark):
    """The query over a whole small table, with counts, mixture and selection in plain Python."""
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text, lang from '{sf}/documents.parquet' order by 1").fetchall()
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    seen = {}
    for i, t, lang in rows:
        if not held[i] and lang is not None:
            seen.setdefault(lang, Counter()).update(plain_trigrams(t or ""))
    names = sorted(seen)
    total = {x: sum(seen[x].values()) + 0.5 * 65536 for x in names}
    got = {r.doc_id: r for r in queries.op6_language(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows[::7]:
        counts = plain_trigrams(t or "")
        if not counts:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        raw = {g: [math.log((seen[x][g] + 0.5) / total[x]) for x in names] for g in counts}
        like = {g: [math.exp(v - max(r)) for v in r] for g, r in raw.items()}
        p, _ = plain_mixture(counts, like)
        order = sorted(range(len(names)), key=lambda k: -p[k])
        chosen, share = order[:1], [1.0]
        best = sum(c * math.log(like[g][chosen[0]]) for g, c in counts.items())
        for k in order[1:]:
            more = [*chosen, k]
            q, gained = plain_mixture(counts, {g: [r[j] for j in more] for g, r in like.items()})
            if gained - best <= 3 * math.log(sum(counts.values()) + 1):
                break
            chosen, share, best = more, q, gained
        top = max(range(len(chosen)), key=lambda k: share[k])
        assert got[i].lang_pred == names[chosen[top]] and got[i].held_out == held[i]
        assert got[i].score == pytest.approx(share[top], abs=2e-4) and len(got[i].langs) == len(chosen)


def test_languages_odd_tables(spark):
    odd = spark.createDataFrame([(1, "aaa bbb", "x"), (2, "aaa bbb", "b")], "doc_id bigint, text string, lang string")
    names, model = language.train(odd)
    # equal languages tie: the first by name
    (r,) = language.predict(odd.where("doc_id = 1"), names, model).collect()
    assert r.lang_pred == "b" and r.score == 1.0
    assert language.predict(odd.limit(0), names, model).collect() == []
    clash = odd.withColumn("score", F.lit("s")).withColumn("langs", F.lit(1)).withColumn("a.b", F.lit(2))
    assert language.predict(clash, names, model, keep=["score", "langs", "a.b"]).columns == ["a.b", "lang_pred", "score", "langs"]
    with pytest.raises(ValueError, match="languages"):
        language.train(spark.range(language.LANGUAGES + 1).selectExpr("'x' AS text", "string(id) AS lang"))


def test_letters_of_every_plane(spark):
    """CJK extensions G and H are letters, private and unassigned code points are none."""
    assert all(len(language.trigrams(chr(c))) == chr(c).isalpha() for c in (0x20000, 0x2FFFF, 0x30000, 0x3134A, 0x31350, 0x323AF, 0x323B0, 0xE0041, 0xF0000, 0x10FFFF))
    rare = "".join(map(chr, range(0x30000, 0x30040)))
    train = spark.createDataFrame([(1, "the quick brown fox " * 20, "en"), (2, rare * 20, "zh")], "doc_id bigint, text string, lang string")
    (got,) = language.predict(spark.createDataFrame([(1, rare)], "doc_id bigint, text string"), *language.train(train)).collect()
    assert got.lang_pred == "zh" and got.score > 0.9


def test_mixture_and_odd_texts(spark):
    en, de = "the quick brown fox jumps over the lazy dog and runs ", "der schnelle braune fuchs springt über den faulen hund und läuft "
    train = spark.createDataFrame([(1, en * 20, "en"), (2, de * 20, "de"), (3, None, "de"), (4, en, None)], "doc_id bigint, text string, lang string")
    names, model = language.train(train)
    assert names == ["de", "en"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, en * 40 + de * 20), (5, de), (5, de), (6, "Ж"), (None, en)], "doc_id bigint, text string")
    got = [(r.doc_id, r.lang_pred, r.score, r.langs) for r in language.predict(odd, names, model).collect()]
    by = {g[0]: g for g in got}
    assert all(by[i][1:3] == ("und", 0.0) for i in (1, 2, 3)) and len(got) == 8
    assert by[4][1] == "en" and set(by[4][3]) == {"en", "de"} and abs(by[4][2] - 0.62) < 0.05
    assert by[5][1] == "de" and set(by[5][3]) == {"de"} and by[6][1] in names
    none = language.train(train.where("false"))
    assert {r.lang_pred for r in language.predict(odd, *none).collect()} == {"und"}


def test_mixture_is_a_maximum():
    rng = np.random.default_rng(3)
    like = rng.dirichlet(np.ones(50), 3).T
    counts = rng.multinomial(4000, like @ [0.5, 0.3, 0.2]).astype("f8")
    p, best = language.mixture(counts, like, 400)
    grid = [(a, b) for a in np.linspace(0.01, 0.98, 60) for b in np.linspace(0.01, 0.98, 60) if a + b < 0.995]
    assert best >= max(counts @ np.log(like @ [a, b, 1 - a - b]) for a, b in grid) - 0.5
    assert np.abs(p - [0.5, 0.3, 0.2]).max() < 0.08


def test_toxicity(spark):
    rows = queries.op8_toxicity(spark, SF).collect()
    true = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    held = [r for r in rows if r.held_out and r.doc_id in true]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == true[r.doc_id] for r in held]) > 0.95
    assert len(rows) == duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]


def test_toxicity_query_by_brute_force(spark):
    """Scores of the query from its own machine, in loops over words, their starts and pairs of terms."""
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by 1").fetchall()
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("crc32(cast(doc_id as string)) % 5 <> 0")
    slot, m = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    assert len(m.w) > 3
    known = {}

    def slot_of(word, n):
        if (word, n) not in known:
            text = word if n is None else word[:n]
            h = sum(int(toxicity_weight[b]) * pow(toxicity_base, k, 1 << 64) for k, b in enumerate(text)) + len(text) * 0xA0761D6478BD642F + (n or 0)
            known[word, n] = int(slot[int(mix(np.array([h % (1 << 64)], "u8"))[0]) >> (64 - toxicity.BITS)])
        return known[word, n]

    got = {r.doc_id: r.score for r in queries.op8_toxicity(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t in rows[::3]:
        words = [w for w in re.split(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower().encode()) if w]
        x = sorted({s for w in set(words) for s in [slot_of(w, None), *(slot_of(w, n) for n in toxicity.PREFIXES if len(w) > n)]} - {-1})
        y = m.bias + sum(m.w[a] for a in x) + sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(x) for b in x[k + 1 :])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, y)))), abs=1e-9)


def test_machine_learns_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((1500, 6)) < 0.5
    y = (x[:, 0] & x[:, 1]) | (~x[:, 0] & ~x[:, 1])  # no single feature tells anything
    who, what = np.nonzero(x)
    m = toxicity.Machine(6).fit(1500, who, what, y.astype("f8"), epochs=120)
    assert np.mean((m.score(1500, who, what) >= 0.5) == y) > 0.95
    s, v = m.raw(1500, who, what)[0], m.v
    for i in range(20):
        f = np.flatnonzero(x[i])
        assert s[i] == pytest.approx(m.bias + m.w[f].sum() + sum(v[a] @ v[b] for k, a in enumerate(f) for b in f[k + 1 :]))


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "scum")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    slot, m = toxicity.train(docs, none)
    assert [r.score for r in toxicity.score(docs, slot, m).collect()] == [0.5] * 5
    slot, m = toxicity.train(docs, spark.createDataFrame([(1, 0), (3, None), (None, 1)], "doc_id bigint, toxic int"))
    assert all(r.predicted == 0 for r in toxicity.score(docs, slot, m).collect())
    assert toxicity.score(docs.limit(0), slot, m).collect() == [] == toxicity.remove_toxic(docs.limit(0), slot, m).collect()
    clash = docs.withColumn("score", F.lit(1)).withColumn("y", F.lit(2)).withColumn("_toxic", F.lit(3)).withColumn("a.b", F.lit(4))
    slot, m = toxicity.train(clash, spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, toxic int"))
    assert toxicity.score(clash, slot, m, keep=["y", "score", "a.b"]).columns == ["y", "a.b", "score", "predicted"]
    assert toxicity.remove_toxic(clash, slot, m).columns == clash.columns
