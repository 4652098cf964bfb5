"""Quality rules as a short-circuit cascade.

A rule rejects a page or not. On a sample of the documents it is estimated what each rule costs (its own seconds, and
those of the features it has to compute) and which pages it rejects. Rules are then put in order one by one: next comes the rule
with the most rejections per cost among the pages that no rule before it rejects, where a feature that a rule
before it has computed costs nothing any more. A document leaves at the first rule that rejects it. The
order changes what a verdict costs, never the verdict.
"""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlore.llm.shared import batches, by_place, col, without

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"
#: Documents (by hash of the text, about) on which costs are estimated.
SAMPLE = 2000


@lru_cache(maxsize=1)
def cases() -> np.ndarray:
    """For each code point 2 for a capital letter (category Lu), 1 for another letter (L), 0 for the rest."""
    kind = map(unicodedata.category, map(chr, range(0x110000)))
    return np.fromiter((2 if k == "Lu" else k[0] == "L" for k in kind), "u1", 0x110000)


class Page:
    """A text whose features are computed when a rule first asks for them. Null counts as empty."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANK))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a three-word window found at least twice."""
        n = self.n_words
        if n < 4:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.fromiter([seen.setdefault(w, len(seen)) for w in self.words], "i8", n)
        if len(seen) == n:
            return 0
        pair = ids[:-1] * n + ids[1:]
        if n > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        _, at, count = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
        cover = np.zeros(n, bool)
        twice = np.flatnonzero(count[at] > 1)
        for k in range(3):
            cover[twice + k] = True
        return int(cover.sum())

    @cached_property
    def case_counts(self) -> tuple[int, int]:
        """(letters, capital letters)."""
        codes = np.frombuffer(self.text.encode("utf-32-le", "replace"), "<u4")
        n = np.bincount(cases()[codes], minlength=3)
        return int(n[1] + n[2]), int(n[2])

    @cached_property
    def n_marks(self) -> int:
        return self.text.count("!")

    @property
    def base_failed(self) -> bool:
        return any(r.rejects(self) for r in BASE)


@dataclass(frozen=True)
class Rule:
    """A rule and the features of a page that it asks for."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Page], bool]


#: The rules that the base verdict consists of.
BASE = (
    Rule("too_short", ("n_words",), lambda p: p.n_words < 50),
    Rule("repetition", ("n_words", "n_repeat_words"), lambda p: 100 * p.n_repeat_words > 50 * p.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", ("n_words", "n_symbols"), lambda p: 10 * p.n_symbols > p.n_words),
    Rule("shouting", ("case_counts",), lambda p: 2 * p.case_counts[1] > p.case_counts[0]),
    Rule("exclaiming", ("n_words", "n_marks"), lambda p: 10 * p.n_marks > 3 * p.n_words),
    Rule("duplicate_lines", ("lines", "n_dup_lines"), lambda p: 10 * p.n_dup_lines > 4 * len(p.lines)),
    Rule("word_length", ("n_words", "word_chars"), lambda p: not 2 * p.n_words <= p.word_chars <= 20 * p.n_words),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Costs:
    """What a sample says: seconds a page of each feature and of each rule's own test, and how many pages each set of rules rejects."""

    features: dict[str, float]
    tests: dict[str, float]
    rejected: dict[frozenset, int]


def features_of(rules: Iterable[Rule]) -> list[str]:
    """Features in an order in which none is computed while another is measured: words and lines come first."""
    needed = list(dict.fromkeys(n for r in rules for n in r.needs))
    return [*(n for n in ("words", "n_words", "lines") if n in needed or n == "words"), *(n for n in needed if n not in ("words", "n_words", "lines"))]


def measure(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample: int = SAMPLE) -> Costs:
    """Costs on about sample documents of df (by hash of the text, so that repeated texts are taken together; all of a small table). An empty table costs and rejects nothing."""
    batches(df.sparkSession)
    n = df.count()
    share = min(1.0, sample / max(1, n))
    some = df.select(text).where(F.pmod(F.xxhash64(col(text)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    names = features_of(rules)

    def run(parts):
        spent, seen = np.zeros(len(names) + len(rules)), {}
        for b in parts:
            for t in b.column(0).to_pylist():
                p, at = Page(t), 0
                for name in names:
                    began = time.perf_counter()
                    getattr(p, name)
                    spent[at] += time.perf_counter() - began
                    at += 1
                hit = 0
                for k, r in enumerate(rules):
                    began = time.perf_counter()
                    hit |= bool(r.rejects(p)) << k
                    spent[at] += time.perf_counter() - began
                    at += 1
                seen[hit] = seen.get(hit, 0) + 1
        rows = [(-1 - k, 0, x) for k, x in enumerate(spent.tolist())] + [(h, c, 0.0) for h, c in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["k", "n", "spent"])

    # a row for each feature and rule, and for each set of rules that rejects a page of the sample
    got = some.mapInArrow(run, "k bigint, n bigint, spent double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("spent").alias("spent")).collect()
    pages = max(1, sum(r.n for r in got if r.k >= 0))
    each = {-1 - r.k: r.spent / pages for r in got if r.k < 0}
    sets = {frozenset(rules[i].name for i in range(len(rules)) if r.k >> i & 1): r.n for r in got if r.k >= 0}
    return Costs({x: each.get(k, 0.0) for k, x in enumerate(names)}, {r.name: each.get(len(names) + k, 0.0) for k, r in enumerate(rules)}, sets)


def arrange(costs: Costs, rules: tuple[Rule, ...] = RULES, paid: Iterable[str] = ()) -> list[tuple[str, float, float]]:
    """(rule, marginal seconds a page, share rejected of the pages left) in the order in which rules should run.

    paid names features that are there anyway. Ties go to the first rule by name; rules that reject nothing more come last.
    """
    there, left, out, rest = {"words", *paid}, dict(costs.rejected), [], {r.name: r for r in rules}
    while rest:
        pages = sum(left.values())
        choice = []
        for r in rest.values():
            cost = costs.tests[r.name] + sum(costs.features.get(n, 0.0) for n in r.needs if n not in there)
            share = sum(n for s, n in left.items() if r.name in s) / pages if pages else 0.0
            choice.append((-share / max(cost, 1e-9), r.name, cost, share))
        _, name, cost, share = min(choice)
        out.append((name, cost, share))
        there |= set(rest.pop(name).needs)
        left = {s: n for s, n in left.items() if name not in s}
    return out


def in_order(df: DataFrame, rules: tuple[Rule, ...], order: list[str] | None, text: str, paid: Iterable[str] = ()) -> list[Rule]:
    by_name = {r.name: r for r in rules}
    if order is None:
        order = [x[0] for x in arrange(measure(df, rules, text), rules, paid)]
    return [by_name[n] for n in order if n in by_name]


def cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each document's verdict, with what the base rules count.

    Returns the kept columns (but those with a name of its own) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and kept. As these counts are wanted for every document, they count as paid for in the order; the base rules
    come first, and the others run only on what these leave, up to the first that rejects. Without an order, it is estimated from df.
    A null or empty text has no words and fails; whole texts of any length are read; repeated rows each get a row; an empty table has none.
    """
    batches(df.sparkSession)
    others = tuple(r for r in rules if r not in BASE)
    ordered = in_order(df, others, order, text, COUNTS)
    keep = without(["doc_id"] if keep is None else keep, *COUNTS, "base_failed", "kept")
    fields = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} bigint" for c in COUNTS), "base_failed boolean, kept boolean"])

    def run(parts):
        for b in parts:
            out = []
            for t in b.column(len(keep)).to_pylist():
                p = Page(t)
                failed = p.base_failed
                out.append((*(getattr(p, c) for c in COUNTS), failed, not failed and not any(r.rejects(p) for r in ordered)))
            cols = list(zip(*out, strict=True)) or [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.bool_()) for c in cols[5:]]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *arrays], names=[*keep, *COUNTS, "base_failed", "kept"])

    return by_place(df.select(*map(col, keep), col(text))).mapInArrow(run, fields)


def keep_good(df: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, text: str = "text") -> DataFrame:
    """The rows of df that no rule rejects, with all their columns, whatever they are called.

    A rejected document costs no more than the rules up to the one that rejects it. A null or empty text has no words and is
    too short; whole texts of any length are read; repeated rows share a verdict; an empty table stays empty.
    """
    batches(df.sparkSession)
    ordered, at = in_order(df, rules, order, text), df.columns.index(text)

    def run(parts):
        for b in parts:
            keep = []
            for t in b.column(at).to_pylist():
                p = Page(t)
                keep.append(not any(r.rejects(p) for r in ordered))
            yield b.filter(pa.array(keep, pa.bool_()))

    plain = by_place(df)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


#: DuckDB SQL for cascade() with RULES.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, [ws[i], ws[i + 1], ws[i + 2]] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g),
q AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY r),
b AS (SELECT w.r, doc_id, t, ls, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(q.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper,
  length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks FROM w LEFT JOIN q ON q.r = w.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_upper > n_letters OR 10 * n_marks > 3 * n_words
    OR 10 * n_dup_lines > 4 * len(ls) OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM f
"""
