"""Mixing sources to target weights: temperature, budget, block permutations.

A source's weight is its share of tokens to the power of an exponent, normalised. The exponent is found by bisection: the
largest one whose weights reach the target entropy, or, where that would repeat a source more often than allowed, the
smallest one that keeps the limit. Each source then owes its weight's part of a token budget. It pays in
epochs: whole passes over its documents, then one pass that ends when the budget is spent. In each epoch its
documents come in blocks (by a hash of the id), and the blocks in a new order (by a hash of epoch and block); a
source's last pass ends within one block, found from block totals, at one key within it. What a document
gets thus follows from a few numbers for each source: no row is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlore.llm.shared import col, drop, fresh, save, without

#: Target entropy as a part of the largest possible, epochs of a source at most, blocks of a source.
ENTROPY, REPEATS, BLOCKS, SEED = 0.95, 2.0, 1024, 17
#: Sources at most.
SOURCES = 1_000_000
STEPS = 60


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def temper(tokens: dict, exponent: float) -> dict:
    """Normalised weights; a source without tokens has none."""
    top = max(tokens.values(), default=0)
    raw = {s: (n / top) ** exponent if n else 0.0 for s, n in tokens.items()}
    total = sum(raw.values()) or 1.0
    return {s: x / total for s, x in raw.items()}


def repeats(tokens: dict, weights: dict, budget: float | None) -> dict:
    """Epochs of each source. Without a budget, the smallest one that pays every source's documents at least once."""
    paid = {s: n for s, n in tokens.items() if n and weights[s]}
    if budget is None:
        budget = max((n / weights[s] for s, n in paid.items()), default=0.0)
    return {s: weights[s] * budget / n if n else 1.0 for s, n in tokens.items()}


def solve(tokens: dict, target: float = ENTROPY, limit: float = REPEATS, budget: float | None = None) -> tuple[float, dict, dict]:
    """(exponent, weights, epochs). target is a part of the entropy of equal weights; the limit wins over it."""
    n = sum(1 for x in tokens.values() if x)
    want = target * math.log(n) if n > 1 else 0.0

    def bisect(holds) -> float:
        """The end of [0, 1] at which a monotone condition changes, on the side where it holds."""
        good, bad = (1.0, 0.0) if holds(1.0) else (0.0, 1.0)
        if not holds(good):
            return 1.0
        if holds(bad):
            return bad
        for _ in range(STEPS):
            mid = (good + bad) / 2
            good, bad = (mid, bad) if holds(mid) else (good, mid)
        return good

    spread = 1.0 if entropy(list(temper(tokens, 1.0).values())) >= want else bisect(lambda a: entropy(list(temper(tokens, a).values())) >= want)
    allowed = bisect(lambda a: max(repeats(tokens, temper(tokens, a), budget).values(), default=0.0) <= limit * (1 + 1e-12))
    exponent = max(spread, allowed)
    weights = temper(tokens, exponent)
    return exponent, weights, repeats(tokens, weights, budget)


def mix_sources(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", target: float = ENTROPY, limit: float = REPEATS, budget: float | None = None, blocks: int = BLOCKS, seed: int = SEED, prefix: str = "mix_") -> DataFrame:
    """A row for each time that a document is used: df's columns with mix_epoch, mix_block and mix_at (or another prefix).

    Ordering by mix_at interleaves the sources in their weights' proportion. Tokens are white-space-delimited words of the whole
    text; null and empty texts have none. A null source is a source of its own; a source without tokens is used once. With no
    budget every document is used at least once. Repeated rows share their key, so that a last pass takes all or none
    of them and ends within a key of its budget; null keys are one key. Two keys whose hashes tie are taken together. An
    empty table gives none. Columns of df under the three names are replaced, all others stay as they are, whatever they are called.
    There may be SOURCES sources at most, with four numbers each on the driver; more raise ValueError.
    """
    spark = df.sparkSession
    sources, own = spark.createDataFrame, [f"{prefix}{x}" for x in ("epoch", "block", "at")]
    s, b, k, whole_, turn_, key_, epoch_ = fresh("s", "b", "k", "whole", "turn", "key", "epoch")
    name = F.concat(F.when(col(source).isNull(), "-").otherwise("+"), F.coalesce(col(source).cast("string"), F.lit("")))
    count = F.coalesce(F.regexp_count(col(text), F.lit(r"[^ \t-\r]+")), F.lit(0))
    order = F.xxhash64(col(key).cast("string"), F.lit(seed))
    block = F.pmod(F.xxhash64(F.lit(seed + 1), order), F.lit(blocks))

    def turn(epoch, at):
        """Where a block comes in an epoch, in [0, 1)."""
        return F.pmod(F.xxhash64(F.lit(seed + 2), epoch.cast("long"), at), F.lit(1 << 52)) / float(1 << 52)

    # words are counted once; the counts are far smaller than the texts
    base = save(df.select(name.alias("s"), block.alias("b"), order.alias("k"), count.alias("n")), "counted")
    totals = save(base.groupBy("s", "b").agg(F.sum("n").alias("n")), "totals")
    by_source = totals.groupBy("s").agg(F.sum("n").alias("n")).limit(SOURCES + 1).collect()
    if len(by_source) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    tokens = {r.s: r.n for r in by_source}
    _, _, epochs = solve(tokens, target, limit, budget)
    plan = {x: [math.floor(r + 1e-9), max(0.0, r - math.floor(r + 1e-9)) * tokens[x]] for x, r in epochs.items()}
    local = sources([(x, w, r) for x, (w, r) in plan.items()], "s string, whole bigint, rest double")
    # the block in which the last epoch ends: one row for each source
    sums = Window.partitionBy("s").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    ends = totals.join(local, "s").withColumn("turn", turn(F.col("whole"), F.col("b"))).withColumn("before", F.coalesce(F.sum("n").over(sums), F.lit(0)))
    ends = ends.where("before < rest").groupBy("s").agg(F.max_by(F.struct("turn", "b", "before"), "turn").alias("e")).select("s", "e.*").collect()
    last = sources([(r.s, r.b, plan[r.s][1] - r.before) for r in ends], "s string, b bigint, room double")
    by_key = base.join(last, ["s", "b"]).groupBy("s", "k", "room").agg(F.sum("n").alias("n"))
    sums = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    keys = {r.s: r.k for r in by_key.withColumn("before", F.coalesce(F.sum("n").over(sums), F.lit(0))).where("before < room").groupBy("s").agg(F.max("k").alias("k")).collect()}
    drop(spark, base, totals)
    cut = {r.s: r.turn for r in ends}
    local = sources([(x, w, cut.get(x, -1.0), keys.get(x)) for x, (w, _) in plan.items()], f"{s} string, {whole_} bigint, {turn_} double, {key_} bigint")
    out = df.withColumns({s: name, k: order, b: block}).join(local, s)
    mine = turn(F.col(whole_), F.col(b))
    part = (mine < F.col(turn_)) | ((mine == F.col(turn_)) & F.coalesce(F.col(k) <= F.col(key_), F.lit(False)))
    used = F.col(whole_) + part.cast("long")
    out = out.where(used > 0).withColumn(epoch_, F.explode(F.sequence(F.lit(0).cast("long"), used - 1)))
    place = F.when(F.col(epoch_) < F.col(whole_), turn(F.col(epoch_), F.col(b))).otherwise(F.least(F.lit(1.0), mine / F.greatest(F.col(turn_), F.lit(1e-12))))
    at = (F.col(epoch_) + place) / (F.col(whole_) + F.when(F.col(turn_) >= 0, 1).otherwise(0))
    return out.select(*map(col, without(df.columns, *own)), F.col(epoch_).alias(own[0]), F.col(b).alias(own[1]), at.alias(own[2]))
