"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, bands, and verified multiset overlap.

A document is the multiset of its five-word shingles. The weight axis of a shingle (its count) is cut into dyadic
intervals (0, 1], (1, 2], (2, 4], (4, 8], ...; each has a Poisson process of its own, seeded by shingle and interval,
whose points have a time, a register and, within the interval, a weight. A shingle of count c takes the points of
weight up to c, so the points of the smaller of two counts are among those of the larger. A register holds the
earliest point that falls on it; two documents agree on a register with the probability of their weighted Jaccard
similarity. As soon as all registers of a document are full, points later than the latest of them are never made.

Equal multisets are one class from the start. Signatures of class representatives are cut into bands; in a bucket of
equal bands, every member is verified against the smallest one, which gives most links in few pairs. What then is
still apart in a bucket is compared across components by its multisets, so that no linked pair that shares a band is
lost while the pairs within a component are never listed. Two bounds that can't err spare comparisons: sizes that differ
too much, and, as one less the similarity is a distance, the triangle inequality by way of a few pivots.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlore.llm.graph import components, joined_by
from fieldlore.llm.shared import batches, col, drop, fresh, lookup, save, wanted_rows
from fieldlore.llm.words import Words, chunks, mix

#: Words of a shingle, registers, registers of a band, similarity of a link.
WIDTH, REGISTERS, BAND, SIMILARITY = 5, 280, 5, 0.8
#: Points aimed at beyond the mean number that fills all registers, per register.
SPARE = 4.0
CELLS = 1 << 20
#: Rows of a block that is compared with another one, pivots of a block, and rounding allowed where a bound decides.
BLOCK, PIVOTS, EPS = 128, 4, 1e-9


def shingles(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their counts, and the range of each text in them. A text of one to width - 1 words is one shingle."""
    w = Words(texts)
    h, first = w.hashes(), w.first
    n = np.diff(first)
    factor = mix(np.arange(11, 11 + width, dtype="u8")) | np.uint64(1)
    total = max(0, len(h) - width + 1)
    s = np.zeros(total, "u8")
    for k in range(width):
        s += h[k : k + total] * factor[k]
    s = mix(s)
    place = np.concatenate([[0], np.cumsum(np.where(n >= width, n - width + 1, np.minimum(n, 1)))])
    out = np.empty(place[-1], "u8")
    for i, (a, z, b, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), place[:-1].tolist(), place[1:].tolist(), strict=True)):
        if n[i] >= width:
            out[b:e] = s[a : a + e - b]
            out[b:e].sort()
        elif n[i]:
            out[b] = mix((h[a:z] * factor[: z - a]).sum() + np.uint64(z - a))
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    starts = place[:-1][n > 0]
    new[starts] = True
    at = np.flatnonzero(new)
    return out[at], np.diff(np.append(at, len(out))), np.searchsorted(at, place)


def signatures(h: np.ndarray, count: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """One row of registers (64-bit identities of points) for each text; zeros for a text without shingles."""
    texts = len(first) - 1
    who = np.repeat(np.arange(texts), np.diff(first))
    level = np.zeros(len(h), "i8")
    el = np.arange(len(h))
    parts, top, j = [(el, level)], 1, 1
    while len(more := np.flatnonzero(count > top)):
        parts.append((more, np.full(len(more), j)))
        top, j = top * 2, j + 1
    el, level = (np.concatenate(x) for x in zip(*parts, strict=True))
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    span = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    seed = mix(h[el] + level.astype("u8") * np.uint64(0xD1B54A32D192ED03))
    doc, limit = who[el], count[el].astype("f8")
    weight = np.bincount(who, count, texts)
    until = registers * (np.log(registers) + SPARE) / np.maximum(weight, 1)
    best, ident = np.full(texts * registers, np.inf), np.zeros(texts * registers, "u8")
    left = weight > 0
    while left.any():
        live = left[doc]
        s, d, lo, sp, lim = seed[live], doc[live], low[live], span[live], limit[live]
        t, r, b = np.zeros(len(s)), 0, 1
        while len(s):
            point = mix(s[:, None] + np.arange(r + 1, r + b + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
            step = -np.log(((point >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53) / sp[:, None]
            when = np.cumsum(np.concatenate([t[:, None], step], 1), 1)[:, 1:]
            other = mix(point ^ np.uint64(0x2545F4914F6CDD1D))
            mark = lo[:, None] + (other & np.uint64(0xFFFFFFFF)).astype("f8") * 2.0**-32 * sp[:, None]
            ok = (when < until[d][:, None]) & (mark < lim[:, None])
            reg = ((other >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype("i8")
            at, w, p = (d[:, None] * registers + reg)[ok], when[ok], point[ok]
            np.minimum.at(best, at, w)
            won = w == best[at]
            ident[at[won]] = p[won]
            t = when[:, -1]
            live = t < until[d]
            s, d, lo, sp, lim, t = s[live], d[live], lo[live], sp[live], lim[live], t[live]
            r += b
            b = max(1, min(2 * b, 64, CELLS // max(1, len(s))))
            if len(s):
                # what comes after the latest register can't win any more
                until = np.minimum(until, np.maximum(best.reshape(texts, registers).max(1), 0))
                live = t < until[d]
                s, d, lo, sp, lim, t = s[live], d[live], lo[live], sp[live], lim[live], t[live]
        left &= np.isinf(best).reshape(texts, registers).any(1)
        until = np.where(left, 2 * until, until)
        again = np.repeat(left, registers)
        best[again], ident[again] = np.inf, 0
    return ident.reshape(texts, registers)


def band_hashes(sig: np.ndarray, band: int = BAND) -> np.ndarray:
    """One hash for each band of each row; equal only for the same band with the same registers."""
    cut = sig[:, : sig.shape[1] // band * band].reshape(len(sig), -1, band)
    acc = np.broadcast_to(mix(np.arange(cut.shape[1], dtype="u8") + np.uint64(99)), cut.shape[:2]).copy()
    for k in range(band):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, k])
    return acc


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two texts' shingle multisets; 0 where one has no word."""
    bags = Bags([a, b])
    return float(bags.similar(0, np.array([1]))[0]) if bags.size.all() else 0.0


class Bags:
    """Shingle multisets of texts, as sorted hashes with counts in one buffer."""

    def __init__(self, texts: list[str | None]):
        parts = [shingles(texts[a:z]) for a, z in chunks(texts)]
        self.h = np.concatenate([p[0] for p in parts] or [np.zeros(0, "u8")])
        self.count = np.concatenate([p[1] for p in parts] or [np.zeros(0, "i8")])
        self.first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts] or [np.zeros(0, "i8")]))])
        self.size = np.diff(np.concatenate([[0], np.cumsum(self.count)])[self.first])

    def similar(self, k: int, others: np.ndarray) -> np.ndarray:
        """Similarity of bag k to others."""
        own, n = self.h[self.first[k] : self.first[k + 1]], self.count[self.first[k] : self.first[k + 1]]
        a, z = self.first[others], self.first[others + 1]
        if not len(own) or not len(others):
            return np.zeros(len(others))
        who = np.repeat(np.arange(len(others)), z - a)
        at = np.arange(len(who)) + np.repeat(a - np.concatenate([[0], np.cumsum(z - a)[:-1]]), z - a)
        h = self.h[at]
        place = np.searchsorted(own, h)
        place[place == len(own)] = 0
        hit = own[place] == h
        both = np.bincount(who[hit], np.minimum(n[place[hit]], self.count[at[hit]]), len(others))
        return both / np.maximum(self.size[k] + self.size[others] - both, 1)

    def may_link(self, k: int, others: np.ndarray, least: float) -> np.ndarray:
        """Others whose size lets the similarity be reached."""
        n, m = self.size[k], self.size[others]
        return (np.minimum(n, m) >= (least - EPS) * np.maximum(n, m)) & (m > 0)


def sign(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, n (shingles), f1 and f2 (fingerprint of the multiset) and bands of every row."""

    def run(parts):
        for b in parts:
            ids, texts = b.column(0), b.column(1).to_pylist()
            cols: list[list] = [[], [], [], []]
            for a, z in chunks(texts):
                h, count, first = shingles(texts[a:z])
                sig = signatures(h, count, first)
                c = count.astype("u8")
                ends = [np.concatenate([[0], np.cumsum(x * c)]).astype("u8") for x in (mix(h), mix(h ^ np.uint64(0x5851F42D4C957F2D)))]
                cols[0] += np.add.reduceat(np.append(count, 0), first[:-1])[np.arange(z - a)].tolist() if len(count) else [0] * (z - a)
                for k, e in enumerate(ends):
                    cols[1 + k] += (e[first[1:]] - e[first[:-1]]).astype("i8").tolist()
                cols[3] += list(band_hashes(sig).astype("i8"))
            # reduceat gives the next text's value for an empty range
            n = [x if cols[1][i] or cols[2][i] else 0 for i, x in enumerate(cols[0])]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))], names=["id", "n", "f1", "f2", "bands"])

    return df.select(col(key).cast("bigint").alias("id"), col(text)).mapInArrow(run, "id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, t) have at least that similarity. A text a with many pairs is sent once for each block of them."""
    total = pairs.count()
    blocks = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = lookup(pairs, blocks, ["a"], total).select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("s"))
    centres = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s")).join(texts.toDF("a", "ta"), "a")
    joined = dealt.join(texts.toDF("b", "tb"), "b").join(centres, ["a", "s"]).select("a", "b", "ta", "tb")

    def run(parts):
        for batch in parts:
            number: dict[str, int] = {}
            pairs = [(number.setdefault(x, len(number)), number.setdefault(y, len(number))) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            bags = Bags(list(number))
            # rows come in the order of a
            keep, k = np.zeros(len(pairs), bool), 0
            while k < len(pairs):
                z = k
                while z < len(pairs) and pairs[z][0] == pairs[k][0]:
                    z += 1
                keep[k:z] = bags.similar(pairs[k][0], np.array([y for _, y in pairs[k:z]])) >= least
                k = z
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def links_of_few(few: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect, among rows (band, id, c) of a band, whatever components their links connect.

    Large bands are compared in blocks of BLOCK by BLOCK rows, so that no group grows with its band. A pair is looked at
    in the least band that it shares and nowhere else; no pair leaves but the links.
    """
    sizes = few.groupBy("band").agg(F.count("*").alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("band", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    rows = save(lookup(few, sizes, ["band"], few.count()).select("band", "id", "c", "k", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("i")), "rows")
    # an id has no more bands than a signature
    facts = rows.groupBy("id").agg(F.sort_array(F.collect_set("band")).alias("bands"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")
    dealt = rows.select("band", "id", "c", "i", other).select("band", "id", "c", "i", F.least("i", "o").alias("p"), F.greatest("i", "o").alias("q"))
    ids = save(rows.select("id").distinct(), "wanted")
    dealt = dealt.join(facts.join(wanted_rows(texts, "id", ids, ids.count()), "id"), "id")

    def compare(key, g):
        ids, c, i, up, out = g.id.to_numpy(), g.c.to_list(), g.i.to_numpy(), {}, []
        bags, lower = Bags(g.t.to_list()), [set(b[: np.searchsorted(b, key[0])].tolist()) for b in g.bands]

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for k in range(len(g)):
            # a pair of one block is seen in that block's own group alone
            near = np.flatnonzero((ids > ids[k]) & ((i != i[k]) | (key[1] == key[2])))
            near = near[bags.may_link(k, near, least)]
            near = np.array([y for y in near.tolist() if root(c[y]) != root(c[k]) and lower[k].isdisjoint(lower[y])], "i8")
            for y in near[bags.similar(k, near) >= least]:
                if root(c[k]) != root(c[y]):
                    up[root(c[k])] = root(c[y])
                    out.append((ids[k], ids[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    out = save(dealt.groupBy("band", "p", "q").applyInPandas(compare, "a bigint, b bigint").distinct(), "links")
    drop(few.sparkSession, rows, ids)
    return out


def links_to_many(asked: DataFrame, found: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """One link (a, b), if there is any, of each asked (x, main) with each block of that component's members.

    Members and askers are dealt in blocks, each pair of blocks to a group of its own; a text is sent once for each block
    it meets. Sizes, and distances to a block's pivots, say which members an asker can't be linked with; the rest is compared.
    """
    asked = asked.distinct()
    size = found.groupBy("component").agg(F.count("*").alias("members"))
    shape = asked.groupBy(F.col("main").alias("component")).agg(F.count("*").alias("askers")).join(size, "component")
    shape = save(shape.withColumn("nx", F.ceil(F.col("askers") / BLOCK).cast("int")).withColumn("ny", F.ceil(F.col("members") / BLOCK).cast("int")), "shape")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = lookup(found.select("component", F.col("node").alias("id")), shape, ["component"], found.count(), "members")
    members = members.select("component", "id", F.lit(False).alias("asks"), every("nx").alias("p"), block("ny").alias("q"))
    askers = lookup(asked.select(F.col("main").alias("component"), F.col("x").alias("id")), shape, ["component"], asked.count(), "askers")
    askers = askers.select("component", "id", F.lit(True).alias("asks"), block("nx").alias("p"), every("ny").alias("q"))
    dealt = members.union(askers)
    ids = save(dealt.select("id").distinct(), "wanted")
    dealt = dealt.join(wanted_rows(texts, "id", ids, ids.count()), "id")

    def compare(g):
        asks = g.asks.to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        ids, bags, out = g.id.to_numpy(), Bags(g.t.to_list()), []
        theirs = np.flatnonzero(~asks)
        pivots = theirs[:: max(1, len(theirs) // PIVOTS)][:PIVOTS]
        known = 1 - np.stack([bags.similar(p, theirs) for p in pivots])
        for k in np.flatnonzero(asks):
            # |d(x, p) - d(p, y)| is at most d(x, y)
            far = np.abs(known - (1 - bags.similar(k, pivots))[:, None]).max(0)
            near = theirs[(far <= 1 - least + EPS) & bags.may_link(k, theirs, least)]
            hit = near[bags.similar(k, near) >= least]
            if len(hit):
                out.append((min(ids[k], ids[hit[0]]), max(ids[k], ids[hit[0]])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    out = save(dealt.groupBy("component", "p", "q").applyInPandas(compare, "a bigint, b bigint").distinct(), "links")
    drop(found.sparkSession, shape, ids)
    return out


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row for each row of df: its id, class_id, component_id and kept.

    class_id is the smallest id with the same shingle multiset, component_id the smallest id reachable by links of at
    least that similarity; kept marks the rows whose id is their component's. A document without words
    (null, empty, white space) links with nothing but other rows of its id. Rows of one id count as linked, whatever their texts. A row
    without an id has null ids and is kept. Whole texts of any length count; ties don't arise, as smallest ids decide; an
    empty table gives no rows; other columns, whatever they are called, don't matter.
    """
    spark = df.sparkSession
    batches(spark)
    signed = save(sign(df.where(col(key).isNotNull()), key, text), "signed")
    total = signed.count()
    print_of = ["n", "f1", "f2"]
    classes = save(signed.where("n > 0").groupBy(*print_of).agg(F.min("id").alias("class_id"), F.count("*").alias("rows")), "prints")
    # rows that another one stands for; only their numbers travel
    copies = lookup(signed.where("n > 0").select("id", *print_of), classes.where("rows > 1"), print_of, total, "rows").where("id <> class_id").select("id", *print_of)
    reps = signed.where("n > 0").join(copies, ["id", *print_of], "left_anti")
    rows = save(reps.select("id", F.explode("bands").alias("band")), "bands")
    buckets = rows.groupBy("band").agg(F.min("id").alias("center"), F.max("id").alias("far"), F.count("*").alias("n")).where("center <> far").drop("far")
    buckets = save(buckets, "buckets")
    # most bands are one document's alone, and are left behind here
    met = save(lookup(rows, buckets, ["band"], rows.count()), "buckets")
    star = save(met.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    some = star.select(F.col("a").alias("id")).union(star.select("b")).distinct()
    some = save(some, "wanted")
    texts = save(wanted_rows(df.select(col(key).cast("bigint").alias("id"), col(text).alias("t")), "id", some, some.count()), "texts")
    links = save(verify(star, texts, least), "links")
    found = first = save(components(links), "components")
    # what is still apart in a bucket
    label = F.coalesce("component", "id").alias("c")
    inside = save(met.where("n > 2").select("band", "id").join(found, F.col("id") == F.col("node"), "left").select("band", "id", label), "inside")
    parts = inside.groupBy("band", "c").agg(F.count("*").alias("n"))
    mains = parts.groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    apart = save(lookup(inside, mains, ["band"], inside.count()).where("c <> main").select("band", "id", "c", "main"), "apart")
    # a document without a link so far is a component of its own
    alone = apart.select("main").distinct().join(found.select(F.col("node").alias("main")), "main", "left_anti")
    whole = found.union(alone.select("main", F.col("main").alias("component")))
    many = links_to_many(apart.select(F.col("id").alias("x"), "main"), whole, texts, least)
    if not many.isEmpty():
        found = joined_by(found, many)
    now = apart.select("band", "id").join(found, F.col("id") == F.col("node"), "left").select("band", "id", label)
    now = save(now, "apart")
    few = links_of_few(now, texts, least)
    # classes of one id that has several texts
    again = signed.where("n > 0").groupBy("id").agg(F.count_distinct(*print_of).alias("c")).where("c > 1").select("id")
    again = save(signed.join(again, "id").join(classes, print_of).select(F.col("id").alias("a"), F.col("class_id").alias("b")), "links")
    second = found
    if not few.union(again).isEmpty():
        found = joined_by(found, few.union(again))
    named = classes.join(found, F.col("class_id") == F.col("node"), "left").select(*print_of, "class_id", "rows", F.coalesce("component", "class_id").alias("component_id"))
    out = lookup(signed.where("n > 0").select("id", *print_of), named, print_of, total, "rows").select(F.col("id").alias("doc_id"), "class_id", "component_id")
    # a row without words goes with the other rows of its id, if there are any
    bare = signed.where("n = 0").select("id")
    own = out.join(bare.distinct(), F.col("doc_id") == F.col("id"), "left_semi").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))
    out = out.union(bare.join(own, F.col("id") == F.col("doc_id"), "left").select("id", F.coalesce("class_id", "id"), F.coalesce("component_id", "id")))
    out = save(out.withColumn("kept", F.col("doc_id") == F.col("component_id")), "duplicates")
    drop(spark, signed, classes, rows, buckets, met, some, inside, star, texts, links, apart, now, many, few, again, first, second, found)
    return out.union(df.where(col(key).isNull()).select(*[F.lit(None).cast("bigint")] * 3, F.lit(True)))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """df with one row of each group of near-duplicates, with all its columns, whatever they are called.

    Rows as in near_duplicates(): the row with a group's smallest id stays; of several rows with that id the one whose text has the
    smallest hash (of rows with equal texts, any one). Rows without an id all stay. An empty table stays empty.
    """
    (own,) = fresh("id")
    near = near_duplicates(df, key, text, least).where(F.col("doc_id").isNotNull())
    gone = near.groupBy(F.col("doc_id").alias(own)).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    same = col(key).cast("bigint") == F.col(own)
    out = df.join(gone.where("NOT kept").select(own), same, "left_anti")
    repeated = gone.where("kept AND n > 1").select(own)
    if repeated.isEmpty():
        return out
    several = out.join(repeated, same, "left_semi").groupBy(col(key).alias(own)).agg(F.min_by(F.struct(*map(col, df.columns)), F.xxhash64(col(text))).alias("row"))
    return out.join(repeated, same, "left_anti").union(several.select("row.*"))
