"""Near-duplicate vectors by product quantisation.

Unit vectors are dealt to coarse lists (k-means centroids, fitted on a bounded sample); what is left of a vector after
its centroid is coded in subspaces, one byte each. Each list has a core, the members so near the centroid that any two of them are
linked, and the rest. A vector probes the cores and rests that may hold a neighbour. A neighbour is at most a distance r away; so the list's
outermost member must be no farther than r, and the vector no farther than s from the bisector between the list's centroid and its own one. With
s = r no neighbour can be missed; but a step of length r in a direction that has nothing to do with the line between two centroids
moves along it by r / sqrt(dimension) only (one standard deviation), so that sufficient probes end at SIGMAS of these.

Where a vector is so near a core that it is linked with all of it, numbers alone are passed on: a large group of near copies
costs a row for each vector and core, never its pairs. In other lists that it probes, distances to all members come from tables (the
probing vector exact, the members by code); who is nearer than r plus the member's own coding error is reranked
by the exact cosine. Lists are compared in blocks; a block gives counts for each vector and a spanning forest of its links.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from fieldlore.llm.graph import components
from fieldlore.llm.shared import batches, col, drop, lookup, save

COSINE = 0.93
#: Vectors and numbers to fit on at most (about), coarse lists at most, subspaces, codes, vectors of a block.
SAMPLE, VALUES, LISTS, SUBSPACES, CODES, BLOCK = 65_536, 8_000_000, 4096, 8, 64, 1024
#: Standard deviations of a link's step across a bisector up to which lists are probed; infinity makes the bound strict.
SIGMAS = 4.0
#: Lengths of vectors that get lists and codes of their own, the most frequent ones; of others all pairs are compared, in blocks.
LENGTHS = 16
#: Rounding allowed on distances before the exact cosine decides.
EPS = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids of x; no more than there are distinct rows."""
    x = x.astype("f8")
    start = np.unique(x, axis=0)
    c = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(rounds):
        near = nearest(x, c)
        order = np.argsort(near, kind="stable")
        hit, at = np.unique(near[order], return_index=True)
        c = c.copy()
        c[hit] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.append(at, len(x)))[:, None]
    return c


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 22) // len(c))
    return np.concatenate([squares(x[i : i + step], c).argmin(1) for i in range(0, len(x), step)] or [np.zeros(0, "i8")])


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their greatest magnitude to one half or more: cosines stay, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Quantiser:
    """Coarse centroids and the code book of each subspace, for vectors of one length, fitted on unit vectors x out of total."""

    def __init__(self, x: np.ndarray, total: int):
        self.size = x.shape[1]
        self.coarse = kmeans(x, max(1, min(LISTS, len(x) // 16, math.isqrt(total))))
        self.cuts = [a for a in np.array_split(np.arange(self.size), min(SUBSPACES, self.size)) if len(a)]
        rest = x - self.coarse[nearest(x, self.coarse)]
        self.books = [kmeans(rest[:, a], CODES, seed=5 + i) for i, a in enumerate(self.cuts)]
        gap = np.sqrt(squares(self.coarse, self.coarse))
        self.gap = np.where(gap > 0, gap, np.inf)
        # over how many dimensions the vectors spread: the participation ratio of the variances
        spread = np.linalg.eigvalsh(np.atleast_2d(np.cov(x.T))) if len(x) > 1 else np.ones(1)
        self.dimension = max(1.0, float(spread.sum() ** 2 / max((spread**2).sum(), 1e-300)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, coding error and distance to the centroid of each row."""
        own = nearest(x, self.coarse)
        rest = x - self.coarse[own]
        codes = np.stack([nearest(rest[:, a], b) for a, b in zip(self.cuts, self.books, strict=True)], 1)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return own, codes.astype("u1"), np.sqrt(((rest - back) ** 2).sum(1)), np.sqrt((rest**2).sum(1))

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float, radius: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """Which parts of lists (rests, then cores, with these radii) may hold a vector no farther than reach, and to which ones' members all are no farther (rows by parts)."""
        n = len(self.coarse)
        d = squares(x, self.coarse)
        side = (d - d[np.arange(len(x)), own][:, None]) / (2 * self.gap[own])
        away = np.sqrt(d)
        near = np.tile(side <= reach * min(1.0, sigmas / math.sqrt(self.dimension)) + EPS, 2) & (np.tile(away, 2) <= reach + radius + EPS)
        near |= np.tile(np.arange(n) == own[:, None], 2)
        sure = np.tile(away, 2) + radius <= reach - EPS
        sure[:, :n] = False
        return near & (radius >= 0), sure & (radius >= 0)

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of rows x to the coded members of a list, summed from tables (members by rows)."""
        rest = x - self.coarse[at]
        out = np.zeros((len(codes), len(x)))
        for i, (a, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += squares(b, rest[:, a])[codes[:, i]]
        return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, of rows that scaled() gave."""
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links connect."""
    up: dict[int, int] = {}
    out = []

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def link_vectors(df: DataFrame, least: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", sigmas: float = SIGMAS) -> DataFrame:
    """One row for each row of df: vec_id, n_links, component_id and kept.

    Rows link when their labels are equal and not null, their vectors of equal length, and the cosine in double precision
    is at least that; vectors of any finite magnitude do. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing. Repeated rows of one id and vector are one vector; kept marks the rows whose id is their component's.
    A null id has null results; an empty table has no rows; ties don't arise, as smallest ids decide; other columns don't matter.

    With sigmas at infinity every link is found. The default looks at far fewer lists; the README has the recall measured.
    """
    spark = df.sparkSession
    batches(spark)
    x, i, c = col(vector), col(key), col(label)
    kind = "float" if isinstance(t := df.schema[vector].dataType, ArrayType) and isinstance(t.elementType, FloatType) else "double"
    ok = c.isNotNull() & i.isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    # zeros have one sign
    plain = F.transform(x, lambda v: (v.cast("double") + 0.0).cast(kind))
    rows = df.where(ok).select(i.cast("bigint").alias("id"), c.alias("label"), plain.alias("v"))
    same = rows.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n"), F.count("*").alias("rows"))
    # numbered when written, and never again
    same = save(same.withColumn("class", F.monotonically_increasing_id()), "classes")
    lengths = {r.d: r.n for r in same.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(LENGTHS).collect()}
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    books = {}
    for d, n in lengths.items():
        share = int(min(1.0, min(SAMPLE, max(20_000, 16 * math.isqrt(n)), VALUES // d) / n) * (1 << 20)) + 1
        some = same.where((F.size("v") == d) & (F.pmod(F.xxhash64("rep", "v"), F.lit(1 << 20)) < share)).select("v").toPandas()
        some = np.array(some.v.tolist(), "f8").reshape(-1, d)
        if len(some):
            books[d] = Quantiser(units(some[np.lexsort(some.T)]), n)
    sent = spark.sparkContext.broadcast(books)
    label_kind = df.schema[label].dataType.simpleString()

    def code(parts):
        for g in parts:
            g = g.reset_index(drop=True)
            for d, k in g.groupby(g.v.map(len)).groups.items():
                p = g.loc[k]
                out = pd.DataFrame({"label": p.label, "v": p.v, "rep": p.rep, "n": p.n, "class": p["class"], "d": d, "part": 0, "core": False, "codes": b"", "error": 0.0, "far": 0.0})
                if d in sent.value:
                    q = sent.value[d]
                    own, codes, error, far = q.encode(units(np.array(p.v.tolist(), "f8").reshape(-1, d)))
                    core = far <= (reach - EPS) / 2
                    out = out.assign(part=own + len(q.coarse) * core, core=core, codes=[c.tobytes() for c in codes], error=error, far=far)
                yield out

    coded = save(same.drop("rows").mapInPandas(code, f"label {label_kind}, v array<{kind}>, rep bigint, n bigint, class bigint, d int, part int, core boolean, codes binary, error double, far double"), "coded")
    total = coded.count()
    # parts without a member have no radius
    radius = {d: np.full(2 * len(q.coarse), -1.0) for d, q in books.items()}
    for r in coded.where(F.col("d").isin([*books])).groupBy("d", "part").agg(F.max("far").alias("far")).collect():
        radius[r.d][r.part] = r.far
    radii = spark.sparkContext.broadcast(radius)

    def probe(parts):
        for g in parts:
            for d, p in g.groupby("d"):
                q = sent.value[d]
                own, part = p.part.to_numpy() % len(q.coarse), p.part.to_numpy()
                near, sure = q.probes(units(np.array(p.v.tolist(), "f8").reshape(-1, d)), own, reach, radii.value[d], sigmas)
                # of a pair in two parts, the one in the lower part probes; cores come after all rests
                k, at = np.nonzero((near | sure) & (np.arange(near.shape[1]) > part[:, None]))
                yield pd.DataFrame({"label": p.label.to_numpy()[k], "d": d, "part": at, "class": p["class"].to_numpy()[k], "rep": p.rep.to_numpy()[k], "n": p.n.to_numpy()[k], "sure": sure[k, at]})

    asks = coded.where(F.col("d").isin([*books])).select("label", "d", "part", "class", "rep", "n", "v").mapInPandas(probe, f"label {label_kind}, d int, part int, class bigint, rep bigint, n bigint, sure boolean")
    asks = save(asks, "asks")
    at = ["label", "d", "part"]
    # one row for each part of a label: its members, what they count, the first of them, who asks, and what is linked with all
    shape = coded.groupBy(*at).agg(F.count("*").alias("members"), F.sum("n").alias("size"), F.min("rep").alias("lead"))
    asked = asks.groupBy(*at).agg(F.count(F.when(~F.col("sure"), 1)).alias("askers"), F.count("*").alias("asks"), F.sum(F.when(F.col("sure"), F.col("n"))).alias("credit"))
    shape = save(shape.join(asked, at, "left").fillna(0, ["askers", "asks", "credit"]), "shape")
    known = shape.select(*at, "size", "lead", "credit", F.ceil(F.col("members") / BLOCK).cast("int").alias("k"), F.ceil(F.col("askers") / BLOCK).cast("int").alias("ka"), "members", "asks")
    members = save(lookup(coded.select(*at, "core", "class", "rep", F.col("n").alias("own")), known, at, total, "members"), "members")
    asking = lookup(asks.select(*at, F.col("class"), F.col("rep"), F.col("n").alias("own"), "sure"), known, at, asks.count(), "asks")
    block = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # blocks of a rest meet each other once: the lower block's rows are its members, the higher block's ask
    both = members.where("NOT core AND members > 1").select(*at, "class", block("k").alias("q"), every(F.col("k")).alias("o"))
    inside = both.select(*at, "class", (F.col("q") > F.col("o")).cast("int").alias("role"), F.greatest("q", "o").alias("p"), F.least("q", "o").alias("q"), F.lit(True).alias("own"))
    outside = members.where("ka > 0").select(*at, "class", F.lit(0).alias("role"), every(F.col("ka")).alias("p"), block("k").alias("q"), F.lit(False).alias("own"))
    others = asking.where("NOT sure").select(*at, "class", F.lit(1).alias("role"), block("ka").alias("p"), every(F.col("k")).alias("q"), F.lit(False).alias("own"))
    facts = coded.select("class", "rep", "n", "v", "codes", "error")
    dealt = inside.union(outside).union(others).join(facts, "class")
    dealt = dealt.withColumn("codes", F.when((F.col("role") == 0) | F.col("own"), F.col("codes")))

    def compare(key, g):
        d, part, p, q, own = key[1], key[2], key[3], key[4], key[5]
        role = g.role.to_numpy()
        member = np.flatnonzero(role == 0)
        asker = member if own and p == q else np.flatnonzero(role == 1)
        none = pd.DataFrame({"class": [], "links": [], "a": [], "b": []}, dtype="int64")
        if not len(member) or not len(asker):
            return none
        x = scaled(np.array(g.v.tolist(), "f8").reshape(-1, d))
        rep, n, who = g.rep.to_numpy(), g.n.to_numpy(), g["class"].to_numpy()
        book, links, found = sent.value.get(d), np.zeros(len(g)), []
        unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        if book:
            codes = np.frombuffer(b"".join(g.codes.iloc[member]), "u1").reshape(len(member), -1)
            most = ((reach + g.error.to_numpy()[member] + EPS) ** 2)[:, None]
        for z in range(0, len(asker), 128):
            some = asker[z : z + 128]
            near = book.distances(unit[some], part % len(book.coarse), codes) <= most if book else np.ones((len(member), len(some)), bool)
            m, a = np.nonzero(near)
            m, a = member[m], some[a]
            if own and p == q:
                m, a = m[who[m] < who[a]], a[who[m] < who[a]]
            hit = np.concatenate([cosines(x[m[i : i + 65536]], x[a[i : i + 65536]]) >= least for i in range(0, len(m), 65536)] or [np.zeros(0, bool)])
            m, a = m[hit], a[hit]
            links += np.bincount(m, n[a], len(g)) + np.bincount(a, n[m], len(g))
            found += forest(rep[m], rep[a])
        k = np.flatnonzero(links)
        f = np.array(found or np.zeros((0, 2)), "i8")
        f = forest(f[:, 0], f[:, 1])
        return pd.DataFrame({"class": [*who[k], *[-1] * len(f)], "links": [*links[k], *[0] * len(f)], "a": [*[0] * len(k), *(e[0] for e in f)], "b": [*[0] * len(k), *(e[1] for e in f)]}, dtype="int64")

    found = save(dealt.groupBy(*at, "p", "q", "own").applyInPandas(compare, "class bigint, links bigint, a bigint, b bigint"), "found")
    # what is linked with a whole core needs no comparison: the core's size for whoever asks, the askers' number for its members
    whole = asking.where("sure").select("class", F.col("size").alias("links"))
    within = members.select("class", (F.when(F.col("core"), F.col("size") - F.col("own")).otherwise(0) + F.col("credit")).alias("links")).where("links > 0")
    links = found.where("class >= 0").select("class", "links").union(whole).union(within).groupBy("class").agg(F.sum("links").alias("links"))
    edges = found.where("class < 0").select("a", "b").union(asking.where("sure").select(F.col("rep").alias("a"), F.col("lead").alias("b"))).union(members.where("core AND rep <> lead").select("rep", "lead"))
    comps = save(components(edges), "components")
    named = same.join(links, "class", "left").join(comps, F.col("rep") == F.col("node"), "left")
    named = save(named.select("label", "v", "rows", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    drop(spark, same, coded, asks, shape, members, found, comps)
    each = df.where(ok).select(i.cast("bigint").alias("vec_id"), c.alias("label"), plain.alias("v"))
    out = lookup(each, named, ["label", "v"], each.count(), "rows").select("vec_id", "n_links", "component_id")
    alone = df.where(~F.coalesce(ok, F.lit(False))).select(i.cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), i.cast("bigint").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
