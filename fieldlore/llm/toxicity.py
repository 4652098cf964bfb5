"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their first bytes, hashed. A document's score is the logistic of a bias, a weight
for each term it has, and the inner product of the factors of each pair of its terms, so that a pair (an insult
with the mention of a group) counts apart from what its parts weigh. The machine is fitted on a bounded sample of labelled rows,
over the terms that differ most between the classes there; every whole text is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlore.llm.shared import batches, by_place, col, drop, fresh, save, without
from fieldlore.llm.words import NO_LETTER, Words, chunks

BITS = 22
#: Lengths in bytes of a longer word's starts that are terms besides the whole word: what a term is, at every size of the tables.
PREFIXES = (4, 5, 6)
#: The documented bounds of the fit: labelled rows (about; by hash of the id), least toxic documents of the sample with a term, terms that the machine has at most
#: (the best ones), least log-likelihood gain of a term. Whole texts are read, and each text is scored with all terms that the machine has. Factors and rounds.
ROWS, SUPPORT, TERMS, GAIN, FACTORS, EPOCHS = 12_000, 5, 2048, 3.0, 4, 40


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed term) for each word and prefix, not yet distinct."""
    w = Words([t.lower() if t else t for t in texts], NO_LETTER)
    docs, out, who = w.texts(), [w.hashes()], [w.texts()]
    for n in PREFIXES:
        longer = w.end - w.start > n
        out.append(w.hashes(n, salt=n)[longer])
        who.append(docs[longer])
    return np.concatenate(who), (np.concatenate(out) >> np.uint64(64 - BITS)).astype("i8")


def distinct(who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(who << BITS | what)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


class Machine:
    """Bias, weights and factors of a factorization machine over binary features."""

    def __init__(self, n: int, factors: int = FACTORS, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(n)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n, factors))

    def raw(self, rows: int, who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and each row's sum of factors. The pairs come from (sum v)^2 - sum v^2."""
        s, q = np.zeros((rows, self.v.shape[1])), np.zeros(rows)
        np.add.at(s, who, self.v[what])
        np.add.at(q, who, (self.v[what] ** 2).sum(1))
        y = self.bias + np.bincount(who, self.w[what], rows) + 0.5 * ((s**2).sum(1) - q)
        return y, s

    def score(self, rows: int, who: np.ndarray, what: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, who, what)[0], -30, 30)))

    def fit(self, rows: int, who: np.ndarray, what: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4, batch: int = 256) -> Machine:
        """Logistic loss by AdaGrad over seeded batches."""
        order = np.argsort(who, kind="stable")
        who, what = who[order], what[order]
        first = np.searchsorted(who, np.arange(rows + 1))
        rate_of = {"b": 1e-8, "w": np.full_like(self.w, 1e-8), "v": np.full_like(self.v, 1e-8)}
        rng = np.random.default_rng(11)
        share = np.clip(label.mean(), 1e-6, 1 - 1e-6)
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            shuffled = rng.permutation(rows)
            for at in range(0, rows, batch):
                some = shuffled[at : at + batch]
                n = first[some + 1] - first[some]
                k = np.repeat(first[some] - np.cumsum(np.append(0, n[:-1])), n) + np.arange(n.sum())
                i, x = np.repeat(np.arange(len(some)), n), what[k]
                y, s = self.raw(len(some), i, x)
                g = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[some]
                gb = g.mean()
                gw, gv = np.zeros_like(self.w), np.zeros_like(self.v)
                np.add.at(gw, x, g[i] / len(some))
                np.add.at(gv, x, (g[i] / len(some))[:, None] * (s[i] - self.v[x]))
                hit = np.unique(x)
                gw, gv = gw[hit] + decay * self.w[hit], gv[hit] + decay * self.v[hit]
                rate_of["b"] += gb**2
                self.bias -= rate * gb / np.sqrt(rate_of["b"])
                rate_of["w"][hit] += gw**2
                self.w[hit] -= rate * gw / np.sqrt(rate_of["w"][hit])
                rate_of["v"][hit] += gv**2
                self.v[hit] -= 0.2 * rate * gv / np.sqrt(rate_of["v"][hit])
        return self


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = ROWS, support: int = SUPPORT, most: int = TERMS, gain: float = GAIN) -> tuple[np.ndarray, Machine]:
    """The slot of each hashed term (-1: none) and the machine, fitted on about rows labelled documents.

    A term is taken if support toxic documents of the sample have it and its share among toxic ones is so much greater than among clean ones that
    the log-likelihood gained exceeds gain; the best ones are, up to most, ties by hash. Rows without a label or key don't count; of several labels of
    one key the greatest does; repeated documents count each time; null and empty texts have no terms. Of a table without both classes only the bias
    is learnt, of an empty one nothing (all scores are 0.5).
    """
    spark = df.sparkSession
    batches(spark)
    (own,) = fresh("key")
    named = labels.where(col(label).isNotNull() & col(key).isNotNull()).groupBy(col(key).alias(own)).agg(F.max(col(label)).cast("int").alias("y"))
    n = named.count()
    share = min(1.0, rows / max(1, n))
    named = named.where(F.pmod(F.xxhash64(own), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # about rows of them
    sample = save(df.select(col(key).alias(own), col(text).alias("t")).join(F.broadcast(named), own).select("t", "y"), "labelled")

    def toxic_terms(parts):
        seen = np.zeros(1 << BITS, "i4")
        for b in parts:
            texts = b.column(0).to_pylist()
            for a, z in chunks(texts):
                seen += np.bincount(distinct(*terms(texts[a:z]))[1], minlength=1 << BITS).astype("i4")
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(seen[k], pa.int32())], names=["term", "n"])

    positive = sample.where("y = 1").mapInArrow(toxic_terms, "term bigint, n int").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= support).toPandas()
    slot = np.full(1 << BITS, -1, "i2" if most < 1 << 15 else "i4")
    counts = sample.groupBy("y").count().collect()
    size = {r.y: r["count"] for r in counts}
    machine = Machine(0)
    if size.get(1, 0) and size.get(0, 0) and len(positive):
        wanted = np.zeros(1 << BITS, bool)
        wanted[positive.term] = True
        mask = spark.sparkContext.broadcast(np.packbits(wanted))

        def clean_terms(parts):
            want, seen = np.unpackbits(mask.value).astype(bool), np.zeros(1 << BITS, "i4")
            for b in parts:
                texts = b.column(0).to_pylist()
                for a, z in chunks(texts):
                    who, what = terms(texts[a:z])
                    hit = want[what]
                    seen += np.bincount(distinct(who[hit], what[hit])[1], minlength=1 << BITS).astype("i4")
            k = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(seen[k], pa.int32())], names=["term", "m"])

        negative = sample.where("y = 0").mapInArrow(clean_terms, "term bigint, m int").groupBy("term").agg(F.sum("m").alias("m")).toPandas()
        both = positive.merge(negative, "left", "term").fillna({"m": 0}).sort_values("term")
        p, q = (both.n + 0.5) / (size[1] + 1), (both.m + 0.5) / (size[0] + 1)
        # the log-likelihood ratio of the term's share among toxic documents against its share among clean ones
        both["gain"] = np.where(p > q, both.n * np.log(p / q), 0)
        best = both.sort_values(["gain", "term"], ascending=[False, True]).head(most)
        best = best[best.gain > gain].term.to_numpy()
        slot[best] = np.arange(len(best))
        machine = Machine(len(best))
        sent = spark.sparkContext.broadcast(slot)

        def features(parts):
            for b in parts:
                texts, y = b.column(0).to_pylist(), b.column(1).to_pylist()
                out = []
                for a, z in chunks(texts):
                    who, what = slots(texts[a:z], sent.value)
                    out += [x.tolist() for x in np.split(what, np.searchsorted(who, np.arange(1, z - a)))]
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(out, pa.list_(pa.int32()))], names=["y", "x"])

        # about rows documents, each with most terms at most
        got = sample.mapInArrow(features, "y int, x array<int>").toPandas()
        got["k"] = [tuple(x) for x in got.x]
        got = got.sort_values(["y", "k"])
        who = np.repeat(np.arange(len(got)), got.x.map(len))
        what = np.concatenate([*map(np.asarray, got.x), []]).astype("i8")
        machine.fit(len(got), who, what, got.y.to_numpy("f8"))
    elif size:
        machine.bias = 30.0 if set(size) == {1} else -30.0 if set(size) == {0} else float(np.log(size[1] / size[0]))
    drop(spark, sample)
    return slot, machine


def slots(texts: list[str | None], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    who, what = terms(texts)
    s = slot[what]
    hit = s >= 0
    return distinct(who[hit], s[hit].astype("i8"))


def score(df: DataFrame, slot: np.ndarray, machine: Machine, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """score (0 to 1) and predicted (1 from 0.5 on) of every whole text.

    Null and empty texts have the bias alone; repeated rows each get a row, an empty table none. Kept columns with one of the two names are replaced.
    """
    batches(df.sparkSession)
    keep = without(["doc_id"] if keep is None else keep, "score", "predicted")
    sent = df.sparkSession.sparkContext.broadcast((slot, machine))
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int"

    def run(parts):
        slot, machine = sent.value
        for b in parts:
            texts, out = b.column(len(keep)).to_pylist(), []
            for a, z in chunks(texts):
                out.append(machine.score(z - a, *slots(texts[a:z], slot)))
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("i4"))], names=[*keep, "score", "predicted"])

    return by_place(df.select(*map(col, keep), col(text))).mapInArrow(run, fields)


def remove_toxic(df: DataFrame, slot: np.ndarray, machine: Machine, text: str = "text") -> DataFrame:
    """The rows of df with a score below 0.5, with all their columns, whatever they are called.

    Null and empty texts have the bias alone; whole texts of any length are read; repeated rows share a verdict; an empty table stays empty.
    """
    batches(df.sparkSession)
    sent, at = df.sparkSession.sparkContext.broadcast((slot, machine)), df.columns.index(text)

    def run(parts):
        slot, machine = sent.value
        for b in parts:
            texts, out = b.column(at).to_pylist(), []
            for a, z in chunks(texts):
                out.append(machine.score(z - a, *slots(texts[a:z], slot)) < 0.5)
            yield b.filter(pa.array(np.concatenate(out) if out else np.zeros(0, bool)))

    plain = by_place(df)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
