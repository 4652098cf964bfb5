"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed letter trigrams, counted over all labelled training texts. A
document is a mixture of languages: expectation-maximisation finds the proportions from its trigrams'
likelihoods, round by round until they stand still, and languages join the document's set, largest proportion first,
while the likelihood gained exceeds a penalty per language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlore.llm.shared import batches, by_place, col, without

BITS = 16
BUCKETS = 1 << BITS
#: Added count, penalty factor, change of a proportion that counts as none, rounds of expectation-maximisation after which a document that still moves is taken as it is.
ALPHA, PENALTY, STILL, ROUNDS = 0.5, 3.0, 1e-5, 2000
#: Languages at most: the driver holds 65,536 numbers of each.
LANGUAGES = 1000
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """The code point of each letter, 32 for whatever is none, over all code points."""
    global _letters
    if _letters is None:
        _letters = np.array([ord(c) if (c := chr(i)).isalpha() else 32 for i in range(0x110000)], "u4")
    return _letters


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams around each letter of a text; none where it has no letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "u4")
    c = letters()[codes]
    h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - BITS))[c[1:-1] != 32]


def mixture(counts: np.ndarray, like: np.ndarray, rounds: int = ROUNDS, still: float = STILL) -> tuple[np.ndarray, float]:
    """Proportions of languages (columns of like) by expectation-maximisation, and their log-likelihood."""
    p = np.full(like.shape[1], 1 / like.shape[1])
    share = counts / counts.sum()
    for _ in range(rounds):
        before = p
        p = p * ((share / (like @ p)) @ like)
        if np.abs(p - before).max() < still:
            break
    return p, float(counts @ np.log(like @ p))


def languages(counts: np.ndarray, log_like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen languages of a document (largest share first, ties in the order of languages) and their proportions."""
    like = np.exp(log_like - log_like.max(1, keepdims=True))
    p, _ = mixture(counts, like)
    order = np.argsort(-p, kind="stable")
    chosen, share = order[:1], np.ones(1)
    best = float(counts @ np.log(np.maximum(like[:, chosen[0]], 1e-300)))
    penalty = PENALTY * np.log(counts.sum() + 1)
    for k in order[1:]:
        more = np.append(chosen, k)
        q, gained = mixture(counts, like[:, more])
        if gained - best <= penalty:
            break
        chosen, share, best = more, q, gained
    by = np.argsort(-share, kind="stable")
    return chosen[by], share[by]


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the logarithm of each bucket's probability in each.

    All rows with a language count, repeated ones each time, with their whole texts; null and empty texts and those without a letter only name a language.
    An empty table teaches none. More than LANGUAGES languages raise ValueError.
    """
    batches(df.sparkSession)

    def count(parts):
        seen: dict[str, np.ndarray] = {}
        for b in parts:
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(name, np.zeros(BUCKETS, "i8"))
                if t:
                    np.add(seen[name], np.bincount(trigrams(t), minlength=BUCKETS), out=seen[name])
        for name, c in seen.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(k) + 1), pa.string()), pa.array(np.append(k, -1), pa.int64()), pa.array(np.append(c[k], 1), pa.int64())], names=["lang", "bucket", "n"])

    counted = df.where(col(lang).isNotNull()).select(col(text), col(lang).cast("string")).mapInArrow(count, "lang string, bucket bigint, n bigint")
    # languages times buckets at most
    most = LANGUAGES * (BUCKETS + 1)
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).limit(most + 1).toPandas()
    if len(rows) > most or rows.lang.nunique() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    names = sorted(rows.lang.unique())
    at = {n: i for i, n in enumerate(names)}
    c = np.zeros((BUCKETS, len(names)))
    rows = rows[rows.bucket >= 0]
    c[rows.bucket.to_numpy("i8"), rows.lang.map(at).to_numpy("i8")] = rows.n.to_numpy("f8")
    return names, np.log((c + ALPHA) / (c.sum(0) + ALPHA * BUCKETS)).astype("f4")


def predict(df: DataFrame, names: list[str], model: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score (its share of the document) and langs (the chosen set with shares) of every whole text.

    Null texts, texts without a letter, and all texts where no language was learnt are ``und`` with score 0. Ties
    go to the first language by name. Repeated rows each get a row, an empty table none. Kept columns with one of the three names are replaced.
    """
    batches(df.sparkSession)
    keep = without(["doc_id"] if keep is None else keep, "lang_pred", "score", "langs")
    shared = df.sparkSession.sparkContext.broadcast((names, model))
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double, langs map<string,double>"

    def one(t):
        names, model = shared.value
        g = trigrams(t) if t and names else ()
        if not len(g):
            return "und", 0.0, []
        c = np.bincount(g, minlength=BUCKETS)
        k = np.flatnonzero(c)
        chosen, share = languages(c[k].astype("f8"), model[k].astype("f8"))
        return names[chosen[0]], float(min(1.0, share[0])), [(names[i], float(s)) for i, s in zip(chosen, share, strict=True)]

    def run(parts):
        for b in parts:
            out = [one(t) for t in b.column(len(keep)).to_pylist()]
            cols = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols], names=[*keep, "lang_pred", "score", "langs"])

    return by_place(df.select(*map(col, keep), col(text))).mapInArrow(run, fields)


