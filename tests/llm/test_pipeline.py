"""The pipeline against its stages done by plain means."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_dedup import brute
from tokenizers import Tokenizer

import corpus_pipeline as C
from fieldlore.llm import rules
from fieldlore.llm.shared import save

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    kept = {}
    for name, stage in C.STAGES[:-1]:
        docs = save(stage(spark, docs, SF), name)
        assert docs.columns == list(spark.read.parquet(f"{SF}/documents.parquet").columns)
        kept[name] = Counter(r.doc_id for r in docs.collect())
    good = {i for i, r in rows.items() if not any(x.rejects(rules.Page(r.text)) for x in rules.RULES)}
    assert set(kept["quality"]) == good and set(kept["quality"].values()) == {1}
    assert set(kept["toxicity"]) <= good
    known = [i for i in good if i in toxic]
    assert np.mean([(i in kept["toxicity"]) == (toxic[i] == 0) for i in known]) > 0.85
    comp = brute([(i, rows[i].text) for i in kept["toxicity"]])
    assert set(kept["near_dedup"]) == set(comp.values()) and set(kept["near_dedup"].values()) == {1}
    assert set(kept["mixing"]) == set(kept["near_dedup"]) and max(kept["mixing"].values()) <= 3
    last = C.STAGES[-1][1](spark, docs, SF).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert Counter(r.doc_id for r in last) == kept["mixing"]
    for r in last:
        ids = lib.encode(rows[r.doc_id].text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    whole = C.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, last))


NAMES = ("_gone", "mix_epoch", "mix_at", "_s", "s", "n", "k", "y", "t", "class_id", "kept", "score", "a.b")


def odd(spark):
    good = " ".join(f"Wort{i} und{i} noch{i} eins mehr{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, good), (4, good), (5, good), (None, good), (6, good + " " + "sehr langer Text " * 2 + " ".join(f"w{i}" for i in range(200_000))), (7, good.upper()), (8, "x" * 50_000)]
    more = [(i, t, "de" if i else None, ["a", None, ""][k % 3], len(t or "")) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(more, "doc_id bigint, text string, lang string, source string, n_chars int")
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(NAMES)))


def test_stages_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and clashing names, stage by stage."""
    docs = odd(spark)
    want = {
        "quality": Counter({4: 2, 5: 1, None: 1, 6: 1}),
        "toxicity": None,
        "near_dedup": Counter({1: 1, 2: 1, 3: 1, 4: 1, None: 1, 6: 1, 7: 1, 8: 1}),
        "mixing": None,
        "encoding": Counter(r.doc_id for r in docs.collect()),
    }
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "encoding":
            assert out.columns == docs.columns, name
            assert all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in rows), name
        got = Counter(r.doc_id for r in rows)
        if want[name] is not None:
            assert got == want[name], name
        if name == "mixing":
            assert set(got) == {r.doc_id for r in docs.collect()}


def test_stages_empty(spark):
    docs = odd(spark).limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, docs, SF).collect() == [], name
