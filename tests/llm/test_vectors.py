"""Vector links against brute force over all pairs of a label, by exact fractions."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from test_dedup import union_find

from fieldlore.llm import queries, vectors

SF = "/root/testdata/sf0.01"
BOUND = Fraction(93, 100)


def linked(x, y):
    """Whether the cosine is at least 0.93, without rounding."""
    x, y = [Fraction(float(v)) for v in x], [Fraction(float(v)) for v in y]
    dot = sum(a * b for a, b in zip(x, y, strict=True))
    return dot > 0 and dot * dot >= BOUND * BOUND * sum(a * a for a in x) * sum(b * b for b in y)


def brute(rows):
    ok = [(i, v, c) for i, v, c in rows if i is not None and c is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    links, edges = {i: 0 for i, _, _ in rows}, []
    for k, (i, x, c) in enumerate(ok):
        a = np.ldexp(np.array(x, "f8"), -math.frexp(max(map(abs, x)))[1])
        for j, y, e in ok[:k]:
            if c == e and len(x) == len(y) and i != j:
                b = np.ldexp(np.array(y, "f8"), -math.frexp(max(map(abs, y)))[1])
                cos = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
                # plain arithmetic where it is far from the bound
                if cos > 0.9300001 or (cos > 0.9299999 and linked(x, y)):
                    links[i] += 1
                    links[j] += 1
                    edges.append((i, j))
    comp = union_find(edges)
    return {i: (n, comp.get(i, i), comp.get(i, i) == i) for i, n in links.items()}


def found(df, **how):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.link_vectors(df, **how).collect()}


def test_embeddings(spark):
    rows = duckdb.sql(f"select vec_id, embedding, label from '{SF}/embeddings.parquet'").fetchall()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op10_vectors(spark, SF).collect()}
    assert got == brute(rows)


ODD = [(400, None, 0), (401, [0.0] * 9, 0), (402, None, 0), (403, [1.0, None], 0), (404, [float("nan")] * 9, 0), (405, [float("inf")] + [0.0] * 8, 0), (407, [], 0), (408, [1.0, 2.0], 0), (409, [2.0, 4.0], 0), (410, [-0.0, 1.0], 1), (411, [0.0, 1.0], 1)]
ODD += [(500, [1.001e200, 1e200, 0.0], 3), (501, [1e200, 1e200, 0.0], 3), (502, [1e-200, 1e-200, 0.0], 3), (503, [0.0, 1e308, 1e308], 3), (504, [0.0, 5e-324, 5e-324], 3), (505, [1.7e308] * 3, 3)]


@pytest.mark.parametrize("block,lists", [(7, 6), (1024, 1), (40, 12)])
def test_blocks_and_odd_rows(spark, monkeypatch, block, lists):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "LISTS", lists)
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (12, 9))
    x = centres[rng.integers(0, 12, 240)] + rng.normal(0, 0.25, (240, 9))
    tight = centres[3] + rng.normal(0, 0.03, (60, 9))
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)] + [(600 + i, v.tolist(), 0) for i, v in enumerate(tight)]
    rows += [(300 + i, x[4].tolist(), 0) for i in range(40)] + [(399, (3 * x[4]).tolist(), 0), (406, x[4].tolist(), None), *ODD]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "'z' AS rep", "1 AS n", "2 AS class", "3 AS part", "4 AS v")
    got, want = found(df), brute(rows)
    assert got == want and found(df, sigmas=float("inf")) == want
    assert want[501] == (2, 500, False) and want[502] == (2, 500, False) and want[504] == (1, 503, False)
    # by the power of two that scales a row, nothing changes
    far = df.selectExpr("vec_id", "transform(embedding, x -> x * double('1.5777218104420236e-30')) AS embedding", "label").where("vec_id < 400 or vec_id >= 600")
    assert found(far) == {i: w for i, w in want.items() if i < 400 or i >= 600}
    again = vectors.link_vectors(df.union(df.where("vec_id = 300"))).where("vec_id = 300").collect()
    assert len(again) == 2 and again[0].n_links == got[300][0]
    assert vectors.link_vectors(df.limit(0)).collect() == []
    assert [tuple(r) for r in vectors.link_vectors(spark.createDataFrame([(None, [1.0], 0), (5, [1.0], 0)], df.schema[:3].simpleString()[7:-1].replace(":", " "))).orderBy("vec_id").collect()] == [(None, 0, None, None), (5, 0, 5, True)]


def test_bounds_hold():
    """Strict probes and tables lose nothing; a sure part has no member too far."""
    rng = np.random.default_rng(9)
    x = vectors.units(rng.normal(0, 1, (900, 16)))
    y = vectors.units(x + rng.normal(0, 0.08, x.shape))
    y[:300] = vectors.units(x[:1] + rng.normal(0, 0.02, (300, 16)))
    x[:300] = vectors.units(x[:1] + rng.normal(0, 0.02, (300, 16)))
    reach = math.sqrt(0.14)
    near = ((x - y) ** 2).sum(1) <= 0.14
    q = vectors.Quantiser(x, 900 * 40)
    own, codes, error, far = q.encode(y)
    core = far <= (reach - vectors.EPS) / 2
    part = own + len(q.coarse) * core
    radius = np.full(2 * len(q.coarse), -1.0)
    np.maximum.at(radius, part, far)
    probes, sure = q.probes(x, q.encode(x)[0], reach, radius, math.inf)
    assert near.sum() > 400 and core.sum() > 100 and probes[np.arange(900), part][near].all() and probes.mean() < 0.9
    assert sure.any()
    for i, k in zip(*np.nonzero(sure), strict=True):
        assert (((x[i] - y[part == k]) ** 2).sum(1) <= 0.14).all()
    for i in range(0, 900, 37):
        d = q.distances(x[i : i + 1], own[i], codes[i : i + 1])[0, 0]
        assert abs(np.sqrt(d) - np.linalg.norm(x[i] - y[i])) <= error[i] + 1e-9


def test_recall_of_sufficient_probes():
    """Pairs at the very bound, in many directions: the default probes find nearly all."""
    rng = np.random.default_rng(3)
    x = vectors.units(rng.normal(0, 1, (20_000, 64)))
    step = rng.normal(0, 1, x.shape)
    step -= np.einsum("ij,ij->i", step, x)[:, None] * x
    y = vectors.units(x + step / np.linalg.norm(step, axis=1)[:, None] * math.tan(math.acos(0.9301)))
    q = vectors.Quantiser(x[:8000], 50_000)
    own, _, _, far = q.encode(y)
    radius = np.zeros(2 * len(q.coarse))
    np.maximum.at(radius, own, far)
    mine = q.encode(x)[0]
    one = q.probes(x, mine, math.sqrt(0.14), radius, vectors.SIGMAS)[0]
    strict = q.probes(x, mine, math.sqrt(0.14), radius, math.inf)[0]
    at = np.arange(len(x))
    assert len(q.coarse) > 200 and strict[at, own].all()
    assert one[at, own].mean() > 0.999 and one.sum() < 0.6 * strict.sum()
