"""Operators over all pairs: blocks against the plain expression, and queries that don't keep what they only read."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlore import queries_fields as QF
from fieldlore.functions import embeddings as E
from fieldlore.functions import nearby as N
from fieldlore.functions import series as S
from fieldlore.operators import alignment as A
from fieldlore.operators import knees as K
from fieldlore.operators import lineage as L
from fieldlore.operators import merging as MG
from fieldlore.operators import pairwise as P
from fieldlore.operators import principal as PR
from fieldlore.operators import semantics as SM
from fieldlore.operators import shapes as SH
from fieldlore.operators import templates as T

SMALL = "/root/testdata/sf0.001"
#: Queries that give one row for each pair.
STREAMED = [
    "aln01_score_domain",
    "dis12_shifts",
    "fea48_lower_triangle",
    "clu10_adjusted",
    "dis05_mixed_lengths",
]


def odd_values(spark, n=90):
    rng = np.random.default_rng(3)
    rows = sorted({bytes(rng.integers(0, [256, 4, 60, 256][k % 4], int(rng.integers(1, 14))).astype(np.uint8)) for k in range(n)})
    return spark.createDataFrame([(i, bytearray(b), 1) for i, b in enumerate(rows)], "rep_id bigint, bytes binary, n bigint").cache()


def plain_pairs(v):
    x = v.select("rep_id", S.values(F.col("bytes")).alias("v"))
    return x.toDF("i", "a").join(x.toDF("j", "b"), F.expr("i < j")).select("i", "j", F.inline(F.array(S.embedding(F.col("a"), F.col("b"))))).select("i", "j", "d", "shift", F.round("d", 6).alias("r"))


def test_blocks_are_the_expression(spark):
    """To the last bit, in as many tasks as there are pairs of blocks."""
    v = odd_values(spark)
    want = sorted(tuple(r) for r in plain_pairs(v).collect())
    got = P.distances(v)
    assert sorted(tuple(r) for r in got.collect()) == [r[:4] for r in want]
    assert sorted((r.i, r.j, r.d) for r in P.distances(v, blocks=3, digits=6, within=0.5).collect()) == [(i, j, r) for i, j, _, _, r in want if r <= 0.5]
    assert got.rdd.getNumPartitions() == 36
    assert P.distances(v.limit(0)).collect() == []


def test_rounding(spark):
    x = [a / b for a in range(1, 260) for b in (3, 7, 64, 128, 512, 1000, 3200)] + [0.0, 0.1234565, 1.0000005]
    want = [r[0] for r in spark.createDataFrame([(y,) for y in x], "x double").select(F.round("x", 6)).collect()]
    assert E.half_up(np.array(x), 6).tolist() == want


@pytest.mark.parametrize("name", STREAMED)
def test_pairs_are_not_kept(spark, name):
    """No checkpoint of all pairs: the plan compares blocks itself."""
    plan = getattr(QF, name)(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_nearest_are_the_neighbours(spark):
    """Ties by id, across blocks, by rounded distances."""
    v = odd_values(spark, 60)
    d = plain_pairs(v).select("i", "j", F.col("r").alias("d"))
    assert sorted(map(tuple, P.nearest(v, 7, digits=6).collect())) == sorted(map(tuple, P.neighbours(d, 7).collect()))
    assert P.nearest(v.limit(1), 3).collect() == []


def test_last_scores():
    rng = np.random.default_rng(6)
    messages = [[bytes(rng.integers(0, 9, int(rng.integers(1, 5))).astype(np.uint8)) for _ in range(int(rng.integers(1, 7)))] for _ in range(30)]
    score = lambda a, b: 1.0 if a == b else 1 - A.value_dissimilarity(a, b)
    rows, columns = np.nonzero(np.ones((30, 30)))
    want = [A.last_line(messages[i], messages[j], score)[-1] for i, j in zip(rows, columns, strict=True)]
    assert A.last_scores(messages, rows, columns) == pytest.approx(want)


def test_last_scores_in_parts(monkeypatch):
    monkeypatch.setattr(A, "SIMILAR", 4)
    test_last_scores()


#: Queries that need the nearest others of each value alone.
NEAREST = ["aln08_parameters", "clu05_parameters", "clu08_curvature", "clu06_sharpest", "clu09_rule_of_thumb", "clu12_mean_growth", "clu11_no_large_cluster"]


@pytest.mark.parametrize("name", NEAREST)
def test_nearest_need_no_table_of_pairs(spark, monkeypatch, name):
    def none(*args, **kwargs):
        assert kwargs.get("within") is not None, "a table of all pairs"
        return pairs(*args, **kwargs)

    module, of = (A, "message_distances") if name.startswith("aln") else (P, "distances")
    pairs = getattr(module, of)
    monkeypatch.setattr(module, of, none)
    assert getattr(QF, name)(spark, SMALL).count() > 0


def test_shifts_of_many():
    """Copies and ties as one by one; thousands at once."""
    rng = np.random.default_rng(5)

    def plain(parts):
        size, out = max(map(len, parts)), []
        v = [np.frombuffer(p, np.uint8).astype(float) for p in parts]
        for x in v:
            long = [y for y in v if len(y) == size and y is not x]
            at = [T.distances_at(x, y) for y in long]
            answers = [0] if len(x) == size else [int(a.argmin()) for a in at]
            if len(x) > 2 and long and all(int(c.argmin()) == 0 and c.min() < w.min() - 1 for c, w in zip([T.distances_at(x[1:], y) for y in long], at, strict=True)):
                answers = [-1]
            out.append(max(dict.fromkeys(answers), key=answers.count))
        return out, size

    for t in range(200):
        parts = [bytes(rng.integers(0, rng.integers(2, 255), int(rng.integers(1, 11))).astype(np.uint8)) for _ in range(1 + t % 8)]
        parts = [b"\xff" + p for p in parts[:1]] + parts[1:] + parts[: t % 3]
        assert T.shifts_of(parts) == plain(parts)
    many = [int(i).to_bytes(5, "big") for i in rng.integers(0, 2**38, 4000)]
    began = time.perf_counter()
    assert T.shifts_of(many)[1] == 5 and time.perf_counter() - began < 20


def test_nearest_of_fields():
    """The least over all values of two fields, many at a time."""
    rng = np.random.default_rng(8)
    a, b = ([int(i).to_bytes(3, "big") for i in rng.choice(2**24, 1500, replace=False)] for _ in range(2))
    assert MG.nearest(a[:20], b[:30]) == pytest.approx(min(A.value_dissimilarity(x, y) for x in a[:20] for y in b[:30]))
    began = time.perf_counter()
    assert 0 <= MG.nearest(a, b) <= MG.nearest(a[:20], b) and time.perf_counter() - began < 5
    assert MG.nearest([b"\x01", b"\x02"], [b"\x02"]) == 0


def test_subclusters_of_many():
    """Parts of the rows give what the whole matrix does."""
    values = sorted({bytes([10 + i % 5, 200 + i % 7, 60 + i % 3]) for i in range(60)} | {bytes([200 + i % 5, 3 + i % 7, 9 + i % 3]) for i in range(60)})
    whole = PR.subclusters(values, 1.0)
    cells, E.CELLS = E.CELLS, 200
    try:
        assert PR.subclusters(values, 1.0) == whole
    finally:
        E.CELLS = cells


def test_refinement_keeps_no_table_of_pairs(spark, monkeypatch):
    pairs = P.distances
    monkeypatch.setattr(P, "distances", lambda *args, **kwargs: pairs(*args, within=kwargs.pop("within"), **kwargs))
    assert QF.ref16_principal(spark, SMALL).count() > 0


def test_densities_by_given_neighbours(spark):
    v = odd_values(spark, 40)
    d = P.distances(v, digits=6).cache()
    labels = v.select(F.col("rep_id").alias("id"), (F.col("rep_id") % 4).alias("label"))
    pairs = lambda **how: sorted(map(tuple, SM.density_pairs(d, labels, near=0.2, alike=0.1, **how).collect()))
    assert pairs(nearest=P.nearest(v, 2, digits=6)) == pairs() != []


def test_links_keep_no_table_of_pairs(spark):
    plan = QF.QUERIES["sem23_statistics"][0](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_large_tables_take_rounds(spark, monkeypatch):
    """Components in one task, and by rounds, are the same."""
    rng = np.random.default_rng(2)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))], "a bigint, b bigint")
    one = sorted(map(tuple, L.components(edges).collect()))
    monkeypatch.setattr(L, "FEW", 0)
    assert sorted(map(tuple, L.components(edges).collect())) == one


@pytest.mark.parametrize("digits", [None, 6])
@pytest.mark.parametrize("leaf", [1, 5, None])
def test_index_gives_the_nearest_of_all(leaf, digits):
    """Ties by id, several lengths, more neighbours than values; bounds of leaves are never above what they hold."""
    rng = np.random.default_rng(8)
    values = sorted({bytes(rng.integers(0, [256, 4, 60][k % 3], int(rng.integers(1, 12 if k % 2 else 3))).astype(np.uint8)) for k in range(150)}, key=lambda v: v[::-1])
    d = E.matrix(values, values, digits=digits)[0]
    x = N.Index(np.arange(len(values)), values, leaf)
    np.fill_diagonal(d, np.inf)
    for k in (1, 6, len(values) + 3):
        rows, columns = E.nearest(d, k)
        got = [r for leaf in range(x.leaves) for r in zip(*(a.tolist() for a in x.nearest(leaf, k, digits=digits)), strict=True)]
        assert sorted(got) == sorted(zip(rows.tolist(), columns.tolist(), d[rows, columns].tolist(), strict=True))
    for p in map(x.rows, range(x.leaves)):
        assert (x.least(p) <= np.minimum.reduceat(x.matrix(p, np.arange(len(values))), x.bounds[:-1], axis=1) + 1e-12).all()


def test_nearest_look_into_few_leaves(monkeypatch):
    """Of 20,000 values a small part of all pairs is compared."""
    seen, matrix = [], N.Index.matrix
    monkeypatch.setattr(N.Index, "matrix", lambda self, rows, columns, *more: seen.append(len(rows) * len(columns)) or matrix(self, rows, columns, *more))
    x = N.Index(np.arange(20_000), [k.to_bytes(2, "big") for k in range(20_000)])
    for leaf in range(x.leaves):
        x.nearest(leaf, 8, digits=6)
    assert sum(seen) < 20_000**2 / 4


def test_blocks_give_the_same_nearest(spark, monkeypatch):
    """What is too much for an index."""
    v = odd_values(spark, 60)
    want = sorted(map(tuple, P.nearest(v, 5, digits=6).collect()))
    assert sorted(map(tuple, P.nearest(v, 5, blocks=3, digits=6).collect())) == want
    monkeypatch.setattr(P, "SENT", 10)
    assert P.sent(v) is None
    assert sorted(map(tuple, P.nearest(v, 5, digits=6).collect())) == want


@pytest.mark.parametrize(("eps", "least"), [(0.05, 1), (0.3, 3), (0.45, 6)])
def test_dense_is_dbscan(spark, eps, least):
    """Also where chains of cores hang together by others than their nearest ones."""
    v = odd_values(spark, 200)
    ids = v.selectExpr("rep_id AS id")
    want = P.dbscan(P.distances(v, digits=6), ids, eps, least)
    index = P.sent(v)
    found = P.nearest(v, max(1, least - 1), digits=6, index=index)
    assert sorted(map(tuple, P.dense(found, index, ids, eps, least, 6).collect())) == sorted(map(tuple, want.collect()))


#: Queries that compare what an index leaves to compare.
INDEXED = ["clu05_parameters", "clu08_curvature", "clu06_sharpest", "clu09_rule_of_thumb", "clu12_mean_growth", "clu11_no_large_cluster"]


@pytest.mark.parametrize("name", INDEXED)
def test_no_pairs_of_blocks(spark, monkeypatch, name):
    def none(*args):
        raise AssertionError("all pairs")

    monkeypatch.setattr(P, "_blocks", none)
    assert getattr(QF, name)(spark, SMALL).count() > 0


@pytest.mark.parametrize("eps", [0.02, 0.1, 0.2, 0.35, 0.6])
def test_density_is_grown(eps):
    """Clusters, their order and which one a value at the border of several goes to, as from the whole matrix."""
    rng = np.random.default_rng(12)
    values = sorted({bytes(rng.integers(0, [256, 9, 60][k % 3], int(rng.integers(2, 5))).astype(np.uint8)) for k in range(400)})
    x = N.Index(np.arange(len(values)), values, 16)
    for least in (1, 2, 5, 9):
        found = tuple(np.concatenate(a) for a in zip(*(x.nearest(leaf, max(1, least - 1)) for leaf in range(x.leaves)), strict=True))
        assert N.density(x, found, eps, least).tolist() == PR.grown(PR.matrix(values) <= eps, least).tolist()


def test_subclusters_of_many():
    """Tens of thousands of values, of which no matrix is made."""
    values = sorted({bytes([k >> 8, k & 255, k * 7919 % 25]) for k in range(20_000)})
    began = time.thread_time()
    assert PR.subclusters(values, 1.0)
    assert time.thread_time() - began < 40


#: Pipelines whose refinement needs no pairs of blocks.
REFINED = ["pip12_PCAmocoSF", "pip11_zerocharPCAmoco", "pip06_zeroPCA", "pip08_PCA", "pip09_PCAmoco"]


@pytest.mark.parametrize("name", REFINED)
def test_refinement_without_pairs_of_blocks(spark, monkeypatch, name):
    def none(*args):
        raise AssertionError("all pairs")

    monkeypatch.setattr(P, "_blocks", none)
    assert QF.QUERIES[name][0](spark, SMALL).count() > 0


def clustered(spark, monkeypatch):
    """Values of several lengths, in small leaves, in clusters of many, few and one, and noise."""
    monkeypatch.setattr(N, "LEAF", 7)
    v = odd_values(spark, 150)
    label = F.when(F.col("rep_id") == 3, 70).when(F.col("rep_id") % 9 == 4, -1).when(F.col("rep_id") < 60, 0).otherwise(F.col("rep_id") % 5)
    return v, v.select(F.col("rep_id").alias("id"), label.cast("bigint").alias("label"))


def close_rows(got, want, keys=1):
    got, want = ({tuple(r[:keys]): tuple(r[keys:]) for r in x.collect()} for x in (got, want))
    assert got.keys() == want.keys() and got
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_shapes_without_table_of_pairs(spark, monkeypatch):
    """Walks to the last bit and all signs, as from all pairs."""
    v, labels = clustered(spark, monkeypatch)
    d = P.distances(v, digits=6).cache()
    clusters = SH.Clusters(P.sent(v), labels)
    counted, sums = SH.counts(clusters, 6)
    inner = SM.C.inside(d, labels)
    top = inner.groupBy("label").agg(F.max("d").alias("most"), F.percentile("d", F.lit(0.99)).alias("cut"))
    calm = inner.join(top, "label").where("d < cut").groupBy("label").agg(F.stddev_pop("d").alias("all"))
    close_rows(counted, top.join(calm, "label", "left"))
    walk = SH.walks(clusters, sums, 6)
    assert sorted(map(tuple, walk.select("label", "step", "id", "d").collect())) == sorted(map(tuple, SM.walks(d, labels).collect()))
    means = {(r.label, r.step): r["mean"] for r in SM.C.trace_means(d, labels).collect()}
    for r in walk.where("step = 0").collect():
        last = max(k for a, k in means if a == r.label)
        assert r["first"] == pytest.approx(means[r.label, 1])
        assert r.growth == (pytest.approx((means[r.label, last] - means[r.label, 1]) / (last - 1)) if last > 1 else None)
    want = sorted(map(tuple, SM.shapes(d, labels).collect()))
    monkeypatch.setattr(P, "distances", None)
    assert sorted(map(tuple, SM.shapes_of(v, labels).collect())) == want


def test_equal_distances_have_no_deviation(spark):
    """Two pairs as far apart, and a third farther: nothing is divided by 0."""
    v = spark.createDataFrame([(1, bytearray(b"\x00\x01"), 1), (2, bytearray(b"\x01\x01"), 1), (3, bytearray(b"\x01\x00"), 1)], "rep_id bigint, bytes binary, n bigint")
    labels = v.select(F.col("rep_id").alias("id"), F.lit(0).alias("label"))
    assert sorted(map(tuple, SM.shapes_of(v, labels).collect())) == sorted(map(tuple, SM.shapes(P.distances(v, digits=6), labels).collect())) != []


def test_links_of_clusters_without_table_of_pairs(spark, monkeypatch):
    v, labels = clustered(spark, monkeypatch)
    d = P.distances(v, digits=6).cache()
    clusters = SH.Clusters(P.sent(v), labels)
    shape, links = SH.nearest_links(clusters, 6)
    close_rows(shape, SM.C.inside(d, labels).groupBy("label").agg(F.avg("d").alias("mean"), F.max("d").alias("extent")))
    close_rows(links.select("p", "q", "i", "j", "least"), SM.link_statistics(d, labels).select("p", "q", "i", "j", "least"), 4)
    pairs = lambda x: sorted(map(tuple, x.collect()))
    for near, alike in ((0.01, 0.002), (0.05, 0.0), (0.3, 0.0), (0.0, 0.1)):
        assert pairs(SM.density_pairs_of(v, labels, near, alike)) == pairs(SM.density_pairs(d, labels, near, alike))
    assert pairs(SM.density_pairs_of(v, labels, 0.3, 0.1)) != []


@pytest.mark.parametrize("name", ["sem09_merge_on_density", "sem18_hypotheses"])
def test_clusters_need_no_table_of_pairs(spark, monkeypatch, name):
    def none(*args, **kwargs):
        raise AssertionError("all pairs")

    monkeypatch.setattr(P, "distances", none)
    assert QF.QUERIES[name][0](spark, SMALL).count() > 0


def test_curves_in_one_query(spark):
    """All ranks' distributions at once, as each by itself; a rank without spread, and one that is missing."""
    rng = np.random.default_rng(4)
    rows = [(k, float(x)) for k in range(4) for x in rng.integers(0, 900, 700) / 1000] + [(4, 0.25)] * 3
    near = spark.createDataFrame(rows, "rank int, d double").cache()
    curves = K.distributions(near)
    for k in range(5):
        d = np.array([x for r, x in rows if r == k])
        points = min(K.GRID, max(4, len(d)))
        width = (d.max() - d.min()) / (points - 1) or 1.0
        at = np.clip(np.ceil((d - d.min()) / width - 1e-12), 0, points - 1).astype(int)
        assert curves[k][0].tolist() == (d.min() + width * np.arange(points)).tolist()
        assert curves[k][1].tolist() == (np.cumsum(np.bincount(at, minlength=points)) / len(d)).tolist()
    spark.sparkContext.setJobGroup("curves", "")
    K.sharpest(near, 3, 0.8)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("curves")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 4, "jobs for each rank"
    with pytest.raises(K.NoKneeError):
        K.sharpest(near, 6, 0.8)


def test_bounds_by_tables():
    """Tables of least terms give what bytes and leaves do one by one."""
    rng = np.random.default_rng(6)
    values = sorted({bytes(rng.integers(0, 256, 2 + k % 3).astype(np.uint8)) for k in range(900)})
    x, y = N.Index(np.arange(len(values)), values, 16), N.Index(np.arange(len(values)), values, 16)
    y.tabled = False
    assert x.tabled
    for leaf in range(0, x.leaves, 3):
        assert (x.least(x.rows(leaf)) == y.least(y.rows(leaf))).all()


@pytest.mark.parametrize("n", [60, 4001, 9000])
def test_sorted_curves_are_whole(spark, n):
    """Every distance has its place, however many there are."""
    rng = np.random.default_rng(n)
    d = rng.integers(0, 3000, (2, n)) / 10_000
    near = spark.createDataFrame([(k, float(x)) for k in range(2) for x in d[k]], "rank int, d double")
    assert K.sorted_curves(near).tolist() == np.sort(d, axis=1).tolist()
    assert K.rule_of_thumb(K.sorted_curves(near.where("rank = 1"))[0]) == K.rule_of_thumb(np.sort(d[1]))


def test_parameters_or_an_error(spark, monkeypatch):
    """As many ranks as the logarithm of the values asks for; too few ranks are an error of another kind than a missing knee, and neither is a row."""
    assert QF.clu05_parameters(spark, "/root/testdata/sf0.1").first().eps > 0
    near = spark.createDataFrame([(k, k / 10 + x / 1000) for k in range(8) for x in range(50)], "rank int, d double")
    with pytest.raises(ValueError, match="rank 8") as e:
        K.by_distribution(near, 3000)
    assert not isinstance(e.value, K.NoKneeError)
    few = spark.createDataFrame([(k, bytearray([k + 1]), 1) for k in range(3)], "id bigint, bytes binary, n bigint")
    monkeypatch.setattr(QF, "values", lambda *_: few)
    with pytest.raises(K.NoKneeError):
        QF.clu05_parameters(spark, SMALL)


@pytest.mark.parametrize("held", [1, 40, 1 << 21])
def test_links_are_counted(spark, monkeypatch, held):
    """All figures of links as from a table of all pairs, which isn't made; counts that a task gives away early."""
    monkeypatch.setattr(SH, "HELD", held)
    v, labels = clustered(spark, monkeypatch)
    want = SM.link_statistics(P.distances(v, digits=6), labels).drop("i", "j").cache()
    assert want.count() > 1
    monkeypatch.setattr(P, "distances", None)
    got = SM.link_statistics_of(v, labels)
    assert got.columns == want.columns
    close_rows(got, want, 2)


def test_links_make_no_table_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "distances", None)
    assert QF.QUERIES["sem23_statistics"][0](spark, SMALL).count() == 10


def odd_messages(n=70):
    rng = np.random.default_rng(11)
    return [[bytes(rng.integers(0, 9, int(rng.integers(1, 5))).astype(np.uint8)) for _ in range(int(rng.integers(1, 6)))] for _ in range(n)]


@pytest.mark.parametrize(("step", "similar"), [(64, 1 << 23), (3, 1 << 23), (3, 50)])
def test_scores_of_two_sides(monkeypatch, step, similar):
    """To the last bit those of pairs one by one; in parts, and for labels inside and apart."""
    monkeypatch.setattr(A, "STEP", step)
    monkeypatch.setattr(A, "SIMILAR", similar)
    messages, places = odd_messages(), np.arange(70)
    score = A.last_scores(messages, *np.nonzero(places[:, None] < places))
    want = dict(zip(zip(*(x.tolist() for x in np.nonzero(places[:, None] < places)), strict=True), score.tolist(), strict=True))
    label = np.where(places < 40, 0, places % 7)
    for left, right in ((places, places), (places[::2], places[1::2]), (places[:50], places[:0])):
        pairs = {(min(i, j), max(i, j)) for i in left.tolist() for j in right.tolist() if i != j}
        for of, inside in ((None, False), (label, True), (label, False)):
            got = list(zip(*(x.tolist() for x in A._scored(messages, left, right, of, inside)), strict=True))
            keep = {p for p in pairs if of is None or (of[p[0]] == of[p[1]]) == inside}
            assert len(got) == len(keep) and {(i, j): s for i, j, s in got} == {p: want[p] for p in keep}


def test_message_clusters_without_table_of_pairs(spark):
    """Clusters and medoids of messages as from all pairs."""
    rows = [(i, k, bytearray(v)) for i, m in enumerate(odd_messages(120)) for k, v in enumerate(m)] + [(500, 0, bytearray())]
    s = spark.createDataFrame(rows, "msg_id bigint, seg_no int, bytes binary").cache()
    ids = s.select(F.col("msg_id").alias("id")).distinct()
    d = A.message_distances(s).select("i", "j", F.col("distance").alias("d")).cache()
    found = A.nearest_messages(s, 4).cache()
    rounded = A.message_distances(s, digits=6).select("i", "j", F.col("distance").alias("d"))
    seen = set()
    for eps in (1.0, 8.0, 14.0, 25.0):
        labels = P.joined(found, ids, eps, 3, lambda x, eps=eps: A.message_links(s, x, eps)).cache()
        got = sorted(map(tuple, labels.collect()))
        assert got == sorted(map(tuple, P.dbscan(d, ids, eps, 3).collect()))
        seen.add(len({label for _, label in got}))
        real = labels.where("label <> -1")
        assert sorted(map(tuple, A.message_medoids(s, real).collect())) == sorted(map(tuple, P.medoids(rounded, real).collect()))
    assert max(seen) > 2


def test_message_types_need_no_table_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(A, "message_distances", None)
    assert QF.aln10_message_types(spark, SMALL).count() == 10
