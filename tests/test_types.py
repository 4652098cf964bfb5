"""Dissection, parameters, semantics, templates, merging, validation and reports on small frames, against plain forms and worked values."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlore.operators import clusters as C
from fieldlore.operators import cuts
from fieldlore.operators import dissection as D
from fieldlore.operators import knees as K
from fieldlore.operators import merging as MG
from fieldlore.operators import pairwise as P
from fieldlore.operators import principal as PR
from fieldlore.operators import segmentation as G
from fieldlore.operators import semantics as SM
from fieldlore.operators import templates as T
from fieldlore.operators import validation as X
from fieldlore.operators.lineage import components, once
from fieldlore.sinks import reports as R
from fieldlore.sources import pcap

NINE = ["01020304", "020304", "010304", "0204", "0203", "141e253245021e", "250545", "00000000", "03020304"]


def nine(spark):
    v = spark.createDataFrame([(i, bytearray.fromhex(h), 1 + i) for i, h in enumerate(NINE)], "id bigint, bytes binary, n bigint")
    return v, once(P.distances(v.select(F.col("id").alias("rep_id"), "bytes", "n")))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (50, 70), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 70: 50, 100: 50}


def test_dissection(spark):
    text = '{"f": {"a_raw": ["1", 0], "a": "x", "b": {"c_raw": ["0A0b", 1], "c_raw": ["ff"]}, "d": {"e_raw": "77"}}, "g": {"h_raw": ["12"]}}'
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "{broken"), (5, "[1, 2]"), (6, '{"f": {}}')], "msg_id bigint, dissection string")
    got = [tuple(r) for r in D.walk(df).collect()]
    assert got == [(1, 0, "a", "01"), (1, 1, "c", "0a0b"), (1, 2, "c", "ff"), (1, 3, "e", "77"), (1, 4, "h", "12")]
    assert [r.name for r in D.walk(df, layer="b").collect()] == ["c", "c"] and D.walk(df, layer="zz").collect() == []
    assert [r.name for r in D.walk(df, ignore=("c",), exclude=("d",)).collect()] == ["a", "h"]
    assert json.loads(text)["g"]["h_raw"] == ["12"] and D.walk(df.limit(0)).collect() == []


def test_knees():
    x = np.linspace(0, 1, 200)
    found = K.find_knees(x, 1 - np.exp(-8 * x))
    # where the slope of the curve, scaled, is that of the diagonal
    assert len(found.at) == 1 and abs(found.at[0] - math.log(8 / (1 - math.exp(-8))) / 8) < 0.01
    assert K.find_knees(x, x).at == [] and K.find_knees(x, np.ones(200)).at == []
    fall = K.find_knees(np.arange(8), np.array([90, 40, 4, 3, 2, 1.5, 1, 0.5]), falling=True)
    assert fall.at == [2.0]
    y = np.random.default_rng(1).normal(0, 0.02, 300) + np.sqrt(np.linspace(0, 1, 300))
    s = K.smoothed(y, 0.03)
    assert ((s - y) ** 2).sum() == pytest.approx(0.03, rel=0.02) and np.abs(np.diff(s, 2)).sum() < np.abs(np.diff(y, 2)).sum() / 2
    curves = np.tile(np.sort(np.concatenate([np.linspace(0.1, 0.2, 80), np.linspace(0.8, 1, 20)])), (3, 1))
    eps, least, k = K.by_curvature(curves, 100)
    assert 0.19 < eps < 0.6 and least == 5 and k == 0
    assert K.by_curvature(np.zeros((3, 100)), 100)[0] == 0.001


def test_parameters(spark):
    """Two tight groups and some strays: the radius parts them."""
    rng = np.random.default_rng(2)
    rows = [(i, bytearray([10 + int(rng.integers(3)), 200 + int(rng.integers(5)), int(rng.integers(3)) + 60])) for i in range(30)]
    rows += [(100 + i, bytearray([200 + int(rng.integers(5)), 3 + int(rng.integers(2)), 9 + int(rng.integers(2))])) for i in range(30)]
    rows += [(200 + i, bytearray(rng.integers(0, 255, 3).astype("u1").tobytes())) for i in range(6)]
    v = spark.createDataFrame(rows, "msg_id bigint, bytes binary")
    reps = once(P.representatives(v))
    d = once(P.distances(reps))
    labels, p = K.cluster(d, reps.selectExpr("rep_id AS id"), sensitivity=1.0, most=None)
    assert 0 < p.eps < 0.7 and p.min_samples == round(math.log(reps.count()))
    got = {r.id: r.label for r in labels.collect()}
    big = [x for x in got.values() if x >= 0]
    assert len(set(big)) >= 2 and all(got[i] < 0 or got[i] != got[j] for i in got for j in got if i < 100 <= j < 200)
    x, y = K.distribution(K.nearest_ranks(d, 3), 2)
    plain = sorted(r.d for r in P.neighbours(d, 3).where("rank = 3").collect())
    assert y[-1] == 1 and all(abs(s - np.mean([q <= t + 1e-9 for q in plain])) < 1e-9 for t, s in zip(x, y, strict=True))
    with pytest.raises(K.NoKneeError):
        K.by_distribution(K.nearest_ranks(d, 2), 3)
    near = K.nearest_ranks(d, 4)
    m = [np.mean([r.d for r in near.where(F.col("rank") == k).collect()]) for k in range(4)]
    assert K.steepest(near) == 1 + int(np.argmax(np.diff(m)))


def test_walk_and_shapes(spark):
    """The worked walk over the nine values, and the signs that follow from it."""
    v, d = nine(spark)
    labels = v.select("id", F.lit(0).alias("label"))
    walk = SM.walks(d, labels).orderBy("step").collect()
    assert [NINE[r.id] for r in walk] == ["00000000", "01020304", "03020304", "020304", "010304", "0204", "0203", "250545", "141e253245021e"]
    assert [r.d for r in walk][1:] == pytest.approx([1, 0.125, 0.2144, 0.1111, 0.3677, 0.0714, 0.7007, 0.5767], abs=2.5e-4)
    (s,) = SM.shapes(d, labels).collect()
    pairs = [r.d for r in d.collect()]
    path, most = sum(r.d for r in walk[1:]), max(pairs)
    assert s.linear1 == (path < most * math.log(9)) and s.chaotic == (path > 1.2 * most * math.log(9))
    steps = [r.d for r in walk[1:]]
    calm = lambda x: np.std([y for y in x if y < np.percentile(x, 99)])
    assert s.linear3 == (calm(steps) / calm(pairs) < 0.4)
    assert SM.walks(d, labels.limit(0)).collect() == []


def test_hypotheses(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for label, make in enumerate([lambda i: bytes([*[0] * 39, i % 2]), lambda i: b"some text %d" % i, lambda i: bytes([7, i]), lambda i: bytes(rng.integers(0, 255, 4).astype("u1"))]):
        for i in range(6):
            k = len(rows)
            rows.append((k, bytearray(make(i)), 1 if label != 2 else 90))
            labels.append((k, label))
    v = spark.createDataFrame(rows, "id bigint, bytes binary, n bigint")
    lab = spark.createDataFrame(labels, "id bigint, label int")
    d = once(P.distances(v.select(F.col("id").alias("rep_id"), "bytes", "n")))
    got = {r.label: r.hypothesis for r in SM.hypotheses(d, lab, v).collect()}
    assert got[0] == "pad" and got[1] == "payload" and got[2] != "payload"
    named = {r.label: r["name"] for r in SM.names(d, lab.withColumn("label", F.when(F.col("label") == 3, -1).otherwise(F.col("label"))), v).collect()}
    assert named[-1] == "Noise: 6 Seg.s (4 bytes)" and named[2].startswith("Cluster #02: 6 Seg.s (d_max=0.") and named[2].endswith("2 bytes)")
    eigen = {r.label: r for r in SM.eigenvalues(lab, v).collect()}
    plain = np.array([list(rows[k][1]) for k, x in labels if x == 3], float)
    assert eigen[3].eigen == pytest.approx(np.sort(np.abs(np.linalg.eigvalsh(np.cov(plain.T)))).tolist(), rel=1e-6)


def test_merge_on_density(spark):
    """Two like groups side by side are merged, a distant one isn't; by the definition in plain numbers."""
    places = {0: [0, 1, 2, 3], 1: [4.5, 5.5, 6.5, 7.5], 2: [90, 90.2, 90.4, 90.6]}
    x = [(10 * k + i, k, p) for k, v in places.items() for i, p in enumerate(v)]
    labels = spark.createDataFrame([(i, k) for i, k, _ in x], "id bigint, label int")
    d = spark.createDataFrame([(i, j, abs(p - q) / 100) for i, _, p in x for j, _, q in x if i < j], "i bigint, j bigint, d double")
    pairs = [tuple(r) for r in SM.density_pairs(d, labels).collect()]
    assert pairs == [(0, 1)]
    assert {r.id: r.label for r in SM.merged(labels, SM.density_pairs(d, labels)).collect()} == {i: (0 if k < 2 else 2) for i, k, _ in x}


def test_templates(spark):
    parts = [b"\x01\x02\x03\x04", b"\x05\x02\x03\x04", b"\x02\x03\x04", b"\x09\x02\x03\x04"]
    assert T.shifts_of(parts) == ([0, 0, 1, 0], 4)
    x = T.laid(parts)
    assert np.isnan(x[2, 0]) and x[2, 1:].tolist() == [2, 3, 4]
    assert T.laid(parts, [b"\x08"] * 4, [b""] * 4)[2].tolist() == [8, 2, 3, 4]
    df = spark.createDataFrame([(1, k, bytearray(p)) for k, p in enumerate(parts)] + [(-1, 9, bytearray(b"zz"))], "label int, id bigint, bytes binary")
    (t,) = T.field_types(df).collect()
    assert t["mean"] == pytest.approx([5, 2, 3, 4]) and t.deviation == pytest.approx([np.std([1, 5, 9]), 0, 0, 0]) and t.members == 4
    again = T.field_types(df).collect()[0]
    assert again.type_id == t.type_id and again.covariance == t.covariance
    m = spark.createDataFrame([(5, bytearray(b"\x00\x00\x00\x00\x05\x02\x03\x04")), (6, bytearray(b"ab")), (7, None)], "msg_id bigint, data binary")
    found = T.recognise(m, T.field_types(df)).orderBy("pos").collect()
    assert [r.pos for r in found] == [0, 1, 2, 3, 4] and found[0].confidence == 99
    inv = np.linalg.pinv(np.array(t.covariance).reshape(4, 4))
    diff = np.array([5, 2, 3, 4]) - np.array(t["mean"])
    assert found[4].confidence == pytest.approx(math.sqrt(max(0, diff @ inv @ diff)), abs=1e-9)
    got = T.recognised(T.recognise(m, T.field_types(df)), T.field_types(df), 0.5).collect()
    assert [(r.msg_id, r.pos, r.length) for r in got] == [(5, 4, 4)]
    assert [bytes(r.bytes) for r in T.to_segments(T.recognised(T.recognise(m, T.field_types(df)), T.field_types(df), 0.5), m).collect()] == [b"\x05\x02\x03\x04"]
    text = spark.createDataFrame([(1, bytearray(b"\x01\x02hello world\0abc\x01")), (2, None)], "msg_id bigint, data binary")
    assert [tuple(r) for r in T.recognised_text(text).collect()] == [(1, 1, 13)]


def test_principal_components():
    """Variation planted in bytes 2 and 3 of eight, with zeros after: the bound behind them is found."""
    rng = np.random.default_rng(1)
    parts = sorted({bytes([7, 1, int(a) >> 8, int(a) & 255, 0, 0, 0, 0]) for a in rng.integers(0, 60000, 60)})
    none = [b""] * len(parts)
    ((rows, shift, bounds),) = PR.analyse(parts, none, none, np.ones(len(parts), int))
    assert rows == list(range(len(parts))) and set(shift) == {0} and bounds == {(0, 8): [0, 4, 8]}
    # zeros before what varies: the bound where it rises
    late = sorted({bytes([0, 0, 0, 0, 0, int(a) >> 8, int(a) & 255]) for a in rng.integers(0, 60000, 60)})
    ((_, _, bounds),) = PR.analyse(late, none[:1] * len(late), none[:1] * len(late), np.ones(len(late), int))
    assert 5 in bounds[0, 7]
    assert PR.analyse([b"ab", b"ab"], [b""] * 2, [b""] * 2, np.ones(2, int)) == []
    values = [bytes(rng.integers(0, 9, int(n)).astype("u1")) for n in rng.integers(1, 12, 30)]
    from fieldlore.operators.alignment import value_dissimilarity

    m = PR.matrix(values)
    assert all(m[i, j] == pytest.approx(value_dissimilarity(a, b), abs=1e-12) for i, a in enumerate(values) for j, b in enumerate(values) if i != j)
    # starts that most segments share are added to those that begin before them
    assert PR.shape_bounds({(0, 6): 3, (2, 6): 7}, [])[0, 6] == [0, 2, 6]
    assert PR.relocations(np.array([[0.7], [0.7], [0.0], [0.0]])) == [2] and PR.relocations(np.zeros((0, 0))) == []


def test_refined_messages(spark):
    """Messages whose segments hide a counter between constants are cut behind it, gap-free."""
    rng = np.random.default_rng(6)
    data = [bytes([7, 1, *map(int, rng.integers(0, 255, 2)), 0, 0, 0, 0]) + bytes([200 + k % 3, 9, 9]) for k in range(60)]
    m = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(data)], "msg_id bigint, data binary")
    whole = G.from_lengths(m, spark.createDataFrame([(k, p, n) for k in range(60) for p, n in enumerate((8, 3))], "msg_id bigint, pos int, len int"))
    labels = whole.where("length = 8").select("bytes", F.lit(0).cast("bigint").alias("label")).distinct()
    bounds = PR.wanted_bounds(PR.new_bounds(whole, labels), whole)
    assert {(r.msg_id, r.bound) for r in bounds.collect()} == {(k, 4) for k in range(60)}
    out = PR.apply_bounds(whole, bounds, m).orderBy("msg_id", "seg_no").collect()
    assert {tuple(r.length for r in out if r.msg_id == k) for k in range(60)} == {(4, 4, 3)}
    assert all(b"".join(bytes(r.bytes) for r in out if r.msg_id == k) == data[k] for k in range(60))
    near = spark.createDataFrame([(0, 7), (1, 1)], "msg_id bigint, bound int")
    out = PR.apply_bounds(whole.where("msg_id < 2"), near, m).orderBy("msg_id", "seg_no").collect()
    assert [(r.msg_id, r.offset) for r in out] == [(0, 0), (0, 7), (1, 0), (1, 1), (1, 8)]
    small = spark.createDataFrame([(1, 0, 0, 3, bytearray(b"\x01\x02z")), (2, 0, 0, 3, bytearray(b"\x01zz"))], G.SEGMENTS)
    assert [r.length for r in PR.split_small_first(small).orderBy("msg_id", "seg_no").collect()] == [1, 1, 1, 3]


def plain_pivots(rows, longest, relaxed):
    out = {}
    for label in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == label]
        n = len({r[1] for r in mine})
        t, found = math.floor(math.log(n)), []
        for col in sorted({r[2] for r in mine}):
            v = [r[3] for r in mine if r[2] == col]
            counts = sorted(v.count(x) for x in {x for x in v if x is not None})
            some = [x for x in v if x is not None]
            if not 1 < len(counts) <= t or v.count(None) > t or max(map(len, some)) > longest or any(not any(x) for x in some):
                continue
            cut = int(np.argmax(np.diff(counts))) + 1
            often = len(counts) - cut > 1 and sum(counts[:cut]) / sum(counts[cut:]) < 0.1 and np.mean(counts[cut:]) > 2 * n / math.log(n)
            if counts[0] > t or (relaxed and often):
                found.append(col)
        if len(found) <= 2:
            out |= {(label, c): 1 for c in found}
    return set(out)


def test_split(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        label = "ab"[i % 2]
        rows += [(label, i, 0, bytes([int(rng.integers(250)) + 1])), (label, i, 1, bytes([1 + i % 4 // 2])), (label, i, 2, b"\0" if i % 3 else b"\1"), (label, i, 3, bytes([5 + (i % 97 == 0)])), (label, i, 4, None if i % 90 == 0 else bytes([3 + int(i % 6 < 3)]))]
    df = spark.createDataFrame([(a, i, c, None if v is None else bytearray(v)) for a, i, c, v in rows], "label string, msg_id bigint, col int, bytes binary")
    for longest, relaxed in ((6, True), (6, False), (0, True)):
        assert {tuple(r) for r in MG.pivot_columns(df, longest, relaxed).collect()} == plain_pivots(rows, longest, relaxed)
    parts = MG.split(df, MG.pivot_columns(df)).collect()
    key = {}
    for r in parts:
        cols = {c for a, c in plain_pivots(rows, 6, True) if a == r.label}
        mine = tuple(v for a, i, c, v in rows if i == r.msg_id and c in cols)
        assert key.setdefault((r.label, r.part), mine) == mine
    assert len(parts) == 400


def test_matches_and_merge(spark):
    rows = []
    for k, (name, third) in enumerate({"p": "x1", "q": "x1", "r": "x2"}.items()):
        for i in range(4):
            cells = [b"\x10\x11", bytes([50 + i]), {"x1": b"\x77\x78\x79", "x2": b"\xe0\x05\x90"}[third]]
            rows += [(name, 10 * k + i, c, bytearray(v)) for c, v in enumerate(cells)]
    df = spark.createDataFrame(rows, "label string, msg_id bigint, col int, bytes binary")
    found = {(r.p, r.q): r for r in MG.matches(df).collect()}
    assert found["p", "q"].matched and found["p", "q"].gaps == 0 and not found["p", "r"].matched and not found["q", "r"].matched
    # two of three clusters are more than 0.66 of all: such a chain goes
    assert MG.merge_pairs(MG.matches(df), 3).collect() == []
    pairs = [tuple(r) for r in MG.merge_pairs(MG.matches(df), 9).collect()]
    assert pairs == [("p", "q")]
    got = {r.msg_id: r.label for r in MG.merged(df.select("msg_id", "label").distinct(), MG.merge_pairs(MG.matches(df), 9)).collect()}
    assert {got[i] for i in (0, 1, 2, 3, 10, 11, 12, 13)} == {"p"} and got[20] == "r"
    dist = {(r.p, r.q): r.distance for r in MG.cluster_distances(df).collect()}
    # dynamic fields with equal values and equal static ones have the greatest score
    assert dist["p", "q"] == pytest.approx(0) and dist["p", "r"] > 1
    assert MG.conditions(None, [b"a"])[0] and MG.conditions([b"\0\0"], [b"a", b"b"])[3] and MG.conditions([b"a"], [b"a", b"b"])[6]
    a, b = MG.with_neighbours_joined([[b"\1"], [b"\2"], [b"\5", b"\6"]], [[b"\1"], None, [b"\5", b"\7"]], {b"\1\2"})
    assert a == [[b"\1\2"], [b"\5", b"\6"]] and b == [[b"\1"], [b"\5", b"\7"]]
    assert MG.long_gap_alone([False, True, True, True, False], [[b"a", b"b"], None, None, None, [b"c", b"d"]])
    assert not MG.long_gap_alone([False, True, True, True, False], [[b"a"], None, None, None, [b"c", b"d"]]) and not MG.long_gap_alone([True] * 3, [None] * 3)


def test_progressive_alignment(spark):
    messages = {1: ["aa", "0102", "bb"], 2: ["aa", "bb"], 3: ["10", "aa", "0102", "bb", "f0f1f2"]}
    s = spark.createDataFrame([(i, k, bytearray.fromhex(h)) for i, p in messages.items() for k, h in enumerate(p)], "msg_id bigint, seg_no int, bytes binary")
    labels = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0), (3, 0, 2.0)], "msg_id bigint, label int, d double")
    rows = MG.progressive_alignment(s, labels, spark.createDataFrame([(0, 1)], "label int, medoid bigint")).orderBy("msg_id", "col").collect()
    table = {i: [r.bytes and bytes(r.bytes).hex() for r in rows if r.msg_id == i] for i in messages}
    assert table == {1: [None, "aa", "0102", "bb", None], 2: [None, "aa", None, "bb", None], 3: ["10", "aa", "0102", "bb", "f0f1f2"]}


def plain_overlap(a, z, ends):
    inner = [e for e in ends if a < e < z]
    best = (0, 0)
    for x, y in zip([a, *inner], [*inner, z], strict=True):
        if best[1] - best[0] < y - x:
            best = (x, y)
    x, y = best
    before, after = max([0] + [e for e in ends if e <= a]), min([e for e in ends if e >= z] + [ends[-1]])
    if (x == a and (y - x) / (y - before) <= 0.5) or (y == z and (y - x) / (after - x) <= 0.5):
        return (0.0, None, None, None)
    return ((y - x) / (z - a), ends.index(after if y == z else y), x, y)


def test_overlaps(spark):
    rng = np.random.default_rng(3)
    segs, ends, want = [], [], {}
    for i in range(60):
        n = int(rng.integers(3, 25))
        e = sorted({*rng.integers(1, n, 4).tolist(), n})
        ends += [(i, x) for x in e]
        cut = sorted({0, *rng.integers(1, n, 3).tolist(), n})
        for a, z in zip(cut, cut[1:], strict=False):
            segs.append((i, a, z - a))
            want[i, a] = plain_overlap(a, z, e)
    got = X.overlaps(spark.createDataFrame(segs, "msg_id bigint, offset int, length int"), spark.createDataFrame(ends, "msg_id bigint, end bigint")).collect()
    assert {(r.msg_id, r.offset): (pytest.approx(r.ratio), r.pos, r["from"], r.to) for r in got} == want


def test_rises_of_frequency(spark):
    rows = [(1, 0, 0, b"a"), (1, 1, 1, b"b"), (1, 2, 2, b"b"), (1, 3, 3, b"c"), (2, 0, 0, b"b"), (2, 1, 1, b"a"), (3, 0, 0, b"b")]
    df = spark.createDataFrame([(i, k, o, len(v), bytearray(v)) for i, k, o, v in rows], G.SEGMENTS)
    n = {b"a": 2, b"b": 4, b"c": 1}
    # a 2, b 4 (rises), b 4 (joins), c: held at 4 - 3 // 4 = 4 (joins)
    got = [(r.msg_id, bytes(r.bytes)) for r in G.merge_on_rise(df).orderBy("msg_id", "seg_no").collect()]
    assert n[b"c"] == 1 and got == [(1, b"a"), (1, b"bbc"), (2, b"ba"), (3, b"b")]


def test_reports(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, 0, 1, bytearray(b"\x01")), (1, 1, 1, 2, bytearray(b"ab")), (2, 0, 0, 1, bytearray(b"z"))], G.SEGMENTS)
    assert sorted(tuple(r) for r in R.read(spark, R.segmented_messages(s, str(tmp_path / "s"))).collect()) == [("1", "01 6162"), ("2", "7a")]
    frames = spark.createDataFrame([(i, 1_700_000_000.5 + (7 - i), bytearray(bytes([i] * (i + 20)))) for i in range(6)], "msg_id bigint, t double, raw binary").selectExpr("msg_id", "timestamp_micros(bigint(t * 1000000)) AS ts", "raw")
    paths = R.capture(frames, str(tmp_path / "cap"), kept=frames.where("msg_id <> 2").select("msg_id"))
    pcap.register(spark)
    back = spark.read.format("pcap").load(str(tmp_path / "cap")).orderBy("ts").collect()
    assert paths and [r.raw[0] for r in back] == [5, 4, 3, 1, 0] and back[0].ts.microsecond == 500000
    st = R.Stages()
    assert st.timed("one", lambda x: x + 1, 2) == 3 and st.table(spark).count() == 1
    m = {r.key: r.value for r in R.metadata(spark, R.title("m", sigma=0.6, k=3), {"b": 1, "a": 2}).collect()}
    assert m["title"] == "m-sigma=0.600-k=3" and m["parameter.a"] == "2" and m["spark"] == spark.version


def test_numbers_of_pictures(spark):
    ids = spark.createDataFrame([(i,) for i in range(5)], "id bigint")
    at = np.array([[0, 0], [3, 0], [0, 4], [3, 4], [1, 1]], float)
    d = spark.createDataFrame([(i, j, float(np.linalg.norm(at[i] - at[j]))) for i in range(5) for j in range(i + 1, 5)], "i bigint, j bigint, d double")
    got = {r.id: np.array([r.x, r.y]) for r in X.layout(d, ids).collect()}
    assert all(np.linalg.norm(got[i] - got[j]) == pytest.approx(np.linalg.norm(at[i] - at[j])) for i in range(5) for j in range(5))
    with pytest.raises(ValueError, match="subsample"):
        X.layout(d, ids, most=3)
    bits = spark.createDataFrame([(1, 0, 3), (1, 1, 5), (1, 2, 16), (1, 3, 4), (1, 4, 4)], "msg_id bigint, pos int, bits int")
    assert [tuple(r) for r in X.bytes_of_bits(bits).orderBy("pos").collect()] == [(1, 0, 1), (1, 1, 2), (1, 2, 1)]


def test_ties_by_name(spark):
    """Of equally frequent types the first by name counts."""
    from fieldlore.operators import scores as V

    df = spark.createDataFrame([("c", k) for k in ("ez", "es", "en", "ee") for _ in range(2)], "cluster string, kind string")
    assert V.cluster_quality(df, "cluster", "kind").first().kind == "ee"


def test_worked_steps():
    assert cuts.refined([b"ab\0\0\0cd"], "zeros") == [b"ab", b"\0\0\0", b"cd"]
    assert C.adjusted_eps(0.5, 0.5) == pytest.approx(0.4)
