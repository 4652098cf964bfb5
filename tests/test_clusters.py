"""Clusters and message distances on small frames, against plain forms of the same."""

import itertools
import math

import pytest

from fieldlore.operators import alignment as A
from fieldlore.operators import clusters as C
from fieldlore.operators import pairwise as P
from fieldlore.operators import scores as V

NINE = ["01020304", "020304", "010304", "0204", "0203", "141e253245021e", "250545", "00000000", "03020304"]


def test_kernel_is_the_expression(spark):
    df = spark.createDataFrame([(i, bytearray.fromhex(h)) for i, h in enumerate(NINE)], "msg_id bigint, bytes binary")
    for r in P.distances(P.representatives(df)).collect():
        assert A.value_dissimilarity(bytes.fromhex(NINE[r.i]), bytes.fromhex(NINE[r.j])) == pytest.approx(r.d, abs=1e-12)


def test_message_distances(spark):
    rows = [(0, 0, "01020304"), (0, 1, "020304"), (0, 2, "010304"), (1, 0, "0204"), (1, 1, "0203"), (2, 0, "141e25"), (2, 1, "25"), (2, 2, "0000"), (2, 3, "03020304"), (3, 0, "")]
    df = spark.createDataFrame([(i, k, bytearray.fromhex(h)) for i, k, h in rows], "msg_id bigint, seg_no int, bytes binary")
    parts = {i: [bytes.fromhex(h) for j, _, h in rows if j == i] for i in range(3)}
    score = lambda a, b: 1 - A.value_dissimilarity(a, b)
    want = {(i, j): A.last_line(parts[i], parts[j], score)[-1] for i, j in itertools.combinations(range(3), 2)}
    for blocks in (1, 3, None):
        got = A.message_distances(df, blocks).collect()
        assert {(r.i, r.j): r.score for r in got} == pytest.approx(want)
        assert all(r.distance == pytest.approx(A.message_distance(r.score, len(parts[r.i]), len(parts[r.j]))) for r in got)
    assert A.message_distances(df.limit(0)).count() == 0


def test_splits_and_noise(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(40, -1), (41, 2)], "id bigint, label int")
    counts = spark.createDataFrame([(i, 500 if i == 0 else 1) for i in range(42)], "id bigint, n bigint")
    o = {r.label: r for r in C.occurrences(labels, counts).collect()}
    assert set(o) == {1, 2} and o[1].total == 539 and o[1].rank == pytest.approx(97.5)
    often = {r.id for r in C.split_by_occurrence(labels, counts).collect() if r.often}
    assert often == {0}
    kept = {r.id: r.label for r in C.least_size(labels, 42).collect()}
    assert kept[41] == -1 and kept[0] == 1 and math.log(42) > 1
    assert C.adjusted_eps(0.5, 0.5) == pytest.approx(0.5 * 0.8)


def test_columns_and_formats(spark):
    rows = [("a", 1, 0, "01"), ("a", 2, 0, "01"), ("a", 1, 1, "05"), ("a", 2, 1, "06"), ("a", 1, 2, None), ("a", 2, 2, None), ("b", 3, 0, "02"), ("b", 3, 1, None)]
    df = spark.createDataFrame([(c, m, k, None if h is None else bytearray.fromhex(h)) for c, m, k, h in rows], "label string, msg_id bigint, col int, bytes binary")
    got = {(r.label, r.col): (r.kind, r.gaps) for r in C.columns(df).collect()}
    assert got == {("a", 0): ("static", 0), ("a", 1): ("dynamic", 0), ("a", 2): ("gap", 2), ("b", 0): ("static", 0), ("b", 1): ("gap", 1)}
    assert sorted((r.label, r.col, bytes(r.bytes)) for r in C.discriminators(df).collect()) == [("a", 0, b"\x01"), ("b", 0, b"\x02")]
    fields = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (2, 1, 3), (2, 0, 2), (3, 0, 5)], "msg_id bigint, pos int, len int")
    assert sorted((r.format, r.n, r.msg_id) for r in V.formats(fields).collect()) == [("2,3", 2, 1), ("5", 1, 3)]


def test_empty(spark):
    labels = spark.createDataFrame([], "id bigint, label int")
    d = spark.createDataFrame([], "i bigint, j bigint, d double")
    for f in (C.remotest, C.detours, C.trace_means, C.links, C.ecdf, P.medoids):
        assert f(d, labels).count() == 0
    assert V.statistics(spark.createDataFrame([], "score double, k int"), "k").count() == 0


def test_divided_alignment():
    sim = [[1.0 if i == j else 0.0 for j in range(5)] for i in range(5)]
    sim[2][1] = sim[1][2] = 0.9
    score = lambda a, b: sim[a][b]
    assert A.divided_alignment([2, 4, 3, 0], [1, 4, 0], score) == ([2, 4, 3, 0], [1, 4, None, 0])
    assert A.divided_alignment([], [1, 2], score) == ([None, None], [1, 2])


def test_star_alignment(spark):
    messages = {1: ["aa", "0102", "bb"], 2: ["aa", "bb"], 3: ["10", "aa", "0102", "bb", "f0f1f2"], 4: ["aa", "0102", "bb", "f0f1f2", "55"], 5: ["77"]}
    s = spark.createDataFrame([(i, k, bytearray.fromhex(h)) for i, p in messages.items() for k, h in enumerate(p)], "msg_id bigint, seg_no int, bytes binary")
    labels = spark.createDataFrame([(i, -1 if i == 5 else 0) for i in messages], "msg_id bigint, label int")
    rows = A.star_alignment(s, labels, spark.createDataFrame([(0, 1)], "label int, medoid bigint")).orderBy("msg_id", "col").collect()
    table = {i: [r.bytes and bytes(r.bytes).hex() for r in rows if r.msg_id == i] for i in range(1, 5)}
    assert table == {
        1: [None, "aa", "0102", "bb", None, None],
        2: [None, "aa", None, "bb", None, None],
        3: ["10", "aa", "0102", "bb", "f0f1f2", None],
        4: [None, "aa", "0102", "bb", "f0f1f2", "55"],
    }
    assert [r.col for r in rows if r.msg_id == 1] == list(range(6)) and not [r for r in rows if r.msg_id == 5]


def plain_frequent(messages, share, drop):
    least, out = share * len(messages), {}
    occ = {(i, o): m[o : o + 1] for i, m in enumerate(messages) for o in range(len(m))}
    count = lambda x: {g: sum(v == g for v in x.values()) for g in x.values()}
    occ = {p: g for p, g in occ.items() if count(occ)[g] >= least}
    while occ:
        n = count(occ)
        longer = {(i, o): g + occ[i, o + 1][-1:] for (i, o), g in occ.items() if (i, o + 1) in occ}
        m = count(longer)
        grown = {p: g for p, g in longer.items() if m[g] >= least and m[g] >= drop * n[g[:-1]]}
        covered = {(i, o + k) for i, o in grown for k in (0, 1)}
        for g in n:
            out[g.hex().upper()] = (len(g), n[g], sum(v == g and p not in covered for p, v in occ.items()))
        occ = grown
    return out


def test_frequent_sequences(spark):
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    messages = [b"abcabcx", b"xabcd", b"abab", b"bcabc", b"", b"zzzz"]
    df = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(messages)], "msg_id bigint, data binary")
    from fieldlore.operators import sequences as SQ

    for share, drop in ((0.6, 0.6), (0.4, 0.9), (5.0, 0.6)):
        got = {r.h: (r.length, r.n, r.rest) for r in SQ.frequent(df, share, drop).collect()}
        assert got == plain_frequent(messages, share, drop)
