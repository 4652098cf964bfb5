"""Segmenters and refinements on worked values, invariants and small frames."""

import numpy as np
import pytest

from fieldlore.operators import cuts as C
from fieldlore.operators import messages as M
from fieldlore.operators import segmentation as G


def test_kernels_lose_nothing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 6, 17, 200):
        for high in (3, 128, 256):
            data = rng.integers(0, high, n, dtype=np.int64).astype(np.uint8).tobytes()
            for cut in (C.lows_between, lambda b: C.lows_between(b, horizon=True), C.steep_changes, C.falls):
                bounds = C.bounds(data, cut)
                assert bounds == sorted(set(bounds)) and bounds[0] == 0 and bounds[-1] == n
            ends = C.bounds(data, C.steepest_rises)
            pieces = [data[x:y] for x, y in zip(ends, ends[1:], strict=False)]
            for step in C.STEPS:
                out = C.refined(pieces, step)
                assert b"".join(out) == data and all(out)


def test_text_widens_by_pairs():
    """A single text takes what is printable on both sides; of two, the first one has taken the second, and what follows keeps its start."""
    assert C.refined([b"\x01ab", b"cde", b"fg\x02h"], "pull") == [b"\x01", b"abcdefg", b"\x02h"]
    assert C.refined([b"\x01ab", b"cde", b"xyz", b"fg\x02h"], "pull") == [b"\x01", b"abcdexyz", b"fg\x02h"]
    assert C.refined([b"ab", b"cd", b"ef", b"g\0"], "pull") == [b"abcdefg", b"\0"]
    assert C.refined([b"a\x01b", b"cd", b"e\x02f", b"gh", b"\x03"], "pull") == [b"a\x01", b"bcde", b"\x02", b"fgh", b"\x03"]


def test_text_fields():
    """Recognised text takes a closing zero in; two bytes a character are text, too; the last bytes open no window."""
    assert C.text_fields(b"\x01\x02hello world\0abc\x01") == [(1, 14)]
    assert C.text_fields(b"h\0e\0l\0l\0o\0\0\x01\x80\x80\x80") == [(0, 11)]
    assert C.text_fields(b"abcdef") == [] and C.text_fields(b"abcdefg") == [(0, 7)]
    assert C.crop_text_fields([b"\xf0\xf1hel", b"lo wor", b"ld\0abc\x80"]) == [b"\xf0\xf1", b"hello world\0", b"abc\x80"]


def test_zero_slices():
    assert C.refined([b"ab\0\0\0cd"], "zeros") == [b"ab", b"\0\0\0", b"cd"]
    assert C.refined([b"ab\0cd"], "zeros") == [b"ab", b"\0cd"]
    assert C.refined([b"abcdef\0gh"], "zeros") == [b"abcdef\0", b"gh"]
    assert C.refined([b"ab\0cd"], "zeros_le") == [b"ab\0", b"cd"]
    # an inferred bound one byte from a zero bound or the end gives way, one further off stays
    assert C.refined([b"a", b"b\0\0\0cd", b"ef"], "zeros") == [b"ab", b"\0\0\0", b"cd", b"ef"]
    assert C.refined([b"ab\0\0\0cd", b"e"], "zeros") == [b"ab", b"\0\0\0", b"cde"]


def test_text_steps():
    assert C.gather_text([b"ab", b"cd", b"efg", b"\xff\x02"]) == [b"abcdefg", b"\xff\x02"]
    assert C.gather_text([b"\xff", b"abc", b"def", b"\0\0"]) == [b"\xff", b"abcdef", b"\0\0"]
    assert C.text_spans(b"\x01\x02hello world\0abc") == [(1, 13)]
    assert C.crop_text([b"\xf0\xf1hel", b"lo wor", b"ld\0abc"]) == [b"\xf0\xf1", b"hello world", b"\0abc"]


def test_sums_say_what_one_value_says():
    rng = np.random.default_rng(2)
    for low, high in ((0, 4), (0, 128), (30, 127), (90, 120)):
        data = rng.integers(low, high, 60, dtype=np.int64).astype(np.uint8).tobytes() + b"hello world, \0\0some text\x01"
        sums = C.Sums(data)
        for a in range(len(data)):
            for z in range(a, len(data) + 1):
                assert sums.text_like(a, z) == C.text_like(data[a:z]), (a, z)
                assert sums.double_zero(a, z) == (b"\0\0" in data[a:z]) and sums.zeros(a, z) == data[a:z].count(0)


def test_long_text_is_linear():
    data = b"plain words " * 100_000
    assert C.text_spans(data) == [(0, len(data))] and C.gather_text([data[k : k + 3] for k in range(0, len(data), 3)]) == [data]


def test_leaps_and_plunges():
    assert C.bounds(bytes([5, 5, 5, 9, 9]), C.steep_changes) == [0, 3, 5]
    assert C.bounds(bytes([0, 255, 0, 100]), C.falls) == [0, 1, 4]


def test_random_runs():
    assert C.bit_entropy(b"\0\0") == 0 and C.bit_entropy(b"\x1b\x74\xe5") > 0.8
    assert C.merge_random([b"\0", b"\0\0", b"\x9b\x74\xe5"]) == [b"\0\0\0", b"\x9b\x74\xe5"]


def frame(spark, rows):
    return spark.createDataFrame([(i, k, o, len(b), bytearray(b)) for i, k, o, b in rows], G.SEGMENTS)


def test_crop_common(spark):
    messages = spark.createDataFrame([(i, bytearray(b"xx")) for i in range(20)], "msg_id bigint, data binary")
    s = frame(spark, [(i, 0, 0, b"\x81\x82") for i in range(6)] + [(9, 0, 0, b"a\x81\x82bc"), (9, 1, 5, b"zz")])
    rows = G.crop_common(s, messages).where("msg_id = 9").orderBy("seg_no").collect()
    assert [(r.seg_no, r.offset, bytes(r.bytes)) for r in rows] == [(0, 0, b"a"), (1, 1, b"\x81\x82"), (2, 3, b"bc"), (3, 5, b"zz")]
    assert G.crop_common(s.limit(0), messages).count() == 0


def test_gaps_wobble_and_split(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcdefgh")), (2, bytearray(b"xy")), (3, bytearray()), (4, None)], "msg_id bigint, data binary")
    s = frame(spark, [(1, 0, 2, b"cd"), (1, 1, 5, b"f")])
    rows = G.fill_gaps(df, s).orderBy("msg_id", "seg_no").collect()
    assert [(r.msg_id, r.seg_no, bytes(r.bytes)) for r in rows] == [(1, 0, b"ab"), (1, 1, b"cd"), (1, 2, b"e"), (1, 3, b"f"), (1, 4, b"gh"), (2, 0, b"xy")]
    assert sorted(bytes(r.bytes) for r in G.wobble(df, s).collect()) == [b"bcd", b"cd", b"d", b"ef", b"f"]
    assert [bytes(r.bytes) for r in G.split_segment(s).orderBy("seg_no").collect()] == [b"c", b"d", b"f"]
    cut = G.random(df).orderBy("msg_id", "seg_no").collect()
    assert b"".join(bytes(r.bytes) for r in cut if r.msg_id == 1) == b"abcdefgh" and {r.msg_id for r in cut} == {1, 2}
    assert G.again(s, ["text"]).select("length").collect()[0][0] == 3


def test_cosine_means(spark):
    rows = [(1, b"aa"), (1, b"bb"), (2, b"aa"), (2, b"aa"), (3, b"cc"), (4, b"bb"), (4, b"cc")]
    s = frame(spark, [(i, 0, 0, b) for i, b in rows])
    n = {b: sum(x == b for _, x in rows) for _, b in rows}
    vec = {i: {b: n[b] for j, b in rows if j == i} for i, _ in rows}
    cos = lambda a, b: sum(a[k] * b.get(k, 0) for k in a) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    want = {i: sum(cos(vec[i], vec[j]) for j in vec) / len(vec) for i in vec}
    assert {r.msg_id: r.mean for r in M.mean_cosine(s).collect()} == pytest.approx(want, abs=1e-8)


def test_measures_and_xor(spark):
    from pyspark.sql import functions as F

    from fieldlore.functions import series as S

    hay, feature = [5, 1, 2, 9, 9, 9, 0, 0, 0, 4], [1, 2, 9]
    df = spark.createDataFrame([(hay, feature, bytearray(b"\x1b\x74\xe5\x01"), bytearray(b"\x00\x80\x77"))], "h array<int>, f array<int>, a binary, b binary")
    a, b = S.values(F.col("a")), S.values(F.col("b"))
    at = {m: S.similarity_at(F.col("f"), F.col("h"), m) for m in ("sad", "cosine", "pearson")}
    row = df.select(*(x.alias(m) for m, x in at.items()), *(S.best_place(x, m).alias("p" + m) for m, x in at.items()), S.xor_entropy(a, b).alias("x"), S.bit_gram_entropy(a).alias("e")).first()
    w, f = np.lib.stride_tricks.sliding_window_view(np.array(hay, float), 3), np.array(feature, float)
    assert row.sad == np.abs(w - f).sum(axis=1).tolist() and row.psad == row.pcosine == row.ppearson == 1
    for k, x in enumerate(w):
        assert row.cosine[k] is None if not x.any() else row.cosine[k] == pytest.approx(1 - x @ f / np.sqrt(x @ x * (f @ f)))
        assert row.pearson[k] is None if x.std() == 0 else row.pearson[k] == pytest.approx(np.corrcoef(x, f)[0, 1])
    assert row.e == pytest.approx(C.bit_entropy(b"\x1b\x74\xe5\x01")) and row.x == pytest.approx(C.bit_entropy(b"\x1b\xf4\x92"))
