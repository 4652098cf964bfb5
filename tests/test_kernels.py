"""Sequential kernels against worked values and invariants."""

import numpy as np
import pytest

from fieldlore.operators import alignment as A
from fieldlore.operators import cuts as C
from fieldlore.operators import pairwise as P
from fieldlore.operators import segmentation as G

SHORT = "00000a41 00002934 00005984 000039cb 000021ca 0000486a 00002779 00005374 00004535 000051c1".split()
NINE = ["01020304", "020304", "010304", "0204", "0203", "141e253245021e", "250545", "00000000", "03020304"]


def test_segments_are_gap_free():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 9, 40, 300):
        for sigma in (0.6, 1.5):
            data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
            bounds = C.bounds(data, C.steepest_rises, sigma)
            assert bounds == sorted(set(bounds)) and bounds[0] == 0 and (bounds[-1] == n)
            pieces = [data[a:z] for a, z in zip(bounds, bounds[1:], strict=False)]
            assert b"".join(pieces) == data
            assert b"".join(C.refined(pieces, "text", "pull")) == data and all(C.refined(pieces, "text", "pull"))


def plain_rises(data, sigma):
    """Steepest rises one message at a time, from the definition."""
    n = len(data)
    bc = [1 - (a ^ b).bit_count() / 8 for a, b in zip(data, data[1:], strict=False)]
    raw = [b - a for a, b in zip(bc, bc[1:], strict=False)]
    m, r = len(raw), int(4 * sigma + 0.5)
    if m < 2:
        return [0, n] if n else [0]
    w = np.exp(-0.5 / (sigma * sigma) * np.arange(-r, r + 1) ** 2)
    w /= w.sum()
    far = lambda i: raw[i % (2 * m)] if i % (2 * m) < m else raw[2 * m - 1 - i % (2 * m)]
    g = []
    for i in range(m):
        x = raw[i] * w[r]
        for k in range(r, 0, -1):
            x += (far(i - k) + far(i + k)) * w[r + k]
        g.append(x)
    low = [i for i in range(m) if (i == 0 or g[i] < g[i - 1]) and (i == m - 1 or g[i] < g[i + 1])]
    high = [i for i in range(m) if (i == 0 or g[i] > g[i - 1]) and (i == m - 1 or g[i] > g[i + 1])]
    turns, found = sorted([(i, "low") for i in low] + [(i, "high") for i in high]), [0]
    for (i, x), (j, y) in zip(turns, turns[1:], strict=False):
        if x == "low" and y == "high":
            found.append(max(range(i, j), key=lambda k: raw[k + 1] - raw[k]) + 2)
    found.append(n)
    kept = [0, *(b for a, b in zip(found, found[1:], strict=False) if b - a > 1)]
    if kept[-1] != n:
        kept = [*(kept[:-1] or [0]), n] if len(kept) > 1 else [0, n]
    return kept


def test_batches_cut_as_single_messages():
    """All kernels give a message the same cuts alone and among others; rises are those of the definition."""
    rng = np.random.default_rng(5)
    messages = []
    for _ in range(400):
        n, high = int(rng.choice([0, 1, 2, 3, 4, 5, 8, 30])), int(rng.choice([3, 128, 256]))
        v = rng.integers(0, high, n).astype("u1")
        v[rng.random(n) < 0.2] = 0
        text = rng.random(n) < 0.4
        v[text] = rng.integers(32, 127, text.sum())
        messages.append(v.tobytes())
    b = C.Batch(messages)
    cuts = {"rises": C.steepest_rises, "lows": C.lows_between, "horizon": lambda x: C.lows_between(x, horizon=True), "changes": C.steep_changes, "falls": C.falls, "back": lambda x: C.backwards(x, C.steepest_rises)}
    cuts |= {s: lambda x, s=s: C.refine(x, C.steepest_rises(x), [s]) for s in C.STEPS}
    for name, cut in cuts.items():
        mask = cut(b)
        for k, m in enumerate(messages):
            own = np.flatnonzero(mask[b.first[k] : b.first[k + 1]]).tolist()
            assert [*own, len(m)] == C.bounds(m, cut) if m else own == [], (name, m)
    for m in messages:
        assert C.bounds(m, C.steepest_rises) == plain_rises(m, 0.6)
        assert C.bounds(m, lambda x: C.backwards(x, C.steepest_rises)) == ([len(m) - x for x in reversed(plain_rises(m[::-1], 0.6))])


def test_default_segmentation_of_short_messages(spark):
    df = spark.createDataFrame([(i, bytearray.fromhex(h)) for i, h in enumerate(SHORT)], "msg_id bigint, data binary")
    rows = G.congruence(df, refined=True).orderBy("msg_id", "seg_no").collect()
    got = [[r.bytes.hex() for r in rows if r.msg_id == i] for i in range(10)]
    assert got == [[h] if i in (0, 4) else [h[:4], h[4:]] for i, h in enumerate(SHORT)]


def test_odd_messages(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"a")), (3, bytearray(b"a"))], "msg_id bigint, data binary")
    for out in (G.congruence(df), G.congruence(df, little_endian=True), G.fixed(df)):
        assert [(r.msg_id, bytes(r.bytes)) for r in out.collect()] == [(3, b"a"), (3, b"a")]
    assert G.congruence(df.limit(0)).collect() == []


def test_distances(spark):
    df = spark.createDataFrame([(i, bytearray.fromhex(h)) for i, h in enumerate(NINE)], "msg_id bigint, bytes binary")
    d = P.distances(P.representatives(df), blocks=3)
    got = {(r.i, r.j): (r.d, r.shift) for r in d.collect()}
    assert len(got) == 36 and got[(0, 1)][1] == 1 and got[(0, 8)][0] == pytest.approx(0.125)
    assert got[(0, 1)][0] == pytest.approx(0.25 + 0.25 * 3 / 16 - 0.33 * 0.25)
    labels = {r.id: r.label for r in _dbscan(spark, d, df)}
    assert set(labels) == set(range(9))
    near = {i: {i} | {b if a == i else a for (a, b), (x, _) in got.items() if i in (a, b) and x <= 0.25} for i in range(9)}
    core = {i for i in near if len(near[i]) >= 3}
    for i in range(9):
        assert (labels[i] == -1) == (not (near[i] & core))
        if i in core:
            assert all(labels[j] == labels[i] for j in near[i] & core)


def _dbscan(spark, d, df):
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return P.dbscan(d, df.selectExpr("msg_id AS id"), eps=0.25, least=3).collect()


def test_alignment():
    sim = np.eye(5)
    sim[2, 1], sim[4, 4] = 0.9, 1.0
    score = lambda a, b: A.score_domain(sim[a, b])
    x, y = [2, 4, 3, 0], [1, 4, 0]
    rows = A.global_alignment(x, y, score)
    assert [t for t in rows[0] if t is not None] == x and [t for t in rows[1] if t is not None] == y
    assert rows == ([2, 4, 3, 0], [1, 4, None, 0])
    assert A.last_line(x, y, score)[-1] == pytest.approx(0.9 + 1 - 1 + 1)
    assert A.message_distance(3.0, 3, 5) == 0 and A.message_distance(-3.0, 3, 5) == 100
