"""One query for each message-analysis operator, over whole tables, with the SQL that checks it.

Messages are the ``props`` of ``events`` as bytes (short messages), or the ``text`` of ``conversations``. Pairwise operators work on
the distinct values among all messages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlore.functions import series as S
from fieldlore.operators import messages as M
from fieldlore.operators import pairwise as P
from fieldlore.operators import scores as V
from fieldlore.operators import segmentation as G
from fieldlore.operators.lineage import checkpoints, once


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(F.col("event_id").cast("bigint").alias("msg_id"), F.col("event_id").cast("bigint").alias("seq"), F.encode("props", "utf-8").alias("data"), "event_type")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select((F.col("conv_id").cast("bigint") * 1000 + F.col("turn")).alias("msg_id"), F.encode("text", "utf-8").alias("data"), "role")


_B = """WITH m AS (SELECT event_id::BIGINT AS msg_id, encode(props) AS data, hex(encode(props)) AS h FROM events),
b AS (SELECT msg_id, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT) AS v FROM m)"""
_BC = "list_transform(range(1, len(v)), lambda i: 1 - bit_count(xor(v[i], v[i + 1])) / 8.0)"


def _delta(x: str) -> str:
    return f"list_transform(range(1, len({x})), lambda i: {x}[i + 1] - {x}[i])"


def _series(x: Callable[[], Column], whole: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = M.with_series(events(spark, sf_dir), x())
        return d.select("msg_id", "pos", F.col("value").cast("bigint").alias("value") if whole else F.round(F.col("value").cast("double"), 6).alias("value"))

    return query


def _series_sql(*steps: str, whole: bool = False) -> str:
    ctes, last = "", "b"
    for k, s in enumerate(steps):
        ctes += f", s{k} AS (SELECT msg_id, v, {s} AS x{k} FROM {last})" if k == 0 else f", s{k} AS (SELECT msg_id, v, {s} AS x{k} FROM s{k - 1})"
        last = f"s{k}"
    name = f"x{len(steps) - 1}" if steps else "v"
    value = "value::BIGINT" if whole else "round(value::DOUBLE, 6)"
    return f"{_B}{ctes} SELECT msg_id, pos::INT AS pos, {value} AS value FROM (SELECT msg_id, unnest(range(len({name}))) AS pos, unnest({name}) AS value FROM {last})"




def _v() -> Column:
    return S.values(F.col("data"))


def _bc() -> Column:
    return S.bit_congruence(_v())


_SIGMA = 0.6

def _gauss(x: str, sigma: float) -> str:
    """SQL of the Gaussian filter of series x."""
    r, w = int(4 * sigma + 0.5), f"exp(-0.5 * (k / {sigma}) ** 2)"
    m = f"((i + k - 1) % (2 * len({x})) + 2 * len({x})) % (2 * len({x}))"
    at = f"{x}[(CASE WHEN {m} < len({x}) THEN {m} + 1 ELSE 2 * len({x}) - {m} END)::INT]"
    ks = f"range(-{r}, {r + 1})"
    return f"list_transform(range(1, len({x}) + 1), lambda i: list_sum(list_transform({ks}, lambda k: {w} * {at})) / list_sum(list_transform({ks}, lambda k: {w})))"


def _gradient(x: str) -> str:
    return f"list_transform(range(1, len({x}) + 1), lambda i: ({x}[least(i + 1, len({x}))] - {x}[greatest(i - 1, 1)]) / CASE WHEN i = 1 OR i = len({x}) THEN 1.0 ELSE 2.0 END)"


def _more(x: str) -> str:
    """SQL that leaves series of under two values, which have no gradient, empty."""
    return f"CASE WHEN len({x}) > 1 THEN {_gradient(x)} ELSE [] END"


_MEAN2 = "list_transform(range(1, len(x0)), lambda i: (x0[i] + x0[i + 1]) / 2)"
_LAG2 = "list_transform(range(1, len(x1) - 1), lambda i: x1[i + 2] - x1[i])"
_HORIZON = "list_transform(range(3, len(x0) + 1), lambda i: x0[i] - (x0[i - 1] + x0[i - 2]) / 2)"


def _mean2() -> Column:
    return S.window_mean(_bc(), 2)


#: name: (query, SQL)
SERIES = {
    "fea03_bit_congruence_gauss": (_series(lambda: S.gaussian(_bc(), 1.5)), _series_sql(_BC, _gauss("x0", 1.5))),
    "fea06_delta_backwards": (_series(lambda: S.mirrored(_v(), lambda v: S.delta(S.bit_congruence(v)))), _series_sql(_BC, "list_transform(range(1, len(x0)), lambda i: x0[i] - x0[i + 1])")),
    "fea08_gram_congruence": (_series(lambda: S.gram_congruence(_v(), 2)), _series_sql("list_transform(range(1, len(v) - 1), lambda i: 1 - (bit_count(xor(v[i], v[i + 1])) + bit_count(xor(v[i + 1], v[i + 2]))) / 16.0)")),
    "fea12_sliding_mean": (_series(_mean2), _series_sql(_BC, _MEAN2)),
    "fea13_sliding_gradient": (_series(lambda: S.inner_gradient(_mean2())), _series_sql(_BC, _MEAN2, _more("x1"), "x2[2:]")),
    "fea14_sliding_delta": (_series(lambda: S.lagged(_mean2(), 2)), _series_sql(_BC, _MEAN2, _LAG2)),
    "fea15_sliding_delta_gauss": (_series(lambda: S.gaussian(S.lagged(_mean2(), 2), 1.5)), _series_sql(_BC, _MEAN2, _LAG2, _gauss("x2", 1.5))),
    "fea16_sliding_2nd_delta": (_series(lambda: S.delta(S.delta(_mean2()))), _series_sql(_BC, _MEAN2, _delta("x1"), _delta("x2"))),
    "fea17_horizon": (_series(lambda: S.horizon(_bc())), _series_sql(_BC, _HORIZON)),
    "fea18_horizon_gauss": (_series(lambda: S.gaussian(S.horizon(_bc()), 1.5)), _series_sql(_BC, _HORIZON, _gauss("x1", 1.5))),
    "fea19_horizon_gradient": (_series(lambda: S.gradient(S.horizon(_bc()))), _series_sql(_BC, _HORIZON, _more("x1"))),
    "fea19_horizon_2nd_delta": (_series(lambda: S.delta(S.delta(S.horizon(_bc())))), _series_sql(_BC, _HORIZON, _delta("x1"), _delta("x2"))),
    "fea20_autocorrelation": (_series(lambda: S.autocorrelation(_bc())), _series_sql(_BC, "list_transform(range(1, 2 * len(x0)), lambda i: list_sum(list_transform(range(1, len(x0) - abs(i - len(x0)) + 1), lambda j: x0[j] * x0[(j + abs(i - len(x0)))::INT])))")),
    "fea23_gram_entropy": (_series(lambda: S.gram_entropy(_v(), 3)), _series_sql("list_transform(range(1, len(v) - 1), lambda i: CASE len(list_distinct([v[i], v[i + 1], v[i + 2]])) WHEN 1 THEN 0 WHEN 2 THEN log2(3) - 2 / 3.0 ELSE log2(3) END)")),
    "seg08_drops": (_series(lambda: S.drops(_v()), True), _series_sql("list_filter(range(0, len(v) - 1), lambda i: v[i + 1] > list_max(v) - (list_max(v) - list_min(v)) * 0.3::DOUBLE AND v[i + 2] < list_min(v) + (list_max(v) - list_min(v)) * 0.3::DOUBLE)", whole=True)),
    "tpl10_flags": (_series(lambda: S.flag_pairs(_v()), True), _series_sql("list_filter(range(0, len(v) - 1), lambda i: bit_count(v[i + 1]) <= 2 AND bit_count(v[i + 2]) <= 2 AND v[i + 1] + v[i + 2] > 0)", whole=True)),
    "fea02_bit_congruence": (_series(lambda: _bc()), _series_sql(_BC)),
    "fea04_bit_congruence_delta": (_series(lambda: S.delta(_bc())), _series_sql(_BC, _delta("x0"))),
    "fea07_bit_congruence_2nd_delta": (_series(lambda: S.delta(S.delta(_bc()))), _series_sql(_BC, _delta("x0"), _delta("x1"))),
    "fea09_window_mean": (_series(lambda: S.window_mean(_bc(), 3)), _series_sql(_BC, "list_transform(range(1, len(x0) - 1), lambda i: (x0[i] + x0[i + 1] + x0[i + 2]) / 3)")),
    "fea10_window_stddev": (_series(lambda: S.window_stddev(_bc(), 3)), _series_sql(_BC, "list_transform(range(1, len(x0) - 1), lambda i: list_stddev_pop([x0[i], x0[i + 1], x0[i + 2]]))")),
    "fea21_cumulated": (_series(lambda: S.cumulated(_v()), True), _series_sql("list_transform(range(0, len(v) + 1), lambda i: coalesce(list_sum(v[1:i]), 0))", whole=True)),
    "fea22_cumulated_gradient": (_series(lambda: S.gradient(S.cumulated(_v()))), _series_sql("list_transform(range(0, len(v) + 1), lambda i: coalesce(list_sum(v[1:i]), 0))", "list_transform(range(1, len(x0) + 1), lambda i: (x0[least(i + 1, len(x0))] - x0[greatest(i - 1, 1)]) / CASE WHEN i = 1 OR i = len(x0) THEN 1.0 ELSE 2.0 END)")),
    "fea24_value_delta": (_series(lambda: S.delta(_v()), True), _series_sql(_delta("v"), whole=True)),
    "fea25_value_2nd_delta": (_series(lambda: S.delta(S.delta(_v())), True), _series_sql(_delta("v"), _delta("x0"), whole=True)),
    "fea27_values": (_series(lambda: _v(), True), _series_sql(whole=True)),
    "fea31_nibbles": (_series(lambda: S.nibbles(_v()), True), _series_sql("flatten(list_transform(v, lambda y: [y // 16, y % 16]))", whole=True)),
    "fea33_maxima": (_series(lambda: S.extrema(_bc()), True), _series_sql(_BC, "list_filter(range(0, len(x0)), lambda i: (i = 0 OR x0[i + 1] > x0[i]) AND (i + 1 = len(x0) OR x0[i + 1] > x0[i + 2]))", whole=True)),
    "fea33_minima": (_series(lambda: S.extrema(_bc(), False), True), _series_sql(_BC, "list_filter(range(0, len(x0)), lambda i: (i = 0 OR x0[i + 1] < x0[i]) AND (i + 1 = len(x0) OR x0[i + 1] < x0[i + 2]))", whole=True)),
    "fea34_zero_borders": (_series(lambda: S.zero_borders(S.nibbles(_v())), True), _series_sql("flatten(list_transform(v, lambda y: [y // 16, y % 16]))", "list_filter(range(1, len(x0)), lambda i: (x0[i + 1] = 0) <> (x0[i] = 0))", whole=True)),
    "fea35_plateaus": (_series(lambda: S.plateaus(S.nibbles(_v())), True), _series_sql("flatten(list_transform(v, lambda y: [y // 16, y % 16]))", "list_filter(range(1, len(x0) - 1), lambda i: x0[i] <> x0[i + 1] AND x0[i + 1] = x0[i + 2])", whole=True)),
}


def fea05_gaussian(spark, sf_dir):
    return _series(lambda: S.gaussian(S.delta(_bc()), _SIGMA))(spark, sf_dir)


FEA05 = _series_sql(_BC, _delta("x0"), _gauss("x1", _SIGMA))


def fea26_value_frequency(spark, sf_dir):
    d = M.with_series(events(spark, sf_dir), _v(), "byte")
    return d.groupBy("msg_id", "byte").agg(F.count("*").alias("n"))


def fea30_ngrams(spark, sf_dir):
    d = M.with_series(events(spark, sf_dir), S.windows(_v(), 3), "gram")
    return d.select("msg_id", "pos", F.array_join(F.transform("gram", lambda x: F.lpad(F.hex(x), 2, "0")), "").alias("gram"))


def fea38_entropy(spark, sf_dir):
    return events(spark, sf_dir).select("msg_id", F.round(S.entropy(_v()), 6).alias("entropy"))


def fea40_mean_stddev(spark, sf_dir):
    mean = F.aggregate(_v(), F.lit(0.0), lambda a, x: a + x) / F.size(_v())
    square = F.aggregate(_v(), F.lit(0.0), lambda a, x: a + x * x) / F.size(_v())
    return events(spark, sf_dir).select("msg_id", F.round(mean, 6).alias("mean"), F.round(F.sqrt(square - mean * mean), 4).alias("stddev"))


def fea44_text(spark, sf_dir):
    return turns(spark, sf_dir).select("msg_id", S.text_like(_v()).alias("text_like"), S.printable(_v()).alias("printable"))


def pre01_deduplicate(spark, sf_dir):
    return M.deduplicate(events(spark, sf_dir)).select("msg_id", "first_seq", F.hex("data").alias("h"))


def src05_lengths(spark, sf_dir):
    return M.lengths(turns(spark, sf_dir))


def pre07_byte_frequency(spark, sf_dir):
    return M.byte_frequency(events(spark, sf_dir))


def pre08_mean_difference(spark, sf_dir):
    return M.mean_byte_difference(events(spark, sf_dir)).select(F.round("mean_difference", 6).alias("mean_difference"))


def _chunks(spark, sf_dir):
    return G.fixed(turns(spark, sf_dir), 4)


_C = """WITH m AS (SELECT conv_id::BIGINT * 1000 + turn AS msg_id, hex(encode(text)) AS h FROM conversations),
o AS (SELECT msg_id, h, unnest(range(0, len(h) // 2, 4)) AS o FROM m),
c AS (SELECT msg_id, (o // 4)::INT AS seg_no, o::INT AS "offset", least(4, len(h) // 2 - o)::INT AS length, substr(h, (2 * o + 1)::INT, 8) AS h FROM o)"""


def seg10_fixed(spark, sf_dir):
    return _chunks(spark, sf_dir).select("msg_id", "seg_no", "offset", "length", F.hex("bytes").alias("h"))


def pre04_commonality(spark, sf_dir):
    return M.commonality(_chunks(spark, sf_dir)).select("msg_id", F.col("commonality").cast("double").alias("commonality"))


def pre10_useful_segments(spark, sf_dir):
    return M.useful_segments(_chunks(spark, sf_dir)).select(F.hex("bytes").alias("h"), "length", "msg_id", "n")


def pre13_containing(spark, sf_dir):
    return M.containing(turns(spark, sf_dir), b"the").select("msg_id")


def ref08_common_values(spark, sf_dir):
    d = turns(spark, sf_dir)
    return M.common_values(G.fixed(d, 4), d.count()).select(F.hex("bytes").alias("h"), "n")


def ref02_merge_text(spark, sf_dir):
    both = lambda a, b: S.printable(S.values(a)) & S.printable(S.values(b))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("msg_id"), F.encode("text", "utf-8").alias("data"))
    return G.islands(G.fixed(d, 4), both).select("msg_id", "seg_no", "offset", "length", F.hex("bytes").alias("h"))


def seg01_congruence(spark, sf_dir):
    return G.congruence(turns(spark, sf_dir)).select("msg_id", "seg_no", "offset", "length", F.hex("bytes").alias("h"))


def seg02_congruence_le(spark, sf_dir):
    return G.congruence(turns(spark, sf_dir), little_endian=True).select("msg_id", "seg_no", "offset", "length", F.hex("bytes").alias("h"))


def pip01_original(spark, sf_dir):
    return G.congruence(turns(spark, sf_dir), refined=True).select("msg_id", "seg_no", "offset", "length", F.hex("bytes").alias("h"))


def _reps(spark, sf_dir):
    return P.representatives(events(spark, sf_dir).withColumnRenamed("data", "bytes"))


def dis16_representatives(spark, sf_dir):
    return _reps(spark, sf_dir).select("rep_id", F.hex("bytes").alias("h"), "n")


def _distances(spark, sf_dir):
    return P.distances(once(_reps(spark, sf_dir)))


def dis10_distances(spark, sf_dir):
    return _distances(spark, sf_dir).select("i", "j", F.round("d", 6).alias("d"), "shift")


def dis14_neighbours(spark, sf_dir):
    d = _distances(spark, sf_dir).withColumn("d", F.round("d", 6))
    return P.neighbours(d)


def clu07_knearest(spark, sf_dir):
    d = _distances(spark, sf_dir).withColumn("d", F.round("d", 6))
    return P.neighbours(d, 5).where("rank = 5").select("i", "d")


def dis15_medoids(spark, sf_dir):
    labels = _reps(spark, sf_dir).select(F.col("rep_id").alias("id"), F.octet_length("bytes").alias("label"))
    return P.medoids(_distances(spark, sf_dir).withColumn("d", F.round("d", 6)), labels)


def sem13_max_distance(spark, sf_dir):
    r = _reps(spark, sf_dir).select(F.col("rep_id").alias("i"), F.octet_length("bytes").alias("label"))
    d = _distances(spark, sf_dir)
    return d.join(r, "i").join(r.select(F.col("i").alias("j"), F.col("label").alias("lj")), "j").where("label = lj").groupBy("label").agg(F.round(F.max("d"), 6).alias("max_distance"))


def clu02_dbscan(spark, sf_dir):
    checkpoints(spark)
    d = _distances(spark, sf_dir)
    return P.dbscan(d, _reps(spark, sf_dir).select(F.col("rep_id").alias("id")), eps=0.01, least=4)


_D = _B + """, r AS (SELECT v, min(msg_id) AS id FROM b WHERE len(v) > 0 GROUP BY v),
p AS (SELECT x.id AS i, y.id AS j, CASE WHEN len(x.v) <= len(y.v) THEN x.v ELSE y.v END AS s, CASE WHEN len(x.v) <= len(y.v) THEN y.v ELSE x.v END AS l FROM r x JOIN r y ON x.id < y.id),
e AS (SELECT i, j, len(s)::DOUBLE AS li, len(l)::DOUBLE AS lo, list_transform(range(0, least(6, len(l) - len(s)) + 1), lambda o: list_sum(list_transform(range(1, len(s) + 1),
  lambda k: CASE WHEN s[k] = 0 AND l[o + k] = 0 THEN 0.0 ELSE abs(s[k] - l[o + k]) / (abs(s[k]) + abs(l[o + k]))::DOUBLE END)) / len(s)) AS es FROM p),
f AS (SELECT i, j, list_min(es) AS e, (list_position(es, list_min(es)) - 1)::INT AS shift, (lo - li) / lo AS r, li / (lo * lo) AS p FROM e),
d AS (SELECT i, j, (1 - r) * e + r + r * p * (1 - e) - 0.33 * r * (1 - e) AS d0, shift FROM f), dd AS (SELECT i, j, round(d0, 6) AS d, shift FROM d),
n AS (SELECT i, j, d FROM dd UNION ALL SELECT j, i, d FROM dd)"""


def _fields(spark, sf_dir):
    """True fields of a message: its runs of digits and of other characters."""
    t = events(spark, sf_dir).select("msg_id", F.posexplode(F.regexp_extract_all(F.decode("data", "utf-8"), F.lit("([0-9]+|[^0-9]+)"), 1)).alias("pos", "f"))
    return t.select("msg_id", "pos", F.octet_length("f").alias("len"))


def val01_field_ends(spark, sf_dir):
    return V.field_ends(_fields(spark, sf_dir)).select("msg_id", "pos", F.col("end").cast("bigint").alias("end"))


def val07_format_match(spark, sf_dir):
    inferred = G.fixed(events(spark, sf_dir), 3).select("msg_id", (F.col("offset") + F.col("length")).alias("end"))
    out = V.format_match(V.field_ends(_fields(spark, sf_dir)), inferred)
    return out.select("msg_id", "true_count", "inferred_count", "exact_count", "near_count", F.round("score", 6).alias("score"))


def val13_cluster_quality(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IS NOT NULL AND lang IS NOT NULL")
    return V.cluster_quality(d, "source", "lang").select("source", "lang", "size", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def val14_pair_counts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IS NOT NULL AND lang IS NOT NULL")
    return V.pair_counts(d, "source", "lang").select("tp", "found", "wanted", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


OTHERS = {
    "fea05_gaussian": (fea05_gaussian, FEA05),
    "fea26_value_frequency": (fea26_value_frequency, _B + " SELECT msg_id, byte, count(*) AS n FROM (SELECT msg_id, unnest(v) AS byte FROM b) GROUP BY ALL"),
    "fea30_ngrams": (fea30_ngrams, "WITH m AS (SELECT event_id::BIGINT AS msg_id, hex(encode(props)) AS h FROM events), o AS (SELECT msg_id, h, unnest(range(0, len(h) // 2 - 2)) AS o FROM m) SELECT msg_id, o::INT AS pos, substr(h, (2 * o + 1)::INT, 6) AS gram FROM o"),
    "fea38_entropy": (fea38_entropy, _B + ", n AS (SELECT msg_id, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY msg_id) AS t FROM (SELECT msg_id, unnest(v) AS y FROM b) GROUP BY msg_id, y) SELECT msg_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM n GROUP BY msg_id"),
    "fea40_mean_stddev": (fea40_mean_stddev, _B + " SELECT msg_id, round(list_avg(v), 6) AS mean, round(list_stddev_pop(v), 4) AS stddev FROM b"),
    "fea44_text": (fea44_text, """WITH m AS (SELECT conv_id::BIGINT * 1000 + turn AS msg_id, hex(encode(text)) AS h FROM conversations),
b AS (SELECT msg_id, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT) AS v FROM m),
s AS (SELECT msg_id, v, list_filter(v, lambda y: y <> 0) AS w FROM b)
SELECT msg_id, CASE WHEN len(v) < 6 OR len(w) = 0 THEN false ELSE list_max(v) < 127 AND list_avg(w) BETWEEN 50 AND 115 AND len(list_filter(w, lambda y: y < 32 OR y > 126)) / len(v) < 0.33 END AS text_like,
len(list_filter(v, lambda y: y < 32 OR y > 126)) = 0 AS printable FROM s"""),
    "pre01_deduplicate": (pre01_deduplicate, "SELECT max(event_id)::BIGINT AS msg_id, min(event_id)::BIGINT AS first_seq, hex(encode(props)) AS h FROM events GROUP BY props"),
    "src05_lengths": (src05_lengths, "SELECT max(strlen(text))::INT AS longest, sum(strlen(text))::BIGINT AS total FROM conversations"),
    "pre07_byte_frequency": (pre07_byte_frequency, _B + " SELECT byte, count(*) AS n FROM (SELECT unnest(v) AS byte FROM b) GROUP BY byte"),
    "pre08_mean_difference": (pre08_mean_difference, _B + " SELECT round(avg((v[-1] - v[1]) / (len(v) - 1)), 6) AS mean_difference FROM b WHERE len(v) > 1"),
    "seg10_fixed": (seg10_fixed, _C + ' SELECT msg_id, seg_no, "offset", length, h FROM c'),
    "pre04_commonality": (pre04_commonality, _C + ", n AS (SELECT h, count(*) AS n FROM c GROUP BY h) SELECT msg_id, median(n)::DOUBLE AS commonality FROM c JOIN n USING (h) GROUP BY msg_id"),
    "pre10_useful_segments": (pre10_useful_segments, _C + " SELECT h, length, min(msg_id) AS msg_id, count(*) AS n FROM c WHERE length > 2 AND regexp_matches(h, '[^0]') GROUP BY h, length"),
    "pre13_containing": (pre13_containing, "SELECT conv_id::BIGINT * 1000 + turn AS msg_id FROM conversations WHERE contains(text, 'the')"),
    "ref08_common_values": (ref08_common_values, _C + ", n AS (SELECT h, count(*) AS n FROM c WHERE length >= 2 AND regexp_matches(h, '[^0]') GROUP BY h HAVING count(*) > 0.1 * (SELECT count(*) FROM m)) SELECT h, n FROM n WHERE NOT EXISTS (SELECT 1 FROM n k WHERE k.h <> n.h AND len(list_filter(range(0, len(n.h) // 2), lambda i: substr(n.h, (2 * i + 1)::INT, len(k.h)) = k.h)) > 0)"),
    "ref02_merge_text": (ref02_merge_text, _C.replace("conv_id::BIGINT * 1000 + turn", "doc_id::BIGINT").replace("conversations", "documents") + """, t AS (SELECT *, NOT regexp_matches(regexp_replace(h, '(..)', '\\1 ', 'g'), '([01][0-9A-F]|7F|[89A-F][0-9A-F]) ') AS txt FROM c),
u AS (SELECT *, CASE WHEN txt AND lag(txt) OVER w THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY msg_id ORDER BY seg_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY msg_id ORDER BY seg_no) AS run FROM u)
SELECT msg_id, (run - 1)::INT AS seg_no, min("offset") AS "offset", sum(length)::INT AS length, string_agg(h, '' ORDER BY seg_no) AS h FROM r GROUP BY msg_id, run"""),
    "dis16_representatives": (dis16_representatives, "SELECT min(event_id)::BIGINT AS rep_id, hex(encode(props)) AS h, count(*) AS n FROM events GROUP BY props"),
    "dis10_distances": (dis10_distances, _D + " SELECT i, j, d, shift FROM dd"),
    "dis14_neighbours": (dis14_neighbours, _D + " SELECT i, row_number() OVER (PARTITION BY i ORDER BY d, j)::INT AS rank, j, d FROM n"),
    "clu07_knearest": (clu07_knearest, _D + " SELECT i, d FROM n QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 5"),
    "dis15_medoids": (dis15_medoids, _D + ", s AS (SELECT len(a.v)::INT AS label, i, round(sum(d), 9) AS s FROM n JOIN r a ON a.id = i JOIN r c ON c.id = j WHERE len(a.v) = len(c.v) GROUP BY 1, 2) SELECT label, i AS medoid FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY s, i) = 1"),
    "sem13_max_distance": (sem13_max_distance, _D + " SELECT len(a.v)::INT AS label, round(max(d0), 6) AS max_distance FROM d JOIN r a ON a.id = i JOIN r c ON c.id = j WHERE len(a.v) = len(c.v) GROUP BY 1"),
    "val01_field_ends": (val01_field_ends, "WITH t AS (SELECT event_id::BIGINT AS msg_id, regexp_extract_all(props, '([0-9]+|[^0-9]+)') AS f FROM events), u AS (SELECT msg_id, unnest(range(len(f))) AS pos, unnest(f) AS f FROM t) SELECT msg_id, pos::INT AS pos, sum(strlen(f)) OVER (PARTITION BY msg_id ORDER BY pos)::BIGINT AS \"end\" FROM u"),
    "val07_format_match": (val07_format_match, """WITH t0 AS (SELECT event_id::BIGINT AS msg_id, strlen(props) AS size, regexp_extract_all(props, '([0-9]+|[^0-9]+)') AS f FROM events),
t1 AS (SELECT msg_id, size, unnest(range(len(f))) AS pos, unnest(f) AS f FROM t0),
t2 AS (SELECT msg_id, size, sum(strlen(f)) OVER (PARTITION BY msg_id ORDER BY pos) AS e FROM t1),
t3 AS (SELECT msg_id, size, e, coalesce(lag(e) OVER w, e) AS l, lead(e) OVER w AS r FROM t2 WINDOW w AS (PARTITION BY msg_id ORDER BY e)),
t AS (SELECT msg_id, size, e, CASE WHEN e - l <= 1 THEN e ELSE l + (e - l) // 2 END AS low, CASE WHEN r - e <= 1 THEN e ELSE e - 1 + (r - e) // 2 END AS high FROM t3 WHERE e < size),
i AS (SELECT msg_id, unnest(range(3, size, 3)) AS x FROM t0),
x AS (SELECT t.*, EXISTS (SELECT 1 FROM i WHERE i.msg_id = t.msg_id AND x = e) AS exact, (SELECT min(x - e) FROM i WHERE i.msg_id = t.msg_id AND x BETWEEN low AND high) AS off FROM t),
a AS (SELECT msg_id, count(*) AS true_count, count(*) FILTER (exact) AS exact_count, count(*) FILTER (NOT exact AND low < high AND off IS NOT NULL) AS near_count,
  coalesce(sum(exp(-((off / 2.0) ** 2))) FILTER (NOT exact AND low < high AND off IS NOT NULL), 0) AS gain FROM x GROUP BY msg_id),
c AS (SELECT msg_id, count(*) AS n FROM i GROUP BY msg_id)
SELECT a.msg_id, true_count, coalesce(n, 0)::BIGINT AS inferred_count, exact_count, near_count, round(exp(-(((true_count - coalesce(n, 0)) / true_count) ** 2)) * (exact_count + gain) / true_count, 6) AS score FROM a LEFT JOIN c USING (msg_id)"""),
    "val13_cluster_quality": (val13_cluster_quality, """WITH d AS (SELECT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), n AS (SELECT source, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS size, sum(count(*)) OVER (PARTITION BY lang) AS k FROM d GROUP BY source, lang)
SELECT source, lang, size::BIGINT AS size, round(n / size, 6) AS precision, round(n / k, 6) AS recall FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1"""),
    "val14_pair_counts": (val14_pair_counts, """WITH d AS (SELECT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
a AS (SELECT sum(n * (n - 1) / 2) AS found FROM (SELECT count(*) AS n FROM d GROUP BY source)), b AS (SELECT sum(n * (n - 1) / 2) AS tp FROM (SELECT count(*) AS n FROM d GROUP BY source, lang)),
c AS (SELECT sum(n * (n - 1) / 2) AS wanted FROM (SELECT count(*) AS n FROM d GROUP BY lang)) SELECT tp, found, wanted, round(tp / found, 6) AS precision, round(tp / wanted, 6) AS recall FROM a, b, c"""),
    "seg01_congruence": (seg01_congruence, None),
    "seg02_congruence_le": (seg02_congruence_le, None),
    "pip01_original": (pip01_original, None),
    "clu02_dbscan": (clu02_dbscan, None),
}

def _all() -> dict:
    from fieldlore import queries_clusters, queries_fields, queries_segments

    return SERIES | OTHERS | queries_segments.QUERIES | queries_clusters.QUERIES | queries_fields.QUERIES


def queries() -> dict:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
