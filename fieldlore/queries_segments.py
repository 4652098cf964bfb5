"""Queries of segmentation, refinement and trace preparation beside those of ``queries``; texts of conversations or of events are the messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlore import queries as Q
from fieldlore.functions import series as S
from fieldlore.operators import messages as M
from fieldlore.operators import segmentation as G

_SEGMENT = ("msg_id", "seg_no", "offset", "length")


def _shown(segments):
    return segments.select(*_SEGMENT, F.hex("bytes").alias("h"))


def fea28_segment_entropy(spark, sf_dir):
    return Q._chunks(spark, sf_dir).select("msg_id", "seg_no", F.round(S.entropy(S.values(F.col("bytes"))), 6).alias("entropy"))


def fea39_value_distance(spark, sf_dir):
    return M.value_distances(Q.events(spark, sf_dir)).select("msg_id", "byte", "least", "most", F.round("mean", 6).alias("mean"))


def fea41_correlate(spark, sf_dir):
    at = S.similarity_at(S.values(F.lit(b'": ')), S.values(F.col("data")))
    return Q.events(spark, sf_dir).select("msg_id", S.best_place(at).alias("place"), F.array_min(at).cast("bigint").alias("sad"))


def fea46_bit_entropy(spark, sf_dir):
    return Q.events(spark, sf_dir).select("msg_id", F.round(S.bit_gram_entropy(Q._v()), 6).alias("entropy"))


def fea47_ecdf(spark, sf_dir):
    return M.ecdf(Q.events(spark, sf_dir).select(F.octet_length("data").alias("x"))).select("x", F.round("y", 6).alias("y"))


def fea49_hex_distance(spark, sf_dir):
    """Every payload against a fixed one."""
    a, b = S.values(F.unhex(F.hex("data"))), S.values(F.unhex(F.lit("7B226B223A20317D")))
    return Q.events(spark, sf_dir).where(F.octet_length("data") > 0).select("msg_id", F.round(S.dissimilarity(a, b), 6).alias("d"))


def pre03_shared_values(spark, sf_dir):
    return M.mean_cosine(Q._chunks(spark, sf_dir), 100).select("msg_id", F.round("mean", 6).alias("mean"))


def pre05_by_commonality(spark, sf_dir):
    """The 100 messages whose segments are rarest."""
    return M.commonality(Q._chunks(spark, sf_dir)).orderBy("commonality", "msg_id").limit(100).select("msg_id", F.col("commonality").cast("double").alias("commonality"))


def pre06_type_counts(spark, sf_dir):
    t = Q.events(spark, sf_dir)
    return M.counts_before_after(t, M.deduplicate(t).select("msg_id"), "event_type")


def pre09_disjoint_parts(spark, sf_dir):
    return M.parts(Q.events(spark, sf_dir), [100, 1000]).select("msg_id", "part")


def pre11_text_segments(spark, sf_dir):
    return _shown(G.fixed(Q.turns(spark, sf_dir), 8).where(S.text_like(S.values(F.col("bytes")))))


def pre12_relevant_segments(spark, sf_dir):
    return _shown(M.relevant(Q._chunks(spark, sf_dir)))


def seg03_congruence_minima(spark, sf_dir):
    return _shown(G.minima(Q.turns(spark, sf_dir)))


def seg04_horizon_minima(spark, sf_dir):
    return _shown(G.minima(Q.turns(spark, sf_dir), horizon=True))


def seg07_variance(spark, sf_dir):
    return _shown(G.variance(Q.turns(spark, sf_dir)))


def seg08_values(spark, sf_dir):
    return _shown(G.falls(Q.events(spark, sf_dir)))


def seg09_zeros(spark, sf_dir):
    return _shown(G.zeros(Q.turns(spark, sf_dir)))


def seg11_true_fields(spark, sf_dir):
    t = Q.events(spark, sf_dir)
    return _shown(G.from_lengths(t, Q._fields(spark, sf_dir)))


def seg12_whole(spark, sf_dir):
    return _shown(G.whole(Q.turns(spark, sf_dir)))


def seg12_bytes(spark, sf_dir):
    return _shown(G.fixed(Q.events(spark, sf_dir), 1))


def seg12_random(spark, sf_dir):
    return _shown(G.random(Q.turns(spark, sf_dir)))


def seg13_fill_gaps(spark, sf_dir):
    """Every other chunk, and what lies between."""
    t = Q.turns(spark, sf_dir)
    return _shown(G.fill_gaps(t, G.fixed(t, 4).where("seg_no % 2 = 1")))


def seg16_wobble(spark, sf_dir):
    t = Q.events(spark, sf_dir)
    return G.wobble(t, G.fixed(t, 4)).select("msg_id", "offset", "length", F.hex("bytes").alias("h"))


def ref03_merge_random(spark, sf_dir):
    return _shown(G.refined(Q.turns(spark, sf_dir), ["random"]))


def ref09_crop_common(spark, sf_dir):
    t = Q.turns(spark, sf_dir)
    return _shown(G.crop_common(G.fixed(t, 4), t))


def ref11_split_first(spark, sf_dir):
    return _shown(G.split_segment(Q._chunks(spark, sf_dir)))


def ref15_overlaps(spark, sf_dir):
    """Chunks of four bytes against true fields."""
    t = Q.events(spark, sf_dir)
    return G.overlaps(G.fixed(t, 4), G.from_lengths(t, Q._fields(spark, sf_dir)))


def _plan(name):
    def query(spark, sf_dir):
        from fieldlore.plans import pipelines

        return _shown(pipelines.segment(Q.turns(spark, sf_dir), name))

    return query


_E = """WITH m AS (SELECT event_id::BIGINT AS msg_id, hex(encode(props)) AS h, strlen(props) AS size FROM events)"""
_E4 = _E + """, o AS (SELECT msg_id, h, size, unnest(range(0, size, 4)) AS o FROM m),
c AS (SELECT msg_id, (o // 4)::INT AS seg_no, o::INT AS "offset", least(4, size - o)::INT AS length, h AS whole, size FROM o)"""
_F = """t0 AS (SELECT event_id::BIGINT AS msg_id, hex(encode(props)) AS whole, regexp_extract_all(props, '([0-9]+|[^0-9]+)') AS f FROM events),
t1 AS (SELECT msg_id, whole, unnest(range(len(f)))::INT AS seg_no, unnest(f) AS f FROM t0),
t AS (SELECT msg_id, seg_no, (sum(strlen(f)) OVER (PARTITION BY msg_id ORDER BY seg_no) - strlen(f))::INT AS "offset", strlen(f)::INT AS length, hex(encode(f)) AS h FROM t1)"""
_OUT = 'SELECT msg_id, seg_no, "offset", length, h FROM '

#: name: (query, SQL)
QUERIES = {
    "fea28_segment_entropy": (fea28_segment_entropy, Q._C + """, y AS (SELECT msg_id, seg_no, substr(h, (2 * k + 1)::INT, 2) AS y FROM (SELECT msg_id, seg_no, h, unnest(range(0, length)) AS k FROM c)),
n AS (SELECT msg_id, seg_no, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY msg_id, seg_no) AS t FROM y GROUP BY msg_id, seg_no, y) SELECT msg_id, seg_no, round(abs(sum(n / t * log2(n / t))), 6) AS entropy FROM n GROUP BY msg_id, seg_no"""),
    "fea39_value_distance": (fea39_value_distance, Q._B + """, p AS (SELECT msg_id, unnest(range(len(v))) AS pos, unnest(v) AS byte FROM b), g AS (SELECT msg_id, byte, pos - lag(pos) OVER (PARTITION BY msg_id, byte ORDER BY pos) AS gap FROM p)
SELECT msg_id, byte, min(gap)::INT AS least, max(gap)::INT AS most, round(avg(gap), 6) AS mean FROM g GROUP BY ALL"""),
    "fea41_correlate": (fea41_correlate, Q._B + """, s AS (SELECT msg_id, list_transform(range(1, len(v) - 1), lambda i: abs(v[i] - 34) + abs(v[i + 1] - 58) + abs(v[i + 2] - 32)) AS a FROM b)
SELECT msg_id, (list_position(a, list_min(a)) - 1)::INT AS place, list_min(a)::BIGINT AS sad FROM s"""),
    "fea46_bit_entropy": (fea46_bit_entropy, Q._B + """, q AS (SELECT msg_id, flatten(list_transform(v, lambda y: list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda k: (y >> k) & 1))) AS q FROM b),
g AS (SELECT msg_id, unnest(list_transform(range(1, len(q) - 1), lambda i: 4 * q[i] + 2 * q[i + 1] + q[i + 2])) AS g FROM q), n AS (SELECT msg_id, g, count(*) AS n, sum(count(*)) OVER (PARTITION BY msg_id) AS t FROM g GROUP BY msg_id, g)
SELECT msg_id, round(-sum(n / t * log2(n / t)) / 3, 6) AS entropy FROM n GROUP BY msg_id"""),
    "fea47_ecdf": (fea47_ecdf, "WITH x AS (SELECT strlen(props)::INT AS x, count(*) AS n FROM events GROUP BY 1) SELECT x, round(sum(n) OVER (ORDER BY x) / sum(n) OVER (), 6) AS y FROM x"),
    "fea49_hex_distance": (fea49_hex_distance, Q._B + """, p AS (SELECT msg_id, v, [123, 34, 107, 34, 58, 32, 49, 125] AS w FROM b WHERE len(v) > 0), q AS (SELECT msg_id, CASE WHEN len(v) <= len(w) THEN v ELSE w END AS s, CASE WHEN len(v) <= len(w) THEN w ELSE v END AS l FROM p),
e AS (SELECT msg_id, len(s)::DOUBLE AS li, len(l)::DOUBLE AS lo, list_min(list_transform(range(0, least(6, len(l) - len(s)) + 1), lambda o: list_sum(list_transform(range(1, len(s) + 1), lambda k: abs(s[k] - l[o + k]) / (abs(s[k]) + abs(l[o + k]))::DOUBLE)) / len(s))) AS e FROM q),
f AS (SELECT msg_id, e, (lo - li) / lo AS r, li / (lo * lo) AS p FROM e) SELECT msg_id, round((1 - r) * e + r + r * p * (1 - e) - 0.33 * r * (1 - e), 6) AS d FROM f"""),
    "pre05_by_commonality": (pre05_by_commonality, Q._C + ", n AS (SELECT h, count(*) AS n FROM c GROUP BY h) SELECT msg_id, median(n)::DOUBLE AS commonality FROM c JOIN n USING (h) GROUP BY msg_id ORDER BY 2, 1 LIMIT 100"),
    "pre06_type_counts": (pre06_type_counts, "WITH k AS (SELECT max(event_id) AS event_id FROM events GROUP BY props) SELECT event_type, count(*) AS before, count(k.event_id) AS after FROM events LEFT JOIN k USING (event_id) GROUP BY event_type"),
    "pre09_disjoint_parts": (pre09_disjoint_parts, "WITH r AS (SELECT event_id::BIGINT AS msg_id, row_number() OVER (ORDER BY event_id) AS r FROM events) SELECT msg_id, (CASE WHEN r <= 100 THEN 0 ELSE 1 END)::INT AS part FROM r WHERE r <= 1100"),
    "pre12_relevant_segments": (pre12_relevant_segments, Q._C + " " + _OUT + "c WHERE length > 1 AND regexp_matches(h, '[^0]')"),
    "seg08_values": (seg08_values, Q._B + """, k AS (SELECT msg_id, v, list_filter(range(1, len(v) - 1), lambda i: v[i + 1] > list_max(v) - (list_max(v) - list_min(v)) * 0.3::DOUBLE AND v[i + 2] < list_min(v) + (list_max(v) - list_min(v)) * 0.3::DOUBLE) AS k FROM b WHERE len(v) > 0),
a AS (SELECT msg_id, v, list_concat([0], k) AS a, list_concat(k, [len(v)]) AS z FROM k), u AS (SELECT msg_id, v, unnest(range(len(a)))::INT AS seg_no, unnest(a)::INT AS "offset", unnest(z)::INT AS z FROM a)
SELECT msg_id, seg_no, "offset", z - "offset" AS length, array_to_string(list_transform(v["offset" + 1:z], lambda y: printf('%02X', y)), '') AS h FROM u"""),
    "seg11_true_fields": (seg11_true_fields, "WITH " + _F + " " + _OUT + "t"),
    "seg12_whole": (seg12_whole, "SELECT conv_id::BIGINT * 1000 + turn AS msg_id, 0 AS seg_no, 0 AS \"offset\", strlen(text)::INT AS length, hex(encode(text)) AS h FROM conversations WHERE strlen(text) > 0"),
    "seg12_bytes": (seg12_bytes, _E + ", o AS (SELECT msg_id, h, unnest(range(0, size))::INT AS o FROM m) SELECT msg_id, o AS seg_no, o AS \"offset\", 1 AS length, substr(h, 2 * o + 1, 2) AS h FROM o"),
    "seg13_fill_gaps": (seg13_fill_gaps, Q._C + " " + _OUT + "c"),
    "seg16_wobble": (seg16_wobble, _E4 + """, w AS (SELECT msg_id, "offset" - s AS "offset", length + s AS length, whole FROM c, (VALUES (-1), (0), (1)) t(s) WHERE "offset" - s >= 0 AND length + s > 0)
SELECT msg_id, "offset", length, substr(whole, 2 * "offset" + 1, 2 * length) AS h FROM w"""),
    "ref11_split_first": (ref11_split_first, Q._C + """, s AS (SELECT msg_id, "offset", length, h FROM c WHERE seg_no > 0 UNION ALL SELECT msg_id, k AS "offset", 1 AS length, substr(h, 2 * k + 1, 2) AS h FROM (SELECT msg_id, h, unnest(range(0, length))::INT AS k FROM c WHERE seg_no = 0))
SELECT msg_id, (row_number() OVER (PARTITION BY msg_id ORDER BY "offset") - 1)::INT AS seg_no, "offset", length, h FROM s"""),
    "ref15_overlaps": (ref15_overlaps, _E4 + ", " + _F + """ SELECT c.msg_id, c.seg_no AS left_no, t.seg_no AS right_no, (least(c."offset" + c.length, t."offset" + t.length) - greatest(c."offset", t."offset"))::INT AS shared
FROM c JOIN t ON c.msg_id = t.msg_id AND c."offset" < t."offset" + t.length AND t."offset" < c."offset" + c.length"""),
    "pre03_shared_values": (pre03_shared_values, Q._C + """, n AS (SELECT h, count(*) AS n FROM c GROUP BY h), x AS (SELECT DISTINCT msg_id, h, n FROM c JOIN n USING (h)), w AS (SELECT msg_id, sqrt(sum(n * n)) AS w FROM x GROUP BY msg_id),
u AS (SELECT h, sum(n / w) AS s FROM x JOIN w USING (msg_id) GROUP BY h), r AS (SELECT x.msg_id, round(sum(n / w * s) / (SELECT count(*) FROM w), 9) AS mean FROM x JOIN w USING (msg_id) JOIN u USING (h) GROUP BY x.msg_id)
SELECT msg_id, round(mean, 6) AS mean FROM r ORDER BY r.mean DESC, msg_id LIMIT 100"""),
    "pre11_text_segments": (pre11_text_segments, Q._C.replace(", 4)) AS o", ", 8)) AS o").replace("o // 4", "o // 8").replace("least(4,", "least(8,").replace("::INT, 8) AS h", "::INT, 16) AS h") + """, v AS (SELECT *, list_transform(range(0, length), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT) AS v FROM c), w AS (SELECT *, list_filter(v, lambda y: y <> 0) AS w FROM v)
SELECT msg_id, seg_no, "offset", length, h FROM w WHERE length >= 6 AND len(w) > 0 AND list_max(v) < 127 AND list_avg(w) BETWEEN 50 AND 115 AND len(list_filter(w, lambda y: y < 32 OR y > 126)) / length < 0.33"""),
    "seg03_congruence_minima": (seg03_congruence_minima, None),
    "seg04_horizon_minima": (seg04_horizon_minima, None),
    "seg07_variance": (seg07_variance, None),
    "seg09_zeros": (seg09_zeros, None),
    "seg12_random": (seg12_random, None),
    "ref03_merge_random": (ref03_merge_random, None),
    "ref09_crop_common": (ref09_crop_common, None),
    "pip02_base": (_plan("base"), None),
    "pip03_split_first": (_plan("first_bytes"), None),
    "pip04_char": (_plan("char"), None),
    "pip05_zero": (_plan("zero"), None),
}
