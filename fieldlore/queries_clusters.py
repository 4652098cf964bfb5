"""Queries of dissimilarity, clusters, alignment and validation beside those of ``queries``. The clusters are distinct payloads of one length."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlore import queries as Q
from fieldlore.functions import series as S
from fieldlore.operators import alignment as A
from fieldlore.operators import clusters as C
from fieldlore.operators import pairwise as P
from fieldlore.operators import scores as V
from fieldlore.operators import segmentation as G
from fieldlore.operators import sequences as SQ


def _d(spark, sf_dir):
    return Q._distances(spark, sf_dir).withColumn("d", F.round("d", 6))


def _labels(spark, sf_dir):
    return Q._reps(spark, sf_dir).select(F.col("rep_id").alias("id"), F.octet_length("bytes").alias("label"))


def _counts(spark, sf_dir):
    return Q._reps(spark, sf_dir).select(F.col("rep_id").alias("id"), "n")


def _on(f, *rounded):
    """A query of f(distances, labels) with columns rounded to six digits, off the ties that means of six-digit distances fall on."""

    def query(spark, sf_dir):
        out = f(Q.once(_d(spark, sf_dir)), Q.once(_labels(spark, sf_dir)))
        return out.select(*(F.round(F.col(c) + 1e-9, 6).alias(c) if c in rounded else c for c in out.columns))

    return query


def dis01_by_length(spark, sf_dir):
    return P.by_length(Q._reps(spark, sf_dir))


def dis06_normalisation(spark, sf_dir):
    n = F.octet_length("bytes")
    return Q._reps(spark, sf_dir).select("rep_id", *(F.round(S.normalisation(m, n), 9).alias(m) for m in ("cosine", "correlation", "canberra", "euclidean", "sqeuclidean")))


def dis07_sigmoid(spark, sf_dir):
    return _d(spark, sf_dir).select("i", "j", F.round(S.sigmoid(F.col("d")), 6).alias("d"))


def dis08_text_gain(spark, sf_dir):
    text = Q._reps(spark, sf_dir).where(S.text_like(S.values(F.col("bytes")))).select(F.col("rep_id").alias("id"))
    return P.text_gain(_d(spark, sf_dir).select("i", "j", "d"), text)


def dis09_matrix(spark, sf_dir):
    return P.matrix(_d(spark, sf_dir), _labels(spark, sf_dir))


def dis11_similarity(spark, sf_dir):
    return _d(spark, sf_dir).select("i", "j", F.round(1 - F.col("d"), 6).alias("similarity"))


def dis13_submatrix(spark, sf_dir):
    ids = _labels(spark, sf_dir)
    return P.submatrix(_d(spark, sf_dir), ids.where("label = 8"), ids.where("label = 9"))


def dis21_to_members(spark, sf_dir):
    d, labels = _d(spark, sf_dir), _labels(spark, sf_dir)
    return P.to_members(d, labels, P.medoids(d, labels))


def pre02_most_dissimilar(spark, sf_dir):
    """The 50 payloads with the greatest mean dissimilarity."""
    return P.mean_dissimilarity(_d(spark, sf_dir), _labels(spark, sf_dir), 50).select("id", F.round("mean", 6).alias("mean"))


def clu01_sizes(spark, sf_dir):
    return C.sizes(_labels(spark, sf_dir)).select("label", "size", F.round("share", 6).alias("share"))


def clu13_nearest(spark, sf_dir):
    return C.nearest(_d(spark, sf_dir))


def sem06_regular(spark, sf_dir):
    return C.regular(_labels(spark, sf_dir))


def sem08_type_counts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IS NOT NULL AND lang IS NOT NULL")
    return C.type_counts(d, "source", "lang").withColumn("share", F.round("share", 6))


def sem10_split(spark, sf_dir):
    return C.split_by_occurrence(_labels(spark, sf_dir), _counts(spark, sf_dir))


def sem11_occurrences(spark, sf_dir):
    return C.occurrences(_labels(spark, sf_dir), _counts(spark, sf_dir)).select("label", "values", "total", F.round("rank", 6).alias("rank"), F.round("spread", 6).alias("spread"))


def tpl02_labels(spark, sf_dir):
    return C.template_label(spark.read.parquet(f"{sf_dir}/documents.parquet"), "n_chars", "lang")


def tpl03_templates(spark, sf_dir):
    """The medoid of each cluster with its value."""
    d, labels = _d(spark, sf_dir), _labels(spark, sf_dir)
    m = P.medoids(d, labels)
    return m.join(Q._reps(spark, sf_dir), F.col("medoid") == F.col("rep_id")).select("label", "medoid", F.hex("bytes").alias("h"))


def val02_formats(spark, sf_dir):
    return V.formats(Q._fields(spark, sf_dir))


def val12_overlays(spark, sf_dir):
    t = Q.events(spark, sf_dir)
    true = G.from_lengths(t, Q._fields(spark, sf_dir)).withColumnRenamed("seg_no", "pos")
    ends = G.fixed(t, 3).select("msg_id", (F.col("offset") + F.col("length")).cast("bigint").alias("end"))
    return V.overlays(true, ends)


def _match(spark, sf_dir):
    return Q.val07_format_match(spark, sf_dir)


def val15_score_statistics(spark, sf_dir):
    out = V.statistics(_match(spark, sf_dir))
    return out.select(*(c if c == "n" else F.round(c, 6).alias(c) for c in out.columns))


def val16_score_by_count(spark, sf_dir):
    out = V.statistics(_match(spark, sf_dir), "inferred_count")
    return out.select(*(c if c in ("n", "inferred_count") else F.round(c, 6).alias(c) for c in out.columns))


def val19_by_score(spark, sf_dir):
    return V.by_score(_match(spark, sf_dir))


def aln05_message_similarity(spark, sf_dir):
    first = Q._reps(spark, sf_dir).select(F.col("rep_id").alias("msg_id"), F.col("bytes").alias("data"))
    return A.message_distances(G.fixed(first, 3)).select("i", "j", F.round("score", 6).alias("score"), F.round("distance", 4).alias("distance"))


def _aligned(spark, sf_dir):
    """Chunks of three bytes of each message, by the type of event; a chunk's number is its column."""
    t = Q.events(spark, sf_dir)
    return G.fixed(t, 3).join(t.select("msg_id", "event_type"), "msg_id").select(F.col("event_type").alias("label"), "msg_id", F.col("seg_no").alias("col"), "bytes")


def _close(spark, sf_dir):
    """Clusters of distinct payloads by message distance."""
    Q.checkpoints(spark)
    first = Q._reps(spark, sf_dir).select(F.col("rep_id").alias("msg_id"), F.col("bytes").alias("data"))
    d = A.message_distances(G.fixed(first, 3)).select("i", "j", F.col("distance").alias("d"))
    return d, P.dbscan(d, first.selectExpr("msg_id AS id"), eps=1.5, least=3)


def aln07_clusters(spark, sf_dir):
    return _close(spark, sf_dir)[1]


def aln09_align(spark, sf_dir):
    """Distinct payloads, cut into digits and other characters, aligned by their length."""
    labels, first = _labels(spark, sf_dir), Q._reps(spark, sf_dir).select(F.col("rep_id").alias("msg_id"))
    fields = G.from_lengths(Q.events(spark, sf_dir), Q._fields(spark, sf_dir)).join(first, "msg_id", "left_semi")
    out = A.star_alignment(fields, labels.withColumnRenamed("id", "msg_id"), P.medoids(_d(spark, sf_dir), labels))
    return out.select("label", "msg_id", "col", F.hex("bytes").alias("h"))


def seq01_frequent(spark, sf_dir):
    Q.checkpoints(spark)
    return SQ.frequent(Q.events(spark, sf_dir))


def aln13_columns(spark, sf_dir):
    return C.columns(_aligned(spark, sf_dir)).withColumn("bytes", F.hex("bytes"))


def aln21_least_size(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    return C.least_size(labels, labels.count() ** 3)


_K = Q._D + ", k AS (SELECT id, len(v)::INT AS label FROM r)"
_I = _K + ", w AS (SELECT a.label, i, j, d FROM n JOIN k a ON a.id = i JOIN k b ON b.id = j WHERE a.label = b.label)"
_R = _I + """, sa AS (SELECT label, i AS a FROM w GROUP BY label, i QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(sum(d), 9) DESC, i) = 1),
rp AS (SELECT label, a, j AS c FROM w JOIN sa USING (label) WHERE i = a QUALIFY row_number() OVER (PARTITION BY label ORDER BY d DESC, j) = 1)"""
_O = "WITH r AS (SELECT min(event_id)::BIGINT AS id, strlen(props)::INT AS label, count(*) AS n FROM events GROUP BY props), s AS (SELECT *, ln(sum(n) OVER (PARTITION BY label)) AS l FROM r), o AS (SELECT label, count(*) AS values, sum(n)::BIGINT AS total, avg((n < l)::INT + (n <= l)::INT) * 50 AS rank, stddev_pop(n) AS spread FROM s GROUP BY label)"
_M = "WITH x AS (" + Q.OTHERS["val07_format_match"][1] + ")"


def _stats(by: str = "") -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return _M + f""", m AS (SELECT *, round(avg(score) OVER ({part}), 9) AS mean FROM x), c AS (SELECT {key}score AS centre FROM m QUALIFY row_number() OVER ({part} ORDER BY abs(score - mean), score) = 1),
g AS (SELECT {key}round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS most, round(median(score), 6) AS median, round(stddev_pop(score), 6) AS spread, count(*) AS n FROM x {group}) SELECT g.*, round(centre, 6) AS centre FROM g {f'JOIN c USING ({by})' if by else ', c'}"""


_TEXT = "len(v) >= 6 AND list_max(v) < 127 AND list_avg(list_filter(v, lambda y: y <> 0)) BETWEEN 50 AND 115 AND len(list_filter(v, lambda y: y <> 0 AND (y < 32 OR y > 126))) / len(v) < 0.33"

#: name: (query, SQL)
QUERIES = {
    "dis01_by_length": (dis01_by_length, "SELECT strlen(props)::INT AS length, count(DISTINCT props) AS n, min(event_id)::BIGINT AS least_id FROM events GROUP BY 1"),
    "dis06_normalisation": (dis06_normalisation, "SELECT min(event_id)::BIGINT AS rep_id, 1.0::DOUBLE AS cosine, 0.5::DOUBLE AS correlation, round(1 / strlen(props)::DOUBLE, 9) AS canberra, round(1 / (strlen(props) * 255.0::DOUBLE), 9) AS euclidean, round(1 / (strlen(props) * 255.0::DOUBLE * 255), 9) AS sqeuclidean FROM events GROUP BY props"),
    "dis07_sigmoid": (dis07_sigmoid, Q._D + " SELECT i, j, round(1 / (1 + exp(-pi() * pi() * (d - 0.5))), 6) AS d FROM dd"),
    "dis08_text_gain": (dis08_text_gain, Q._D + f", t AS (SELECT id FROM r WHERE {_TEXT}) SELECT i, j, CASE WHEN i IN (FROM t) AND j IN (FROM t) THEN d * 0.5 ELSE d END AS d FROM dd"),
    "dis09_matrix": (dis09_matrix, Q._D + " SELECT i, j, d FROM n UNION ALL SELECT id, id, 0.0::DOUBLE FROM r"),
    "dis11_similarity": (dis11_similarity, Q._D + " SELECT i, j, round(1 - d, 6) AS similarity FROM dd"),
    "dis13_submatrix": (dis13_submatrix, _K + " SELECT i, j, d FROM n JOIN k a ON a.id = i JOIN k b ON b.id = j WHERE a.label = 8 AND b.label = 9"),
    "dis21_to_members": (dis21_to_members, _I + ", q AS (SELECT label, i AS medoid FROM w GROUP BY label, i QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(sum(d), 9), i) = 1) SELECT label, medoid, j AS id, d FROM w JOIN q USING (label) WHERE i = medoid"),
    "pre02_most_dissimilar": (pre02_most_dissimilar, Q._D + ", s AS (SELECT i AS id, round(sum(d) / (count(*) + 1), 9) AS mean FROM n GROUP BY i) SELECT id, round(mean, 6) AS mean FROM s ORDER BY s.mean DESC, id LIMIT 50"),
    "clu01_sizes": (clu01_sizes, _O + " SELECT label, count(*) AS size, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY label"),
    "clu13_nearest": (clu13_nearest, Q._D + " SELECT i, j, d FROM n QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 1"),
    "sem06_regular": (sem06_regular, _O + ' SELECT label, values, values > 3 AS regular FROM o'),
    "sem08_type_counts": (sem08_type_counts, "SELECT source, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang"),
    "sem10_split": (sem10_split, _O + " SELECT id, label, rank > 95 AND spread > ln(total) AND n > ln(total) AS often FROM r JOIN o USING (label)"),
    "sem11_occurrences": (sem11_occurrences, _O + " SELECT label, values, total, round(rank, 6) AS rank, round(spread, 6) AS spread FROM o"),
    "sem12_remotest": (_on(C.remotest), _R + " SELECT label, a, c FROM rp"),
    "sem16_trace_means": (_on(C.trace_means, "mean"), _R + """, pl AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY d, id) AS p FROM (SELECT label, j AS id, d FROM w JOIN rp USING (label) WHERE i = a UNION ALL SELECT label, a, 0 FROM rp))
SELECT w.label, abs(x.p - y.p)::INT AS step, round(avg(d) + 1e-9, 6) AS mean FROM w JOIN pl x ON x.id = i JOIN pl y ON y.id = j WHERE i < j GROUP BY 1, 2"""),
    "sem21_detours": (_on(C.detours, "detour"), _R + " SELECT x.label, x.j AS b, round(x.d + y.d - z.d + 1e-9, 6) AS detour FROM rp JOIN w x ON x.i = a AND x.j <> c JOIN w y ON y.i = x.j AND y.j = c JOIN w z ON z.i = a AND z.j = c"),
    "sem23_links": (_on(C.links, "mean"), _K + " SELECT least(a.label, b.label) AS p, greatest(a.label, b.label) AS q, min(d) AS least, max(d) AS most, round(avg(d) + 1e-9, 6) AS mean FROM dd JOIN k a ON a.id = i JOIN k b ON b.id = j WHERE a.label <> b.label GROUP BY 1, 2"),
    "sem24_ecdf": (_on(C.ecdf, "share"), _I + " SELECT DISTINCT label, d, round(cume_dist() OVER (PARTITION BY label ORDER BY d) + 1e-9, 6) AS share FROM w WHERE i < j"),
    "tpl02_labels": (tpl02_labels, "SELECT n_chars, CASE WHEN min(lang) IS NULL THEN '[unknown]' WHEN min(lang) = max(lang) THEN min(lang) ELSE '[mixed]' END AS name FROM documents GROUP BY n_chars"),
    "tpl03_templates": (tpl03_templates, _I + ", q AS (SELECT label, i AS medoid FROM w GROUP BY label, i QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(sum(d), 9), i) = 1) SELECT label, medoid, m.h FROM q JOIN m ON msg_id = medoid"),
    "val02_formats": (val02_formats, "WITH t AS (SELECT event_id::BIGINT AS msg_id, array_to_string(list_transform(regexp_extract_all(props, '([0-9]+|[^0-9]+)'), lambda f: strlen(f)), ',') AS format FROM events) SELECT format, count(*) AS n, min(msg_id) AS msg_id FROM t GROUP BY format"),
    "val12_overlays": (val12_overlays, """WITH t0 AS (SELECT event_id::BIGINT AS msg_id, strlen(props) AS size, regexp_extract_all(props, '([0-9]+|[^0-9]+)') AS f FROM events), t1 AS (SELECT msg_id, size, unnest(range(len(f)))::INT AS pos, unnest(f) AS f FROM t0),
t2 AS (SELECT msg_id, size, pos, strlen(f) AS l, sum(strlen(f)) OVER (PARTITION BY msg_id ORDER BY pos) AS z FROM t1), t AS (SELECT msg_id, pos, z - l AS a, z, list_distinct(list_concat(range(0, size, 3), [size])) AS e FROM t2)
SELECT msg_id, pos, CASE WHEN len(list_filter(e, lambda x: x > a AND x < z)) > 0 THEN len(list_filter(e, lambda x: x > a AND x < z)) WHEN list_contains(e, a::BIGINT) AND list_contains(e, z::BIGINT) THEN 0 ELSE -1 END::INT AS code FROM t"""),
    "val15_score_statistics": (val15_score_statistics, _stats()),
    "val16_score_by_count": (val16_score_by_count, _stats("inferred_count")),
    "val19_by_score": (val19_by_score, _M + " SELECT round(score, 3) AS score, count(*) AS n, min(msg_id) AS msg_id FROM x GROUP BY 1"),
    "aln13_columns": (aln13_columns, """WITH m AS (SELECT event_type AS label, event_id, hex(encode(props)) AS h, strlen(props) AS size FROM events), o AS (SELECT label, h, unnest(range(0, size, 3)) AS o FROM m),
c AS (SELECT label, (o // 3)::INT AS col, substr(h, (2 * o + 1)::INT, 6) AS b FROM o) SELECT label, col, count(DISTINCT b) AS values, 0::BIGINT AS gaps, CASE WHEN count(DISTINCT b) = 1 THEN 'static' ELSE 'dynamic' END AS kind, CASE WHEN count(DISTINCT b) = 1 THEN min(b) END AS bytes FROM c GROUP BY label, col"""),
    "aln21_least_size": (aln21_least_size, _O + " SELECT id, CASE WHEN count(*) OVER (PARTITION BY label) < ln((SELECT count(*) FROM r) ** 3) THEN -1 ELSE label END::INT AS label FROM r"),
    "aln09_align": (aln09_align, """WITH r AS (SELECT min(event_id)::BIGINT AS msg_id, strlen(props)::BIGINT AS label, regexp_extract_all(props, '([0-9]+|[^0-9]+)') AS f FROM events GROUP BY props)
SELECT label, msg_id, unnest(range(len(f)))::INT AS col, hex(encode(unnest(f))) AS h FROM r"""),
    "aln05_message_similarity": (aln05_message_similarity, None),
    "aln07_clusters": (aln07_clusters, None),
    "seq01_frequent": (seq01_frequent, None),
}
