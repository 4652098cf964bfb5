"""Queries over dissected messages: each supplier is a short binary message of six fields of several lengths, with zeros, numbers and text.

Distinct field values are the values of pairwise operators, their places in the message the clusters. Customers, by segment and nation, are aligned messages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlore import queries as Q
from fieldlore import queries_clusters as QC
from fieldlore.functions import series as S
from fieldlore.operators import alignment as A
from fieldlore.operators import clusters as C
from fieldlore.operators import dissection as D
from fieldlore.operators import knees as K
from fieldlore.operators import merging as MG
from fieldlore.operators import pairwise as P
from fieldlore.operators import principal as PR
from fieldlore.operators import scores as V
from fieldlore.operators import segmentation as G
from fieldlore.operators import semantics as SM
from fieldlore.operators import sequences as SQ
from fieldlore.operators import templates as T
from fieldlore.operators import validation as X
from fieldlore.operators.lineage import checkpoints, once
from fieldlore.plans import pipelines
from fieldlore.sinks import reports as R

NAMES = ("id", "pad", "nation", "balance", "name", "check")
TYPES = ("id", "pad", "enum", "int", "chars", "checksum")
LABELS = ("sup.id", "sup.pad", "sup.nation", "sup.opt", "sup.opt", "sup.check")


def _supplier(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    h = [
        F.format_string("%04x", F.expr("cast(s_suppkey % 65536 AS int)")),
        F.lit("0000"),
        F.format_string("%02x", "s_nationkey"),
        F.format_string("%06x", F.expr("cast(round(s_acctbal * 100) + 100000 AS int)")),
        F.lower(F.hex(F.encode(F.expr("substr(s_name, 1, 3 + s_nationkey % 5)"), "utf-8"))),
        F.format_string("%02x", F.expr("cast((s_suppkey * 7919) % 256 AS int)")),
    ]
    return t.select(F.col("s_suppkey").cast("bigint").alias("msg_id"), F.col("s_nationkey").alias("nation"), F.array(*h).alias("f"))


def fields(spark, sf_dir):
    """True fields (msg_id, pos, name, type, hex, len)."""
    x = _supplier(spark, sf_dir).select("msg_id", "nation", F.posexplode("f").alias("pos", "hex"))
    at = lambda names: F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1)
    return x.select("msg_id", "nation", "pos", at(NAMES).alias("name"), at(TYPES).alias("type"), "hex", (F.length("hex") / 2).cast("int").alias("len"))


def packets(spark, sf_dir):
    """Messages (msg_id, data)."""
    return _supplier(spark, sf_dir).select("msg_id", F.unhex(F.array_join("f", "")).alias("data"))


def segments(spark, sf_dir):
    return G.from_lengths(packets(spark, sf_dir), fields(spark, sf_dir))


def values(spark, sf_dir):
    """(id, bytes, n) of distinct field values; an id's last digit is the place of the value's first field."""
    x = fields(spark, sf_dir).select((F.col("msg_id") * 10 + F.col("pos")).alias("id"), F.unhex("hex").alias("bytes"))
    return once(x.groupBy("bytes").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "bytes", "n"))


def labels(v):
    return v.select("id", (F.col("id") % 10).alias("label"))


def _reps(v):
    return v.select(F.col("id").alias("rep_id"), "bytes", "n")


def _pairs(v):
    """Distances in six digits, made anew where they are read: a table of all pairs is larger than what it comes from."""
    return P.distances(_reps(v), digits=6)


def distances(v):
    return once(_pairs(v))


def inferred(spark, sf_dir, n=3):
    x = G.fixed(packets(spark, sf_dir), n)
    return x.select("msg_id", (F.col("offset") + F.col("length")).cast("bigint").alias("end"))


def ends(spark, sf_dir):
    return V.field_ends(fields(spark, sf_dir)).select("msg_id", F.col("end").cast("bigint").alias("end"))


def aligned(spark, sf_dir):
    """Customers as aligned messages: label, msg_id, col, bytes; every seventh lacks its last column's value."""
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    cells = F.array(
        F.format_string("%06x", F.col("c_custkey").cast("int")),
        F.format_string("%02x", F.expr("c_nationkey % 3 + 1")),
        F.lit("0000"),
        F.lower(F.hex(F.encode(F.expr("substr(c_mktsegment, 1, 3)"), "utf-8"))),
        F.expr("CASE WHEN c_custkey % 40 <> 0 THEN format_string('%02x', cast(c_custkey % 2 + 1 AS int)) END"),
    )
    x = t.select(F.expr("CASE WHEN c_custkey % 5 < 3 THEN 'a' ELSE 'b' END").alias("label"), F.col("c_custkey").cast("bigint").alias("msg_id"), F.posexplode(cells).alias("col", "h"))
    return x.select("label", "msg_id", "col", F.unhex("h").alias("bytes"))


# sources


def src03_in_memory(spark, sf_dir):
    return packets(spark, sf_dir).select("msg_id", F.lower(F.hex("data")).alias("hex"))


def src04_base_layer(spark, sf_dir):
    link = F.element_at(F.array(*map(F.lit, (1, 101, 127, 7))), F.col("nation") % 4 + 1)
    x = _supplier(spark, sf_dir).select("msg_id", link.alias("link"))
    return x.select("msg_id", D.base_layer(F.col("link")).alias("layer"), D.link_type(D.base_layer(F.col("link"))).alias("link"))


def _json(spark, sf_dir):
    f = lambda k: F.element_at("f", k + 1)
    raw = lambda name, k: F.concat(F.lit(f'"{name}": "x", "{name}_raw": ["'), f(k), F.lit('", 0, 1]'))
    body = F.concat(F.lit('{"frame": {"frame.len_raw": ["00c", 0, 2]}, "sup": {'), raw("sup.id", 0), F.lit(', "sup.flags": {'), raw("sup.pad", 1), F.lit(", "), raw("sup.nation", 2), F.lit("}, "), raw("sup.opt", 3), F.lit(", "), raw("sup.opt", 4), F.lit(", "), raw("sup.check", 5), F.lit("}}"))
    return _supplier(spark, sf_dir).select("msg_id", body.alias("dissection"))


def _dissected(spark, sf_dir):
    return D.walk(_json(spark, sf_dir), layer="sup")


def src08_parse(spark, sf_dir):
    return D.walk(_json(spark, sf_dir))


def src09_beside(spark, sf_dir):
    """Dissections of two of three messages beside all of them."""
    p = _json(spark, sf_dir).where("msg_id % 3 <> 0").withColumnRenamed("msg_id", "seq")
    return D.beside(packets(spark, sf_dir).withColumn("seq", F.col("msg_id")), p).select("msg_id", F.col("dissection").isNotNull().alias("known"))


def src11_tree_walk(spark, sf_dir):
    return D.walk(_json(spark, sf_dir), ignore=("sup.pad",), exclude=("frame",))


def src12_rest(spark, sf_dir):
    m = packets(spark, sf_dir).select("msg_id", F.lower(F.hex("data")).alias("h"))
    return D.with_rest(_dissected(spark, sf_dir).where("pos < 5"), m)


def src13_by_name(spark, sf_dir):
    return D.by_name(_dissected(spark, sf_dir), "sup.opt").select("msg_id", F.array_join("hexes", ",").alias("hexes"))


def src14_sequence(spark, sf_dir):
    s = D.sequence(_dissected(spark, sf_dir))
    return s.select("msg_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("names", "hexes", "lengths")))


def _types(spark):
    return spark.createDataFrame([(f"sup.{n}", t) for n, t in zip(NAMES[:3], TYPES[:3], strict=True)] + [("sup.opt", "option")], "name string, type string")


def src15_types(spark, sf_dir):
    return D.typed(_dissected(spark, sf_dir), _types(spark)).select("msg_id", "pos", "name", "len", "type")


def src16_values_of_types(spark, sf_dir):
    return D.values_of_types(D.typed(_dissected(spark, sf_dir), _types(spark))).select("type", F.array_join("hexes", ",").alias("hexes"))


def src17_untyped(spark, sf_dir):
    return D.untyped(_dissected(spark, sf_dir), _types(spark))


def src18_message_types(spark, sf_dir):
    rules = spark.createDataFrame([("sup.nation", "03", "00", "zero", 0), ("sup.nation", "03", "01", "one", 0), ("sup.id", None, "0001", "first", 1), ("sup.id", "0001", "0001", "odd", 2)], "name string, mask string, hex string, title string, rank int")
    return D.message_types(_dissected(spark, sf_dir), rules)


def src19_registry(spark, sf_dir):
    r = D.registry({"a": {"x": [1, 2], "y": 1}}, {"a": {"x": [2, 3], "z": 2}, "b": 4}, {"a": {"y": 5}})
    return spark.createDataFrame([("a.x", str(r["a"]["x"])), ("a.y", str(r["a"]["y"])), ("a.z", str(r["a"]["z"])), ("b", str(r["b"]))], "key string, value string")


def src21_type_table(spark, sf_dir):
    rows = [(None, None, "f", "old"), (None, "2.2", "f", "new"), ("p", "3.2", "f", "newest"), ("p", None, "g", "own"), ("q", None, "g", "other"), (None, None, "h", "any")]
    return D.type_table(spark.createDataFrame(rows, "protocol string, version string, name string, type string"), "p", "2.6")


# features


def fea29_registry(spark, sf_dir):
    """Three of the named features of events."""
    t = Q.events(spark, sf_dir)
    out = None
    for name in ("bc", "variance", "value"):
        x = t.select("msg_id", F.lit(name).alias("feature"), F.posexplode(S.FEATURES[name](Q._v())).alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))
        out = x if out is None else out.union(x)
    return out


def _halves():
    v = Q._v()
    n = F.floor(F.size(v) / 2).cast("int")
    return F.slice(v, 1, n), F.slice(v, n + 1, n)


def fea42_absolute_difference(spark, sf_dir):
    a, b = _halves()
    return Q.events(spark, sf_dir).select("msg_id", S.absolute_difference(a, b).alias("sad"))


def fea45_printable(spark, sf_dir):
    x = segments(spark, sf_dir)
    v = S.values(F.col("bytes"))
    return x.select("msg_id", "seg_no", S.printable(v).alias("printable"), S.first_unprintable(v).alias("first"))


def fea48_lower_triangle(spark, sf_dir):
    return P.lower_triangle(P.symmetric(_pairs(values(spark, sf_dir))))


def fea41_measures(spark, sf_dir):
    v, feature = Q._v(), S.values(F.lit(b'": '))
    best = lambda m, f: F.round(f(S.similarity_at(feature, v, m)), 6)
    return Q.events(spark, sf_dir).select("msg_id", best("cosine", F.array_min).alias("cosine"), best("pearson", F.array_max).alias("pearson"))


# segmentation and refinement


def seg14_from_cells(spark, sf_dir):
    cells = _supplier(spark, sf_dir).select("msg_id", F.transform("f", lambda h: F.when(h != "0000", F.unhex(h))).alias("cells"))
    return G.from_cells(cells).select("msg_id", "seg_no", "offset", "length", F.hex("bytes").alias("h"))


def seg15_convert(spark, sf_dir):
    """Chunks of four bytes with the differences of bytes that begin in them."""
    t = Q.events(spark, sf_dir)
    return G.with_feature(G.fixed(t, 4), t.select("msg_id", S.delta(Q._v()).alias("values"))).select("msg_id", "seg_no", F.array_join(F.col("values").cast("array<string>"), ",").alias("values"))


def _shown(x):
    return x.select("msg_id", "seg_no", "offset", "length", F.hex("bytes").alias("h"))


def ref01_merge_like(spark, sf_dir):
    """Chunks of two bytes merged while their first half-bytes are equal."""
    first = lambda c: F.substring(F.hex(c), 1, 1)
    return _shown(G.islands(G.fixed(Q.events(spark, sf_dir), 2), lambda a, b: first(a) == first(b)))


def ref04_frequency_rise(spark, sf_dir):
    return _shown(G.merge_on_rise(G.fixed(Q.turns(spark, sf_dir), 2)))


def ref05_widen(spark, sf_dir):
    return _shown(G.again(G.fixed(Q.turns(spark, sf_dir), 5), ["pull"]))


def ref06_widen_text(spark, sf_dir):
    return _shown(G.refined(Q.turns(spark, sf_dir), ["pull"]))


def ref07_rarest_pair(spark, sf_dir):
    t = Q.turns(spark, sf_dir)
    return _shown(G.at_rarest_pairs(G.fixed(t, 4), t))


def ref10_gather_text(spark, sf_dir):
    return _shown(G.refined(Q.turns(spark, sf_dir), ["gather"]))


def ref13_zero_slices(spark, sf_dir):
    return _shown(G.again(G.whole(packets(spark, sf_dir)), ["zeros"]))


def ref14_crop_text(spark, sf_dir):
    return _shown(G.again(G.whole(packets(spark, sf_dir)), ["crop_fields"]))


def ref16_principal(spark, sf_dir):
    m = once(packets(spark, sf_dir))
    return _shown(PR.refine(G.fixed(m, 5), m))


def ref26_apply_bounds(spark, sf_dir):
    """Chunks of four bytes with the true bounds put in."""
    m = packets(spark, sf_dir)
    b = ends(spark, sf_dir).select("msg_id", F.col("end").cast("int").alias("bound")).join(m.select("msg_id", F.octet_length("data").alias("size")), "msg_id").where("bound < size").drop("size")
    return _shown(PR.apply_bounds(G.fixed(m, 4), b, m))


def _plan(name):
    def query(spark, sf_dir):
        return _shown(pipelines.segment(once(packets(spark, sf_dir)), name))

    return query


# dissimilarity


def dis02_value_matrix(spark, sf_dir):
    return P.value_matrix(values(spark, sf_dir))


def dis03_methods(spark, sf_dir):
    d = P.equal_length_distances(values(spark, sf_dir), ("canberra", "euclidean", "sqeuclidean", "cosine"))
    return d.select("i", "j", *(F.round(m, 6).alias(m) for m in ("canberra", "euclidean", "sqeuclidean", "cosine")))


def dis04_embedding(spark, sf_dir):
    v = values(spark, sf_dir)
    x, y = v.select(F.col("id").alias("i"), S.values(F.col("bytes")).alias("a")), v.select(F.col("id").alias("j"), S.values(F.col("bytes")).alias("b"))
    pairs = x.join(y, F.size("a") < F.size("b"))
    return pairs.where("i % 10 >= 2 AND j % 10 >= 2").select("i", "j", F.inline(F.array(S.best_shift(F.col("a"), F.col("b"))))).select("i", "j", F.round("e", 6).alias("e"), "shift")


def dis05_mixed_lengths(spark, sf_dir):
    return _pairs(values(spark, sf_dir)).select("i", "j", "d")


def dis12_shifts(spark, sf_dir):
    return _pairs(values(spark, sf_dir)).where("shift > 0").select("i", "j", "shift")


def dis17_subset(spark, sf_dir):
    """Distinct representatives of the first two and of the last two fields of messages."""
    f = fields(spark, sf_dir).withColumn("bytes", F.unhex("hex"))
    return P.representatives_of(f.where("pos < 2"), f.where("pos > 3"), values(spark, sf_dir))


def dis20_cached(spark, sf_dir):
    """Distances kept under their parameters; the second call reads what the first wrote."""
    v = values(spark, sf_dir)
    build = lambda: P.distances(v.select(F.col("id").alias("rep_id"), "bytes", "n"))
    key = {"table": sf_dir, "relief": 0.33, "rows": v.count()}
    P.cached(spark, key, build)
    return P.cached(spark, key, build).select("i", "j", F.round("d", 6).alias("d"))


# templates


def tpl01_same_length(spark, sf_dir):
    v = values(spark, sf_dir)
    return T.same_feature(labels(v), v.select("id", F.octet_length("bytes").alias("feature")))


def tpl03_means(spark, sf_dir):
    v = values(spark, sf_dir)
    return T.mean_templates(labels(v), v).withColumn("mean", F.round("mean", 6))


def _members(spark, sf_dir):
    v = values(spark, sf_dir)
    return v.join(labels(v), "id").select("label", "id", "bytes")


def _templates(spark, sf_dir):
    return once(T.field_types(_members(spark, sf_dir).where("label IN (0, 2, 3)")))


def tpl04_templates(spark, sf_dir):
    return T.field_types(_members(spark, sf_dir)).select("label", "members", F.posexplode(F.arrays_zip("mean", "deviation")).alias("pos", "m")).select("label", "members", "pos", F.round("m.mean", 6).alias("mean"), F.round("m.deviation", 6).alias("deviation"))


def tpl05_context(spark, sf_dir):
    s = PR.relevant(segments(spark, sf_dir)).select(F.col("seg_no").alias("label"), F.col("msg_id").alias("id"), "bytes", "before", "after")
    return T.field_types(s, context=True).select("label", "members", F.size("mean").alias("size"))


def tpl06_confidence(spark, sf_dir):
    """How far each template's own values are from it."""
    m = _members(spark, sf_dir).where("label IN (0, 2, 3)")
    found = T.recognise(m.select(F.col("id").alias("msg_id"), F.col("bytes").alias("data")), _templates(spark, sf_dir))
    return found.where("pos = 0").select("msg_id", "label", F.round("confidence", 4).alias("confidence"))


def tpl07_persisted(spark, sf_dir):
    path = f"{checkpoints(spark)}/templates-{abs(hash(sf_dir)):x}"
    _templates(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("label", "members", F.size("mean").alias("size"), F.length("type_id") > 0)


def tpl08_recognise(spark, sf_dir):
    return T.recognise(packets(spark, sf_dir), _templates(spark, sf_dir)).select("msg_id", "label", "pos", F.round("confidence", 4).alias("confidence"))


def tpl09_text(spark, sf_dir):
    return T.recognised_text(Q.turns(spark, sf_dir))


def tpl11_recognised(spark, sf_dir):
    t = _templates(spark, sf_dir)
    return T.recognised(T.recognise(packets(spark, sf_dir), t), t, 3.0).select("msg_id", "label", "pos", "length", F.round("confidence", 4).alias("confidence"))


def tpl12_overlaps(spark, sf_dir):
    """Fields that reach one byte into the next one."""
    x = segments(spark, sf_dir).select("msg_id", F.col("offset").alias("pos"), (F.col("length") + 1).alias("length"))
    return T.overlapping(x)


def tpl13_types(spark, sf_dir):
    return T.by_type(fields(spark, sf_dir).withColumnRenamed("hex", "bytes"))


# clusters


def _near(spark, sf_dir, k):
    return K.nearest_ranks_of(_reps(values(spark, sf_dir)), k, 6)


def clu05_parameters(spark, sf_dir):
    """The radius found; NoKneeError where there is no knee."""
    v = values(spark, sf_dir)
    n = v.count()
    p = K.by_distribution(K.nearest_ranks_of(_reps(v), K.ranks(n), 6), n)
    return spark.createDataFrame([(float(p.eps), p.min_samples, p.k)], "eps double, min_samples int, k int")


def clu06_sharpest(spark, sf_dir):
    near = _near(spark, sf_dir, 7)
    return spark.createDataFrame([(K.sharpest(near, 5, 0.8),)], "k int")


def clu08_curvature(spark, sf_dir):
    v = values(spark, sf_dir)
    n = v.count()
    near = K.nearest_ranks_of(_reps(v), K.curves(n), 6)
    return spark.createDataFrame([K.by_curvature(K.sorted_curves(near), n)], "eps double, min_samples int, k int")


def clu09_rule_of_thumb(spark, sf_dir):
    curve = K.sorted_curves(_near(spark, sf_dir, 3).where("rank = 2"))[0]
    return spark.createDataFrame([(K.rule_of_thumb(curve),)], "place int")


def clu10_adjusted(spark, sf_dir):
    d = _pairs(values(spark, sf_dir))
    return d.select("i", "j", F.round(K.adjusted_eps(F.col("d"), F.col("d") / 2), 6).alias("eps"))


def clu11_no_large_cluster(spark, sf_dir):
    v = values(spark, sf_dir)
    try:
        return K.cluster_values(_reps(v), digits=6)[0]
    except K.NoKneeError:
        return v.select("id", F.lit(-1).cast("bigint").alias("label"))


def clu12_mean_growth(spark, sf_dir):
    return K.mean_growth(_near(spark, sf_dir, 5)).select("rank", F.round(F.col("mean") + 1e-9, 5).alias("mean"), F.round(F.col("growth") + 1e-9, 5).alias("growth"))


def clu14_nested(spark, sf_dir):
    v = values(spark, sf_dir)
    types = v.select("id", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("id") % 10 + 1).cast("int")).alias("type"))
    noisy = labels(v).withColumn("label", F.when(F.col("label") == 5, -1).otherwise(F.col("label")))
    return SM.nested(noisy, v, types.where("id % 10 <> 3"))


# semantics


def _on(f):
    def query(spark, sf_dir):
        v = values(spark, sf_dir)
        return f(v)

    return query


def _of(f):
    def query(spark, sf_dir):
        v = values(spark, sf_dir)
        return f(distances(v), labels(v), v)

    return query


def _noisy(v):
    """Check bytes are noise."""
    return labels(v).withColumn("label", F.when(F.col("label") == 5, -1).otherwise(F.col("label")).cast("int"))


def sem05_unique(spark, sf_dir):
    f = fields(spark, sf_dir).select((F.col("msg_id") * 10 + F.col("pos")).alias("id"), F.unhex("hex").alias("bytes"), "pos")
    return SM.of_unique_values(f.where("pos < 5").select("id", F.col("pos").alias("label")), f).select(F.hex("bytes").alias("h"), "name")


def _lengths(v):
    x = SM.lengths_and_text(labels(v), v)
    return x.select("label", F.array_join(F.col("lengths").cast("array<string>"), " ").alias("lengths"), "text", "members")


def _skew(v):
    return SM.skewness(labels(v), v).select("label", F.round("skew", 6).alias("skew"), F.round("percentile", 6).alias("percentile"))


def _merged(v):
    return SM.merged(labels(v), SM.density_pairs_of(_reps(v), labels(v)))


def _hypotheses(v):
    return SM.hypotheses(None, labels(v), v, SM.shapes_of(_reps(v), labels(v)))


def _links(v):
    x = SM.link_statistics_of(_reps(v), labels(v))
    r = lambda c: F.round(F.col(c) + 1e-9, 5).alias(c)
    return x.select("p", "q", "least", "most", r("mean"), r("median"), r("deviation"))


def _eigen(v):
    return SM.eigenvalues(labels(v), v).select("label", F.size("eigen").alias("size"), "direction")


def sem07_export(spark, sf_dir):
    """One template for each regular cluster, and one for all singular values together."""
    v = values(spark, sf_dir)
    kind = SM.cauldron(labels(v), v).where("kind <> 'noise'")
    x = kind.join(v, "id").select(F.when(F.col("kind") == "regular", F.col("label")).otherwise(99).alias("label"), "id", "bytes")
    return T.field_types(x).select("label", "members", F.size("mean").alias("size"))


# alignment


def aln01_score_domain(spark, sf_dir):
    return _pairs(values(spark, sf_dir)).select("i", "j", F.round(A.score_of(1 - F.col("d"), 5.0, -1.0), 6).alias("score"))


def aln06_distance(spark, sf_dir):
    """Scores of as many matches as the shorter of two messages has segments, less the difference of their numbers."""
    n = fields(spark, sf_dir).where("hex <> '0000'").groupBy("msg_id").agg(F.sum("len").alias("k"))
    x = n.toDF("i", "a").join(n.toDF("j", "b"), F.col("j") == F.col("i") + 1)
    score = F.least("a", "b") - F.abs(F.col("a") - F.col("b"))
    return x.select("i", "j", F.round(A.distance_of(score, F.col("a"), F.col("b")), 6).alias("distance"))


def aln03_alignment(spark, sf_dir):
    """Each message's segments beside the next one's."""
    return A.aligned_pairs(segments(spark, sf_dir))


def aln04_divided(spark, sf_dir):
    return A.aligned_pairs(segments(spark, sf_dir), divided=True)


def aln02_last_line(spark, sf_dir):
    return A.last_lines(segments(spark, sf_dir)).select("i", "j", F.array_join(F.transform("line", lambda x: F.round(x, 6).cast("string")), ",").alias("line"))


def aln08_parameters(spark, sf_dir):
    m = once(segments(spark, sf_dir))
    return spark.createDataFrame([K.message_curvature(m, m.select("msg_id").distinct().count())], "eps double, min_samples int, k int")


def _message_types(spark, sf_dir):
    return pipelines.message_types(once(segments(spark, sf_dir)))


def aln10_message_types(spark, sf_dir):
    return _message_types(spark, sf_dir)


def aln11_pivots(spark, sf_dir):
    return MG.pivot_columns(aligned(spark, sf_dir), relaxed=False)


def aln12_pivots_relaxed(spark, sf_dir):
    return MG.pivot_columns(aligned(spark, sf_dir), longest=3)


def aln12_split(spark, sf_dir):
    a = aligned(spark, sf_dir)
    return MG.split(a, MG.pivot_columns(a, longest=3))


def _clusters_of_columns(spark, sf_dir):
    """Customers by segment of market."""
    a = once(aligned(spark, sf_dir))
    kind = a.where("col = 3").select("msg_id", F.decode("bytes", "utf-8").alias("label"))
    return once(a.where("col > 0").drop("label").join(kind, "msg_id").select("label", "msg_id", "col", "bytes"))


def aln14_matches(spark, sf_dir):
    return MG.matches(_clusters_of_columns(spark, sf_dir)).select("p", "q", "fields", "gaps", "matched", "torn")


def aln18_merge(spark, sf_dir):
    a = _clusters_of_columns(spark, sf_dir)
    pairs = MG.merge_pairs(once(MG.matches(a)), a.select("label").distinct().count())
    return MG.merged(a.select("msg_id", "label").distinct(), pairs)


def aln19_cluster_distances(spark, sf_dir):
    return MG.cluster_distances(_clusters_of_columns(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


def aln20_missed(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    x = t.select(F.col("c_custkey").alias("msg_id"), F.expr("c_nationkey % 7").alias("label"), F.expr("concat('t', c_nationkey % 3)").alias("type"))
    return MG.missed_merges(x.select("msg_id", "label"), x.select("msg_id", "type")).select("type", F.array_join("clusters", ",").alias("clusters"))


def aln22_discriminators(spark, sf_dir):
    x = aligned(spark, sf_dir)
    kind = x.where("col = 1").select("msg_id", F.hex("bytes").alias("label"))
    return C.discriminators(x.drop("label").join(kind, "msg_id")).select("label", "col", F.hex("bytes").alias("h"))


def aln23_without_gaps(spark, sf_dir):
    return MG.without_gaps(aligned(spark, sf_dir))


def aln23_to_first(spark, sf_dir):
    return MG.to_first(aligned(spark, sf_dir).where("col = 1")).select("label", "col", "msg_id", F.round("d", 6).alias("d"))


def seq02_support(spark, sf_dir):
    n = fields(spark, sf_dir).groupBy("hex").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(float(SQ.support(n)),)], "support double")


def seq03_most_frequent(spark, sf_dir):
    checkpoints(spark)
    return SQ.most_frequent(SQ.frequent(Q.events(spark, sf_dir)))


# validation


def val03_exact(spark, sf_dir):
    return X.exact(ends(spark, sf_dir), inferred(spark, sf_dir))


def val04_scopes(spark, sf_dir):
    return X.scopes(ends(spark, sf_dir))


def val05_near(spark, sf_dir):
    return X.near(ends(spark, sf_dir), inferred(spark, sf_dir))


def val06_in_scope(spark, sf_dir):
    return X.in_scope(ends(spark, sf_dir), inferred(spark, sf_dir))


def val08_by_step(spark, sf_dir):
    t = Q.events(spark, sf_dir)
    cut = lambda n: G.fixed(t, n).select(F.lit(n).alias("step"), "msg_id", (F.col("offset") + F.col("length")).cast("bigint").alias("end"))
    out = X.format_match_by(V.field_ends(Q._fields(spark, sf_dir)).select("msg_id", F.col("end").cast("bigint").alias("end")), cut(2).union(cut(3)), "step")
    return out.select("step", "msg_id", "exact_count", "near_count", F.round("score", 6).alias("score"))


def val09_overlaps(spark, sf_dir):
    return X.overlaps(G.fixed(packets(spark, sf_dir), 4), ends(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


def val10_typed(spark, sf_dir):
    x = X.typed_segments(segments(spark, sf_dir), fields(spark, sf_dir))
    return x.select("msg_id", "offset", F.hex("bytes").alias("h"), "name", "type", "ratio")


def val11_types_of_values(spark, sf_dir):
    x = X.types_of_values(X.typed_segments(segments(spark, sf_dir), fields(spark, sf_dir)))
    return x.select(F.hex("bytes").alias("h"), "n", "type", "ratio")


def val17_format_examples(spark, sf_dir):
    return X.format_examples(fields(spark, sf_dir))


def val17_bits(spark, sf_dir):
    return X.bytes_of_bits(fields(spark, sf_dir).select("msg_id", "pos", (F.col("len") * 8 - F.when(F.col("pos") == 1, 5).otherwise(0) + F.when(F.col("pos") == 2, 5).otherwise(0)).alias("bits")))


def _runs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IS NOT NULL AND lang IS NOT NULL").withColumn("run", F.expr("doc_id % 3"))
    n = d.groupBy("run", "source", "lang").agg(F.count("*").alias("n"))
    x = n.groupBy("run", "source").agg(F.max(F.struct("n", "lang")).alias("m"), F.sum("n").alias("size"))
    return x.select("run", F.when(F.col("size") < 5, "NOISE").otherwise(F.col("source")).alias("label"), F.col("m.lang").alias("type"), (F.col("m.n") / F.col("size")).alias("precision"), (F.col("size") / 100).alias("recall"))


def val18_run_scores(spark, sf_dir):
    x = X.run_scores(_runs(spark, sf_dir))
    return x.select("run", F.round("least", 6).alias("least"), "type", F.round("recall", 6).alias("recall"))


def val20_few_labels(spark, sf_dir):
    v = values(spark, sf_dir)
    lab = labels(v)
    return X.few_labels(lab, SM.largest_distance(distances(v), lab), 2)


def val21_members(spark, sf_dir):
    v = values(spark, sf_dir)
    t = v.join(labels(v), "id").where("n > 1").select("label", "bytes")
    return X.members(t, segments(spark, sf_dir))


# reports and the numbers of pictures


def _folder(spark, sf_dir, name):
    return f"{checkpoints(spark)}/report-{name}-{abs(hash(sf_dir)):x}"


def snk01_scores(spark, sf_dir):
    m = V.format_match(ends(spark, sf_dir), inferred(spark, sf_dir)).select("msg_id", "exact_count", "near_count", F.round("score", 6).alias("score"))
    return R.read(spark, R.score_report(m, _folder(spark, sf_dir, "scores"))[0])


def snk02_segments(spark, sf_dir):
    return R.read(spark, R.segmented_messages(segments(spark, sf_dir), _folder(spark, sf_dir, "segments")))


def snk03_elements(spark, sf_dir):
    v = values(spark, sf_dir)
    return R.read(spark, R.cluster_elements(labels(v), v, _folder(spark, sf_dir, "elements")))


def snk04_hypotheses(spark, sf_dir):
    v = values(spark, sf_dir)
    d, lab = distances(v), labels(v)
    return R.read(spark, R.hypotheses(SM.hypotheses(d, lab, v), SM.names(d, lab, v), _folder(spark, sf_dir, "hypotheses")))


def snk05_alignment(spark, sf_dir):
    return R.read(spark, R.alignment_table(aligned(spark, sf_dir), _folder(spark, sf_dir, "alignment")))


def snk06_stages(spark, sf_dir):
    s = R.Stages()
    s.timed("segments", lambda: segments(spark, sf_dir).count())
    s.timed("values", lambda: values(spark, sf_dir).count())
    return s.table(spark).select("stage", (F.col("seconds") >= 0).alias("timed"))


def snk07_metadata(spark, sf_dir):
    return R.metadata(spark, R.title("congruence", sigma=0.6, refinement="original", eps=None), {"sigma": 0.6})


def snk09_steps(spark, sf_dir):
    x = MG.step_statistics(aligned(spark, sf_dir).where("col BETWEEN 1 AND 4"))
    return x.select("label", "col", "values", "step", "low", "high", F.round("mean_low", 6).alias("mean_low"), F.round("mean_high", 6).alias("mean_high"))


def snk10_titles(spark, sf_dir):
    rows = [(k, R.title("congruence", sigma=s, refinement=r)) for k, (s, r) in enumerate([(0.6, "original"), (1.2, None), (None, "base")])]
    return spark.createDataFrame(rows, "k int, title string")


def vis01_subsample(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return X.every_kth(t, most=50, aim=40)


def vis02_layout(spark, sf_dir):
    v = values(spark, sf_dir).where("id % 10 = 2")
    return X.layout(distances(v), v.select("id")).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def vis05_deviations(spark, sf_dir):
    return X.deviation_counts(ends(spark, sf_dir), inferred(spark, sf_dir))


def vis06_ends(spark, sf_dir):
    return X.end_counts(ends(spark, sf_dir))


def vis08_printed(spark, sf_dir):
    return R.printed(segments(spark, sf_dir))


def vis09_side_by_side(spark, sf_dir):
    return X.side_by_side(ends(spark, sf_dir).select("msg_id", F.col("end").alias("x")), inferred(spark, sf_dir).select("msg_id", F.col("end").alias("y")))


def vis13_separation(spark, sf_dir):
    v = values(spark, sf_dir)
    return X.separation(distances(v), v.select("id", (F.col("id") % 10).alias("type")))


# the same in SQL

_S = """WITH pk AS (SELECT s_suppkey::BIGINT AS msg_id, s_nationkey AS nation, [printf('%04x', (s_suppkey % 65536)::INT), '0000', printf('%02x', s_nationkey), printf('%06x', (round(s_acctbal * 100) + 100000)::INT), lower(hex(encode(substr(s_name, 1, (3 + s_nationkey % 5)::INT)))), printf('%02x', ((s_suppkey * 7919) % 256)::INT)] AS f FROM supplier),
t AS (SELECT msg_id, nation, unnest(range(6))::INT AS pos, unnest(['id', 'pad', 'nation', 'balance', 'name', 'check']) AS name, unnest(['id', 'pad', 'enum', 'int', 'chars', 'checksum']) AS type, unnest(['sup.id', 'sup.pad', 'sup.nation', 'sup.opt', 'sup.opt', 'sup.check']) AS label, unnest(f) AS hex FROM pk),
ft AS (SELECT *, (length(hex) // 2)::INT AS len, (sum(length(hex) // 2) OVER (PARTITION BY msg_id ORDER BY pos))::BIGINT AS e FROM t)"""
_VALS = _S + """, vals AS (SELECT hex, min(msg_id * 10 + pos)::BIGINT AS id, count(*) AS n, list_transform(range(0, length(hex) // 2), lambda i: ('0x' || substr(hex, (2 * i + 1)::INT, 2))::INT) AS v FROM t GROUP BY hex),
lb AS (SELECT id, (id % 10)::BIGINT AS label, v, n, hex FROM vals)"""
_PD = _VALS + ", r AS (SELECT v, id FROM vals)," + "\np AS" + Q._D.split(",\np AS", 1)[1]
_IN = _PD + ", w AS (SELECT a.label, i, j, d FROM dd JOIN lb a ON a.id = i JOIN lb b ON b.id = j WHERE a.label = b.label)"
_INF = _S + ", sz AS (SELECT msg_id, max(e) AS size FROM ft GROUP BY msg_id), i3 AS (SELECT msg_id, unnest(list_distinct(list_concat(range(3, size, 3), [size])))::BIGINT AS x FROM sz)"
_SC = _INF + """, nb AS (SELECT msg_id, e, coalesce(lag(e) OVER w, e) AS l, lead(e) OVER w AS r FROM ft WINDOW w AS (PARTITION BY msg_id ORDER BY e)),
sc AS (SELECT msg_id, e AS "end", CASE WHEN e - l <= 1 THEN e ELSE l + (e - l) // 2 END AS low, CASE WHEN r - e <= 1 THEN e ELSE e - 1 + (r - e) // 2 END AS high FROM nb WHERE r IS NOT NULL),
scp AS (SELECT * FROM sc WHERE low < high), ins AS (SELECT s.msg_id, s."end", x AS inferred, x - s."end" AS off FROM scp s JOIN i3 ON i3.msg_id = s.msg_id AND x BETWEEN low AND high WHERE NOT EXISTS (SELECT 1 FROM i3 k WHERE k.msg_id = s.msg_id AND k.x = s."end"))"""
_AL = """WITH c AS (SELECT CASE WHEN c_custkey % 5 < 3 THEN 'a' ELSE 'b' END AS label, c_custkey::BIGINT AS msg_id, [printf('%06x', c_custkey::INT), printf('%02x', c_nationkey % 3 + 1), '0000', lower(hex(encode(substr(c_mktsegment, 1, 3)))), CASE WHEN c_custkey % 40 <> 0 THEN printf('%02x', (c_custkey % 2 + 1)::INT) END] AS f FROM customer),
al AS (SELECT label, msg_id, unnest(range(5))::INT AS col, unnest(f) AS h FROM c)"""
_CV = _AL + """, cv AS (SELECT label, col, h, count(*) AS n FROM al WHERE h IS NOT NULL GROUP BY ALL), cs AS (SELECT label, col, list_sort(list(n)) AS counts, max(length(h) // 2) AS long, max((NOT regexp_matches(h, '[^0]'))::INT) AS zero FROM cv GROUP BY label, col),
sz AS (SELECT label, count(DISTINCT msg_id) AS size FROM al GROUP BY label), gp AS (SELECT label, col, count(*) FILTER (h IS NULL) AS gaps FROM al GROUP BY label, col),
pre AS (SELECT label, col, counts, size, floor(ln(size)) AS t, list_transform(range(1, len(counts)), lambda i: counts[i + 1] - counts[i]) AS steps FROM cs JOIN sz USING (label) JOIN gp USING (label, col) WHERE len(counts) > 1 AND len(counts) <= floor(ln(size)) AND gaps <= floor(ln(size)) AND zero = 0 AND long <= {long})"""
_ONE = _CV.format(long=6) + ", pv AS (SELECT label, col FROM pre WHERE counts[1] > t)"
_TWO = _CV.format(long=3) + """, st AS (SELECT *, list_position(steps, list_max(steps)) AS cut FROM pre),
pv AS (SELECT label, col FROM st WHERE counts[1] > t OR (len(counts) - cut > 1 AND list_sum(counts[1:cut]) / list_sum(counts[cut + 1:]) < 0.1 AND list_avg(counts[cut + 1:]) > 2 * size / ln(size)))"""
_FEW = " SELECT label, col FROM pv WHERE label IN (SELECT label FROM pv GROUP BY label HAVING count(*) <= 2)"
_TX = QC._TEXT
_EV = Q._B.replace("WITH m", "WITH m")
_MATCH = Q.OTHERS["val07_format_match"][1]
_RUNS = """WITH n AS (SELECT doc_id % 3 AS run, source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL),
x AS (SELECT run, source, max({'n': n, 'lang': lang}) AS m, sum(n) AS size FROM n GROUP BY run, source), c AS (SELECT run, CASE WHEN size < 5 THEN 'NOISE' ELSE source END AS label, m.lang AS type, m.n / size AS precision, size / 100 AS recall FROM x)"""
_T4 = Q._C + """, f AS (SELECT msg_id, "offset" AS o, h FROM c), ms AS (SELECT msg_id, h, length(h) // 2 AS n FROM m), bd AS (SELECT f.msg_id, o, n, substr(ms.h, (2 * o - 1)::INT, 4) AS across, substr(ms.h, (2 * o - 3)::INT, 4) AS before, substr(ms.h, (2 * o + 1)::INT, 4) AS after FROM f JOIN ms USING (msg_id) WHERE o >= 2 AND o + 2 <= n),
pf AS (SELECT g, count(*) AS k FROM (SELECT unnest([across, before, after]) AS g FROM bd) GROUP BY g),
sh AS (SELECT msg_id, o, CASE WHEN a.k <= b.k AND a.k <= z.k THEN 0 WHEN b.k <= z.k THEN -1 ELSE 1 END AS s FROM bd JOIN pf a ON a.g = across JOIN pf b ON b.g = before JOIN pf z ON z.g = after),
nb AS (SELECT DISTINCT f.msg_id, (f.o + coalesce(s, 0))::INT AS o FROM f LEFT JOIN sh USING (msg_id, o)), ne AS (SELECT nb.msg_id, o, coalesce(lead(o) OVER (PARTITION BY nb.msg_id ORDER BY o), n)::INT AS z, ms.h, n, row_number() OVER (PARTITION BY nb.msg_id ORDER BY o) - 1 AS k FROM nb JOIN ms USING (msg_id) WHERE o < n)
SELECT msg_id, k::INT AS seg_no, o AS "offset", z - o AS length, substr(h, 2 * o + 1, 2 * (z - o)) AS h FROM ne"""

QUERIES = {
    "src03_in_memory": (src03_in_memory, _S + " SELECT msg_id, array_to_string(f, '') AS hex FROM pk"),
    "src04_base_layer": (src04_base_layer, _S + " SELECT msg_id, CASE nation % 4 WHEN 0 THEN 'ethernet' WHEN 1 THEN 'raw_ip' WHEN 2 THEN 'radiotap' ELSE 'undecoded' END AS layer, CASE nation % 4 WHEN 0 THEN 1 WHEN 1 THEN 101 WHEN 2 THEN 127 ELSE -1 END AS link FROM pk"),
    "src08_parse": (src08_parse, _S + " SELECT msg_id, pos + 1 AS pos, label AS name, hex FROM t UNION ALL SELECT msg_id, 0, 'frame.len', '000c' FROM pk"),
    "src09_beside": (src09_beside, _S + " SELECT msg_id, msg_id % 3 <> 0 AS known FROM pk"),
    "src10_fields": (_dissected, _S + " SELECT msg_id, pos, label AS name, hex FROM t"),
    "src11_tree_walk": (src11_tree_walk, _S + " SELECT msg_id, CASE WHEN pos > 1 THEN pos - 1 ELSE pos END::INT AS pos, label AS name, hex FROM t WHERE pos <> 1"),
    "src12_rest": (src12_rest, _S + " SELECT msg_id, pos, CASE WHEN pos < 5 THEN label WHEN hex = '00' THEN 'pad' ELSE 'data' END AS name, hex FROM t"),
    "src13_by_name": (src13_by_name, _S + " SELECT msg_id, f[4] || ',' || f[5] AS hexes FROM pk"),
    "src14_sequence": (src14_sequence, _S + " SELECT msg_id, string_agg(label, ',' ORDER BY pos) AS names, string_agg(hex, ',' ORDER BY pos) AS hexes, string_agg(len::VARCHAR, ',' ORDER BY pos) AS lengths FROM ft GROUP BY msg_id"),
    "src15_types": (src15_types, _S + " SELECT msg_id, pos, label AS name, len, CASE pos WHEN 0 THEN 'id' WHEN 1 THEN 'pad' WHEN 2 THEN 'enum' WHEN 5 THEN NULL ELSE 'option' END AS type FROM ft"),
    "src16_values_of_types": (src16_values_of_types, _S + ", y AS (SELECT DISTINCT CASE pos WHEN 0 THEN 'id' WHEN 1 THEN 'pad' WHEN 2 THEN 'enum' ELSE 'option' END AS type, hex FROM t WHERE pos < 5) SELECT type, string_agg(hex, ',' ORDER BY hex) AS hexes FROM y GROUP BY type"),
    "src17_untyped": (src17_untyped, "SELECT 'sup.check' AS name, count(*) AS n FROM supplier"),
    "src18_message_types": (src18_message_types, _S + " SELECT msg_id, concat_ws(':', CASE nation & 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END, CASE WHEN f[1] = '0001' THEN 'first' END, CASE WHEN msg_id % 2 = 1 THEN 'odd' END) AS message_type FROM pk WHERE nation & 3 < 2 OR msg_id % 2 = 1"),
    "src19_registry": (src19_registry, "SELECT * FROM (VALUES ('a.x', '[1, 2, 3]'), ('a.y', '5'), ('a.z', '2'), ('b', '4')) v(key, value)"),
    "src21_type_table": (src21_type_table, "SELECT * FROM (VALUES ('f', 'new'), ('g', 'own'), ('h', 'any')) v(name, type)"),
    "fea29_registry": (fea29_registry, Q._B + f", s AS (SELECT msg_id, v, {Q._BC} AS bc, {Q._delta('v')} AS d FROM b) SELECT msg_id, 'bc' AS feature, unnest(range(len(bc)))::INT AS pos, round(unnest(bc)::DOUBLE, 6) AS value FROM s UNION ALL SELECT msg_id, 'variance', unnest(range(len(d)))::INT, unnest(d)::DOUBLE FROM s UNION ALL SELECT msg_id, 'value', unnest(range(len(v)))::INT, unnest(v)::DOUBLE FROM s"),
    "fea32_token_delta": (Q._series(lambda: S.delta(S.nibbles(Q._v())), True), Q._series_sql("flatten(list_transform(v, lambda y: [y // 16, y % 16]))", Q._delta("x0"), whole=True)),
    "fea36_undefined": (Q._series(lambda: S.undefined_borders(F.transform(Q._v(), lambda x: F.when(x >= 60, x))), True), Q._series_sql("list_filter(range(1, len(v)), lambda i: (v[i] >= 60) <> (v[i + 1] >= 60))", whole=True)),
    "fea41_measures": (fea41_measures, Q._B + """, s AS (SELECT msg_id, list_transform(range(1, len(v) - 1), lambda i: [v[i], v[i + 1], v[i + 2]]) AS w FROM b),
z AS (SELECT msg_id, list_transform(w, lambda x: 1 - (34 * x[1] + 58 * x[2] + 32 * x[3]) / sqrt((34 * 34 + 58 * 58 + 32 * 32)::DOUBLE * (x[1] * x[1] + x[2] * x[2] + x[3] * x[3]))) AS c,
list_transform(w, lambda x: (3 * (34 * x[1] + 58 * x[2] + 32 * x[3]) - 124 * (x[1] + x[2] + x[3])) / sqrt(((3 * 5544 - 124 * 124)::DOUBLE) * nullif(3 * (x[1] * x[1] + x[2] * x[2] + x[3] * x[3]) - (x[1] + x[2] + x[3]) * (x[1] + x[2] + x[3]), 0))) AS p FROM s)
SELECT msg_id, round(list_min(c), 6) AS cosine, round(list_max(p), 6) AS pearson FROM z"""),
    "fea42_absolute_difference": (fea42_absolute_difference, Q._B + " SELECT msg_id, list_sum(list_transform(range(1, len(v) // 2 + 1), lambda i: abs(v[i] - v[i + len(v) // 2])))::DOUBLE AS sad FROM b"),
    "fea43_gaussian_filter": (Q._series(lambda: S.gaussian(Q._v(), 1.0)), Q._series_sql(Q._gauss("v", 1.0))),
    "fea45_printable": (fea45_printable, _S + ", v AS (SELECT msg_id, pos, list_transform(range(0, len), lambda i: ('0x' || substr(hex, (2 * i + 1)::INT, 2))::INT) AS v FROM ft) SELECT msg_id, pos AS seg_no, len(list_filter(v, lambda y: y < 32 OR y > 126)) = 0 AS printable, list_min(list_filter(range(0, len(v)), lambda i: v[i + 1] < 32 OR v[i + 1] > 126))::INT AS first FROM v"),
    "fea48_lower_triangle": (fea48_lower_triangle, _PD + " SELECT j AS i, i AS j, d FROM dd"),
    "seg14_from_cells": (seg14_from_cells, _S + ", x AS (SELECT msg_id, pos, hex, len FROM ft WHERE hex <> '0000') SELECT msg_id, (row_number() OVER w - 1)::INT AS seg_no, (sum(len) OVER w - len)::INT AS \"offset\", len AS length, upper(hex) AS h FROM x WINDOW w AS (PARTITION BY msg_id ORDER BY pos)"),
    "seg15_convert": (seg15_convert, Q._B + f", s AS (SELECT msg_id, len(v) AS n, {Q._delta('v')} AS d FROM b), o AS (SELECT msg_id, d, unnest(range(0, n, 4)) AS o FROM s) SELECT msg_id, (o // 4)::INT AS seg_no, array_to_string(d[o + 1:o + 4], ',') AS values FROM o"),
    "ref01_merge_like": (ref01_merge_like, """WITH m AS (SELECT event_id::BIGINT AS msg_id, hex(encode(props)) AS h FROM events), o AS (SELECT msg_id, h, unnest(range(0, length(h) // 2, 2)) AS o FROM m), c AS (SELECT msg_id, (o // 2)::INT AS seg_no, o::INT AS "offset", least(2, length(h) // 2 - o)::INT AS length, substr(h, (2 * o + 1)::INT, 4) AS h FROM o),
u AS (SELECT *, CASE WHEN substr(h, 1, 1) = substr(lag(h) OVER w, 1, 1) THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY msg_id ORDER BY seg_no)), r AS (SELECT *, sum(new) OVER (PARTITION BY msg_id ORDER BY seg_no) AS run FROM u)
SELECT msg_id, (run - 1)::INT AS seg_no, min("offset") AS "offset", sum(length)::INT AS length, string_agg(h, '' ORDER BY seg_no) AS h FROM r GROUP BY msg_id, run"""),
    "ref07_rarest_pair": (ref07_rarest_pair, _T4),
    "ref26_apply_bounds": (ref26_apply_bounds, _S + """, sz AS (SELECT msg_id, max(e) AS size FROM ft GROUP BY msg_id), nw AS (SELECT msg_id, e AS b FROM ft JOIN sz USING (msg_id) WHERE e < size),
ol AS (SELECT msg_id, unnest(range(0, size, 4)) AS b FROM sz), kp AS (SELECT msg_id, b FROM ol WHERE b = 0 OR NOT EXISTS (SELECT 1 FROM nw WHERE nw.msg_id = ol.msg_id AND abs(nw.b - ol.b) = 1) UNION SELECT msg_id, b FROM nw),
q AS (SELECT k.msg_id, b, coalesce(lead(b) OVER w, size) AS z, array_to_string(f, '') AS whole, row_number() OVER w - 1 AS k FROM kp k JOIN sz USING (msg_id) JOIN pk USING (msg_id) WINDOW w AS (PARTITION BY k.msg_id ORDER BY b))
SELECT msg_id, k::INT AS seg_no, b::INT AS "offset", (z - b)::INT AS length, upper(substr(whole, (2 * b + 1)::INT, (2 * (z - b))::INT)) AS h FROM q"""),
    "dis02_value_matrix": (dis02_value_matrix, _VALS + ", k AS (SELECT max(len(v)) AS k FROM vals), c AS (SELECT id, v, unnest(range(0, k))::INT AS col FROM vals, k) SELECT id, col, v[col + 1] AS value FROM c"),
    "dis03_methods": (dis03_methods, _VALS + """, p AS (SELECT x.id AS i, y.id AS j, x.v AS a, y.v AS b FROM vals x JOIN vals y ON len(x.v) = len(y.v) AND x.id < y.id),
z AS (SELECT i, j, list_sum(list_transform(range(1, len(a) + 1), lambda k: CASE WHEN a[k] = 0 AND b[k] = 0 THEN 0.0 ELSE abs(a[k] - b[k]) / (a[k] + b[k])::DOUBLE END)) AS canberra, list_sum(list_transform(range(1, len(a) + 1), lambda k: (a[k] - b[k]) * (a[k] - b[k])))::DOUBLE AS q,
list_sum(list_transform(range(1, len(a) + 1), lambda k: a[k] * b[k]))::DOUBLE AS ab, list_sum(list_transform(a, lambda x: x * x))::DOUBLE AS aa, list_sum(list_transform(b, lambda x: x * x))::DOUBLE AS bb FROM p)
SELECT i, j, round(canberra, 6) AS canberra, round(sqrt(q), 6) AS euclidean, q AS sqeuclidean, CASE WHEN aa = 0 OR bb = 0 THEN 1.0 ELSE abs(round(1 - ab / sqrt(aa * bb), 6)) END AS cosine FROM z"""),
    "dis04_embedding": (dis04_embedding, _VALS + """, p AS (SELECT x.id AS i, y.id AS j, x.v AS s, y.v AS l FROM vals x JOIN vals y ON len(x.v) < len(y.v) WHERE x.id % 10 >= 2 AND y.id % 10 >= 2),
z AS (SELECT i, j, list_transform(range(0, least(6, len(l) - len(s)) + 1), lambda o: list_sum(list_transform(range(1, len(s) + 1), lambda k: CASE WHEN s[k] = 0 AND l[o + k] = 0 THEN 0.0 ELSE abs(s[k] - l[o + k]) / (s[k] + l[o + k])::DOUBLE END)) / len(s)) AS es FROM p)
SELECT i, j, round(list_min(es), 6) AS e, (list_position(es, list_min(es)) - 1)::INT AS shift FROM z"""),
    "dis05_mixed_lengths": (dis05_mixed_lengths, _PD + " SELECT i, j, d FROM dd"),
    "dis12_shifts": (dis12_shifts, _PD + " SELECT i, j, shift FROM dd WHERE shift > 0"),
    "dis17_subset": (dis17_subset, _VALS + " SELECT DISTINCT id AS rep_id, CASE WHEN pos < 2 THEN 'left' ELSE 'right' END AS side FROM t JOIN vals USING (hex) WHERE pos < 2 OR pos > 3"),
    "dis20_cached": (dis20_cached, _PD + " SELECT i, j, d FROM dd"),
    "tpl01_same_length": (tpl01_same_length, _VALS + " SELECT label, count(DISTINCT len(v)) = 1 AS same FROM lb GROUP BY label"),
    "tpl03_means": (tpl03_means, _VALS + ", x AS (SELECT label, unnest(range(len(v)))::INT AS pos, unnest(v) AS y FROM lb) SELECT label, pos, round(avg(y), 6) AS mean FROM x GROUP BY label, pos"),
    "tpl12_overlaps": (tpl12_overlaps, _S + " SELECT x.msg_id, (x.e - x.len)::INT AS a, (y.e - y.len)::INT AS b, (least(x.e + 1, y.e + 1) - (y.e - y.len))::INT AS shared FROM ft x JOIN ft y ON x.msg_id = y.msg_id AND x.pos < y.pos AND y.e - y.len < x.e + 1"),
    "tpl13_types": (tpl13_types, _S + " SELECT type, count(*) AS n, count(DISTINCT hex) AS values FROM t GROUP BY type"),
    "clu10_adjusted": (clu10_adjusted, _PD + " SELECT i, j, round(d * (16 * (d / 2) * (d / 2) - 10 * (d / 2) + 1.8::DOUBLE), 6) AS eps FROM dd"),
    "clu12_mean_growth": (clu12_mean_growth, _PD + ", k AS (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) - 1 AS rank FROM n), g AS (SELECT rank, avg(d) AS mean FROM k WHERE rank < 5 GROUP BY rank) SELECT rank::INT AS rank, round(mean + 1e-9, 5) AS mean, round(mean - lag(mean) OVER (ORDER BY rank) + 1e-9, 5) AS growth FROM g"),
    "clu14_nested": (clu14_nested, _VALS + f", x AS (SELECT id, CASE WHEN label = 5 THEN -1 ELSE label END AS label, coalesce({_TX}, false) AS text, v FROM lb), z AS (SELECT *, count(*) OVER (PARTITION BY label) AS size FROM x) SELECT CASE WHEN text THEN 'text' WHEN label = -1 THEN 'noise' WHEN size = 1 THEN 'singular' ELSE 'cluster' END AS part, label, CASE WHEN id % 10 = 3 THEN '[unknown]' ELSE ['id', 'pad', 'enum', 'int', 'chars', 'checksum'][(id % 10 + 1)::INT] END AS type, id FROM z"),
    "sem02_cauldron": (_on(lambda v: SM.cauldron(_noisy(v), v)), _VALS + ", x AS (SELECT id, CASE WHEN label = 5 THEN -1 ELSE label END::INT AS label FROM lb), z AS (SELECT *, count(*) OVER (PARTITION BY label) AS size FROM x) SELECT CASE WHEN label = -1 THEN 'noise' WHEN size > 3 THEN 'regular' ELSE 'singular' END AS kind, label, id FROM z"),
    "sem03_singular": (_on(lambda v: SM.singular_from_noise(_noisy(v), v)), _VALS + " SELECT id, CASE WHEN label < 5 THEN label WHEN n > ln((SELECT sum(n) FROM vals)) THEN -2 - id ELSE -1 END::BIGINT AS label FROM lb"),
    "sem04_text": (_on(lambda v: SM.append_text(labels(v).where("label <> 4"), v, 77)), _VALS + f" SELECT id, label FROM lb WHERE label <> 4 UNION ALL SELECT id, 77 FROM lb WHERE label = 4 AND {_TX}"),
    "sem05_unique": (sem05_unique, _S + ", x AS (SELECT hex, min(pos) FILTER (pos < 5) AS a, max(pos) FILTER (pos < 5) AS z FROM t GROUP BY hex) SELECT upper(hex) AS h, CASE WHEN a IS NULL THEN '[unknown]' WHEN a = z THEN a::VARCHAR ELSE '[mixed]' END AS name FROM x"),
    "sem15_lengths": (_on(_lengths), _VALS + f", x AS (SELECT label, len(v) AS k, coalesce({_TX}, false) AS text FROM lb), l AS (SELECT label, string_agg(k::VARCHAR, ' ' ORDER BY k) AS lengths FROM (SELECT DISTINCT label, k FROM x) GROUP BY label) SELECT label, lengths, sum(text::INT)::BIGINT AS text, count(*) AS members FROM x JOIN l USING (label) GROUP BY label, lengths"),
    "sem19_skewness": (_on(_skew), _VALS + ", m AS (SELECT label, n AS mode FROM (SELECT label, n, count(*) AS k FROM lb GROUP BY label, n) QUALIFY row_number() OVER (PARTITION BY label ORDER BY k DESC, n) = 1) SELECT label, round((mode - median(n)) / nullif(stddev_pop(n), 0), 6) AS skew, round(quantile_cont(n, 0.9), 6) AS percentile FROM lb JOIN m USING (label) GROUP BY label, mode"),
    "sem23_statistics": (_on(_links), _PD + " SELECT least(a.label, b.label) AS p, greatest(a.label, b.label) AS q, min(d) AS least, max(d) AS most, round(avg(d) + 1e-9, 5) AS mean, round(median(d) + 1e-9, 5) AS median, round(stddev_pop(d) + 1e-9, 5) AS deviation FROM dd JOIN lb a ON a.id = i JOIN lb b ON b.id = j WHERE a.label <> b.label GROUP BY 1, 2"),
    "aln01_score_domain": (aln01_score_domain, _PD + " SELECT i, j, round((1 - d) * 6 - 1, 6) AS score FROM dd"),
    "aln06_distance": (aln06_distance, _S + ", k AS (SELECT msg_id, sum(len) AS k FROM ft WHERE hex <> '0000' GROUP BY msg_id) SELECT x.msg_id AS i, y.msg_id AS j, round(100 - 100 * (least(x.k, y.k) - abs(x.k - y.k) + least(x.k, y.k)) / (2 * least(x.k, y.k)), 6) AS distance FROM k x JOIN k y ON y.msg_id = x.msg_id + 1"),
    "aln11_pivots": (aln11_pivots, _ONE + _FEW),
    "aln12_pivots_relaxed": (aln12_pivots_relaxed, _TWO + _FEW),
    "aln12_split": (aln12_split, _TWO + ", fw AS (" + _FEW + "), k AS (SELECT label, msg_id, string_agg(coalesce(upper(h), '-'), ',' ORDER BY col) AS key FROM al JOIN fw USING (label, col) GROUP BY label, msg_id), d AS (SELECT label, key, row_number() OVER (PARTITION BY label ORDER BY key) - 1 AS part FROM (SELECT DISTINCT label, key FROM k)) SELECT c.msg_id, c.label, part::INT AS part FROM c LEFT JOIN k ON k.msg_id = c.msg_id AND k.label = c.label LEFT JOIN d ON d.label = k.label AND d.key = k.key"),
    "aln20_missed": (aln20_missed, "WITH n AS (SELECT c_nationkey % 7 AS label, 't' || (c_nationkey % 3) AS type, count(*) AS n FROM customer GROUP BY ALL), m AS (SELECT label, type FROM n QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, type) = 1) SELECT type, string_agg(label::VARCHAR, ',' ORDER BY label::VARCHAR) AS clusters FROM m GROUP BY type HAVING count(*) > 1"),
    "aln22_discriminators": (aln22_discriminators, _AL + ", k AS (SELECT msg_id, upper(h) AS label FROM al WHERE col = 1), s AS (SELECT k.label, col, min(h) AS h FROM al JOIN k USING (msg_id) GROUP BY k.label, col HAVING count(DISTINCT h) = 1 AND count(*) = count(h)) SELECT label, col, upper(h) AS h FROM s WHERE col IN (SELECT col FROM s GROUP BY col HAVING count(DISTINCT h) > 1)"),
    "aln23_without_gaps": (aln23_without_gaps, _AL + " SELECT label, msg_id, string_agg(upper(h), ' ' ORDER BY col) AS values FROM al WHERE h IS NOT NULL GROUP BY label, msg_id"),
    "aln23_to_first": (aln23_to_first, _AL + ", f AS (SELECT label, msg_id, col, ('0x' || h)::INT AS x, first_value(('0x' || h)::INT) OVER (PARTITION BY label ORDER BY msg_id) AS y FROM al WHERE col = 1) SELECT label, col, msg_id, round(abs(x - y) / (x + y)::DOUBLE, 6) AS d FROM f"),
    "seq02_support": (seq02_support, _S + ", n AS (SELECT hex, count(*) AS n FROM t GROUP BY hex) SELECT quantile_cont(n, 0.8)::DOUBLE AS support FROM n"),
    "val03_exact": (val03_exact, _INF + ' SELECT ft.msg_id, e AS "end" FROM ft JOIN sz USING (msg_id) JOIN i3 ON i3.msg_id = ft.msg_id AND x = e WHERE e < size'),
    "val04_scopes": (val04_scopes, _SC + ' SELECT msg_id, "end", low::BIGINT AS low, high::BIGINT AS high FROM scp'),
    "val05_near": (val05_near, _SC + ' SELECT msg_id, "end", inferred FROM ins QUALIFY row_number() OVER (PARTITION BY msg_id, "end" ORDER BY abs(off), inferred) = 1'),
    "val06_in_scope": (val06_in_scope, _SC + ' SELECT msg_id, "end", inferred, off FROM ins'),
    "val08_by_step": (val08_by_step, f"SELECT 3 AS step, msg_id, exact_count, near_count, score FROM ({_MATCH}) UNION ALL SELECT 2, msg_id, exact_count, near_count, score FROM ({_MATCH.replace('range(3, size, 3)', 'range(2, size, 2)')})"),
    "val10_typed": (val10_typed, _S + ' SELECT msg_id, (e - len)::INT AS "offset", upper(hex) AS h, name, type, 1.0::DOUBLE AS ratio FROM ft'),
    "val11_types_of_values": (val11_types_of_values, _S + ", g AS (SELECT upper(hex) AS h, count(*) AS n, min(type) AS a, max(type) AS z FROM t GROUP BY 1) SELECT h, n, CASE WHEN a = z THEN a ELSE '[unknown]' END AS type, CASE WHEN a = z THEN 1.0 ELSE 0.0 END::DOUBLE AS ratio FROM g"),
    "val17_format_examples": (val17_format_examples, _S + ", x AS (SELECT msg_id, string_agg(len::VARCHAR, ',' ORDER BY pos) AS format FROM ft GROUP BY msg_id) SELECT format, min(msg_id) AS msg_id FROM x GROUP BY format"),
    "val17_bits": (val17_bits, _S + " SELECT msg_id, pos::INT AS pos, len::BIGINT AS len FROM ft"),
    "val18_run_scores": (val18_run_scores, _RUNS + ", l AS (SELECT run, min(precision) AS least FROM c WHERE label <> 'NOISE' GROUP BY run) SELECT run, round(least, 6) AS least, CASE WHEN label = 'NOISE' THEN 'NOISE' ELSE split_part(type, ':', 1) END AS type, round(sum(recall), 6) AS recall FROM c LEFT JOIN l USING (run) GROUP BY ALL"),
    "val20_few_labels": (val20_few_labels, _IN + ", m AS (SELECT label, max(d) AS most FROM w GROUP BY label), x AS (SELECT id, CASE WHEN coalesce(most, 0) = 0 THEN 'one without extent' ELSE label::VARCHAR END AS name FROM lb LEFT JOIN m USING (label)), k AS (SELECT name, row_number() OVER (ORDER BY count(*) DESC, name) AS r FROM x GROUP BY name) SELECT id, CASE WHEN r <= 2 THEN name ELSE 'one of the smallest' END AS name FROM x JOIN k USING (name)"),
    "val21_members": (val21_members, _VALS + ', f AS (SELECT msg_id, (sum(length(hex) // 2) OVER (PARTITION BY msg_id ORDER BY pos) - length(hex) // 2)::INT AS "offset", hex FROM t) SELECT label, msg_id, "offset" FROM f JOIN lb USING (hex) WHERE n > 1'),
    "snk02_segments": (snk02_segments, _S + " SELECT msg_id::VARCHAR AS msg_id, string_agg(hex, ' ' ORDER BY pos) AS segments FROM t GROUP BY msg_id"),
    "snk03_elements": (snk03_elements, _VALS + " SELECT label::VARCHAR AS cluster, hex, n::VARCHAR AS occurrence FROM lb"),
    "snk05_alignment": (snk05_alignment, _AL + " SELECT label, msg_id::VARCHAR AS msg_id, string_agg(coalesce(h, '-'), ' ' ORDER BY col) AS fields FROM al GROUP BY label, msg_id"),
    "snk09_steps": (snk09_steps, _AL + """, cv AS (SELECT label, col, h, count(*) AS n FROM al WHERE h IS NOT NULL AND col BETWEEN 1 AND 4 GROUP BY ALL), cs AS (SELECT label, col, list_sort(list(n)) AS k FROM cv GROUP BY label, col HAVING count(*) > 1),
s AS (SELECT *, list_transform(range(1, len(k)), lambda i: k[i + 1] - k[i]) AS d FROM cs), p AS (SELECT *, list_position(d, list_max(d))::INT AS step FROM s)
SELECT label, col, len(k)::INT AS values, step, list_sum(k[1:step])::BIGINT AS low, list_sum(k[step + 1:])::BIGINT AS high, round(list_sum(k[1:step]) / step, 6) AS mean_low, round(list_sum(k[step + 1:]) / (len(k) - step), 6) AS mean_high FROM p"""),
    "snk10_titles": (snk10_titles, "SELECT * FROM (VALUES (0, 'congruence-sigma=0.600-refinement=original'), (1, 'congruence-sigma=1.200'), (2, 'congruence-refinement=base')) v(k, title)"),
    "vis01_subsample": (vis01_subsample, "WITH n AS (SELECT count(*) // 40 AS k FROM customer), r AS (SELECT c_custkey AS id, c_mktsegment AS label, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS r FROM customer) SELECT id, label FROM r, n WHERE r % k = 0"),
    "vis05_deviations": (vis05_deviations, _SC + ", o AS (SELECT off FROM ins UNION ALL SELECT 0 FROM ft JOIN sz USING (msg_id) JOIN i3 ON i3.msg_id = ft.msg_id AND x = e WHERE e < size) SELECT off, count(*) AS n FROM o GROUP BY off"),
    "vis06_ends": (vis06_ends, _S + ' SELECT e AS "end", count(*) AS n FROM ft GROUP BY e'),
    "vis08_printed": (vis08_printed, _S + " SELECT msg_id, string_agg(hex, ' ' ORDER BY pos) AS text FROM t GROUP BY msg_id"),
    "vis09_side_by_side": (vis09_side_by_side, _INF + " SELECT coalesce(ft.msg_id, i3.msg_id) AS msg_id, e AS x, i3.x AS y FROM ft FULL OUTER JOIN i3 ON i3.msg_id = ft.msg_id AND i3.x = e"),
    "vis13_separation": (vis13_separation, _PD + " SELECT a.label = b.label AS match, least(floor(d * 20), 19)::INT AS bin, count(*) AS n FROM dd JOIN lb a ON a.id = i JOIN lb b ON b.id = j GROUP BY 1, 2"),
    # no SQL: sequential, iterative or numerical
    "ref04_frequency_rise": (ref04_frequency_rise, None),
    "ref05_widen": (ref05_widen, None),
    "ref06_widen_text": (ref06_widen_text, None),
    "ref10_gather_text": (ref10_gather_text, None),
    "ref13_zero_slices": (ref13_zero_slices, None),
    "ref14_crop_text": (ref14_crop_text, None),
    "ref16_principal": (ref16_principal, None),
    "tpl04_templates": (tpl04_templates, None),
    "tpl05_context": (tpl05_context, None),
    "tpl06_confidence": (tpl06_confidence, None),
    "tpl08_recognise": (tpl08_recognise, None),
    "tpl09_text": (tpl09_text, None),
    "tpl11_recognised": (tpl11_recognised, None),
    "clu05_parameters": (clu05_parameters, None),
    "clu06_sharpest": (clu06_sharpest, None),
    "clu08_curvature": (clu08_curvature, None),
    "clu09_rule_of_thumb": (clu09_rule_of_thumb, None),
    "clu11_no_large_cluster": (clu11_no_large_cluster, None),
    "sem01_names": (_of(SM.names), None),
    "sem07_export": (sem07_export, None),
    "sem09_merge_on_density": (_on(_merged), None),
    "sem14_walk": (_of(lambda d, lab, v: SM.walks(d, lab)), None),
    "sem17_shapes": (_of(lambda d, lab, v: SM.shapes(d, lab)), None),
    "sem18_hypotheses": (_on(_hypotheses), None),
    "sem20_eigenvalues": (_on(_eigen), None),
    "sem22_shape_report": (_of(lambda d, lab, v: SM.shape_report(d, lab, v).select("label", "members", F.round("most", 6).alias("most"), "total", F.round("zeros", 6).alias("zeros"), "chaotic")), None),
    "aln02_last_line": (aln02_last_line, None),
    "aln03_alignment": (aln03_alignment, None),
    "aln04_divided": (aln04_divided, None),
    "aln08_parameters": (aln08_parameters, None),
    "aln10_message_types": (aln10_message_types, None),
    "aln14_matches": (aln14_matches, None),
    "aln18_merge": (aln18_merge, None),
    "aln19_cluster_distances": (aln19_cluster_distances, None),
    "seq03_most_frequent": (seq03_most_frequent, None),
    "val09_overlaps": (val09_overlaps, None),
    "snk01_scores": (snk01_scores, None),
    "snk04_hypotheses": (snk04_hypotheses, None),
    "snk06_stages": (snk06_stages, None),
    "snk07_metadata": (snk07_metadata, None),
    "vis02_layout": (vis02_layout, None),
    **{f"pip{k:02d}_{name}": (_plan(name), None) for k, name in enumerate(pipelines.PRINCIPAL, 6)},
}
