"""Named compositions: from messages to segments, and from segments to field types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlore.operators import alignment, knees, merging, pairwise, principal, segmentation
from fieldlore.operators.lineage import once

#: name: function of (messages, sigma)
SEGMENTERS = {
    "congruence": lambda d, sigma: segmentation.congruence(d, sigma),
    "congruence_le": lambda d, sigma: segmentation.congruence(d, sigma, little_endian=True),
    "original": lambda d, sigma: segmentation.congruence(d, sigma, refined=True),
    "base": lambda d, sigma: base(d, sigma),
    "first_bytes": lambda d, sigma: segmentation.split_segment(base(d, sigma)),
    "char": lambda d, sigma: segmentation.refined(d, ["text", "pull", "gather"], sigma),
    "zero": lambda d, sigma: base(d, sigma, ["zeros"]),
    "zeros": lambda d, sigma: segmentation.zeros(d),
    "minima": lambda d, sigma: segmentation.minima(d, sigma),
    "whole": lambda d, sigma: segmentation.whole(d),
    "4bytesfixed": lambda d, sigma: segmentation.fixed(d, 4),
}


def base(messages: DataFrame, sigma: float = 0.6, before: list[str] | None = None) -> DataFrame:
    """Text merged and pulled, common values cut out, and text gathered. Messages are segmented once; the segments are a checkpoint."""
    s = once(segmentation.refined(messages, [*(before or []), "text", "pull"], sigma))
    return segmentation.again(segmentation.crop_common(s, messages), ["gather"])


CHAR = ["text", "pull", "gather"]


def composed(messages: DataFrame, sigma: float, first: list[str], *then) -> DataFrame:
    """Segments after first, and each step in then: a list of steps on masks and segments, "pca", "common" (values cut out) or "first" (a message's small first bytes)."""
    s = once(segmentation.refined(messages, first, sigma))
    for step in then:
        if step == "pca":
            s = principal.refine(s, messages)
        elif step == "common":
            s = once(segmentation.crop_common(s, messages))
        elif step == "first":
            s = once(principal.split_small_first(s))
        else:
            s = once(segmentation.again(s, step))
    return s


#: What follows the bit-congruence segmentation, by name of the pipeline.
PRINCIPAL = {
    "zeroPCA": (["zeros", "text", "pull"], "common", ["gather"], CHAR, "pca", CHAR),
    "PCA1": (CHAR, "pca", CHAR),
    "PCA": ([], "pca", "pca", CHAR),
    "PCAmoco": ([], "pca", "pca", "common", CHAR),
    "PCAmocoDoubleChar": (CHAR, "pca", "pca", "common", CHAR),
    "zerocharPCAmoco": (["zeros", "crop_fields"], "pca", "pca", "common"),
    "PCAmocoSF": ([], "pca", "common", "first"),
    "zerocharPCAmocoSF": (["zeros", "crop_fields"], "pca", "common", "first"),
    "emzcPCAmocoSF": (["random", "zeros", "crop_fields"], "pca", "common", "first"),
}
SEGMENTERS |= {name: lambda d, sigma, steps=steps: composed(d, sigma, *steps) for name, steps in PRINCIPAL.items()}


def segment(messages: DataFrame, method: str = "original", sigma: float = 0.6) -> DataFrame:
    return SEGMENTERS[method](messages, sigma)


def field_types(segments: DataFrame, eps: float, least: int) -> DataFrame:
    """(id, label): clusters of the distinct values of segments."""
    reps = pairwise.representatives(segments)
    return pairwise.dbscan(pairwise.distances(reps), reps.selectExpr("rep_id AS id"), eps, least)


def message_types(segments: DataFrame, tune: float = 0.8, least: int = 3, longest: int = 6) -> DataFrame:
    """(msg_id, label): messages (msg_id, seg_no, bytes) by type: clustered by alignment scores, aligned, split by fields with few values, merged where fields agree.

    The radius comes from the curvature of the distances, times tune. Noise is -1; parts of a cluster are named after it.
    """
    s = once(segments.select("msg_id", "seg_no", "bytes"))
    n = s.select("msg_id").distinct().count()
    ids = s.select(F.col("msg_id").alias("id")).distinct()
    if n > 8:
        # nearest others give the radius and most of the clusters; no table of pairs is made
        found = once(alignment.nearest_messages(s, max(knees.curves(n), least - 1)))
        eps = knees.by_curvature(knees.sorted_curves(found.select((F.col("rank") - 1).alias("rank"), "d")), n)[0] * tune
        labels = once(pairwise.joined(found, ids, eps, least, lambda x: alignment.message_links(s, x, eps)))
    else:
        d = alignment.message_distances(s, within=1.5).select("i", "j", F.col("distance").alias("d"))
        labels = once(pairwise.dbscan(d, ids, 1.5, least))
    centres = once(alignment.message_medoids(s, labels.where("label <> -1")))
    members = labels.withColumnRenamed("id", "msg_id")
    aligned = once(alignment.star_alignment(s, members, centres))
    parts = once(merging.split(aligned, merging.pivot_columns(aligned, longest)))
    name = F.when(F.col("part").isNull(), F.col("label").cast("string")).otherwise(F.concat_ws("s", F.col("label").cast("string"), F.col("part").cast("string")))
    named = once(parts.select("msg_id", name.alias("label")))
    columns = once(aligned.drop("label").join(named, "msg_id"))
    pairs = merging.merge_pairs(once(merging.matches(columns)), named.select("label").distinct().count())
    done = merging.merged(named, pairs)
    return done.union(labels.where("label = -1").select("id", F.lit("-1")))
