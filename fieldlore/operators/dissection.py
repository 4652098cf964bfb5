"""Dissected messages: from a dissector's JSON to flat fields, and lookups on them.

A dissector's JSON repeats keys, so that objects are read as lists of pairs. Values are in leaves whose key ends in _raw and whose
first element is the hex text; other leaves are only for people. Fields are (msg_id, pos, name, hex); a type table has (name, type).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Link types of captures by the layer that a frame begins with.
LINK_TYPES = {"ethernet": 1, "ipv4": 228, "raw_ip": 101, "ieee802_11": 105, "radiotap": 127, "loopback": 0}
FIELDS = "msg_id bigint, pos int, name string, hex string"


def base_layer(link: Column) -> Column:
    """The name of the layer of a link type, undecoded where it is none of LINK_TYPES."""
    out = F.lit("undecoded")
    for name, number in LINK_TYPES.items():
        out = F.when(link == number, name).otherwise(out)
    return out


def link_type(layer: Column) -> Column:
    """The link type of a layer, -1 for others."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LINK_TYPES.items() for x in kv))[layer], F.lit(-1))


def leaves(tree: list, ignore: frozenset[str] = frozenset(), exclude: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """(name, hex) of a tree of pairs, in order. Subtrees under a name of exclude are left out, fields of ignore are; hex of an odd length gets a zero in front."""
    out = []
    for name, value in tree:
        if name in exclude:
            continue
        if name.endswith("_raw"):
            text = value[0] if isinstance(value, list) and value and not isinstance(value[0], tuple) else value
            if isinstance(text, list):
                text = text[0] if text else ""
            if isinstance(text, str) and name[:-4] not in ignore:
                out.append((name[:-4], "0" * (len(text) % 2) + text.lower()))
        elif isinstance(value, list) and value and isinstance(value[0], tuple):
            out += leaves(value, ignore, exclude)
    return out


def pairs(text: str | None) -> list:
    """A JSON object as (key, value) pairs, repeated keys and all; nothing for null or what is no object."""
    if not text:
        return []
    try:
        tree = json.loads(text, object_pairs_hook=list)
    except ValueError:
        return []
    return tree if isinstance(tree, list) and all(isinstance(x, tuple) for x in tree) else []


def under(tree: list, layer: str | None) -> list:
    """The first subtree of that name, looked for from the top; all of the tree without a name."""
    if layer is None:
        return tree
    level = [tree]
    while level:
        below = []
        for t in level:
            for name, value in t:
                if isinstance(value, list) and value and isinstance(value[0], tuple):
                    if name == layer:
                        return value
                    below.append(value)
        level = below
    return []


def walk(df: DataFrame, column: str = "dissection", layer: str | None = None, ignore: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Fields of each message's (msg_id, dissection) JSON below a layer. Null, empty and broken texts have none; each task parses its own rows."""
    skip, out_of = frozenset(ignore), frozenset(exclude)

    def run(parts):
        for b in parts:
            rows = [(i, k, n, h) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, (n, h) in enumerate(leaves(under(pairs(t), layer), skip, out_of))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["msg_id", "pos", "name", "hex"])

    return df.select(F.col("msg_id").cast("bigint"), F.col(column).cast("string")).mapInArrow(run, FIELDS)


def beside(messages: DataFrame, packets: DataFrame) -> DataFrame:
    """Messages (msg_id, seq, ...) with the dissection (seq, dissection) of the same number, null where the dissector has none."""
    return messages.join(packets.select("seq", "dissection"), "seq", "left")


def with_rest(fields: DataFrame, messages: DataFrame) -> DataFrame:
    """Fields of each message's bytes (msg_id, h) in full: what the fields leave over at the end is one more, a pad if all zero, else data."""
    size = fields.groupBy("msg_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "hex"))), lambda s: s["hex"])).alias("done"), F.max("pos").alias("last"))
    m = messages.select("msg_id", F.lower("h").alias("h")).join(size, "msg_id", "left").fillna({"done": "", "last": -1})
    rest = F.substring("h", F.length("done") + 1, F.length("h"))
    extra = m.where(F.length("h") > F.length("done")).where(F.startswith("h", F.col("done"))).select("msg_id", (F.col("last") + 1).alias("pos"), F.when(rest.rlike("^0+$"), "pad").otherwise("data").alias("name"), rest.alias("hex"))
    return fields.select("msg_id", "pos", "name", "hex").union(extra)


def by_name(fields: DataFrame, name: str) -> DataFrame:
    """(msg_id, hexes): all values of a repeated name in each message, in order."""
    got = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hex"))), lambda s: s["hex"])
    return fields.where(F.col("name") == name).groupBy("msg_id").agg(got.alias("hexes"))


def sequence(fields: DataFrame) -> DataFrame:
    """(msg_id, names, hexes, lengths) of each message's fields in order."""
    s = F.array_sort(F.collect_list(F.struct("pos", "name", "hex")))
    f = fields.groupBy("msg_id").agg(s.alias("s"))
    return f.select("msg_id", F.col("s.name").alias("names"), F.col("s.hex").alias("hexes"), F.transform("s", lambda x: (F.length(x["hex"]) / 2).cast("int")).alias("lengths"))


def typed(fields: DataFrame, types: DataFrame) -> DataFrame:
    """Fields with type and len. A name that the type table lacks has a null type; untyped() says which."""
    return fields.join(types.select("name", "type"), "name", "left").select("msg_id", "pos", "name", "hex", (F.length("hex") / 2).cast("int").alias("len"), "type")


def untyped(fields: DataFrame, types: DataFrame) -> DataFrame:
    """(name, n): field names that the type table lacks."""
    return fields.join(types.select("name"), "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"))


def values_of_types(fields: DataFrame) -> DataFrame:
    """(type, hexes): the distinct values of each type, in order."""
    return fields.where("type IS NOT NULL").groupBy("type").agg(F.sort_array(F.collect_set("hex")).alias("hexes"))


def message_types(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """(msg_id, message_type) by rules (name, mask, hex, title, rank): the titles of the rules that a field fits, joined in their order.

    A rule fits a field of its name whose number, cut down to the mask's bits if there is a mask, is the rule's; messages without any have no row.
    """
    number = lambda c: F.conv(c, 16, 10).cast("bigint")
    x = fields.join(rules.withColumnRenamed("hex", "wanted"), "name")
    own = number(F.col("hex"))
    own = F.when(F.col("mask").isNotNull(), own.bitwiseAND(number(F.col("mask")))).otherwise(own)
    hit = x.where(own == number(F.col("wanted")))
    titles = F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos", "title"))), lambda s: s["title"])
    return hit.groupBy("msg_id").agg(F.concat_ws(":", titles).alias("message_type"))


def registry(*tables: dict) -> dict:
    """Nested tables as one: a later one adds to what an earlier one has, lists without repeats, other values replaced."""
    out: dict = {}
    for table in tables:
        for key, value in table.items():
            old = out.get(key)
            if isinstance(old, dict) and isinstance(value, dict):
                out[key] = registry(old, value)
            elif isinstance(old, list) and isinstance(value, list):
                out[key] = list(dict.fromkeys([*old, *value]))
            else:
                out[key] = value
    return out


def type_table(types: DataFrame, protocol: str | None = None, version: str | None = None) -> DataFrame:
    """(name, type) from a table (protocol, version, name, type): rows of a protocol and of the greatest version up to the given one; a null protocol or version fits all."""
    t = types
    if protocol is not None:
        t = t.where(F.col("protocol").isNull() | (F.col("protocol") == protocol))
    if version is not None:
        t = t.where(F.col("version").isNull() | (F.col("version") <= version))
    newest = Window.partitionBy("name").orderBy(F.col("version").desc_nulls_last(), F.col("protocol").desc_nulls_last(), "type")
    return t.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("name", "type")
