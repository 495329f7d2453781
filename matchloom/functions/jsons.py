"""JSON inside free text: the greedy outermost object or array, and documents under two spellings of their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two spellings of a tree's keys.
_TREE = "root string, `根节点` string, dimensions array<struct<name string, `维度` string, description string, `描述` string, entities array<string>, `实体` array<string>>>, `维度节点` array<struct<name string, `维度` string, description string, `描述` string, entities array<string>, `实体` array<string>>>"


def extracted(c: Column, kind: str = "{}") -> Column:
    """From the first opening to the last closing bracket, line breaks included; null without them."""
    return F.nullif(F.regexp_extract(c, rf"(?s)(\{kind[0]}.*\{kind[1]})", 1), F.lit(""))


def tree(c: Column, root: str) -> Column:
    """``root`` and ``dimensions`` (``name``, ``description``, ``entities``) of a text that holds a tree.

    Either spelling of a key is read, the first one first. Dimensions without a name are left out, missing
    descriptions are empty, missing entities none. Without a root the given one stands; without
    dimensions, or in text that is no JSON, they are null, for the caller's default.
    """
    x = F.from_json(F.coalesce(extracted(c), c), _TREE)
    dims = F.filter(F.coalesce(x["dimensions"], x["维度节点"]), lambda d: F.coalesce(d["name"], d["维度"]).isNotNull())
    own = F.transform(
        dims,
        lambda d: F.struct(
            F.coalesce(d["name"], d["维度"]).alias("name"), F.coalesce(d["description"], d["描述"], F.lit("")).alias("description"),
            F.coalesce(d["entities"], d["实体"], F.array().cast("array<string>")).alias("entities"),
        ),
    )
    return F.struct(F.coalesce(x["root"], x["根节点"], F.lit(root)).alias("root"), own.alias("dimensions"))


def lists(c: Column) -> Column:
    """A map of lists from a text that holds one object; an empty map in text that is no such JSON."""
    return F.coalesce(F.from_json(F.coalesce(extracted(c), c), "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>"))


def triples(c: Column) -> Column:
    """``subject``, ``relation``, ``object`` from a text that holds an array of triples, none where it is no such JSON.

    An object that is a list itself gives its first element, an empty one the empty text. Triples
    of another length are left out.
    """
    raw = F.from_json(F.coalesce(extracted(c, "[]"), c), "array<array<string>>")
    first = lambda o: F.when(o.startswith("["), F.coalesce(F.try_element_at(F.from_json(o, "array<string>"), F.lit(1)), F.lit(""))).otherwise(o)
    own = F.transform(F.filter(raw, lambda t: F.size(t) == 3), lambda t: F.struct(t[0].alias("subject"), t[1].alias("relation"), first(t[2]).alias("object")))
    return F.coalesce(own, F.array().cast("array<struct<subject:string,relation:string,object:string>>"))
