"""Resolution: competing claims of a property become one value, under a declared policy.

A value is a struct ``rank, bool, num, str, cbor``: primitives fill their lane; anything else is canonical bytes. Every policy is one aggregate over
``(root, prop)``, so that resolving is a single shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assertia.functions.body import python_value, target_value
from assertia.functions.canon import encode
from assertia.operators.claims import RANKS
from assertia.operators.predicates import lane_of, predicate, str_match
from assertia.operators.views import View

VALUE = "struct<rank:int,bool:boolean,num:double,str:string,cbor:binary>"

def _value(rank: Column, boolean: Column, num: Column, text: Column, cbor: Column) -> Column:
    types = dict(x.split(":") for x in VALUE[7:-1].split(","))
    return F.struct(*(c.cast(types[n]).alias(n) for n, c in zip(types, (rank, boolean, num, text, cbor), strict=True)))


def constant_value(x: Any) -> Column:
    lane = lane_of(x)
    return _value(F.lit(RANKS[lane]), *(F.lit(x) if lane == n else F.lit(None) for n in ("bool", "num", "str")), F.lit(None))


@F.pandas_udf(T.BinaryType())
def _complex(rest: pd.Series, nested: pd.Series) -> pd.Series:
    """Canonical bytes of a bytes leaf or of an object by role; null where a primitive lane serves."""
    out = []
    for pointers, children in zip(rest, nested, strict=True):
        if pointers is None:
            out.append(None)
            continue
        children = dict(children) if children is not None else {}
        found: dict[str, Any] = {}
        values = [(x["p"]["role"], target_value(x["p"], children.get(x["i"]))) for x in pointers]
        if len(values) == 1:
            out.append(encode(values[0][1]))
            continue
        for role, v in values:
            found[role] = v if role not in found else [*found[role], v] if isinstance(found[role], list) else [found[role], v]
        out.append(encode(found))
    return pd.Series(out, dtype=object)


def candidates(view: View, schema_for: Callable[[View, dict], DataFrame]) -> DataFrame:
    """``entries`` with ``value``: what each claim says of its root, without the pointers that file it."""
    df = view.entries
    if view.layout is not None and not view.expansions:
        others = [s for s in view.layout if s.kind != "e"]
        entities = [s for s in view.layout if s.kind == "e"]
        if len(entities) == 1 and len(others) == 1 and others[0].kind == "p":  # one filing pointer and one primitive
            s = others[0]
            said = _value(F.lit(RANKS[s.lane]), *(s.value() if s.lane == n else F.lit(None) for n in ("bool", "num", "str")), F.lit(None))
            bare = _value(F.lit(0), F.lit(True), F.lit(None), F.lit(None), F.lit(None))
            return df.withColumn("value", F.when(s.value().isNotNull(), said).otherwise(bare))
    df = with_nested(view, df, schema_for)
    rest = F.filter(F.transform("pointers", lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: ~((x["p"]["kind"] == "e") & (x["p"]["entity"] == F.col("root"))))
    df = df.withColumn("rest", rest)
    one = F.get("rest", F.lit(0))
    p = one["p"]
    child = F.col("nested")[one["i"]]
    hard = (F.size("rest") > 1) | ((F.size("rest") == 1) & child.isNull() & (p["kind"] == "y"))
    df = df.withColumn("__complex", _complex(F.when(hard, F.col("rest")), F.when(hard, F.col("nested"))))
    value = (
        F.when(F.size("rest") == 0, _value(F.lit(0), F.lit(True), F.lit(None), F.lit(None), F.lit(None)))
        .when(hard, _value(F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.col("__complex")))
        .when(child.isNotNull(), _value(F.lit(None), F.lit(None), F.lit(None), F.lit(None), child))
        .when(p["kind"] == "p", _value(p["rank"], p["bool"], p["num"], p["str"], F.lit(None)))
        .otherwise(_value(F.lit(2), F.lit(None), F.lit(None), F.coalesce(p["entity"], p["delta_ref"]), F.lit(None)))
    )
    return df.withColumn("value", value).drop("rest", "__complex", "nested")


def with_nested(view: View, df: DataFrame, child_bytes: Callable[[View, dict | None], DataFrame]) -> DataFrame:
    """Adds ``nested``, a map from pointer index to the canonical bytes of what the pointer expands to; the last matching expansion holds."""
    if not view.expansions:
        return df.withColumn("nested", F.lit(None).cast("map<int,binary>"))
    keys = ["root", "prop", "id"]
    flat = df.select(*keys, F.posexplode("pointers").alias("pos", "p")).where("p.kind = 'e'").select(*keys, "pos", "p.role", "p.entity")
    which = F.lit(None).cast("int")
    for k, e in enumerate(view.expansions):
        which = F.when(str_match(F.col("role"), e.role), F.lit(k)).otherwise(which)
    flat = flat.withColumn("k", which).where("k is not null")
    parts = None
    for k, e in enumerate(view.expansions):
        readings = [x.reading for x in view.expansions[: k + 1] if x.reading is not None]
        # an earlier reading serves where the role of a later expansion names none
        reading = e.reading if e.reading is not None else (readings[-1] if readings else None)
        got = flat.where(F.col("k") == k).join(child_bytes(e.child, reading).select(F.col("root").alias("entity"), F.col("bytes").alias("child")), "entity")
        parts = got if parts is None else parts.unionByName(got)
    maps = parts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", "child"))).alias("nested"))
    return df.join(maps, keys, "left")


def order_keys(order: Any) -> list[Column]:
    """Sort keys; ids settle what is left."""
    if order == "lexById":
        return [F.col("id")]
    [(tag, value)] = order.items()
    if tag == "byTimestamp":
        return [-F.col("timestamp") if value == "desc" else F.col("timestamp")]
    if tag == "byAuthorRank":
        rank = F.lit(len(value))
        for i in range(len(value) - 1, -1, -1):
            rank = F.when(F.col("author") == F.lit(value[i]), F.lit(i)).otherwise(rank)
        return [rank]
    if tag == "byPred":
        return [F.when(predicate(value["pred"]), 0).otherwise(1), *order_keys(value["then"])]
    return [k for o in value for k in order_keys(o)]


def _sort_key(order: Any, *rest: Column) -> Column:
    return F.struct(*(k.alias(f"k{i}") for i, k in enumerate([*order_keys(order), F.col("id")])), *rest)


def policy_column(policy: dict) -> tuple[Column, Column]:
    """Aggregates for a property's value and, for lists, its items; null stands for absent."""
    [(tag, body)] = policy.items()
    no_items, primitive = F.lit(None).cast(f"array<{VALUE}>"), F.col("value.rank").isNotNull()
    if tag == "pick":
        return F.min_by("value", _sort_key(body["order"])), no_items
    if tag in ("all", "conflicts"):
        items = F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), _sort_key(body["order"], F.col("value").alias("v"))))), lambda x: x["v"])
        if tag == "conflicts" or body.get("distinct"):
            items = F.array_distinct(items)
        return F.lit(None).cast(VALUE), F.when(F.size(items) >= (2 if tag == "conflicts" else 1), items)
    if tag == "absentAs":
        value, items = policy_column(body["then"])
        return F.when(items.isNull(), F.coalesce(value, constant_value(body["const"]))), items
    if body == "count":
        n = F.count("id")
        return F.when(n > 0, _value(F.lit(1), F.lit(None), n, F.lit(None), F.lit(None))), no_items
    if body in ("max", "min"):
        return (F.max if body == "max" else F.min)(F.when(primitive, F.col("value"))), no_items
    if body == "sum":  # in id order: addition of floats does not commute
        numbers = F.array_sort(F.collect_list(F.when(F.col("value.rank") == 1, F.struct("id", F.col("value.num").alias("num")))))
        return F.when(F.size(numbers) > 0, _value(F.lit(1), F.lit(None), F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x["num"]), F.lit(None), F.lit(None))), no_items
    if body in ("and", "or"):
        flag = F.when(F.col("value.rank") == 0, F.col("value.bool"))
        folded = F.bool_and(flag) if body == "and" else F.bool_or(flag)
        return F.when(folded.isNotNull(), _value(F.lit(0), folded, F.lit(None), F.lit(None), F.lit(None))), no_items
    items = F.array_sort(F.collect_list(F.when(primitive, F.col("value"))))
    return F.lit(None).cast(VALUE), F.when(F.size(items) > 0, items)


def resolve_rows(view: View, schema: dict, child_bytes: Callable[[View, dict | None], DataFrame]) -> DataFrame:
    """``(root, prop, value, items)`` of every property that is not absent."""
    found = candidates(view, child_bytes)
    by_policy: dict[str, list[str]] = {}
    for prop, policy in schema["props"].items():
        by_policy.setdefault(json.dumps(policy, sort_keys=True), []).append(prop)
    branches = [(json.loads(k), F.col("prop").isin(props), props) for k, props in by_policy.items()]
    branches.append((schema["default"], ~F.col("prop").isin(*schema["props"]) if schema["props"] else F.lit(True), []))
    out = None
    for policy, mine, props in branches:
        value, items = policy_column(policy)
        own = found.where(mine)
        if "absentAs" in policy and props:  # named properties are considered at every root
            wanted = view.all_roots().select("root", F.explode(F.array(*map(F.lit, props))).alias("prop"))
            own = wanted.join(own, ["root", "prop"], "left")
        part = own.groupBy("root", "prop").agg(value.alias("value"), items.alias("items")).where("value is not null or items is not null")
        out = part if out is None else out.unionByName(part)
    return out


def assembled(view: View, rows: DataFrame) -> DataFrame:
    """``(root, bytes)``: each root's resolved view in canonical form."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        made = {}
        for r in pdf.itertuples(index=False):
            if r.prop is not None:
                made[r.prop] = [python_value(x) for x in r.items] if hasattr(r.items, "__len__") else python_value(r.value)
        return pd.DataFrame({"root": [pdf["root"].iloc[0]], "bytes": [encode(made)]})

    return view.all_roots().join(rows, "root", "left").select("root", "prop", "value", "items").groupBy("root").applyInPandas(one, "root string, bytes binary")

