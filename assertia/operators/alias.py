"""Aliased names: one hop from a name to its slots and back to all fragments that map to them."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assertia.operators.claims import ClaimSet
from assertia.operators.mask import mask
from assertia.operators.predicates import predicate
from assertia.plans.vocabulary import Vocabulary


def _of_role(role: str, kind: str, lane: str) -> Column:
    return F.transform(F.filter("pointers", lambda p: (p["role"] == F.lit(role)) & (p["kind"] == kind) & p[lane].isNotNull()), lambda p: p[lane])


def closure(ambient: ClaimSet, spec: dict, vocabulary: Vocabulary) -> DataFrame:
    """``name``: the name itself and every fragment that shares a slot with it. Trust, where given, restricts mappings, slot
    declarations and their negations; ``via`` restricts slots to those declared for a concept."""
    trusted = predicate(spec["trust"], layout=ambient.layout) if "trust" in spec else None
    standing = mask(ambient.plain(), "drop", trusted)
    if trusted is not None:
        standing = standing.where(trusted)
    parts = standing.df.select(_of_role(vocabulary.fragment, "p", "str").alias("fragments"), _of_role(vocabulary.slot, "e", "entity").alias("slots"), _of_role(vocabulary.concept, "e", "entity").alias("concepts")).where(F.size("slots") > 0)
    mappings = parts.where(F.size("fragments") > 0).select(F.explode("fragments").alias("fragment"), "slots").select("fragment", F.explode("slots").alias("slot"))
    if "via" in spec:
        declared = parts.where(F.array_contains("concepts", F.lit(spec["via"]))).select(F.explode("slots").alias("slot")).distinct()
        mappings = mappings.join(declared, "slot", "left_semi")
    slots = mappings.where(F.col("fragment") == F.lit(spec["name"])).select("slot").distinct()
    own = ambient.df.sparkSession.createDataFrame([(spec["name"],)], "name string")
    return mappings.join(slots, "slot", "left_semi").select(F.col("fragment").alias("name")).unionByName(own).distinct()


def relation_signature(pointers: list) -> list[list[str]]:
    """``[role, context?]`` of a claim's entity pointers, in the order of their canonical bytes."""
    from assertia.functions.canon import encode

    pairs = [[p["role"]] + ([p["context"]] if p["context"] is not None else []) for p in pointers if p["kind"] == "e"]
    return sorted(pairs, key=encode)


