"""Views: claims filed under properties of roots, as long tables ``(root, prop, id, negated, claim columns)``."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assertia.operators.claims import ClaimSet
from assertia.operators.predicates import str_match, str_matches
from assertia.plans.term import TermError


@dataclass(frozen=True)
class Expansion:
    """Entity pointers of matching roles stand for the child view of the entity they name."""

    role: dict
    child: View
    reading: dict | None


@dataclass(frozen=True)
class View:
    """Entries of many roots. ``roots`` is None where every root has entries; else empty roots survive by it."""

    entries: DataFrame
    roots: DataFrame | None
    layout: tuple | None = None
    expansions: tuple[Expansion, ...] = ()

    def all_roots(self) -> DataFrame:
        return self.entries.select("root").distinct() if self.roots is None else self.roots


def _keep(claims: ClaimSet) -> list[str]:
    return [c for c in claims.df.columns if c not in ("root", "negated")]


def _negated(claims: ClaimSet) -> Column:
    return (F.col("negated") if claims.annotated else F.lit(False)).alias("negated")


def group(claims: ClaimSet, key: Any, roots: DataFrame | None) -> View:
    """Files claims under a context, a role or a fixed property. Without ``roots``, every entity is a root."""
    df, kept = claims.df, _keep(claims)
    if isinstance(key, dict):
        prop = F.lit(key["const"]).alias("prop")
        if not claims.rooted:
            if roots is None:
                raise TermError("a fixed property needs given roots")
            df = df.crossJoin(roots)  # every claim files at every root, by definition; few roots are broadcast by their size alone
        return View(df.select("root", prop, _negated(claims), *kept), roots, claims.layout)
    by_context = key == "byTargetContext"
    if claims.layout is not None:
        specs = [s for s in claims.layout if s.kind == "e" and (s.context_value() is not None or not by_context)]
        parts = []
        for s in specs:
            filed = df.where(s.value() == F.col("root")) if claims.rooted else df.where(s.value().isNotNull()).withColumn("root", s.value())
            parts.append(filed.select("root", (s.context_value() if by_context else F.lit(s.role)).alias("prop"), _negated(claims), *kept))
        if not parts:
            return View(df.select(F.lit("").alias("root"), F.lit("").alias("prop"), _negated(claims), *kept).where(F.lit(False)), roots, claims.layout)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        names = [s.context if by_context else s.role for s in specs]
        if len(set(names)) < len(names) or (by_context and len(specs) > 1 and any(s.context_column for s in specs)):
            out = out.dropDuplicates(["root", "prop", "id"])
    else:
        name = "context" if by_context else "role"
        filing = F.filter("pointers", lambda p: (p["kind"] == "e") & p[name].isNotNull())
        places = F.array_distinct(F.transform(filing, lambda p: F.struct(p["entity"].alias("root"), p[name].alias("prop"))))
        if claims.rooted:
            places = F.filter(places, lambda x: x["root"] == F.col("root"))
            out = df.select("root", F.explode(F.transform(places, lambda x: x["prop"])).alias("prop"), _negated(claims), *kept)
        else:
            out = df.select(F.explode(places).alias("place"), _negated(claims), *kept).select("place.root", "place.prop", "negated", *kept)
    if roots is not None and not claims.rooted:
        out = out.join(roots, "root", "left_semi")
    return View(out, roots, claims.layout)


def prune(view: View, keep: Any) -> View:
    if keep == "all":
        return view
    return replace(view, roots=view.all_roots(), entries=view.entries.where(str_match(F.col("prop"), keep)))


def expand(view: View, role: dict, child: View, reading: dict | None) -> View:
    return replace(view, expansions=(*view.expansions, Expansion(role, child, reading)))


def expanded_entities(view: View, role: dict) -> DataFrame:
    """Distinct entities that pointers of matching roles name: the child view's roots."""
    if view.layout is not None:
        parts = [view.entries.select(s.value().alias("root")).where("root is not null") for s in view.layout if s.kind == "e" and str_matches(s.role, role)]
        out = parts[0] if parts else view.entries.select("root").where(F.lit(False))
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()
    found = F.transform(F.filter("pointers", lambda p: (p["kind"] == "e") & str_match(p["role"], role)), lambda p: p["entity"])
    return view.entries.select(F.explode(found).alias("root")).distinct()
