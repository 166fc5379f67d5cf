"""Terms to DataFrames.

A root is a column: a body is planned once for all roots, a ``{var: root}`` that must hold becomes an equi-join with them, and an
``expand`` plans the child's body once for the distinct entities of its level. Holes, aliased matches and reflected views are lowered before
a predicate meets data. Sub-terms that do not depend on a root are planned once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assertia.functions.blake3 import content_address
from assertia.functions.body import entry
from assertia.functions.canon import Encoded, encode
from assertia.operators import claims as sets
from assertia.operators import views
from assertia.operators.alias import closure
from assertia.operators.claims import ClaimSet
from assertia.operators.mask import mask
from assertia.operators.predicates import conjuncts, mentions_root, predicate
from assertia.operators.resolve import assembled, resolve_rows, with_nested
from assertia.operators.views import View
from assertia.plans.registry import Registry
from assertia.plans.term import TermError, is_hole, operator_of, schema_hash
from assertia.plans.vocabulary import Vocabulary


@dataclass(frozen=True)
class Resolved:
    """``rows``: (root, prop, value, items); ``view`` is what was resolved."""

    view: View
    rows: DataFrame


class Planner:
    """Plans terms over one ambient claim set."""

    def __init__(self, ambient: ClaimSet, registry: Registry | None = None, vocabulary: Vocabulary | None = None):
        self.ambient, self.registry, self.vocabulary = ambient, registry, vocabulary or Vocabulary()
        self.spark: SparkSession = ambient.df.sparkSession
        self.memo: dict[tuple, ClaimSet] = {}

    # --- terms ---------------------------------------------------------------------------------------------------

    def plan(self, term: Any, roots: DataFrame | str | None = None, bindings: dict | None = None) -> ClaimSet | View | Resolved:
        """``roots``: a frame with a ``root`` column, ``"all"`` for every entity, or None for terms without a root."""
        op = operator_of(term)
        if op == "input":
            return self.ambient
        if op in ("select", "union", "intersect", "difference", "mask"):
            return self.plan_set(term, roots, bindings)
        if op == "fix":
            return self.plan_program(term["schema"], self._one_root(term["entity"]), term.get("bindings", bindings) if "bindings" in term else bindings)
        if op == "group":
            if roots is None:
                raise TermError("group needs a root")
            of = self.plan_set(term["in"], roots, bindings)
            return views.group(of, term["key"], None if isinstance(roots, str) else roots)
        of = self.plan(term["in"], roots, bindings)
        if not isinstance(of, View):
            raise TermError(f"{op} needs a view")
        if op == "prune":
            return views.prune(of, term["keep"] if term["keep"] == "all" else self.lower_match(term["keep"], roots))
        if op == "expand":
            role = self.lower_match(term["role"], roots)
            reading = self._registry().reading(term["reading"]) if "reading" in term else None
            child = self.plan_program(term["schema"], views.expanded_entities(of, role), bindings)
            return views.expand(of, role, child, reading)
        return Resolved(of, resolve_rows(of, term["schema"], self.child_view_bytes))

    def plan_program(self, ref: Any, roots: DataFrame, bindings: dict | None) -> View:
        out = self.plan(self._registry().program(ref).body, roots, bindings)
        if not isinstance(out, View):
            raise TermError("a schema's body must make a view")
        return out

    def plan_set(self, term: Any, roots: DataFrame | str | None, bindings: dict | None) -> ClaimSet:
        if term == "input":
            return self.ambient
        op = operator_of(term)
        if op not in ("select", "union", "intersect", "difference", "mask"):
            raise TermError(f"{op} does not make a set of claims")
        key = (json.dumps(term, sort_keys=True), json.dumps(bindings, sort_keys=True))
        free = not mentions_root(term)
        if free and key in self.memo:
            return self.memo[key]
        out = self._plan_set(op, term, roots, bindings)
        if free:
            self.memo[key] = out
        return out

    def _plan_set(self, op: str, term: dict, roots: DataFrame | str | None, bindings: dict | None) -> ClaimSet:
        if op == "select":
            of = self.plan_set(term["in"], roots, bindings).plain()
            return self.select(of, self.lower(term["pred"], roots, bindings), roots)
        if op == "mask":
            of = self.plan_set(term["in"], roots, bindings).plain()
            if not isinstance(term["policy"], dict):
                return mask(of, term["policy"])
            pred = self.lower(term["policy"]["trust"], roots, bindings)
            of, condition, flags = self.with_condition(of, pred, roots)
            out = mask(of, "drop", condition)
            return replace(out, df=out.df.drop(*flags))
        a, b = ("of", "without") if op == "difference" else ("left", "right")
        left, right = (self.plan_set(term[k], roots, bindings) for k in (a, b))
        if left.rooted != right.rooted:
            left, right = (x if x.rooted else self.at_roots(x, roots) for x in (left, right))
        return {"union": sets.union, "intersect": sets.intersect, "difference": sets.difference}[op](left, right)

    # --- predicates ------------------------------------------------------------------------------------------------

    def select(self, of: ClaimSet, pred: Any, roots: DataFrame | str | None) -> ClaimSet:
        of, condition, flags = self.with_condition(of, pred, roots)
        return replace(of, df=of.df.where(condition).drop(*flags))

    def with_condition(self, of: ClaimSet, pred: Any, roots: DataFrame | str | None) -> tuple[ClaimSet, Column, list[str]]:
        """The set with what a lowered predicate needs: roots joined in, and flags of reflected memberships."""
        flags: list[str] = []

        def joined(node: Any) -> Any:
            nonlocal of
            if isinstance(node, list):
                return [joined(x) for x in node]
            if not isinstance(node, dict):
                return node
            if "reflected" in node:
                flag, values, field = f"in_view_{len(flags)}", node["reflected"]["values"], node["reflected"]["field"]
                flags.append(flag)
                of = replace(of, df=of.df.join(values.select(F.col("value").alias(field), F.lit(True).alias(flag)), field, "left").withColumn(flag, F.coalesce(flag, F.lit(False))))
                return {"flag": flag}
            return {k: joined(v) if k in ("and", "or", "not") else v for k, v in node.items()}

        pred = joined(pred)
        root = None
        if mentions_root(pred):
            if roots is not None:
                of = self.anchored(of, pred, roots)
                root = F.col("root")
        elif of.rooted:
            root = F.col("root")
        return of, predicate(pred, layout=of.layout, root=root), flags

    def anchored(self, of: ClaimSet, pred: Any, roots: DataFrame | str) -> ClaimSet:
        """The set at the roots it can match: by an equi-join where a pointer to the root must exist."""
        if of.rooted:
            return of
        must = any(isinstance(c, dict) and "hasPointer" in c and c["hasPointer"].get("targetEntity") == {"var": "root"} for c in conjuncts(pred))
        if not must:
            return self.at_roots(of, roots)
        if of.layout is not None:
            columns = [s.value() for s in of.layout if s.kind == "e"]
            places = F.array_distinct(F.filter(F.array(*columns), lambda x: x.isNotNull())) if columns else F.array().cast("array<string>")
        else:
            places = F.array_distinct(F.transform(F.filter("pointers", lambda p: p["kind"] == "e"), lambda p: p["entity"]))
        df = of.df.withColumn("root", F.explode(places))
        if isinstance(roots, DataFrame):
            df = df.join(roots, "root", "left_semi")
        return replace(of, df=df, rooted=True)

    def at_roots(self, of: ClaimSet, roots: DataFrame | str | None) -> ClaimSet:
        """Every claim at every root, where a term's meaning asks for it."""
        if not isinstance(roots, DataFrame):
            raise TermError("this term needs given roots")
        return replace(of, df=of.df.crossJoin(roots), rooted=True)

    def lower(self, pred: Any, roots: DataFrame | str | None, bindings: dict | None) -> Any:
        """Holes to constants, aliased matches to sets, reflected views to value tables."""
        if isinstance(pred, list):
            return [self.lower(x, roots, bindings) for x in pred]
        if not isinstance(pred, dict):
            return pred
        if is_hole(pred):
            if not bindings or pred["hole"] not in bindings:
                raise TermError(f"unbound hole {pred['hole']!r}")
            return bindings[pred["hole"]]
        if "aliased" in pred:
            return self.lower_match(pred, roots)
        if "inView" in pred:
            node = pred["inView"]
            sub = self.plan_set(node["term"], roots, bindings)
            return {"reflected": {"field": node["field"], "values": self.extracted(sub, node["extract"])}}
        if "hasPointer" in pred:
            fields = {k: self.lower(v, roots, bindings) for k, v in pred["hasPointer"].items()}
            if not isinstance(fields.get("targetEntity", ""), str | dict):
                return "false"  # an entity is named by a string
            return {"hasPointer": fields}
        out = {k: self.lower(v, roots, bindings) for k, v in pred.items()}
        for node in (out.get("match"), out.get("vcmp")):
            if node and node["cmp"] == "prefix" and not isinstance(node.get("const", node.get("value")), str):
                return "false" if "match" in out else {"inSet": []}
        return out

    def lower_match(self, match: dict, roots: DataFrame | str | None) -> dict:
        if "aliased" not in match:
            return match
        names = closure(self.ambient, match["aliased"], self.vocabulary)
        return {"inSet": sorted(r.name for r in names.collect())}  # names of one concept: a vocabulary, not data

    def extracted(self, sub: ClaimSet, extract: dict) -> DataFrame:
        """Distinct strings of a facet of a set."""
        if "field" in extract:
            return sub.df.select(F.col(extract["field"]).alias("value")).distinct()
        own = F.filter("pointers", lambda p: p["role"] == F.lit(extract["role"]))
        said = F.transform(own, lambda p: F.coalesce(p["entity"], p["delta_ref"], p["str"]))
        return sub.df.select(F.explode(said).alias("value")).where("value is not null").distinct()

    # --- canonical forms -------------------------------------------------------------------------------------------

    def child_view_bytes(self, view: View, reading: dict | None) -> DataFrame:
        if reading is None:
            raise TermError("an expansion without a reading cannot be resolved")
        return assembled(view, resolve_rows(view, reading, self.child_view_bytes))

    def child_gather_bytes(self, view: View, reading: dict | None) -> DataFrame:
        return self.gathered(view, reading)

    def gathered(self, view: View, reading: dict | None = None) -> DataFrame:
        """``(root, bytes)``: each root's view in canonical form, all claims with their provenance."""
        address = schema_hash(reading) if reading is not None else None
        entries = with_nested(view, view.entries, self.child_gather_bytes)

        def one(pdf):
            import pandas as pd

            props: dict[str, list] = {}
            for r in pdf.sort_values(["id"], key=lambda s: s.map(lambda x: (x or "").encode())).itertuples(index=False):
                if r.prop is None:
                    continue
                nested = dict(r.nested) if r.nested is not None else {}
                props.setdefault(r.prop, []).append(Encoded(encode(entry(r, nested))))
            made = {"id": pdf["root"].iloc[0], "props": props}
            return pd.DataFrame({"root": [made["id"]], "bytes": [encode(made if address is None else made | {"reading": address})]})

        rows = view.all_roots().join(entries.select("root", "prop", *sets.COLUMNS, "negated", "nested"), "root", "left")
        return rows.groupBy("root").applyInPandas(one, "root string, bytes binary")

    def canonical_bytes(self, result: ClaimSet | View | Resolved) -> bytes:
        """The canonical bytes of a result of one root, or of a set; for checking, not for large results."""
        if isinstance(result, Resolved):
            return bytes(assembled(result.view, result.rows).collect()[0].bytes)
        if isinstance(result, View):
            return bytes(self.gathered(result).collect()[0].bytes)
        ids = sorted(r.id for r in result.df.select("id").collect())
        if not result.annotated:
            return encode(ids)
        return encode({"ids": ids, "negated": sorted(r.id for r in result.df.where("negated").select("id").collect())})

    def address(self, result: ClaimSet | View | Resolved) -> str:
        return content_address(self.canonical_bytes(result))

    def _registry(self) -> Registry:
        if self.registry is None:
            raise TermError("a schema is named but there is no registry")
        return self.registry

    def _one_root(self, entity: str) -> DataFrame:
        return self.spark.createDataFrame([(entity,)], "root string")
