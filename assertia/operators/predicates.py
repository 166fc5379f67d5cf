"""Predicates as Columns, two-valued.

A filter passes neither null nor false, so a predicate that only stands under ``and`` and ``or`` is left as it is: its comparisons stay plain and reach the scan. What
stands under ``not`` must tell the two apart, so there every leaf is made null-free.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from assertia.operators.claims import RANKS, PointerSpec
from assertia.plans.term import TermError, is_hole

def lane_of(value: Any) -> str:
    return "bool" if isinstance(value, bool) else "num" if isinstance(value, float | int) else "str"


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_of(columns: list[Column]) -> Column:
    out = F.lit(False)
    for i, c in enumerate(columns):
        out = c if i == 0 else out | c
    return out


def all_of(columns: list[Column]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(columns):
        out = c if i == 0 else out & c
    return out


def compare_typed(x: Column, lane: str, cmp: str, constant: Any) -> Column:
    """A value of a known type against a constant, in the canonical order: booleans, then numbers, then strings."""
    other = lane_of(constant)
    if cmp == "prefix":
        return x.startswith(constant) if lane == other == "str" else F.lit(False)
    if lane != other:
        below = RANKS[lane] < RANKS[other]
        return F.lit({"eq": False, "neq": True, "lt": below, "lte": below, "gt": not below, "gte": not below}[cmp])
    c = F.lit(constant)
    return {"eq": x == c, "neq": x != c, "lt": x < c, "lte": x <= c, "gt": x > c, "gte": x >= c}[cmp]


def in_typed(x: Column, lane: str, values: list) -> Column:
    own = [v for v in values if lane_of(v) == lane]
    return x.isin(own) if own else F.lit(False)


def compare_ranked(p: Column, cmp: str, constant: Any) -> Column:
    """A primitive pointer's value, of any type, against a constant."""
    lane = lane_of(constant)
    rank = RANKS[lane]
    if cmp == "prefix":
        return _sure((p["rank"] == 2) & p["str"].startswith(constant))
    same = (p["rank"] == rank) & compare_typed(p[lane], lane, cmp, constant)
    other = {"eq": F.lit(False), "neq": p["rank"] != rank, "lt": p["rank"] < rank, "lte": p["rank"] < rank, "gt": p["rank"] > rank, "gte": p["rank"] > rank}[cmp]
    return _sure(same) | _sure(other)


def str_match(x: Column, match: dict) -> Column:
    """A string column against a match, null for a null; a null never matches."""
    [(tag, value)] = match.items()
    if tag == "aliased":
        raise TermError("an aliased match outside its operator")
    return {"exact": lambda: x == F.lit(value), "prefix": lambda: x.startswith(value), "inSet": lambda: x.isin(value) if value else F.lit(False)}[tag]()


def str_matches(text: str | None, match: dict) -> bool:
    """The same for a string known while planning."""
    [(tag, value)] = match.items()
    if tag not in ("exact", "prefix", "inSet"):
        raise TermError("an aliased match outside its operator")
    return text is not None and (text == value if tag == "exact" else text.startswith(value) if tag == "prefix" else text in value)


def _value_ranked(p: Column, match: dict) -> Column:
    [(tag, value)] = match.items()
    if tag == "vcmp":
        return compare_ranked(p, value["cmp"], value["value"])
    if tag == "between":
        return compare_ranked(p, "gte", value[0]) & compare_ranked(p, "lte", value[1])
    return any_of([compare_ranked(p, "eq", v) for v in value])


def _value_typed(x: Column, lane: str, match: dict) -> Column:
    [(tag, value)] = match.items()
    if tag == "vcmp":
        return compare_typed(x, lane, value["cmp"], value["value"])
    if tag == "between":
        return compare_typed(x, lane, "gte", value[0]) & compare_typed(x, lane, "lte", value[1])
    return in_typed(x, lane, value)


def pointer_matches(p: Column, pred: dict, root: Column | None) -> Column:
    """All given fields on one pointer of an array; never null."""
    here = {
        "role": lambda want: str_match(p["role"], want),
        "context": lambda want: p["kind"].isin("e", "d") & str_match(p["context"], want),
        "targetDelta": lambda want: (p["kind"] == "d") & (p["delta_ref"] == F.lit(want)),
        "targetIsPrimitive": lambda want: (p["kind"] == "p") == F.lit(want),
        "targetValue": lambda want: (p["kind"] == "p") & _value_ranked(p, want),
        "targetEntity": lambda want: (p["kind"] == "e") & (p["entity"] == (root if want == {"var": "root"} else F.lit(want))),
    }
    return all_of([F.lit(False) if want == {"var": "root"} and root is None else _sure(here[key](want)) for key, want in pred.items()])


def spec_matches(spec: PointerSpec, pred: dict, root: Column | None) -> Column | None:
    """The same on a layout's pointer: what the layout settles is settled now; None if nothing can match."""
    tests = [F.col(spec.column).isNotNull()] if spec.constant is None else []
    for key, want in pred.items():
        if key == "role":
            if not str_matches(spec.role, want):
                return None
        elif key == "context":
            if spec.kind not in "ed":
                return None
            if spec.context_column:
                tests.append(str_match(F.col(spec.context_column), want))
            elif not str_matches(spec.context, want):
                return None
        elif key == "targetIsPrimitive":
            if (spec.kind == "p") != want:
                return None
        elif key == "targetValue":
            if spec.kind != "p":
                return None
            tests.append(_value_typed(spec.value(), spec.lane, want))
        elif key == "targetDelta":
            if spec.kind != "d":
                return None
            tests.append(spec.value() == F.lit(want))
        elif spec.kind != "e" or (want == {"var": "root"} and root is None):
            return None
        elif spec.constant is not None and isinstance(want, str):
            if spec.constant != want:
                return None
        else:
            tests.append(spec.value() == (root if want == {"var": "root"} else F.lit(want)))
    return all_of(tests)


def predicate(pred: Any, *, layout: tuple[PointerSpec, ...] | None = None, root: Column | None = None, exact: bool = False) -> Column:
    """A closed, lowered predicate over a claim's columns, as a filter's condition; with ``exact`` it is never null."""

    def part(node: Any) -> Column:
        return predicate(node, layout=layout, root=root, exact=exact)

    if pred in ("true", "false"):
        return F.lit(pred == "true")
    [(tag, value)] = pred.items()
    if tag == "match":
        field, cmp, constant = value["field"], value["cmp"], value["const"]
        if is_hole(constant):
            raise TermError(f"unbound hole {constant['hole']!r}")
        lane = "num" if field == "timestamp" else "str"
        return in_typed(F.col(field), lane, constant) if cmp == "inSet" else compare_typed(F.col(field), lane, cmp, constant)
    if tag == "hasPointer":
        if layout is None:
            return F.exists("pointers", lambda p: pointer_matches(p, value, root))
        held = any_of([c for s in layout if (c := spec_matches(s, value, root)) is not None])
        return _sure(held) if exact else held
    if tag == "and":
        return all_of([part(x) for x in value])
    if tag == "or":
        return any_of([part(x) for x in value])
    if tag == "not":
        return ~predicate(value, layout=layout, root=root, exact=True)
    if tag == "flag":  # a reflected membership that the planner joined in
        return F.col(value)
    raise TermError(f"a predicate that was not lowered: {tag}")


def conjuncts(pred: Any) -> list:
    if isinstance(pred, dict) and "and" in pred:
        return [x for side in pred["and"] for x in conjuncts(side)]
    return [pred]


def mentions_root(pred: Any) -> bool:
    if isinstance(pred, dict):
        return pred == {"var": "root"} or any(map(mentions_root, pred.values()))
    return isinstance(pred, list) and any(map(mentions_root, pred))
