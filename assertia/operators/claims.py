"""Claim sets as DataFrames.

A claim is a row ``id, author, timestamp, pointers, sig``; a pointer is a struct with a discriminator ``kind`` (p primitive, e entity,
d delta, y bytes) and nullable lanes. A set may also have a ``layout``: all its claims carry the same pointers, each
from a literal or a column ``c_*`` of the frame. Then predicates become plain comparisons of those columns, which reach
the Parquet scan, and the pointer array is an expression that Catalyst drops wherever nobody reads it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTER = "struct<role:string,kind:string,rank:int,bool:boolean,num:double,str:string,entity:string,delta_ref:string,context:string,mime:string,bytes:binary>"
CLAIM_DDL = f"id string, author string, timestamp double, pointers array<{POINTER}>, sig string"
COLUMNS = ["id", "author", "timestamp", "pointers", "sig"]
RANKS = {"bool": 0, "num": 1, "str": 2}
LANES = ("role", "kind", "rank", "bool", "num", "str", "entity", "delta_ref", "context", "mime", "bytes")


@dataclass(frozen=True)
class PointerSpec:
    """One pointer of a layout: its role, kind, lane (for primitives), the column that holds its value, and its context. A null value is
    an absent pointer. ``constant``: the value is a literal instead; ``context_column``: the context is a column."""

    role: str
    kind: str
    lane: str = "str"
    column: str = ""
    context: str | None = None
    constant: str | None = None
    context_column: str = ""

    def context_value(self) -> Column | None:
        return F.col(self.context_column) if self.context_column else None if self.context is None else F.lit(self.context)

    def value(self) -> Column:
        return F.lit(self.constant) if self.constant is not None else F.col(self.column)


def pointer(role: Column, kind: str, *, lane: str = "", value: Column, context: Column | None = None) -> Column:
    """A pointer struct with one lane filled."""
    types = dict(x.split(":") for x in POINTER[7:-1].split(","))
    filled = {"role": role, "kind": F.lit(kind), "context": context}
    if kind == "p":
        filled |= {"rank": F.lit(RANKS[lane]), lane: value}
    else:
        filled |= {{"e": "entity", "d": "delta_ref"}[kind]: value}
    return F.struct(*((filled[name] if filled.get(name) is not None else F.lit(None)).cast(types[name]).alias(name) for name in LANES))


def layout_pointers(layout: tuple[PointerSpec, ...]) -> Column:
    each = [F.when(s.value().isNotNull(), pointer(F.lit(s.role), s.kind, lane=s.lane, value=s.value(), context=s.context_value())) for s in layout]
    return F.filter(F.array(*each), lambda p: p.isNotNull())


@dataclass(frozen=True)
class ClaimSet:
    """Claims unique by id, or by ``(root, id)`` where ``rooted``; ``negated`` is a column only right after an annotating mask."""

    df: DataFrame
    layout: tuple[PointerSpec, ...] | None = None
    rooted: bool = False
    annotated: bool = False

    @property
    def keys(self) -> list[str]:
        return ["root", "id"] if self.rooted else ["id"]

    def where(self, condition: Column) -> ClaimSet:
        return replace(self, df=self.df.where(condition), annotated=False).plain()

    def plain(self) -> ClaimSet:
        """Without annotation tags."""
        return replace(self, df=self.df.drop("negated"), annotated=False)

    def general(self) -> ClaimSet:
        """Without a layout."""
        return replace(self, df=self.df.select(*(["root"] if self.rooted else []), *COLUMNS, *(["negated"] if self.annotated else [])), layout=None)


def union(left: ClaimSet, right: ClaimSet) -> ClaimSet:
    """By id; the left copy wins."""
    left, right = _aligned(left.plain(), right.plain())
    return replace(left, df=left.df.unionByName(right.df.join(left.df.select(*left.keys), left.keys, "left_anti")))


def intersect(left: ClaimSet, right: ClaimSet) -> ClaimSet:
    left, right = left.plain(), right.plain()
    return replace(left, df=left.df.join(right.df.select(*right.keys), right.keys, "left_semi"))


def difference(of: ClaimSet, without: ClaimSet) -> ClaimSet:
    of, without = of.plain(), without.plain()
    return replace(of, df=of.df.join(without.df.select(*without.keys), without.keys, "left_anti"))


def _aligned(left: ClaimSet, right: ClaimSet) -> tuple[ClaimSet, ClaimSet]:
    if left.layout is not None and left.layout == right.layout and set(left.df.columns) == set(right.df.columns):
        return left, right
    return left.general(), right.general()
