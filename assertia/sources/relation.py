"""Tables as claims: a row becomes one claim that files under its relation and carries a pointer for each attribute.

The set has a layout, so predicates on attributes are plain comparisons of the table's own columns and reach its scan. Null cells are absent
pointers. Integers travel as doubles and are refused beyond 2^53; ``decode_relation`` casts them back.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assertia.operators.claims import ClaimSet, PointerSpec, layout_pointers

EXACT = 2**53
CONTEXT = "tuples"


def lane_column(df: DataFrame, name: str) -> tuple[str, Column]:
    """The lane of a table's column, and its value in it."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return "bool", c
    if isinstance(kind, T.DoubleType):
        return "num", c
    if isinstance(kind, T.LongType):
        return "num", _exact_double(df, c)
    if isinstance(kind, T.NumericType):
        return "num", c.cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return "num", F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`) / 1000.0D")
    if isinstance(kind, T.TimestampType):
        return "num", F.unix_micros(c) / F.lit(1000.0)
    return "str", c.cast("string")


def _exact_double(df: DataFrame, c: Column) -> Column:
    """A long as a double, or an error beyond 2^53. Under ANSI the error is an arithmetic overflow, which unlike ``raise_error`` is deterministic, so that
    Catalyst drops the column where nobody reads it."""
    if df.sparkSession.conf.get("spark.sql.ansi.enabled") == "true":
        return F.when((F.abs(c) - 1) * (2**63 // EXACT) < 2**63 - 1, c.cast("double"))
    return F.when(F.abs(c) > EXACT, F.raise_error(F.lit("an integer beyond 2^53"))).otherwise(c.cast("double"))


def claim_frame(df: DataFrame, layout: Iterable[PointerSpec], *, id: Column | None, author: Column, timestamp: Column, columns: dict[str, Column]) -> ClaimSet:
    """A laid-out claim set over a table: ``columns`` are the layout's ``c_*`` columns. Without ``id``, claims are addressed by content."""
    layout = tuple(layout)
    held = df.select(author.alias("author"), timestamp.cast("double").alias("timestamp"), (F.lit(None).cast("string") if id is None else id).alias("id"), *(c.alias(n) for n, c in columns.items()))
    out = held.select("id", "author", "timestamp", layout_pointers(layout).alias("pointers"), F.lit(None).cast("string").alias("sig"), *columns)
    if id is None:
        from assertia.sources.profile import content_id

        out = out.withColumn("id", content_id("author", "timestamp", "pointers"))
    return ClaimSet(out, layout)


def encode_relation(df: DataFrame, name: str, columns: list[str] | None = None, *, id: Column | None = None, author: str = "encoder", timestamp: Column | None = None) -> ClaimSet:
    """One claim for each row, with the row's attributes under their names."""
    names = columns or df.columns
    lanes = {n: lane_column(df, n) for n in names}
    layout = [PointerSpec("rel", "e", constant=f"rel:{name}", context=CONTEXT)] + [PointerSpec(n, "p", lane, f"c_{n}") for n, (lane, _) in lanes.items()]
    return claim_frame(df, layout, id=id, author=F.lit(author), timestamp=F.lit(0.0) if timestamp is None else timestamp, columns={f"c_{n}": c for n, (_, c) in lanes.items()})


def first_pointer(role: str) -> Column:
    return F.get(F.filter("pointers", lambda p: p["role"] == F.lit(role)), F.lit(0))


def decode_relation(claims: ClaimSet, source: DataFrame, columns: list[str]) -> DataFrame:
    """Attributes of a relation's claims as columns of the source's types."""
    out = []
    for n in columns:
        kind = source.schema[n].dataType
        if claims.layout is not None:
            c = F.col(f"c_{n}")
        else:
            lane, _ = lane_column(source, n)
            c = first_pointer(n)[lane]
        if isinstance(kind, T.TimestampNTZType):
            c = F.timestamp_micros(F.round(c * 1000).cast("long")).cast("timestamp_ntz")
        out.append(c.cast(kind).alias(n))
    return claims.df.select(*out)
