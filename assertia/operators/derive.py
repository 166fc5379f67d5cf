"""Derivation: computation outside the algebra whose results come back as claims with their provenance.

A derivation is a named function from a DataFrame of resolved rows or of claims to rows of pointers; this is where joins and comparisons of
two attributes live. Emission appends, supersedes all earlier output of the author, or replaces by key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assertia.operators import claims as sets
from assertia.operators.claims import ClaimSet, PointerSpec
from assertia.operators.mask import NEGATES
from assertia.plans.vocabulary import Vocabulary
from assertia.sources.relation import claim_frame, first_pointer


@dataclass(frozen=True)
class Derivation:
    """``columns`` are the output's pointers: role to ``(kind, lane, context)``; ``key`` names those that identify a result."""

    name: str
    columns: dict[str, tuple[str, str, str | None]]
    key: tuple[str, ...] = ()
    vocabulary: Vocabulary = field(default_factory=Vocabulary)

    def emit(self, rows: DataFrame, id: Column | None = None) -> ClaimSet:
        """Rows (one column for each role) as claims by the derivation, of timestamp 0."""
        by = PointerSpec(self.vocabulary.role("derived.by"), "p", "str", constant=self.name)
        layout = [PointerSpec(role, kind, lane, f"c_{role}", context) for role, (kind, lane, context) in self.columns.items()]
        return claim_frame(rows, [*layout, by], id=id, author=F.lit(f"derived:{self.name}"), timestamp=F.lit(0.0), columns={f"c_{r}": F.col(r) for r in self.columns})

    def replace(self, log: ClaimSet, fresh: ClaimSet, mode: str = "append") -> ClaimSet:
        """The log with fresh output: ``append``; ``supersede`` negates all standing earlier output; ``keyed`` negates earlier
        output of the same key. What is emitted again unchanged is not negated."""
        out = sets.union(log, fresh)
        if mode == "append":
            return out
        earlier = log.df.where((F.col("author") == f"derived:{self.name}") & ~F.exists("pointers", lambda p: p["role"] == NEGATES)).join(fresh.df.select("id"), "id", "left_anti")
        done = F.transform(F.filter("pointers", lambda p: p["role"] == NEGATES), lambda p: p["delta_ref"])
        earlier = earlier.join(log.df.select(F.explode(done).alias("id")).distinct(), "id", "left_anti")
        if mode == "keyed":
            earlier = earlier.withColumn("k", self._key()).join(fresh.df.select(self._key().alias("k")).distinct(), "k", "left_semi")
        against = claim_frame(earlier, [PointerSpec(NEGATES, "d", column="c_target")], id=None, author=F.lit(f"derived:{self.name}"), timestamp=F.lit(0.0), columns={"c_target": F.col("id")})
        return sets.union(out, against)

    def _key(self) -> Column:
        own = [first_pointer(r) for r in self.key]
        return F.struct(*(F.coalesce(p["str"], p["entity"], p["delta_ref"], p["num"].cast("string"), p["bool"].cast("string")).alias(r) for p, r in zip(own, self.key, strict=True)))


def reproduces(derivation: Derivation, rows: DataFrame, log: ClaimSet) -> bool:
    """Whether replaying a pure derivation gives claims that the log holds already."""
    return derivation.emit(rows).df.join(log.df.select("id"), "id", "left_anti").isEmpty()
