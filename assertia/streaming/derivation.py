"""The derivation host: functions over views whose results come back into the log as signed claims with their provenance.

A binding names a view, a function from the changed roots' resolved rows to rows of pointers, and how output replaces earlier output. Each batch that changes the view
triggers it once, over all changed roots together; what it emits is one more batch, whose changes may trigger others, until nothing fires or ``DEPTH`` batches have followed one
another. A binding does not fire on a batch of its own claims alone. After ``budget`` triggers it is suspended, which is itself a claim.

Installing writes a signed claim that binds the function to its author. Which output stands, and how often a binding has fired, is read from the log and the reactor's
state, so that a host on a reopened reactor goes on; the functions are given again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assertia.functions.blake3 import content_addresses
from assertia.functions.ed25519 import PREFIX, public_key, sign_id
from assertia.operators.claims import CLAIM_DDL, COLUMNS, ClaimSet, PointerSpec
from assertia.operators.mask import NEGATES, mask
from assertia.operators.resolve import assembled
from assertia.plans.tables import written
from assertia.plans.vocabulary import Vocabulary
from assertia.sources.relation import claim_frame, first_pointer
from assertia.streaming.reactor import Reactor, validated

DEPTH = 32


@dataclass(frozen=True)
class Binding:
    """``function``: rows ``(root, prop, value, items)`` to rows with ``root`` and a column for each output role; ``columns``: role to ``(kind, lane, context)``;
    ``emit``: append, supersede (all earlier output goes) or keyed (earlier output of the same values of the roles ``key`` goes)."""

    name: str
    function_id: str
    view: str
    function: Callable[[DataFrame], DataFrame]
    columns: dict[str, tuple[str, str, str | None]]
    budget: int
    emit: str = "append"
    key: tuple[str, ...] = ()


def signed(claims: DataFrame, seed: bytes) -> DataFrame:
    """Claim rows with their author's signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = [sign_id(seed, r["author"], r["id"]) for r in b.select(["author", "id"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sigs, pa.string())], b.schema.names)

    return claims.select(*COLUMNS).mapInArrow(run, CLAIM_DDL)


def input_addresses(resolved: DataFrame) -> DataFrame:
    """``(root, came)``: the content address of each root's resolved rows, in canonical form."""
    from assertia.operators.views import View

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content_addresses([bytes(x) for x in b.column(1).to_pylist()]), pa.string())], ["root", "came"])

    roots = resolved.select("root").distinct()
    return assembled(View(resolved, roots), resolved).mapInArrow(run, "root string, came string")


def emissions(binding: Binding, author: str, resolved: DataFrame, vocabulary: Vocabulary) -> ClaimSet:
    """The claims that a binding makes of resolved rows, of timestamp 0: a function of the input alone, which replay recomputes."""
    layout = [PointerSpec(role, kind, lane, f"c_{role}", context) for role, (kind, lane, context) in binding.columns.items()]
    layout += [
        PointerSpec(vocabulary.role("derived.by"), "e", constant=binding.function_id),
        PointerSpec(vocabulary.role("derived.from"), "p", "str", column="c_came"),
        PointerSpec(vocabulary.role("derived.under"), "e", constant=binding.name),
    ]
    rows = binding.function(resolved).join(input_addresses(resolved), "root")
    columns = {f"c_{role}": F.col(role) for role in binding.columns} | {"c_came": F.col("came")}
    return claim_frame(rows, layout, id=None, author=F.lit(author), timestamp=F.lit(0.0), columns=columns)


def reproduced(binding: Binding, resolved: DataFrame, emitted: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``(id, reproduced)`` of emitted claims: whether signature and id are right, and replaying the function over ``resolved`` makes the same claim."""
    vocabulary, emitted = vocabulary or Vocabulary(), emitted.select(*COLUMNS)
    author = emitted.select("author").limit(1).collect()
    made = emissions(binding, author[0].author if author else "", resolved, vocabulary).df.select("id", F.lit(True).alias("made"))
    sound = validated(emitted).select("id", (F.col("reason").isNull() & F.col("sig").isNotNull()).alias("sound"))
    return sound.join(made, "id", "left").select("id", (F.col("sound") & F.coalesce("made", F.lit(False))).alias("reproduced"))


class Host:
    """Runs bindings over a reactor's views."""

    def __init__(self, reactor: Reactor):
        self.reactor, self.bindings = reactor, {}
        self.used: dict[str, dict] = reactor.state["more"].setdefault("bindings", {})

    def install(self, binding: Binding, seed: bytes) -> str:
        """Writes the claim that binds the function to its author, and returns the author."""
        if binding.name in self.bindings:
            raise ValueError(f"another binding is named {binding.name!r}")
        if binding.view not in self.reactor.state["views"]:
            raise ValueError(f"there is no view {binding.view!r}")
        author = PREFIX + public_key(seed).hex()
        self.bindings[binding.name] = (binding, seed, author)
        if binding.name not in self.used:
            self.used[binding.name] = {"fired": 0, "suspended": False}
            v = self.reactor.vocabulary
            binds = [PointerSpec(v.role("derived.binds"), "e", constant=binding.function_id, context="bindings"), PointerSpec(v.role("derived.author"), "p", "str", constant=author)]
            self.reactor.ingest(self._own(binds, author, seed))
        return author

    def suspended(self, name: str) -> bool:
        return self.used[name]["suspended"]

    def ingest(self, batch: DataFrame, number: int | None = None) -> int:
        """Ingests a batch, then what bindings make of its changes, until nothing fires. Returns the number of batches written back."""
        waiting, depth, wrote = [self.reactor.ingest(batch, number)], 0, 0
        while waiting and depth < DEPTH:
            depth, following = depth + 1, []
            for changes in waiting:
                for binding, seed, author in list(self.bindings.values()):
                    out = self._trigger(binding, seed, author, changes)
                    if out is not None:
                        wrote += 1
                        following.append(self.reactor.ingest(out))
            waiting = following
        return wrote

    def _trigger(self, binding: Binding, seed: bytes, author: str, changes: dict[str, DataFrame]) -> DataFrame | None:
        state, changed = self.used[binding.name], changes.get(binding.view)
        if state["suspended"] or changed is None or changed.isEmpty():
            return None
        accepted = changes[""].where("status = 'accepted'").select("id")
        if self.reactor._read("log", accepted).join(accepted, "id", "left_semi").where(F.col("author") != author).isEmpty():
            return None
        v = self.reactor.vocabulary
        if state["fired"] >= binding.budget:
            state["suspended"] = True
            return self._own([PointerSpec(v.role("derived.suspended"), "e", constant=binding.name, context="suspensions")], author, seed)
        state["fired"] += 1
        # a function sees what others say of a root, not its own earlier output
        rows = self.reactor.view(binding.view).join(changed.select("root").distinct(), "root", "left_semi").where(~F.col("prop").isin(self._contexts(binding)))
        fresh = written(emissions(binding, author, written(rows, "resolved"), v).general().df, "emissions")
        if binding.emit == "append":
            return signed(fresh, seed)
        gone = self._standing(binding, author).join(fresh.select("id"), "id", "left_anti")
        if binding.emit == "keyed":
            gone = gone.withColumn("k", self._key(binding)).join(fresh.select(self._key(binding).alias("k")).distinct(), "k", "left_semi")
        against = claim_frame(gone, [PointerSpec(NEGATES, "d", column="c_target")], id=None, author=F.lit(author), timestamp=F.lit(0.0), columns={"c_target": F.col("id")})
        return signed(fresh.unionByName(against.general().df), seed)

    def _contexts(self, binding: Binding) -> list[str]:
        return [context for _, _, context in binding.columns.values() if context is not None]

    def _standing(self, binding: Binding, author: str) -> DataFrame:
        """Earlier output of a binding that its author has not taken back."""
        log, under = self.reactor.log(), self.reactor.vocabulary.role("derived.under")
        own = ClaimSet(log.df.where(F.col("author") == author))
        return mask(own, "drop").df.where(F.exists("pointers", lambda p: (p["role"] == under) & (p["entity"] == binding.name)))

    def _key(self, binding: Binding) -> Column:
        found = [first_pointer(role) for role in binding.key]
        return F.struct(*(F.coalesce(p["entity"], p["delta_ref"], p["str"], p["num"].cast("string"), p["bool"].cast("string")).alias(role) for p, role in zip(found, binding.key, strict=True)))

    def _own(self, pointers: list[PointerSpec], author: str, seed: bytes) -> DataFrame:
        """One signed claim of constant pointers."""
        one = self.reactor.spark.range(1)
        return signed(claim_frame(one, pointers, id=None, author=F.lit(author), timestamp=F.lit(0.0), columns={}).general().df, seed)
