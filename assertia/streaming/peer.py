"""Peers: a reactor with a key, a lens that says what it offers, and a predicate that says what it admits.

A pull compares sets of ids by joins and moves only what is lacking; signed claims travel alone, unsigned ones only under a signed manifest that lists them, which enters
as a whole or not at all. What arrives is verified again by ingest.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assertia.functions.ed25519 import PREFIX, public_key
from assertia.operators.claims import COLUMNS, ClaimSet
from assertia.operators.predicates import predicate
from assertia.plans.tables import written
from assertia.plans.term import TermError, parse_pred, parse_term
from assertia.plans.vocabulary import Vocabulary
from assertia.sources.profile import claim_set
from assertia.streaming.derivation import signed
from assertia.streaming.federation import offer
from assertia.streaming.reactor import Reactor


@dataclass(frozen=True)
class Report:
    """Claims that a pull was offered, withheld for want of a signature, declined by admission, accepted and rejected."""

    offered: int
    withheld: int
    declined: int
    accepted: int
    rejected: int


class Peer:
    def __init__(self, spark: SparkSession, seed: bytes, lens: Any = "input", admission: Any = None, path: str | None = None, vocabulary: Vocabulary | None = None):
        self.spark, self.seed, self.author = spark, seed, PREFIX + public_key(seed).hex()
        self.lens, self.admission = parse_term(lens), None if admission is None else parse_pred(admission)
        self.reactor = Reactor(spark, path, vocabulary=vocabulary)

    def author_claims(self, claims: list[dict]) -> list[str]:
        """Signs a few JSON claims (without an author) as this peer's and ingests them; returns their ids."""
        frame = claim_set(self.spark, [c | {"author": self.author} for c in claims]).df
        self.reactor.ingest(signed(frame, self.seed))
        return [r.id for r in frame.select("id").collect()]

    def offered_set(self) -> ClaimSet:
        """What the lens, a term that makes a set, reads of the log."""
        out = self.reactor.eval(self.lens)
        if not isinstance(out, ClaimSet):
            raise TermError("a lens must make a set of claims")
        return out

    def pull_from(self, other: Peer) -> Report:
        have = self.reactor.log().df.select("id")
        theirs = ClaimSet(written(other.offered_set().general().df, "offered"))
        lacking = theirs.df.join(have, "id", "left_anti").count()
        offered = written(offer(theirs, have, self.reactor.vocabulary), "offer")
        travelling, taken = offered.count(), offered
        if self.admission is not None:
            able = offered.withColumn("ok", F.coalesce(predicate(self.admission), F.lit(False)))
            barred = able.where("not ok and bundle is not null").select("bundle").distinct()
            taken = able.where("ok").join(barred, "bundle", "left_anti").drop("ok")
        taken = written(taken.select(*COLUMNS), "taken")
        n = taken.count()
        outcomes = self.reactor.ingest(taken).get("") if n else None
        accepted = outcomes.where("status = 'accepted'").count() if outcomes is not None else 0
        rejected = outcomes.where("status = 'rejected'").count() if outcomes is not None else 0
        return Report(lacking, lacking - travelling, travelling - n, accepted, rejected)


def sync_both(a: Peer, b: Peer) -> int:
    """Pulls both ways until nothing moves; returns the rounds. Sets only grow, so this ends."""
    rounds = 0
    while True:
        rounds += 1
        if a.pull_from(b).accepted + b.pull_from(a).accepted == 0:
            return rounds


def manifest(author: str, timestamp: float, members: list[str], prior: str | None = None, intent: str | None = None, vocabulary: Vocabulary | None = None) -> dict:
    """A JSON claim that lists claims by id: a bundle's manifest."""
    v = vocabulary or Vocabulary()
    pointers = [{"role": v.member, "target": {"delta": m}} for m in members]
    if prior is not None:
        pointers.append({"role": v.role("txn.prior"), "target": {"delta": prior}})
    if intent is not None:
        pointers.append({"role": v.role("txn.intent"), "target": intent})
    return {"timestamp": timestamp, "author": author, "pointers": pointers}


def manifests(listed: DataFrame, author: str, timestamp: float, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Manifest claim rows of a frame ``(bundle, id)``, one for each bundle, with ``bundle``; a manifest lists its members in the order of their ids."""
    from assertia.operators.claims import pointer
    from assertia.sources.profile import content_id

    v = vocabulary or Vocabulary()
    grouped = listed.groupBy("bundle").agg(F.array_sort(F.collect_set("id")).alias("m"))
    pointers = F.transform("m", lambda x: pointer(F.lit(v.member), "d", value=x))
    made = grouped.select("bundle", F.lit(author).alias("author"), F.lit(float(timestamp)).alias("timestamp"), pointers.alias("pointers"))
    return made.select("bundle", content_id("author", "timestamp", "pointers").alias("id"), "author", "timestamp", "pointers", F.lit(None).cast("string").alias("sig"))
