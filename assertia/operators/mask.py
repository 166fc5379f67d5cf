"""Negation: which claims of a set are negated by claims of the set that are not negated themselves.

Claims address what they negate by content, so the negations form a graph without cycles. If no negator is negated, one join settles
all. Else paths of claims with one negator each are first contracted by doubling, since along them the state just alternates; then rounds settle, from the leaves up,
targets with a standing negator (negated) and targets whose negators are all negated (standing), and drop the edges that are decided. Each round is a written table;
there are as many as a chain has claims with several negators, and a few. Ids that were never verified may form cycles; what
these leave unsettled counts as standing.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assertia.operators.claims import ClaimSet
from assertia.plans.tables import dealt, written

NEGATES = "negates"


def negations(claims: ClaimSet, trusted: Column | None = None) -> DataFrame:
    """``(root?, n, t)``: negator and target ids inside a set; only trusted negators count."""
    df = claims.df if trusted is None else claims.df.where(trusted)
    root = ["root"] if claims.rooted else []
    if claims.layout is not None:
        specs = [s for s in claims.layout if s.role == NEGATES and s.kind == "d"]
        parts = [df.select(*root, F.col("id").alias("n"), s.value().alias("t")).where("t is not null") for s in specs]
        if not parts:
            return df.select(*root, F.col("id").alias("n"), F.col("id").alias("t")).where(F.lit(False))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    else:
        targets = F.transform(F.filter("pointers", lambda p: (p["role"] == NEGATES) & (p["kind"] == "d")), lambda p: p["delta_ref"])
        out = df.select(*root, F.col("id").alias("n"), F.explode(targets).alias("t"))
    return out.distinct()


def negated(claims: ClaimSet, trusted: Column | None = None) -> DataFrame:
    """Keys ``(root?, id)`` of the negated claims."""
    root = ["root"] if claims.rooted else []
    edges = written(negations(claims, trusted), "negations")
    many, targets = edges.count(), edges.select(*root, F.col("t").alias("n")).distinct()
    if edges.join(dealt(targets, many), [*root, "n"], "left_semi").isEmpty():
        return dealt(edges.select(*root, F.col("t").alias("id")).distinct(), many)
    path = contracted(edges, root)
    # a negator is an end of its path, whose state or (odd) its opposite it has
    open_ = edges.join(dealt(path, many), [*root, "n"], "left").select(*root, F.coalesce("end", "n").alias("n"), F.coalesce("odd", F.lit(0)).alias("odd"), "t").distinct()
    fresh = written(open_.select(*root, "n").distinct().join(dealt(targets, many), [*root, "n"], "left_anti").withColumn("hit", F.lit(0)), "settled")
    open_, struck = written(open_, "open"), None
    while not fresh.isEmpty():
        known = written(open_.join(dealt(fresh, many), [*root, "n"], "left").withColumn("negates", F.lit(1) - F.col("hit").bitwiseXOR(F.col("odd"))), "known")
        votes = known.groupBy(*root, "t").agg(F.max("negates").alias("struck"), F.count("hit").alias("told"), F.count(F.lit(1)).alias("all"))
        decided = written(votes.where("struck = 1 or told = all").select(*root, F.col("t").alias("n"), F.coalesce("struck", F.lit(0)).alias("hit")), "decided")
        hit = decided.where("hit = 1").select(*root, F.col("n").alias("id"))
        struck = hit if struck is None else struck.unionByName(hit)
        # what is decided needs no edges any more, and a negator that strikes nothing no edge
        left = known.where("hit is null").select(*root, "n", "odd", "t").join(dealt(decided.select(*root, F.col("n").alias("t")), many), [*root, "t"], "left_anti")
        open_, fresh = written(left, "open"), decided
    return dealt(struck, many)


def contracted(edges: DataFrame, root: list[str]) -> DataFrame:
    """``(root?, n, end, odd)``: where a path of claims with one negator each leads from ``n``, and whether its length is odd. Each round doubles the length."""
    single = edges.groupBy(*root, "t").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("by")).where("c = 1")
    path = written(single.select(*root, F.col("t").alias("n"), F.col("by").alias("end"), F.lit(1).alias("odd")), "paths")
    # as many doublings as a path through all claims needs; what moves after that goes in a circle
    many = path.count()
    for _ in range(many.bit_length() + 1):
        on = path.select(*root, F.col("n").alias("end"), F.col("end").alias("further"), F.col("odd").alias("more"))
        longer = path.join(dealt(on, many), [*root, "end"], "left")
        path = written(longer.select(*root, "n", F.coalesce("further", "end").alias("end"), F.col("odd").bitwiseXOR(F.coalesce("more", F.lit(0))).alias("odd"), F.col("further").isNotNull().alias("moved")), "paths")
        still = path.where("moved").isEmpty()
        path = path.drop("moved")
        if still:
            break
    return path


def mask(claims: ClaimSet, policy: str, trusted: Column | None = None) -> ClaimSet:
    """``drop`` removes negated claims, ``annotate`` tags them."""
    claims = claims.plain()
    gone = negated(claims, trusted)
    if policy == "annotate":
        tagged = claims.df.join(gone.withColumn("negated", F.lit(True)), claims.keys, "left").withColumn("negated", F.coalesce("negated", F.lit(False)))
        return replace(claims, df=tagged, annotated=True)
    return replace(claims, df=claims.df.join(gone, claims.keys, "left_anti"))
