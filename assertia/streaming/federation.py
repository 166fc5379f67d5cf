"""Sets that meet: filtered union, offers, bundles and their completeness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assertia.operators import claims as sets
from assertia.operators.claims import ClaimSet
from assertia.plans.tables import written
from assertia.plans.vocabulary import Vocabulary


def federate(own: ClaimSet, other: ClaimSet, condition: Column) -> ClaimSet:
    """Own claims and the other's that a predicate admits; own copies win."""
    return sets.union(own, other.where(condition))


def members(claims: ClaimSet, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``(manifest, member)``: what each manifest lists."""
    role = (vocabulary or Vocabulary()).member
    if claims.layout is not None and not any(s.role == role for s in claims.layout):
        claims = claims.general()
    listed = F.transform(F.filter("pointers", lambda p: (p["role"] == F.lit(role)) & (p["kind"] == "d")), lambda p: p["delta_ref"])
    return claims.df.select(F.col("id").alias("manifest"), F.explode(listed).alias("member")).distinct()


def completeness(claims: ClaimSet, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``(manifest, members, held, complete)`` of every manifest."""
    listed = members(claims, vocabulary)
    held = claims.df.select(F.col("id").alias("member"), F.lit(1).alias("here"))
    joined = listed.join(held, "member", "left").groupBy("manifest").agg(F.count(F.lit(1)).alias("members"), F.count("here").alias("held"))
    return joined.withColumn("complete", F.col("members") == F.col("held"))


@F.pandas_udf(T.BooleanType())
def signed_right(author: pd.Series, id: pd.Series, sig: pd.Series) -> pd.Series:
    """Whether a signature is its author's over the id; null where there is none."""
    from assertia.functions.ed25519 import verify_id

    return pd.Series([None if s is None else verify_id(a, i, s) for a, i, s in zip(author, id, sig, strict=True)], dtype=object)


def offer(theirs: ClaimSet, have: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """What a pull from ``theirs`` brings to a holder of the ids ``have``: missing claims that are signed, or that a signed manifest
    covers; ``bundle`` is that manifest (the manifest itself belongs to its bundle), null for loose ones."""
    lacking = theirs.plain().df.join(have.select("id"), "id", "left_anti")
    signed = theirs.df.where(F.col("sig").isNotNull()).where(signed_right("author", "id", "sig"))
    listed = members(theirs, vocabulary).join(signed.select(F.col("id").alias("manifest")), "manifest", "left_semi")
    cover = listed.groupBy(F.col("member").alias("id")).agg(F.min("manifest").alias("bundle"))
    heads = listed.select(F.col("manifest").alias("id"), F.col("manifest").alias("bundle")).distinct()
    cover = cover.unionByName(heads).groupBy("id").agg(F.min("bundle").alias("bundle"))
    good = signed.select("id", F.lit(True).alias("own"))
    return lacking.join(cover, "id", "left").join(good, "id", "left").where("bundle is not null or own").drop("own")


def pull(own: ClaimSet, theirs: ClaimSet, admit: Column | None = None, vocabulary: Vocabulary | None = None) -> ClaimSet:
    """Own claims with the admitted part of an offer; a bundle enters as a whole or not at all."""
    offered = offer(theirs, own.df.select("id"), vocabulary)
    if admit is not None:
        offered = offered.withColumn("ok", F.coalesce(admit, F.lit(False)))
        barred = offered.where(~F.col("ok")).where("bundle is not null").select("bundle").distinct()
        offered = offered.where("ok").join(barred, "bundle", "left_anti").drop("ok")
    return sets.union(own, ClaimSet(offered.select(*sets.COLUMNS)))


#: Bytes of a part that one task hashes, a power of two of the hash function's chunks, and subtrees that one task merges.
PART, FAN = 1 << 20, 1 << 14


def digest(claims: ClaimSet) -> str:
    """The address of a set's sorted ids, as the canonical list of them.

    The hash function is a tree: the sorted ids get their places in the list's bytes, tasks hash parts of a mebibyte, and subtrees are merged by
    further tasks until one round fits the driver. An empty set has the empty list's address; equal ids count once.
    """
    from assertia.functions.blake3 import CHUNK, MULTIHASH, content_address, merged_value, part_value
    from assertia.functions.canon import encode, head

    spark = claims.df.sparkSession
    size = F.octet_length("id")
    long = size + F.when(size < 24, 1).when(size < 1 << 8, 2).when(size < 1 << 16, 3).otherwise(5)
    ids = claims.df.select("id").distinct().orderBy("id").select("id", long.cast("long").alias("size"), F.spark_partition_id().alias("part"))
    ids = written(ids, "digest-ids")
    parts = ids.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).orderBy("part").collect()  # one row a partition
    start = head(4, sum(p.n for p in parts))
    total = len(start) + sum(p["size"] for p in parts)
    if total <= PART:
        return content_address(encode([r.id for r in ids.orderBy("id").collect()]))
    at, places = len(start), []
    for p in parts:
        places.append((p.part, at))
        at += p["size"]
    before = F.sum("size").over(W.partitionBy("part").orderBy("id").rowsBetween(W.unboundedPreceding, -1))
    placed = ids.join(F.broadcast(spark.createDataFrame(places, "part int, base long")), "part").select("id", "size", (F.col("base") + F.coalesce(before, F.lit(0))).alias("at"))
    blocks = F.sequence(F.floor(F.col("at") / PART), F.floor((F.col("at") + F.col("size") - 1) / PART))

    def hashed(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        out = bytearray(start if block == 0 else b"")
        for i, o in pdf[["id", "at"]].sort_values("at").itertuples(index=False):
            out += encode(i)[max(0, block * PART - o) : max(0, (block + 1) * PART - o)]
        return pd.DataFrame({"block": [block], "value": [part_value(bytes(out), block * (PART // CHUNK))]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(pdf["up"].iloc[0])], "value": [merged_value(list(pdf.sort_values("block")["value"]), False)]})

    values = written(placed.withColumn("block", F.explode(blocks)).groupBy("block").applyInPandas(hashed, "block long, value binary"), "digest-values")
    n = -(-total // PART)
    while n > FAN:
        values = written(values.withColumn("up", F.floor(F.col("block") / FAN)).groupBy("up").applyInPandas(merged, "block long, value binary"), "digest-values")
        n = -(-n // FAN)
    return (MULTIHASH + merged_value([bytes(r.value) for r in values.orderBy("block").collect()], True)).hex()  # at most FAN values
