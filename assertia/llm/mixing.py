"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's repetition rate is its target share of the corpus's characters over the characters it has. Each document gets a uniform
number from a hash of its id and the seed, and as many copies as the inverted Poisson distribution of its source's rate has at
that number; copies are dealt to partitions and sorted by a hash of their own, which is a global shuffle. The mean size of the
mixture is the size of the corpus.

A source's cumulative probabilities are computed once, from 12 deviations and 30 below its rate to as many above, beyond which less than 1e-30 lies: 60 numbers and 24 for
each unit of the rate's root, so that a rate of a million takes 24,060. Rates and distributions are written tables: their size is known when documents meet
them, and Spark broadcasts them by its own threshold, so that documents move only once, in the final deal.

Weights: ``weights`` names targets; sources not named share what is left of 1 by ``characters ** alpha``.

Defined results: a null source is a source of its own; null and empty texts weigh nothing but are copied at their source's rate; a source without
characters, or of weight 0, has rate 0; repeated rows of one id get the same count; a null id hashes as the empty text; an empty table
gives no rows; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assertia.llm.common import materialize, own, packed, unpacked

ALPHA = 0.5
SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 over the parts as a number in [0, 1)."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def log_factorial(k: Column) -> Column:
    """log k! by Stirling's series at k + 10, and the ten factors between taken off; exact to 1e-12."""
    z = k + F.lit(10.0)
    above = (z + 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    for i in range(1, 11):
        above = above - F.log(k + F.lit(float(i)))
    return above


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, *, source_col: str = "source", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """The written table ``(source, chars, rate, base, cdf)``; cdf[i] is the probability of at most base + i copies."""
    named = weights or {}
    if any(w < 0 for w in named.values()) or sum(named.values()) > 1 + 1e-9:
        raise ValueError("weights are shares of 1")
    sizes = materialize(docs.groupBy(own(source_col).alias("source")).agg(F.coalesce(F.sum(F.length(own(text_col))), F.lit(0)).alias("chars")), "sizes")
    given = F.coalesce(F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.col("source").cast("string")], F.lit(None).cast("double")) if named else F.lit(None).cast("double")
    sized = sizes.withColumn("given", given).withColumn("pull", F.when(F.col("given").isNull(), F.pow(F.col("chars").cast("double"), F.lit(alpha))).otherwise(F.lit(0.0)))
    total = sized.agg(F.sum("chars").alias("all_chars"), F.sum("pull").alias("all_pull"))
    left = 1.0 - sum(named.values())
    weight = F.coalesce("given", F.when(F.col("all_pull") > 0, F.lit(left) * F.col("pull") / F.col("all_pull")).otherwise(F.lit(0.0)))
    rates = sized.crossJoin(F.broadcast(total))  # one row
    rate = F.when(F.col("chars") > 0, weight * F.col("all_chars") / F.col("chars")).otherwise(F.lit(0.0))
    rates = materialize(rates.select(F.struct("source").alias("s"), "chars", rate.alias("rate")), "rates")  # a struct is never null, even of a null source
    spread = 12 * F.sqrt("rate") + 30
    low, high = F.greatest(F.lit(0), F.floor(F.col("rate") - spread)).cast("long"), F.ceil(F.col("rate") + spread).cast("long")
    each = rates.where("rate > 0").select("s", "rate", low.alias("base"), F.explode(F.sequence(low, high)).alias("k"))
    k = F.col("k").cast("double")
    chance = F.exp(k * F.log("rate") - F.col("rate") - log_factorial(k))
    summed = each.select("s", "base", "k", F.sum(chance).over(W.partitionBy("s").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("p"))
    cdf = summed.groupBy("s").agg(F.min("base").alias("base"), F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("cdf"))
    found = rates.join(cdf, "s", "left").select("s.source", "chars", "rate", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("cdf", F.array(F.lit(1.0))).alias("cdf"))
    return materialize(found, "distributions")


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", alpha: float = ALPHA, seed: str = SEED, names: Iterable[str] = ("__copy", "__place")) -> DataFrame:
    """``docs`` with the columns ``names`` (which it must not have): the copy (1 up to the document's count) and the uniform number it is shuffled by."""
    rates = source_rates(docs, weights, source_col=source_col, text_col=text_col, alpha=alpha).select("source", "base", "cdf")
    rows = packed(docs, own(id_col).alias("id"), own(source_col).alias("of"))
    joined = rows.join(rates, F.col("of").eqNullSafe(F.col("source")))
    u = uniform(F.col("id"), F.lit(seed))
    count = F.col("base") + F.size(F.filter("cdf", lambda p: p <= u))
    copies = joined.select("row", "id", count.cast("int").alias("n")).where("n > 0").select("row", "id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    copy, place = names
    return unpacked(copies, F.col("copy").alias(copy), uniform(F.col("id"), F.col("copy"), F.lit(seed)).alias(place))


def shuffled(copies: DataFrame, place: str = "__place") -> DataFrame:
    """A global shuffle: dealt by a hash of the place, then sorted by it."""
    return copies.repartition(own(place)).sortWithinPartitions(own(place))


def oracle_sql(alpha: float = ALPHA, seed: str = SEED) -> str:
    """The mixture of ``documents`` without named weights, in DuckDB SQL."""
    return f"""
WITH s AS (SELECT source, coalesce(sum(length(text)), 0) AS chars FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN chars > 0 THEN pow(chars, {alpha}) / (SELECT sum(pow(chars, {alpha})) FROM s) * (SELECT sum(chars) FROM s) / chars ELSE 0 END AS rate FROM s),
k AS (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate)) + 30 AS BIGINT))) AS k FROM r WHERE rate > 0),
c AS (SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p FROM k),
d AS (SELECT doc_id, source, text, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|{seed}'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
n AS (SELECT doc_id, d.source, any_value(text) AS text, count(*) AS n FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND p <= u GROUP BY doc_id, d.source)
SELECT doc_id, source, text, copy::INTEGER AS copy, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || copy || '|{seed}'), 1, 13))::BIGINT / 4503599627370496.0 AS place
FROM (SELECT doc_id, source, text, unnest(generate_series(1, n)) AS copy FROM n)
"""
