"""MinHash near-duplicates with tensored banding.

Two collections of ``m`` sub-keys, each of ``h`` minhashes, are computed per document; every pair of a sub-key of the first and one of
the second makes a table key. ``m * m`` tables of ``2 * h`` rows thus need ``2 * m * h`` minhashes instead of ``2 * m * m * h``. At
similarity 0.8 and the defaults, a pair shares a key with probability 0.998.

1. One pass over the texts writes each row's shingle count, set key and sub-keys. Rows of equal sets are one node from here on.
2. Each bucket links its members to its least node; these candidate links are confirmed on full sets.
3. Where a bucket still holds nodes of different components, the nodes outside its largest component are compared with all its
   nodes, in blocks, inside tasks that emit confirmed links only. Buckets that share components form a group; a group is compared as one where that moves
   fewer rows than its buckets one by one (near copies share dozens of buckets; texts that share a footer share few).
4. Components of the confirmed links give each row the least document id it can reach.

No candidate pair is dropped and no bucket is capped; steps 2 and 3 emit rows in proportion to nodes and links, not to
pairs, and the work of step 3 is bounded by candidate pairs, those that share a bucket. Hot buckets and hot sets are only aggregated with partial sums and joined (splittable by skew handling).

Defined results: a null text or one without words has an empty set and is linked with nothing; fewer words than a shingle
are one shingle; repeated rows and repeated ids are one node if their sets are equal; a null id reaches the least non-null id; an
empty table gives no rows; other columns, whatever their names, are not read by ``classes`` and are kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assertia.llm.common import column, dealt, materialize, packed, slices, texts, unpacked
from assertia.llm.common import own as named
from assertia.llm.components import components

SUBKEYS, ROWS, SIMILARITY_PERCENT = 10, 3, 80
BLOCK = 512
CACHE_WORDS = 400_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _FOLD
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``size``-word shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    with np.errstate(over="ignore"):
        s = _mixed(h[: len(h) - size + 1] + _MIX * np.uint64(size))
        for i in range(1, size):
            s = _mixed(s * _MIX + h[i : len(h) - size + 1 + i])
    return np.unique(s)


def sub_keys(shingles: np.ndarray, multipliers: np.ndarray, rows: int) -> np.ndarray:
    """Sub-keys of a non-empty set: minhashes by multiply-and-add, folded ``rows`` at a time with the sub-key's number."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            part = shingles[i : i + 4096]
            np.minimum(least, (part[None, :] * multipliers[:, :1] + multipliers[:, 1:]).min(axis=1), out=least)
        keys = np.arange(1, len(least) // rows + 1, dtype=np.uint64) * _MIX
        for column_ in least.reshape(-1, rows).T:
            keys = _mixed(keys * _MIX + column_)
    return keys


def multipliers_of(subkeys: int, rows: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, (2 * subkeys * rows, 2), np.uint64) | np.array([1, 0], np.uint64)


def signatures(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, subkeys: int, rows: int) -> DataFrame:
    """The written table ``(id, th, n, set_key, subs)``; th is a hash of the text, which with the id names a row's content."""
    id_type = docs.schema[id_col].dataType.simpleString()
    multipliers = multipliers_of(subkeys, rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "t"):
            counts, keys, subs = [], [], []
            for text in texts(batch, "t"):
                s = shingle_set(text, shingle, hashes)
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                subs.append(sub_keys(s, multipliers, rows).astype(np.int64) if len(s) else None)
            cols = [pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(subs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "th"), *cols], ["id", "th", "n", "set_key", "subs"])

    texts_ = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("t"))
    return materialize(texts_.mapInArrow(run, f"id {id_type}, th long, n long, set_key binary, subs array<long>"), "signatures")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (small + large - common)


def _buckets(nodes: DataFrame, subkeys: int, *extra: str) -> DataFrame:
    first = nodes.select("node", *extra, F.explode(F.slice("subs", 1, subkeys)).alias("a"), F.slice("subs", subkeys + 1, subkeys).alias("bs"))
    return first.select("node", *extra, "a", F.explode("bs").alias("b")).select(F.xxhash64("a", "b").alias("key"), "node", *extra)


def _full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, many: int, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """The written table ``(node, set)`` of the wanted nodes, ``many`` at most, made of one document's text each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array([shingle_set(t, shingle, hashes).tobytes() for t in texts(batch, "t")], pa.binary())], ["node", "set"])

    reps = nodes.join(wanted, "node", "left_semi").select(F.xxhash64("rep.id", "rep.th").alias("k"), F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth"), "node")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("t")).withColumn("k", F.xxhash64("id", "th"))
    found = rows.join(dealt(reps, many), "k").where(F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))).select("node", "t")
    return materialize(found.mapInArrow(run, "node long, set binary").dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, many: int, percent: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_ = [[np.frombuffer(x, np.uint64) for x in column(batch, c).to_pylist()] for c in ("su", "sv")]
            good = pa.array([_similar(a, b, percent) for a, b in zip(*sets_, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "u").filter(good), column(batch, "v").filter(good)], ["u", "v"])

    su, sv = (dealt(sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}")), many) for c in "uv")
    both = pairs.join(su, "u").join(sv, "v")
    return both.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _rest(candidates: DataFrame, sets: DataFrame, many: int, percent: int) -> DataFrame:
    """Confirmed links between different components of a unit: ``candidates`` are ``(unit, node, comp, minor)``, ``many`` at most. Blocks of minor nodes
    meet blocks of all nodes of their unit; a task emits one link for each minor node and component."""

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        rows = [np.frombuffer(x, np.uint64) for x in right["set"]]
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(rows)), sizes)[order]
        comps, nodes, out = right.comp.to_numpy(), right.node.to_numpy(), []
        for node, comp, raw in zip(left.node, left.comp, left["set"], strict=True):
            own = np.frombuffer(raw, np.uint64)
            a, b = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
            spans = b - a
            at = np.repeat(a - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
            common = np.bincount(owner[at], minlength=len(rows))
            good = (100 * common >= percent * (sizes + len(own) - common)) & (comps != comp)
            for c in np.unique(comps[good]):
                out.append((node, nodes[np.flatnonzero(good & (comps == c))[0]]))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    sized = candidates.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(1 << 30)))
    blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).alias("all_blocks"), F.greatest(F.lit(1), F.ceil(F.sum("minor") / BLOCK)).alias("minor_blocks")
    counts = materialize(sized.groupBy("unit").agg(*blocks), "units")
    placed = sized.join(dealt(counts, many), "unit").join(dealt(sets, many), "node")
    minors = placed.where("minor = 1").select("unit", F.pmod("slot", "minor_blocks").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_blocks") - 1)).alias("y"), F.lit(0).alias("side"), "node", "comp", "set")
    everyone = placed.select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("minor_blocks") - 1)).alias("x"), F.pmod("slot", "all_blocks").alias("y"), F.lit(1).alias("side"), "node", "comp", "set")
    return minors.unionByName(everyone).groupBy("unit", "x", "y").applyInPandas(block, "u long, v long")


def _units(open_: DataFrame, many: int) -> DataFrame:
    """``(unit, node, comp, minor)``: what is compared with each other, of the open buckets' members ``(key, node, comp, least)``. A unit is a group of
    buckets, or one bucket, whichever moves fewer rows for the group."""
    groups = components(open_.select(F.col("comp").alias("u"), F.col("least").alias("v"))).select(F.col("node").alias("comp"), F.col("comp").alias("grp"))
    members = materialize(open_.select("key", "node", "comp").join(groups, "comp"), "members")

    def parted(units: DataFrame) -> DataFrame:
        sizes = units.groupBy("unit", "comp").agg(F.count(F.lit(1)).alias("c"))
        main = sizes.groupBy("unit").agg(F.max_by("comp", F.struct("c", F.col("comp"))).alias("main"), F.sum("c").alias("all"), (F.sum("c") - F.max("c")).alias("rest"))
        moved = F.col("rest") * F.ceil(F.col("all") / BLOCK) + F.col("all") * F.greatest(F.lit(1), F.ceil(F.col("rest") / BLOCK))
        main = materialize(main.select("unit", "main", moved.alias("moved")), "mains")
        return units.join(dealt(main, many), "unit").withColumn("minor", (F.col("comp") != F.col("main")).cast("int"))

    by_group = parted(members.select(F.xxhash64(F.lit("group"), "grp").alias("unit"), "grp", "node", "comp").distinct())
    by_bucket = parted(members.select(F.xxhash64(F.lit("bucket"), "key").alias("unit"), "grp", "node", "comp"))
    one = by_group.select("grp", "unit", "moved").distinct().select("grp", F.col("moved").alias("as_one"))
    each = by_bucket.select("grp", "unit", "moved").distinct().groupBy("grp").agg(F.sum("moved").alias("as_buckets"))
    way = materialize(one.join(dealt(each, many), "grp").select("grp", (F.col("as_buckets") < F.col("as_one")).alias("bucketwise")), "ways")
    columns = ("unit", "node", "comp", "minor")
    way = dealt(way, many)
    return by_group.join(way.where("not bucketwise"), "grp").select(*columns).unionByName(by_bucket.join(way.where("bucketwise"), "grp").select(*columns))


def links(docs: DataFrame, nodes: DataFrame, *, id_col: str, text_col: str, shingle: int, subkeys: int, percent: int) -> DataFrame:
    """Confirmed links between nodes, enough to connect whatever confirmed candidate pairs connect."""
    keys, n = _buckets(nodes, subkeys), nodes.count()
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    star = materialize(keys.join(dealt(shared, n * subkeys**2), "key").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct(), "star")
    wanted = star.select(F.col("u").alias("node")).unionByName(star.select(F.col("v").alias("node"))).distinct()
    many = min(n, 2 * star.count())
    wanted = dealt(wanted, many)
    sets = _full_sets(docs, nodes, wanted, many, id_col=id_col, text_col=text_col, shingle=shingle)
    first = materialize(_confirmed(star, sets, many, percent), "links")
    label = components(first)
    # what shares a bucket but no component yet
    inside = nodes.join(wanted, "node", "left_semi").join(label, "node", "left").select("node", "subs", F.coalesce("comp", "node").alias("comp"))
    keys = _buckets(inside, subkeys, "comp")
    mixed = keys.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("key", "least")
    mixed = materialize(mixed, "mixed")
    open_ = materialize(keys.join(dealt(mixed, mixed.count()), "key").select("key", "node", "comp", "least").distinct(), "open")
    many = open_.count()
    second = materialize(_rest(_units(open_, many), sets, many, percent), "links")
    return first.unionByName(second)


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = SIMILARITY_PERCENT, subkeys: int = SUBKEYS, rows: int = ROWS) -> DataFrame:
    """``(id, th, n_shingles, component_id, stays)`` of every row; stays marks the least ``(id, th)`` of each component."""
    sig = signatures(docs, id_col=id_col, text_col=text_col, shingle=shingle, subkeys=subkeys, rows=rows)
    full = sig.where("set_key is not null")
    least = full.groupBy("set_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep"), F.first("subs").alias("subs"))
    nodes = materialize(least.withColumn("node", F.monotonically_increasing_id()), "nodes")
    label = components(links(docs, nodes, id_col=id_col, text_col=text_col, shingle=shingle, subkeys=subkeys, percent=percent))
    own = materialize(nodes.select("node", "set_key", "rep").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "labels")
    best = materialize(own.groupBy("comp").agg(F.min("rep").alias("best")), "best")  # written, so that the join on a hot component can be split
    n = own.count()
    of_set = own.join(dealt(best, n), "comp").select("set_key", "best")
    out = sig.select("id", "th", "n", "set_key").join(dealt(of_set, n), "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("best.id"))
    stays = F.col("set_key").isNull() | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("th") == F.col("best.th")))
    return out.select("id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), stays.alias("stays"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The rows that stay: one of each component, and every row without words; columns as they came."""
    staying = classes(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent).where("stays").groupBy("id", "th", "n_shingles").count()
    staying = staying.select(F.xxhash64("id", "th").alias("k"), F.col("id").alias("of"), F.col("th").alias("of_th"), F.when(F.col("n_shingles") > 0, 1).otherwise(F.col("count")).alias("copies"))
    rows = packed(docs, named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("th")).withColumn("k", F.xxhash64("id", "th"))
    found = rows.join(dealt(staying), "k").where(F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")))
    single = found.where("copies = 1").dropDuplicates(["k", "of", "of_th"])
    return unpacked(single.unionByName(found.where("copies > 1")))
