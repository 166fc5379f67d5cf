"""The registered queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assertia.llm import license_scan, line_dedup, mixing
from assertia.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assertia.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assertia.llm.media import measured_columns, store

    index, folder = store(table(spark, sf_dir, "documents"))
    return measured_columns(index, folder).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assertia.llm.common import bucket_of
    from assertia.llm.toxicity import THRESHOLD, toxicity

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity(docs, labels, bucket_of(labels["doc_id"], 3) != 1)
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assertia.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assertia.llm.common import bucket_of
    from assertia.llm.language_id import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    found = identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__unsure").alias("ambiguous"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Per-conversation digests of formatted turns."""
    from assertia.llm.chat import canonical, format_turns, read_back, turn_records

    keys = ["conv_id", "turn"]
    return read_back(format_turns(canonical(turn_records(conversations), "record", keys), keys))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return format_conversations(rows.unionByName(planted))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assertia.llm.mixing import replicate, shuffled

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return shuffled(replicate(docs)).withColumnsRenamed({"__copy": "copy", "__place": "place"})


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assertia.llm.line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"))


def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assertia.llm.near_dup import classes

    found = classes(table(spark, sf_dir, "documents"), shingle=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from assertia.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_media_columns": op2_media_columns,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_source_mixing": op7_source_mixing,
    "op8_minhash_near_dup": op8_minhash_near_dup,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.oracle_sql(),
    "op7_source_mixing": mixing.oracle_sql(),
    "op9_line_dedup": line_dedup.oracle_sql(),
    "op4_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w, row_number() OVER () AS r FROM documents),
bw AS (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS s, least(13, len(w)) AS n FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, spot.n, item_id FROM spot JOIN win USING (s) WHERE spot.n = win.n),
spots AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r),
place AS (SELECT r, unnest(generate_series(1, len(w))) AS p, unnest(w) AS t FROM dw),
freq AS (SELECT t, count(*) AS f FROM place GROUP BY t),
tm AS (SELECT DISTINCT s, n, unnest(generate_series(0, n - 1)) AS o, unnest(string_split(s, ' ')) AS t FROM win),
rare AS (SELECT s, any_value(n) AS n, arg_min(o, f) AS o, arg_min(t, f) AS t FROM tm JOIN freq USING (t) GROUP BY s HAVING count(*) = any_value(n)),
cand AS (SELECT DISTINCT s, n, r, p - o + k AS st FROM rare JOIN place USING (t), (SELECT unnest([-2, -1, 0, 1, 2]) AS k)),
loose AS (SELECT s, cand.r AS r FROM cand JOIN tm USING (s, n) JOIN place ON place.r = cand.r AND place.t = tm.t AND place.p BETWEEN st + tm.o - 2 AND st + tm.o + 2 GROUP BY s, cand.r, st HAVING count(DISTINCT tm.o) = any_value(cand.n)),
near AS (SELECT r, count(DISTINCT item_id) AS n_near FROM loose JOIN win USING (s) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(x, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM dw LEFT JOIN spots USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)
""",
}
