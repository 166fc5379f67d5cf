"""Line dedup by a log-template tree, in DataFrame functions only.

A line's tokens (split at blanks; a token with a digit is a variable field, ``*``) lead down a tree of fixed depth: the token count, then the first
``LEAD`` tokens. Within a leaf, a token's support at a place is the number of (text, line) pairs of the leaf that have it there. A field's values
have less support than the words around it, whatever the field, so the places of a line are made variable in the order of their support: every
level at which support changes gives a template, as long as at most one place in ``OPEN`` is variable and at least one in ``FIXED`` stays a word.
The template with no variable place is the whole line; lines of fewer than ``MIN_TOKENS`` tokens have that one only, and only if they have a letter
and no token with a digit.

A template recurs if ``MIN_DOCS`` distinct texts have it; a whole line of more than ``LONG`` tokens recurs from ``LONG_DOCS`` texts on. Whatever stands beside a
line, it counts; texts that are equal but for blanks and blank lines are one text. Recurring lines are dropped from all documents but the one of least id and those whose
text equals that one's: exact copies of a document lose the same lines and stay copies, for near-duplicate detection to find.

Only leaves of enough (text, line) pairs are looked into, since all templates of a line lie below its leaf. Counts are partial sums and templates are 64-bit
hashes, so a line that a third of all rows share loads no single task; what may be broadcast are written tables, by Spark's own size threshold.

Not found: fields among the leading tokens unless they have a digit, fields in more than a quarter of a line, fields of several tokens whose number varies.

Defined results: null text stays null and an empty one empty; blank lines stay; repetitions within one document do not count; repeated rows are
one text; rows without an id are one vote and never the least; ties of texts under one least id go to the least text hash; empty tables give no rows; other
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assertia.llm.common import ROW, materialize, own, packed

LEAD, MIN_TOKENS, MIN_DOCS = 2, 4, 5
#: Whole lines of more than ``LONG`` tokens recur from ``LONG_DOCS`` texts on.
LONG, LONG_DOCS = 50, 2
#: At most one place in ``OPEN`` is made variable, and at least one in ``FIXED`` stays a word.
OPEN, FIXED = 4, 2


def _lines(text: Column) -> Column:
    """A text's lines, blanks collapsed (most texts have nothing to collapse, and one look tells)."""
    collapsed = F.when(text.rlike("[\\t\\r\\f\\x0B]|  "), F.regexp_replace(text, "[ \\t\\r\\f\\x0B]+", " ")).otherwise(text)
    return F.transform(F.split(collapsed, "\n", -1), lambda s: F.trim(s))


def _count(text: Column, byte: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(byte), F.lit("")))


def _masked(line: Column) -> Column:
    """Tokens with a digit as ``*``."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "*")).otherwise(line)


def _need(n: Column, min_docs: int) -> Column:
    """Texts in which a whole line of ``n`` tokens must stand."""
    return F.when(n > LONG, F.least(F.lit(LONG_DOCS), F.lit(min_docs))).otherwise(F.lit(min_docs))


def tree_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, th, same, pos, n, leaf, h, s)`` of every line that may recur: whose it is, its text's identity, its tokens, leaf, hash and (for long enough ones) normal form."""
    lines = docs.select(own(id_col).alias("doc"), F.xxhash64(own(text_col).cast("string")).alias("th"), _lines(own(text_col).cast("string")).alias("lines"))
    # equal for texts that are copies but for blanks and blank lines; found once a text, not once a line
    named = lines.select("doc", "th", "lines", F.xxhash64(F.filter("lines", lambda s: s != "")).alias("same"))
    rows = named.select("doc", "th", "same", F.posexplode("lines").alias("pos", "s")).withColumn("s", _masked(F.col("s")))
    placed = rows.withColumn("n", _count(F.col("s"), " ") + 1)
    able = placed.where((F.col("n") >= MIN_TOKENS) | (F.col("s").rlike("\\p{L}") & ~F.array_contains(F.split("s", " ", -1), "*")))
    return able.select("doc", "th", "same", "pos", "n", F.xxhash64("n", F.substring_index("s", " ", LEAD)).alias("leaf"), F.xxhash64("s").alias("h"), F.when(F.col("n") >= MIN_TOKENS, F.col("s")).alias("s"))


def level_templates(held: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(h, texts, t)``: templates with variable places of distinct lines ``(leaf, n, h, s, texts)``.

    A template is its leaf and the xor of its places' hashes; a running xor in the order of support gives those of all levels at once."""
    words = held.select("leaf", "n", "h", "texts", F.posexplode(F.split("s", " ", -1)).alias("i", "w"))
    places = words.select("leaf", "n", "h", "texts", F.xxhash64("i", "w").alias("p"), (F.col("w") != "*").cast("int").alias("word"))
    # less support than a template needs is as good as none
    often = places.groupBy("leaf", "p").agg(F.sum("texts").alias("c")).where(F.col("c") >= min_docs)
    known = places.join(often, ["leaf", "p"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    line = W.partitionBy("leaf", "h")
    so_far = line.orderBy("c").rangeBetween(W.unboundedPreceding, W.currentRow)
    total, opened = F.bit_xor("p").over(line), F.bit_xor("p").over(so_far)
    levels = known.select("leaf", "n", "h", "texts", "c", total.bitwiseXOR(opened).alias("key"), F.count(F.lit(1)).over(so_far).alias("open"), (F.sum("word").over(line) - F.sum("word").over(so_far)).alias("fixed"))
    fit = levels.where((F.col("open") * OPEN <= F.col("n")) & (F.col("fixed") * FIXED >= F.col("n"))).dropDuplicates(["leaf", "h", "c"])
    return fit.select("h", "texts", F.xxhash64("leaf", "key").alias("t"))


def candidates(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The written table ``(h, t, need)``: lines with those of their templates that may recur, and how many texts these need."""
    once = lines.groupBy("h", "n", "leaf", "same").agg(F.lit(1).alias("one"))
    counted = materialize(once.groupBy("h", "n", "leaf").agg(F.count(F.lit(1)).alias("texts")), "counted")
    exact = counted.where(F.col("texts") >= _need(F.col("n"), min_docs)).select("h", F.xxhash64(F.lit("whole"), "h").alias("t"), _need(F.col("n"), min_docs).alias("need"))
    hot = materialize(counted.where(F.col("n") >= MIN_TOKENS).groupBy("leaf").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= min_docs).select("leaf"), "leaves")
    held = lines.join(hot, "leaf", "left_semi").select("leaf", "n", "h", "s", "same").distinct().groupBy("leaf", "n", "h").agg(F.first("s").alias("s"), F.count(F.lit(1)).alias("texts"))
    found = materialize(level_templates(held, min_docs), "levels")
    live = found.groupBy("t").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= min_docs).select("t")
    return materialize(exact.unionByName(found.join(live, "t", "left_semi").select("h", "t", F.lit(min_docs).alias("need"))), "templates")


def recurring(spots: DataFrame, templates: DataFrame) -> DataFrame:
    """The written table ``(h, first, kept)``: for each line that has recurring templates, the keepers of these: their least document id and its text."""
    # a text votes by its least id, so that rows of one id, or of none, are one vote whatever their texts
    own_ = spots.groupBy("h", "same").agg(F.min("doc").alias("doc"))
    votes = own_.join(templates, "h").groupBy("t", "same").agg(F.min("doc").alias("first"), F.max("need").alias("need"))
    once = votes.groupBy("t", "first").agg(F.min("same").alias("same"), F.max("need").alias("need"))
    least = F.min(F.when(F.col("first").isNotNull(), F.struct("first", "same")))
    total = once.groupBy("t").agg(F.count(F.lit(1)).alias("votes"), least.alias("x"), F.max("need").alias("need"))
    keepers = materialize(total.where("votes >= need").select("t", F.col("x.first").alias("first"), F.col("x.same").alias("kept")), "keepers")
    return materialize(templates.join(keepers, "t").select("h", "first", "kept").distinct(), "recurring")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, names: Iterable[str] = ("__lines", "__dropped")) -> DataFrame:
    """``docs`` with recurring lines taken out of the text, and counts (columns ``names``, which ``docs`` must not have) of its lines and those dropped."""
    lines = materialize(tree_lines(docs, id_col, text_col), "lines")
    templates = candidates(lines, min_docs)
    some = materialize(templates.select("h").distinct(), "wanted")
    spots = materialize(lines.select("doc", "th", "same", "pos", "h").join(some, "h", "left_semi"), "spots")
    often = recurring(spots, templates)
    kept = F.col("doc").eqNullSafe(F.col("first")) | (F.col("same") == F.col("kept"))
    gone = spots.join(often, "h").where(~kept).groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))  # as many as one text has lines
    keyed = packed(docs, own(id_col).alias("id"), F.xxhash64(own(text_col).cast("string")).alias("th")).withColumn("k", F.xxhash64("id", "th"))
    joined = keyed.join(gone.select(F.xxhash64("doc", "th").alias("k"), "doc", F.col("th").alias("of"), "gone"), "k", "left")
    # two keys of one hash: the wrong one's lines stay
    mine = F.col("gone").isNotNull() & F.col("id").eqNullSafe(F.col("doc")) & (F.col("th") == F.col("of"))
    text = F.col(ROW)[text_col].cast("string")
    split = F.split(text, "\n", -1)
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone")), lambda p: F.get(split, p)), "\n")
    new = F.when(mine, left).otherwise(text)
    counts = [F.coalesce(_count(text, "\n") + 1, F.lit(0)).cast("long"), F.when(mine, F.size("gone")).otherwise(0).cast("long")]
    return joined.select(*((new if c == text_col else F.col(ROW)[c]).alias(c) for c in docs.columns), *(x.alias(n) for x, n in zip(counts, names, strict=True)))


def oracle_sql(min_docs: int = MIN_DOCS) -> str:
    """The same in DuckDB SQL over ``documents`` with unique ids, written from the definition: places counted one by one and templates as texts."""
    return rf"""
WITH b AS (SELECT doc_id, regexp_replace(text, '[ \t\r\f\x0B]+', ' ', 'g') AS text FROM documents),
x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') AS same, string_split(regexp_replace(text, '[^ \n]*[0-9][^ \n]*', '*', 'g'), chr(10)) AS m FROM b),
l AS (SELECT doc_id, same, pos, trim(m[pos], ' ') AS s FROM (SELECT doc_id, same, m, unnest(generate_series(1, len(m))) AS pos FROM x)),
w AS (SELECT *, string_split(s, ' ') AS w, len(string_split(s, ' ')) AS n FROM l),
line AS (SELECT doc_id, same, pos, s, n, w, (n || ' ' || array_to_string(w[1:{LEAD}], ' ')) AS leaf FROM w
  WHERE n >= {MIN_TOKENS} OR (regexp_matches(s, '\p{{L}}') AND NOT list_contains(w, '*'))),
held AS (SELECT leaf, n, s, any_value(w) AS w, count(DISTINCT same) AS texts FROM line GROUP BY leaf, n, s),
deep AS (SELECT * FROM held WHERE n >= {MIN_TOKENS} AND leaf IN (SELECT leaf FROM line GROUP BY leaf HAVING count(DISTINCT same) >= {min_docs})),
place AS (SELECT leaf, n, s, unnest(generate_series(1, n)) AS i, unnest(w) AS word, texts FROM deep),
support AS (SELECT leaf, i, word, sum(texts) AS c FROM place GROUP BY leaf, i, word),
known AS (SELECT leaf, n, s, i, word, CASE WHEN c >= {min_docs} THEN c ELSE 0 END AS c FROM place JOIN support USING (leaf, i, word)),
level AS (SELECT DISTINCT leaf, n, s, c AS v FROM known),
opened AS (SELECT leaf, n, s, v, list(CASE WHEN c <= v THEN NULL ELSE word END ORDER BY i) AS t, count(*) FILTER (WHERE c <= v) AS open, count(*) FILTER (WHERE c > v AND word <> '*') AS fixed
  FROM level JOIN known USING (leaf, n, s) GROUP BY leaf, n, s, v),
t AS (SELECT leaf, n, s, 'whole' AS t, CASE WHEN n > {LONG} THEN {min(LONG_DOCS, min_docs)} ELSE {min_docs} END AS need, s AS of FROM held
  UNION ALL SELECT leaf, n, s, 'level', {min_docs}, to_json(t)::VARCHAR FROM opened WHERE open * {OPEN} <= n AND fixed * {FIXED} >= n),
spot AS (SELECT DISTINCT line.doc_id, line.same, line.pos, t.leaf, t.t, t.of, t.need FROM line JOIN t USING (leaf, n, s)),
often AS (SELECT leaf, t, of, min(doc_id) AS first, arg_min(same, doc_id) AS kept FROM spot GROUP BY leaf, t, of HAVING count(DISTINCT same) >= any_value(need)),
gone AS (SELECT DISTINCT doc_id, pos FROM spot JOIN often USING (leaf, t, of) WHERE doc_id <> first AND same <> kept),
raw AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS s FROM documents),
left_ AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY pos) AS text FROM raw ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_.text, '') END AS text, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN left_ USING (doc_id) LEFT JOIN n USING (doc_id)
"""
