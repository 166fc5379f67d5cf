"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the corpus into blocks of whole documents and writes, per block, every term's postings: ascending positions in
the block's concatenated words, with a gap between documents that no phrase can cross. The index is of the corpus alone and serves any benchmark. ``search`` brings test
phrases to every block in bounded chunks; within a block a phrase starts from its rarest term's list and intersects the
others' lists, each moved by the term's offset in the phrase, in order of rarity. Exact phrases need offsets to agree; a
proximity match is a place at which each term lies at most ``slack`` words away from its own place.

A block is one task's work and is bounded by words (a longer document is a block of its own); nothing is shuffled by term, so a very
frequent word or passage loads no single task. The benchmark streams through the driver: test phrases reach tasks in chunks of at most ``CHUNK_WINDOWS``
phrases, each chunk's matches are written and its broadcast is dropped before the next; more chunks mean more passes over the index, not a larger broadcast.

Defined results: null or wordless text has no words, no hits and is not contaminated; repeated rows and repeated ids are
rows of their own; an item without words matches nothing; equal windows of several items count for each of them; empty tables
give no rows (documents) or no hits (benchmark); other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assertia.llm.common import column, materialize, slices, texts

WINDOW = 13
#: Words in a block, at which it is closed; phrases in a chunk; words by which a term of a proximity match may be off.
BLOCK_WORDS, CHUNK_WINDOWS, SLACK = 400_000, 20_000, 2
#: Bytes of words: digits, ASCII letters (lower-cased) and everything beyond ASCII; the rest separates.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def item_windows(text: bytes, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Distinct runs of ``size`` words; a shorter item that has words is one run."""
    w = words(text)
    return list(dict.fromkeys(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))) if w else []


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gap: int = 64) -> DataFrame:
    """The written index: a row for each block with its documents' ids (an array), starts and word counts, its terms, and all postings as one run of
    differences, ``cuts`` telling where each term's begin; a term's first is its position itself."""
    id_type = docs.schema[id_col].dataType

    def block(ids: list, id_arrow: pa.DataType, lengths: list[int], held: list[bytes]) -> pa.RecordBatch:
        counts = np.array(lengths, np.int64)
        starts = np.cumsum(np.r_[0, counts[:-1] + gap])
        place = np.arange(len(held)) + np.repeat(starts - np.cumsum(np.r_[0, counts[:-1]]), counts)
        coded = pa.array(held, pa.binary()).dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code.astype(np.uint16) if len(coded.dictionary) <= 1 << 16 else code, kind="stable")
        code, place = code[order], place[order]
        cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        steps = np.diff(place, prepend=0)
        steps[cuts] = place[cuts]
        blobs = (starts, counts, np.r_[cuts, len(code)], steps.astype(np.uint32))
        row = [pa.array([ids], pa.list_(id_arrow)), *(pa.array([x.tobytes()], pa.binary()) for x in blobs), pa.ListArray.from_arrays(pa.array([0, len(cuts)], pa.int32()), coded.dictionary)]
        return pa.RecordBatch.from_arrays(row, ["ids", "starts", "counts", "cuts", "postings", "terms"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, held = [], [], []
        for batch in slices(batches, "t"):
            for i, text in zip(column(batch, "i").to_pylist(), texts(batch, "t"), strict=True):
                w = words(text)
                if ids and len(held) + len(w) > BLOCK_WORDS:
                    yield block(ids, column(batch, "i").type, lengths, held)
                    ids, lengths, held = [], [], []
                ids.append(i)
                lengths.append(len(w))
                held += w
            last = column(batch, "i").type
        if ids:
            yield block(ids, last, lengths, held)

    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *T._parse_datatype_string("starts binary, counts binary, cuts binary, postings binary, terms array<binary>").fields])
    return materialize(docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema), "postings")


def match_phrase(lists: Mapping[bytes, np.ndarray], phrase: tuple[bytes, ...], slack: int = 0) -> np.ndarray:
    """Ascending block positions at which the phrase begins: the rarest term's list, moved to the phrase's start (and, with slack, to every start that lets it
    be off), kept where each other term's moved list has a position within ``slack``. Which term is the rarest does not matter for the result."""
    found = sorted((len(lists[w]), o, w) for o, w in enumerate(phrase))

    def kept(starts: np.ndarray, offset: int, word: bytes, off: int) -> np.ndarray:
        other = lists[word] - offset
        at = np.searchsorted(other, starts - off)
        return starts[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= starts + off)]

    _, offset, word = found[0]
    starts = lists[word] - offset
    if slack:
        # two terms that are each off by slack are off by twice as much from each other
        for _, o, w in found[1:]:
            if not len(starts):
                return starts
            starts = kept(starts, o, w, 2 * slack)
        starts = np.unique(starts[:, None] + np.arange(-slack, slack + 1))
    for _, o, w in found[1:]:
        if not len(starts):
            break
        starts = kept(starts, o, w, slack)
    return starts


class Postings(dict):
    """A block's lists of wanted terms, unpacked when first asked for."""

    def __init__(self, terms: pa.Array, wanted: pa.Array, cuts: bytes, postings: bytes):
        super().__init__()
        self.cuts, self.steps = np.frombuffer(cuts, np.int64), np.frombuffer(postings, np.uint32)
        at = np.flatnonzero(pc.is_in(terms, value_set=wanted).to_numpy(zero_copy_only=False)) if len(terms) else np.zeros(0, np.int64)
        self.at = dict(zip(terms.take(pa.array(at)).to_pylist(), at.tolist(), strict=True)) if len(at) else {}

    def __missing__(self, term: bytes) -> np.ndarray:
        k = self.at[term]
        value = self[term] = np.cumsum(self.steps[self.cuts[k] : self.cuts[k + 1]], dtype=np.int64)
        return value


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of words, sorted and joined where they touch."""
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def search(index: DataFrame, phrases: dict[tuple[bytes, ...], list[str]], *, slack: int = 0) -> DataFrame:
    """One pass of a chunk of phrases (each with its items' names) over the index, written: ``(id, spans, items, near)`` for each document row that has a match, spans being
    joined runs ``start, end`` of its words inside exact matches, items those of exact matches, and near those of proximity matches."""
    share = index.sparkSession.sparkContext.broadcast(list(phrases.items()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tried: dict[bytes, list] = defaultdict(list)  # a phrase is tried in a block only if its longest word is there, then all others
        for phrase, of in share.value:
            tried[max(phrase, key=len)].append((phrase, frozenset(phrase), of))
        wanted = pa.array(sorted({t for phrase, _ in share.value for t in phrase}), pa.binary())
        for batch in batches:
            for b in range(batch.num_rows):
                ids = column(batch, "ids")[b].values
                starts, counts = (np.frombuffer(column(batch, c)[b].as_py(), np.int64) for c in ("starts", "counts"))
                lists = Postings(column(batch, "terms")[b].values, wanted, *(column(batch, c)[b].as_py() for c in ("cuts", "postings")))
                spans: dict[int, list] = defaultdict(list)
                items: dict[int, set] = defaultdict(set)
                near: dict[int, set] = defaultdict(set)
                for t in tried.keys() & lists.at.keys():
                    for phrase, terms, of in tried[t]:
                        if not terms <= lists.at.keys():
                            continue
                        loose = match_phrase(lists, phrase, slack)
                        if not len(loose):
                            continue
                        # a start may lie up to slack before its document's first word
                        for d in np.unique(np.searchsorted(starts, loose + slack, side="right") - 1).tolist():
                            near[d].update(of)
                        for s in match_phrase(lists, phrase).tolist() if slack else loose.tolist():
                            d = int(np.searchsorted(starts, s, side="right")) - 1
                            spans[d].append((s - int(starts[d]), s - int(starts[d]) + len(phrase)))
                            items[d].update(of)
                at = sorted(near)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array([merged(spans[d]) for d in at], _SPANS), *(pa.array([sorted(x[d]) for d in at], pa.list_(pa.string())) for x in (items, near))], ["id", "spans", "items", "near"])

    schema = T.StructType([T.StructField("id", index.schema["ids"].dataType.elementType), *T._parse_datatype_string("spans array<struct<start:long,end:long>>, items array<string>, near array<string>").fields])
    found = materialize(index.mapInArrow(run, schema), "matches")
    share.destroy()
    return found


def indexed_rows(index: DataFrame) -> DataFrame:
    """``(id, n_words)`` of every document row of the index."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([column(batch, "ids")[b].values, pa.array(np.frombuffer(column(batch, "counts")[b].as_py(), np.int64))], ["id", "n_words"])

    schema = T.StructType([T.StructField("id", index.schema["ids"].dataType.elementType), T.StructField("n_words", T.LongType())])
    return index.select("ids", "counts").mapInArrow(run, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def benchmark_windows(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """Chunks of distinct windows with their items' ids as text (a null id is the empty text)."""
    chunk: dict[tuple[bytes, ...], list[str]] = {}
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        for w in item_windows((row.t or "").encode()):
            chunk.setdefault(w, []).append(row.i or "")
            if len(chunk) >= CHUNK_WINDOWS:
                yield chunk
                chunk = {}
    if chunk:
        yield chunk


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", slack: int = SLACK) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items)`` for every document row: words inside exact occurrences
    of benchmark windows, the items these are of, and the number of items of which some window has a proximity match."""
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")).alias("k"), F.col(text_col).alias("text"))
    index = build_index(rows, id_col="k")  # a written table, so that a row's number is the same in every pass
    passes = [search(index, chunk, slack=slack) for chunk in benchmark_windows(benchmark, id_col=item_col)]
    base = indexed_rows(index).select("id.row", F.col("id.id").alias("of"), "n_words")
    if not passes:
        found = base.select("row").where(F.lit(False)).selectExpr("row", "cast(array() as array<struct<start:bigint,end:bigint>>) as spans", "cast(array() as array<string>) as items", "cast(array() as array<string>) as near")
    else:
        found = reduce(DataFrame.unionByName, passes).select("id.row", "spans", "items", "near")
    gathered = found.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near")))
    zero = F.lit(0).cast("long")
    # spans in order: each adds what lies beyond the furthest end so far
    hit = F.aggregate("spans", F.struct(zero.alias("n"), zero.alias("end")), lambda x, s: F.struct((x["n"] + F.greatest(zero, s["end"] - F.greatest(s["start"], x["end"]))).alias("n"), F.greatest(x["end"], s["end"]).alias("end")), lambda x: x["n"])
    none = F.array().cast("array<string>")
    items, near = (F.coalesce(c, none) for c in ("items", "near"))
    out = base.join(gathered, "row", "left").select(
        F.col("of").alias(id_col), "n_words", F.coalesce(hit, zero).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce(hit, zero) * 20 >= F.greatest("n_words", F.lit(1))).alias("contaminated"), F.size(near).cast("long").alias("n_near"), items.alias("items"),
    )
    return out
