"""Language ID by error-correcting output codes.

Each language has a codeword; one binary classifier per code bit, a logistic model over hashed byte 2- and 3-grams, predicts that bit.
Decoding sums each codeword's logistic loss under the margins and takes the least; the loss turned into a share is the score,
and a small lead over the second codeword flags the row ambiguous.

The models are fitted on a bounded sample (``rows_per_language``) of rows with a language, chosen by a hash of the id. Executors turn the
sample's texts into sparse features (at most 24 KB a row, however long its text); one task takes these and fits all bits in a fixed number of
small steps, so that no text and no dense matrix of the sample is ever held, and the driver gets only the model. Prediction covers every whole text.

Defined results: a null text or one without a letter is ``und`` with score 0; repeated rows predict alike; with one language
it is always predicted; with none every row is ``und``; an empty table gives no rows; ids, sources and languages are no inputs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assertia.llm.common import ROW, column, own, packed, slices, texts, unused

BUCKETS = 1 << 12
ROWS_PER_LANGUAGE = 1500
#: Steps of the fit and rows in each.
STEPS, BATCH = 240, 512
#: Up to so many languages all column splits are used; beyond it, random codes of ``15 * ceil(log2 n)`` bits.
EXHAUSTIVE = 6
UNKNOWN = "und"
AMBIGUOUS_LEAD = 1.0
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER, _ASCII = regex.compile(r"\p{L}"), regex.compile(rb"[A-Za-z]")


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """``n`` rows of +1 and -1, no two rows or complementary columns alike."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        bits = np.array([[1, *((c >> k) & 1 for k in range(n - 1))] for c in range(2 ** (n - 1) - 1)]).T
        return bits * 2.0 - 1
    length, rng, best = 15 * int(np.ceil(np.log2(n))), np.random.default_rng(seed), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, length))
        gap = (length - (code @ code.T - 2 * length * np.eye(n)).max()) / 2
        if best is None or gap > best[0]:
            best = (gap, code)
    return best[1]


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed 2- and 3-grams of the text's letters, words apart by one space."""
    data = np.frombuffer(b" " + b" ".join(text.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(BUCKETS, np.float32)
    two = (data[:-1] << 8 | data[1:]) * np.uint32(0x9E3779B1)
    three = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(0x85EBCA6B)
    counts = np.bincount(np.concatenate([two, three]) >> 20, minlength=BUCKETS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def sparse(text: bytes) -> tuple[bytes, bytes]:
    """Places (uint16) and values (float32) of a text's features."""
    x = features(text)
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes(), x[at].tobytes()


def dense(rows: list[tuple[bytes, bytes]]) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for x, (at, values) in zip(out, rows, strict=True):
        x[np.frombuffer(at, np.uint16)] = np.frombuffer(values, np.float32)
    return out


def has_letter(text: bytes) -> bool:
    return bool(_ASCII.search(text)) or (not text.isascii() and bool(_LETTER.search(text.decode("utf-8", "replace"))))


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.code, self.weights, self.bias = languages, code, weights, bias

    def predict(self, batch: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, unsure = [], [], []
        for i in range(0, len(batch), 256):
            part = batch[i : i + 256]
            known = [bool(self.languages) and has_letter(t) for t in part]
            if len(self.languages) < 2:
                loss = np.zeros((len(part), max(1, len(self.languages))))
            else:
                margins = np.stack([features(t) for t in part]) @ self.weights + self.bias
                loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(axis=2)
            share = np.exp(loss.min(axis=1, keepdims=True) - loss)
            share /= share.sum(axis=1, keepdims=True)
            order = np.sort(loss, axis=1)
            for k, (ok, c) in enumerate(zip(known, loss.argmin(axis=1), strict=True)):
                names.append(self.languages[c] if ok else UNKNOWN)
                scores.append(float(share[k, c]) if ok else 0.0)
                unsure.append(not ok or (loss.shape[1] > 1 and bool(order[k, 1] - order[k, 0] < AMBIGUOUS_LEAD)))
        return names, scores, unsure


def fit(rows: list[tuple[str, tuple[bytes, bytes]]], *, steps: int = STEPS, batch: int = BATCH, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Bit classifiers on ``(language, sparse features)`` rows, languages weighted alike: each step takes the next ``batch`` rows."""
    languages = sorted({lang for lang, _ in rows})
    code = codewords(len(languages))
    shape = (BUCKETS, code.shape[1])
    w, b = np.zeros(shape, np.float32), np.zeros(shape[1], np.float32)
    if len(languages) < 2:
        return Model(languages, code, w, b)
    y = np.searchsorted(languages, [lang for lang, _ in rows])
    order = np.random.default_rng(5).permutation(len(rows))
    weight = (len(rows) / np.bincount(y)[y] / len(languages)).astype(np.float32)[:, None]
    state = [np.zeros_like(v) for v in (w, w, b, b)]
    for t in range(1, steps + 1):
        at = order[np.arange((t - 1) * batch, t * batch) % len(rows)] if len(rows) > batch else order
        x, target = dense([rows[i][1] for i in at]), code[y[at]].astype(np.float32)
        pull = -target * weight[at] / len(at) / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        for k, (value, grad) in enumerate(((w, x.T @ pull + decay * w), (b, pull.sum(0)))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(languages, code, w, b)


def training_rows(docs: DataFrame, allowed: Column, *, id_col: str, text_col: str, lang_col: str, rows_per_language: int) -> DataFrame:
    """``(l, h, at, value)``: sparse features of a bounded sample of each language's rows, the same for the same table."""
    able = docs.where(allowed & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.col(id_col), F.lit("language")).alias("h"), F.col(text_col).cast("string").alias("t"))
    counts = {r.l: r["count"] for r in able.groupBy("l").count().collect()}  # a row for each language
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.3 * rows_per_language / n))]) if counts else F.lit(None).cast("map<string,double>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            at, value = zip(*map(sparse, texts(batch, "t")), strict=True)
            yield pa.RecordBatch.from_arrays([column(batch, "l"), column(batch, "h"), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["l", "h", "at", "value"])

    picked = able.where((F.pmod("h", F.lit(1_000_003)) < 1_000_003 * share[F.col("l")]) & F.col("t").isNotNull())
    return picked.mapInArrow(run, "l string, h long, at binary, value binary").orderBy("h", "l", "at", "value").limit(2 * rows_per_language * max(1, len(counts)))


def fitted(sample: DataFrame, rows_per_language: int) -> Model:
    """The model of a sample, fitted in one task: the sample is bounded by rows and, being sparse features, by bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for lang, at, value in zip(*(column(batch, c).to_pylist() for c in ("l", "at", "value")), strict=True):
                rows = held.setdefault(lang, [])
                if len(rows) < rows_per_language:
                    rows.append((lang, (at, value)))
        model = fit([x for lang in sorted(held) for x in held[lang]])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample.repartition(1).sortWithinPartitions("h", "l", "at", "value").mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([])  # an empty table has no task


def predictions(docs: DataFrame, model: Model, names: Iterable[str], *, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``names`` for language, score and ambiguity. All of a row's columns pass through Arrow untouched as one struct."""
    share, names = docs.sparkSession.sparkContext.broadcast(model), list(names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_text = (pa.RecordBatch.from_arrays([r := column(b, ROW), r.field(at)], [ROW, "t"]) for b in batches)
        for batch in slices(with_text, "t"):
            found = share.value.predict(texts(batch, "t"))
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, ROW), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], [ROW, "l", "s", "u"])

    plain = isinstance(docs.schema[text_col].dataType, T.StringType)
    at = docs.columns.index(text_col) if plain else len(docs.columns)
    carried = packed(docs) if plain else docs.select(F.struct(*(own(c) for c in docs.columns), own(text_col).cast("string").alias(unused(docs, "t")[0])).alias(ROW))
    schema = T.StructType([carried.schema[ROW], *T._parse_datatype_string("l string, s double, u boolean").fields])
    found = carried.mapInArrow(run, schema)
    return found.select(*(F.col(ROW)[c].alias(c) for c in docs.columns), *(F.col(c).alias(n) for c, n in zip("lsu", names, strict=True)))


def identify(docs: DataFrame, allowed: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, names: Iterable[str] = ("__lang", "__score", "__unsure")) -> DataFrame:
    """Fits on the rows where ``allowed`` holds and adds the columns ``names`` (which ``docs`` must not have) to every row of ``docs``."""
    sample = training_rows(docs, allowed, id_col=id_col, text_col=text_col, lang_col=lang_col, rows_per_language=rows_per_language)
    return predictions(docs, fitted(sample, rows_per_language), names, text_col=text_col)
