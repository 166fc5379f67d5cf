"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its embedding (words outside the training vocabulary share none: a zero vector) beside the mean embedding of its
hashed character 3- and 4-grams. Windows of 32 words, 16 apart, cover a text; the last one ends with it. A window's
states are pooled by learned attention into a logit, and a text's score is its highest window's.

Training takes a bounded sample (``MAX_ROWS``, toxic ones up to a third of it) of labelled rows chosen by a hash of the id, and a fixed number of
steps: first random windows under their text's label, then each text's highest window, chosen anew now and then,
with half of the clean rows drawn from those scored highest. Words are left out of their embedding at random, so that their characters
must serve: inflected forms are told by their stems.

Defined results: null and wordless texts are one empty window, scored by the bias alone; repeated rows score alike; without
labelled rows the untrained network's bias scores every row; an empty table gives no rows; ids, sources and languages
are no inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assertia.llm.common import column, slices, texts

SIZE, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
CHAR_BITS = 14
MAX_ROWS, VOCABULARY, LEAST_SEEN = 12_000, 30_000, 10
BATCH = 4096
THRESHOLD = 0.7
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def window_starts(n: int) -> list[int]:
    """Starts of the windows that cover ``n`` words."""
    return [*range(0, max(1, n - SIZE + 1), STRIDE)] + ([n - SIZE] if n > SIZE and (n - SIZE) % STRIDE else [])


def gram_codes(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 3- and 4-grams of each word with its edges marked, flat and word by word, and their number in each word."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in distinct) + b"\0", np.uint8).astype(np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in distinct), np.int64, len(distinct))
    three = data[:-3] << 16 | data[1:-2] << 8 | data[2:-1]
    codes = np.stack([three * np.uint32(0x85EBCA6B), (three << 8 | data[3:]) * np.uint32(0x9E3779B1)], axis=1) >> (32 - CHAR_BITS)
    left = np.repeat(np.cumsum(lengths), lengths)[: len(codes)] - np.arange(len(codes))
    use = np.stack([left >= 3, left >= 4], axis=1)
    return codes[use], 2 * (lengths - 2) - 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, vocabulary: list[bytes], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}

        def init(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        width = WORD_DIM + CHAR_DIM
        self.p = {
            "word": (rng.standard_normal((len(vocabulary) + 1, WORD_DIM)) * 0.1).astype(np.float32), "char": (rng.standard_normal((1 << CHAR_BITS, CHAR_DIM)) * 0.1).astype(np.float32),
            "w": init(width, 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, np.float32), "uf": init(HIDDEN, 3 * HIDDEN), "ub": init(HIDDEN, 3 * HIDDEN),
            "a": init(2 * HIDDEN, ATTENTION), "v": init(ATTENTION), "o": init(2 * HIDDEN), "c": np.full(1, -2.0, np.float32),
        }
        self.p["word"][0] = 0

    def inputs(self, distinct: list[bytes], masked: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words; masked ones go without their own embedding."""
        ids = np.fromiter((self.index.get(w, 0) for w in distinct), np.int64, len(distinct))
        if masked is not None:
            ids[masked] = 0
        codes, counts = gram_codes(distinct)
        chars = np.add.reduceat(self.p["char"][codes], np.r_[0, np.cumsum(counts)[:-1]], axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][ids], chars], axis=1), (ids, codes, counts)

    def _direction(self, x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, kept: list | None) -> np.ndarray:
        n, h = HIDDEN, np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((x.shape[0], x.shape[1], n), np.float32)
        for t in range(x.shape[0]):
            g = h @ u
            gates = _sigmoid(x[t, :, : 2 * n] + g[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(x[t, :, 2 * n :] + r * g[:, 2 * n :])
            step = new + z * (h - new)
            if mask is not None:
                step = np.where(mask[t][:, None], step, h)
            if kept is not None:
                kept.append((h, z, r, new, g[:, 2 * n :]))
            out[t] = h = step
        return out

    def forward(self, projected: np.ndarray, at: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows: ``at`` (time, window) indexes rows of the projected inputs; mask marks the places in use."""
        p, n = self.p, 3 * HIDDEN
        x = projected[at]
        saved: tuple[list, list] | tuple[None, None] = ([], []) if keep else (None, None)
        ahead = self._direction(x[:, :, :n], p["uf"], mask, saved[0])
        back = self._direction(x[::-1, :, n:], p["ub"], None if mask is None else mask[::-1], saved[1])[::-1]
        states = np.concatenate([ahead, back], axis=2)
        inner = np.tanh(states @ p["a"])
        e = inner @ p["v"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        alpha = np.exp(e - e.max(axis=0))
        if mask is not None:
            alpha = alpha * mask
        alpha /= np.maximum(alpha.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", alpha, states)
        return pooled @ p["o"] + p["c"][0], (x, saved, states, inner, alpha, pooled)

    def _back_direction(self, d: np.ndarray, x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, kept: list) -> tuple[np.ndarray, np.ndarray]:
        du, dx, carry = np.zeros_like(u), np.empty_like(x), np.zeros_like(d[0])
        for t in range(len(d) - 1, -1, -1):
            h, z, r, new, gn = kept[t]
            dh = d[t] + carry
            stay = 0.0
            if mask is not None:
                m = mask[t][:, None]
                stay, dh = dh * ~m, dh * m
            dn = dh * (1 - z) * (1 - new * new)
            dz, dr = dh * (h - new) * z * (1 - z), dn * gn * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            du += h.T @ dg
            carry = dh * z + dg @ u.T + stay
        return dx, du

    def gradients(self, distinct: list[bytes], at: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray, masked: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss of windows."""
        p, n = self.p, 3 * HIDDEN
        vectors, (ids, codes, counts) = self.inputs(distinct, masked)
        logits, (x, saved, states, inner, alpha, pooled) = self.forward(vectors @ p["w"] + p["b"], at, mask, keep=True)
        d = ((_sigmoid(logits) - target) * weight).astype(np.float32)
        g = {"c": np.array([d.sum()], np.float32), "o": pooled.T @ d}
        dpooled = d[:, None] * p["o"]
        dalpha = np.einsum("tbh,bh->tb", states, dpooled)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        dinner = de[:, :, None] * p["v"] * (1 - inner * inner)
        g["v"], g["a"] = np.einsum("tb,tba->a", de, inner), np.einsum("tbh,tba->ha", states, dinner)
        dstates = alpha[:, :, None] * dpooled + dinner @ p["a"].T
        fx, g["uf"] = self._back_direction(dstates[:, :, :HIDDEN], x[:, :, :n], p["uf"], mask, saved[0])
        bx, g["ub"] = self._back_direction(dstates[::-1, :, HIDDEN:], x[::-1, :, n:], p["ub"], mask[::-1], saved[1])
        dproj = np.zeros((len(distinct), 6 * HIDDEN), np.float32)
        np.add.at(dproj, at, np.concatenate([fx, bx[::-1]], axis=2) * mask[:, :, None])
        g["w"], g["b"] = vectors.T @ dproj, dproj.sum(0)
        dvec = dproj @ p["w"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], ids, dvec[:, :WORD_DIM])
        g["word"][0] = 0
        np.add.at(g["char"], codes, np.repeat(dvec[:, WORD_DIM:] / counts[:, None], counts, axis=0))
        return g

    def scores(self, batch: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Highest window logit of each text, and that window's number."""
        code: dict[bytes, int] = {}
        flat: list[np.ndarray] = []
        for t in batch:
            w = words(t)
            flat.append(np.fromiter((code.setdefault(x, len(code)) for x in w), np.int64, len(w)))
        projected = (self.inputs(list(code))[0] @ self.p["w"] + self.p["b"]) if code else np.zeros((1, 6 * HIDDEN), np.float32)
        best, which = np.full(len(batch), -np.inf), [0] * len(batch)
        long = [(k, i, s) for k, f in enumerate(flat) if len(f) >= SIZE for i, s in enumerate(window_starts(len(f)))]
        spots = np.arange(SIZE)
        offsets = np.r_[0, np.cumsum([len(f) for f in flat])]
        every = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        for i in range(0, len(long), BATCH):
            part = long[i : i + BATCH]
            begin = np.array([offsets[k] + s for k, _, s in part])
            logits, _ = self.forward(projected, every[begin[None, :] + spots[:, None]], None)
            for (k, w, _), x in zip(part, logits.tolist(), strict=True):
                if x > best[k]:
                    best[k], which[k] = x, w
        short = [k for k, f in enumerate(flat) if len(f) < SIZE]
        for i in range(0, len(short), BATCH):
            part = short[i : i + BATCH]
            at, mask = np.zeros((SIZE, len(part)), np.int64), np.zeros((SIZE, len(part)), bool)
            for c, k in enumerate(part):
                at[: len(flat[k]), c], mask[: len(flat[k]), c] = flat[k], True
            best[part] = self.forward(projected, at, mask)[0]
        return best, which


def _windows_of(coded: list[np.ndarray], picks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word codes of windows, and the windows as places among them with their mask."""
    at, mask = np.zeros((SIZE, len(picks)), np.int64), np.zeros((SIZE, len(picks)), bool)
    for c, (k, start) in enumerate(picks):
        part = coded[k][start : start + SIZE]
        at[: len(part), c], mask[: len(part), c] = part, True
    distinct, place = np.unique(at, return_inverse=True)
    return distinct, place.reshape(at.shape), mask


def train(rows: list[tuple[bytes, int]], *, steps: tuple[int, int] = (300, 600), batch: int = 192, rate: float = 0.01, masked: float = 0.3, seed: int = 3) -> Network:
    code: dict[bytes, int] = {}
    seen: Counter[int] = Counter()
    coded = []
    for text, _ in rows:
        w = words(text)
        coded.append(np.fromiter((code.setdefault(x, len(code)) for x in w), np.int32, len(w)))
        seen.update(np.unique(coded[-1]).tolist())
    every, labels = list(code), np.array([y for _, y in rows], np.float32)
    net = Network([every[w] for w, c in seen.most_common(VOCABULARY) if c >= LEAST_SEEN])
    toxic, clean = (np.array([k for k, c in enumerate(coded) if len(c) and labels[k] == y], int) for y in (1, 0))
    if not len(toxic) + len(clean):
        return net
    rng = np.random.default_rng(seed)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    starts = [window_starts(len(c)) for c in coded]
    highest, hard = [0] * len(rows), clean
    for t in range(1, sum(steps) + 1):
        late = t > steps[0]
        if late and (t - steps[0] - 1) % 200 == 0:
            found = [net.scores([rows[k][0] for k in range(i, min(i + 300, len(rows)))]) for i in range(0, len(rows), 300)]
            highest, logits = [w for _, ws in found for w in ws], np.concatenate([x for x, _ in found])
            hard = clean[np.argsort(-logits[clean])[: max(32, len(clean) // 20)]]
        thirds = [(side, batch // 3) for side in (toxic, hard if late else clean, clean) if len(side)]
        chosen = np.concatenate([rng.choice(side, n) for side, n in thirds])
        picks = [(int(k), starts[k][highest[k]] if late else starts[k][rng.integers(len(starts[k]))]) for k in chosen]
        distinct, at, mask = _windows_of(coded, picks)
        weight = np.full(len(chosen), 1 / len(chosen), np.float32)
        grads = net.gradients([every[w] for w in distinct], at, mask, labels[chosen], weight, rng.random(len(distinct)) < masked)
        pace = rate * (1.0 if t < 0.7 * sum(steps) else 0.3)
        for name, grad in grads.items():
            m, v = state[name]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            net.p[name] -= pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, *, id_col: str, text_col: str, label_col: str, max_rows: int) -> list[tuple[bytes, int]]:
    """A bounded sample of labelled rows; an id with several labels counts as toxic if one of them says so."""
    marked = labels.where(allowed & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg((F.max(label_col) > 0).cast("int").alias("y")).withColumn("h", F.xxhash64("i", F.lit("toxicity")))
    toxic = marked.where("y = 1").orderBy("h").limit(max_rows // 3)
    clean = marked.where("y = 0").orderBy("h").limit(max_rows - max_rows // 3)
    picked = F.broadcast(toxic.unionByName(clean))  # at most max_rows ids
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(picked, "i").select("i", "t", "y", "h").orderBy("h", "i").limit(max_rows)
    return [((r.t or "").encode(), r.y) for r in rows.collect()]


def toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """``(id, score)`` of every row; the network learns from ``labels`` rows where ``allowed`` holds."""
    net = train(training_rows(docs, labels, allowed, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows))
    share = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            best, _ = share.value.scores(texts(batch, "t"))
            yield pa.RecordBatch.from_arrays([column(batch, "i"), pa.array(_sigmoid(best.astype(np.float64)))], ["i", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {id_type}, score double").withColumnRenamed("i", id_col)
