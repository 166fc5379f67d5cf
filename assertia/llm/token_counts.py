"""Byte-level BPE token counts by rank-synchronous array merging.

A batch's distinct pre-tokens are held as one ragged numpy array of symbols. In each round every sequence applies
its own lowest-rank pair at all its places at once; sequences without a mergeable pair leave, and their surviving
symbols are counted. A pre-token's count is remembered in a bounded table, so frequent words are merged once.

Defined results: null text counts as empty (0 bytes, 0 tokens); very long pre-tokens need no special path;
repeated rows are counted row by row; further columns of the input are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assertia.llm.common import column, slices

#: Remembered pre-tokens of a worker: entries and bytes per entry; longer ones are merged each time.
CACHE_ENTRIES, CACHE_TOKEN_BYTES = 400_000, 64
NO_PAIR = np.int32(2**31 - 1)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves,
    the others take the code points from 256 on in ascending order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Token counts under a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        pre = spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
        self.symbol_of_byte = np.zeros(256, np.int32)
        for char, byte in byte_symbols().items():
            self.symbol_of_byte[byte] = vocab[char]
        self.width = np.int64(len(vocab) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.words = regex.compile(pattern)
        special = [t["content"] for t in spec.get("added_tokens", []) if not t.get("normalized")]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_PAIR)

    def merge_counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte sequence after all merges."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        counts = np.zeros(len(tokens), np.int64)
        symbols = self.symbol_of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        ranks = np.full(len(symbols), NO_PAIR, np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inner] = self.pair_ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(ranks, starts)
            done = least == NO_PAIR
            if done.any():
                counts[owner[starts[done]]] = sizes[done]
                stay = np.repeat(~done, sizes)
                symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
                sizes, least = sizes[~done], least[~done]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            # in a run of overlapping places (a pair of equal symbols) every second one merges, from the left
            begins = np.r_[True, np.diff(at) > 1]
            offset = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[offset % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            # the pair right of a merged place spans what the dropped symbol began
            ranks[at] = ranks[at + 1]
            place = np.cumsum(keep) - 1
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            fresh = np.unique(np.r_[place[at], place[at] - 1])
            fresh = fresh[fresh >= 0]
            last = fresh == len(symbols) - 1
            ends = last | (owner[fresh] != owner[np.minimum(fresh + 1, len(symbols) - 1)])
            ranks[fresh[ends]] = NO_PAIR
            go = fresh[~ends]
            ranks[go] = self.pair_ranks(symbols[go], symbols[go + 1])
        return counts

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings, each one token."""
        if self.special is None or not self.special.search(text):
            return self.words.findall(text), 0
        parts = self.special.split(text)
        return [w for part in parts for w in self.words.findall(part)], len(parts) - 1

    def count(self, batch: list[str]) -> list[int]:
        split, known = [self.split(t) for t in batch], self.known
        new = list({w for words, _ in split for w in words if w not in known})
        fresh: dict[str, int] = {}
        if new:
            fresh = dict(zip(new, self.merge_counts([w.encode() for w in new]).tolist(), strict=True))
            if len(known) + len(new) > CACHE_ENTRIES:
                fresh |= {w: known[w] for words, _ in split for w in words if w in known}
                known.clear()
            small = fresh if max(map(len, fresh)) <= CACHE_TOKEN_BYTES else {w: n for w, n in fresh.items() if len(w) <= CACHE_TOKEN_BYTES}
            if len(small) <= CACHE_ENTRIES:
                known.update(small)
        if all(w in known for w in fresh):
            return [sum(map(known.__getitem__, words)) + n for words, n in split]
        both = known | fresh
        return [sum(map(both.__getitem__, words)) + n for words, n in split]


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(path, pattern)
    return _LOADED[path, pattern]


def token_counts(df: DataFrame, tokenizer_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row; the vocabulary file is read where the executors run."""
    id_type = df.schema[id_col].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path, pattern)
        for batch in slices(batches, "t"):
            data = column(batch, "t")
            sizes = pa.compute.fill_null(pa.compute.binary_length(data), 0).cast(pa.int64())
            counts = bpe.count([x or "" for x in data.to_pylist()])
            yield pa.RecordBatch.from_arrays([column(batch, "i"), sizes, pa.array(counts, pa.int64())], ["i", "n_bytes", "n_tokens"])

    out = df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {id_type.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("i").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
