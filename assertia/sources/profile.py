"""Claims as JSON, validated on the way in and addressed by content."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assertia.functions.blake3 import content_addresses
from assertia.functions.body import claim_body
from assertia.functions.canon import b64u_decode, b64u_encode, encode
from assertia.operators.claims import CLAIM_DDL, LANES, RANKS, ClaimSet
from assertia.operators.predicates import lane_of
from assertia.plans.term import TermError


class ClaimError(ValueError):
    """A claim outside the data model."""


def _text(raw: Any, what: str) -> str:
    if not isinstance(raw, str) or not raw:
        raise ClaimError(f"{what} must be a non-empty string")
    raw.encode()
    return raw


def _number(raw: Any, what: str) -> float:
    if isinstance(raw, bool) or not isinstance(raw, int | float) or not math.isfinite(float(raw)):
        raise ClaimError(f"{what} must be a finite number")
    return float(raw) + 0.0


def pointer_row(raw: Any) -> dict:
    """One pointer of the JSON profile as a row."""
    if not isinstance(raw, dict) or set(raw) != {"role", "target"}:
        raise ClaimError("a pointer has a role and a target")
    row = dict.fromkeys(LANES) | {"role": _text(raw["role"], "role")}
    target = raw["target"]
    if isinstance(target, bool | str):
        lane = lane_of(target)
        if isinstance(target, str):
            target.encode()
        return row | {"kind": "p", "rank": RANKS[lane], lane: target}
    if isinstance(target, int | float):
        return row | {"kind": "p", "rank": 1, "num": _number(target, "target")}
    keys = set(target) if isinstance(target, dict) else set()
    if keys == {"mime", "value"}:
        if not isinstance(target["value"], str):
            raise ClaimError("bytes are base64url")
        return row | {"kind": "y", "mime": _text(target["mime"], "mime"), "bytes": b64u_decode(target["value"])}
    for key, kind, lane in (("id", "e", "entity"), ("delta", "d", "delta_ref")):
        if keys in ({key}, {key, "context"}):
            if not isinstance(target[key], str):
                raise ClaimError(f"{key} must be a string")
            target[key].encode()
            return row | {"kind": kind, lane: target[key]} | ({"context": _text(target["context"], "context")} if "context" in target else {})
    raise ClaimError("a target is a primitive, {id}, {delta} or {mime, value}")


def claim_row(raw: Any) -> dict:
    """Claims of the JSON profile as ``author, timestamp, pointers``."""
    if not isinstance(raw, dict) or set(raw) != {"timestamp", "author", "pointers"}:
        raise ClaimError("claims have timestamp, author and pointers")
    if not isinstance(raw["pointers"], list) or not raw["pointers"]:
        raise ClaimError("claims have at least one pointer")
    return {"author": _text(raw["author"], "author"), "timestamp": _number(raw["timestamp"], "timestamp"), "pointers": [pointer_row(p) for p in raw["pointers"]]}


def claim_json(row: Any) -> dict:
    """Back to the JSON profile."""

    def target(p: Any) -> Any:
        if p["kind"] == "p":
            return {0: p["bool"], 1: p["num"], 2: p["str"]}[p["rank"]]
        if p["kind"] == "y":
            return {"mime": p["mime"], "value": b64u_encode(bytes(p["bytes"]))}
        own = {"id": p["entity"]} if p["kind"] == "e" else {"delta": p["delta_ref"]}
        return own if p["context"] is None else own | {"context": p["context"]}

    return {"timestamp": row["timestamp"], "author": row["author"], "pointers": [{"role": p["role"], "target": target(p)} for p in row["pointers"]]}


def claim_ids(rows: Iterable[dict]) -> list[str]:
    return content_addresses([encode(claim_body(r["author"], r["timestamp"], r["pointers"])) for r in rows])


def claim_set(spark: SparkSession, claims: list[dict]) -> ClaimSet:
    """A set of a few JSON claims; an item is claims, or ``{claims, id?, sig?}`` whose id is verified."""
    items = [c if "claims" in c else {"claims": c} for c in claims]
    rows = [claim_row(c["claims"]) for c in items]
    out: dict[str, tuple] = {}
    for c, r, own in zip(items, rows, claim_ids(rows), strict=True):
        if c.get("id", own) != own:
            raise ClaimError(f"id {c['id']} is not the address of its claims")
        out.setdefault(own, (own, r["author"], r["timestamp"], [tuple(p[k] for k in LANES) for p in r["pointers"]], c.get("sig")))
    return ClaimSet(spark.createDataFrame(list(out.values()), CLAIM_DDL))


@F.pandas_udf(T.StringType())
def content_id(author: pd.Series, timestamp: pd.Series, pointers: pd.Series) -> pd.Series:
    """Content addresses of claim rows, a batch at a time."""
    return pd.Series(content_addresses([encode(claim_body(a, t, p)) for a, t, p in zip(author, timestamp, pointers, strict=True)]), dtype=object)


def read_claims(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to claim rows with ``reason``, null where the line is a valid claim (or ``{claims, id?, sig?}``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, reasons = [], []
            for text in pdf[column]:
                try:
                    raw = json.loads(text)
                    item = raw if isinstance(raw, dict) and "claims" in raw else {"claims": raw}
                    rows.append(claim_row(item["claims"]) | {"sig": item.get("sig"), "want": item.get("id")})
                    reasons.append(None)
                except (ValueError, TypeError, TermError) as e:
                    rows.append(None)
                    reasons.append(str(e))
            good = [r for r in rows if r is not None]
            ids = iter(claim_ids(good))
            out = []
            for r, reason in zip(rows, reasons, strict=True):
                if r is None:
                    out.append((None, None, None, None, None, reason))
                    continue
                own = next(ids)
                out.append((own, r["author"], r["timestamp"], r["pointers"], r["sig"], None if r["want"] in (None, own) else "the id is not the address of the claims"))
            yield pd.DataFrame(out, columns=["id", "author", "timestamp", "pointers", "sig", "reason"])

    return lines.select(column).mapInPandas(run, f"{CLAIM_DDL}, reason string")


@F.pandas_udf(T.StringType())
def claim_line(id: pd.Series, author: pd.Series, timestamp: pd.Series, pointers: pd.Series, sig: pd.Series) -> pd.Series:
    """Claim rows as lines of the JSON profile, ``{id, claims, sig?}``."""
    out = []
    for i, a, t, p, s in zip(id, author, timestamp, pointers, sig, strict=True):
        item = {"id": i, "claims": claim_json({"author": a, "timestamp": t, "pointers": p})}
        out.append(json.dumps(item if s is None else item | {"sig": s}, ensure_ascii=False))
    return pd.Series(out, dtype=object)


def write_claims(claims: ClaimSet, path: str) -> None:
    """A set as JSON lines, which ``read_claims(spark.read.text(path))`` reads back. Ids must be content addresses to be admitted there."""
    claims.df.select(claim_line("id", "author", "timestamp", "pointers", "sig").alias("value")).write.text(path)
