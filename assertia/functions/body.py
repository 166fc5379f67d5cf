"""Canonical content of claims, entries and values: what workers encode."""

from __future__ import annotations

from typing import Any

from assertia.functions.canon import Encoded


def python_value(v: Any) -> Any:
    """A value struct as Python: a primitive, or canonical bytes."""
    return Encoded(v["cbor"]) if v["rank"] is None else {0: v["bool"], 1: v["num"], 2: v["str"]}[v["rank"]]


def target_value(p: Any, nested: bytes | None) -> Any:
    if nested is not None:
        return Encoded(nested)
    if p["kind"] == "p":
        return {0: p["bool"], 1: p["num"], 2: p["str"]}[p["rank"]]
    return {"e": p["entity"], "d": p["delta_ref"]}[p["kind"]] if p["kind"] in "ed" else {"mime": p["mime"], "value": bytes(p["bytes"])}


def claim_body(author: str, timestamp: float, pointers: Any, nested: dict | None = None) -> dict:
    """A claim's canonical content; ``nested`` replaces targets of expanded pointers."""

    def target(i: int, p: Any) -> Any:
        if nested and i in nested:
            return Encoded(nested[i])
        if p["kind"] in ("e", "d"):
            own = {"id": p["entity"]} if p["kind"] == "e" else {"delta": p["delta_ref"]}
            return own if p["context"] is None else own | {"context": p["context"]}
        return target_value(p, None)

    return {"author": author, "pointers": [{"role": p["role"], "target": target(i, p)} for i, p in enumerate(pointers)], "timestamp": float(timestamp)}


def entry(r: Any, nested: dict) -> dict:
    out: dict[str, Any] = {"id": r.id, "claims": claim_body(r.author, r.timestamp, r.pointers, nested)}
    if isinstance(r.sig, str):
        out["sig"] = r.sig
    if r.negated is True or (r.negated is not None and bool(r.negated)):
        out["negated"] = True
    return out
