"""Packs: a set of claims as one canonical item, strings in one table, members of a bundle relative to their manifest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assertia.functions.blake3 import content_address, content_addresses
from assertia.functions.body import claim_body
from assertia.functions.canon import decode, encode
from assertia.operators.claims import CLAIM_DDL, COLUMNS, LANES, RANKS, ClaimSet
from assertia.plans.vocabulary import Vocabulary

VERSION = 1.0
#: The format's pointer keys by kind of target.
KIND_KEYS = {"e": "entity", "d": "delta_ref"}


def pack(rows: Iterable[Any], vocabulary: Vocabulary | None = None) -> bytes:
    """Claim rows (mappings with ``id, author, timestamp, pointers, sig``) as pack bytes. One pack is made on one machine."""
    role = (vocabulary or Vocabulary()).member
    claims = {r["id"]: r for r in sorted(rows, key=lambda r: r["id"])}
    manifests = [i for i, r in claims.items() if any(p["role"] == role and p["kind"] == "d" for p in r["pointers"])]
    of: dict[str, str] = {}
    for m in manifests:
        for p in claims[m]["pointers"]:
            if p["role"] == role and p["kind"] == "d" and p["delta_ref"] in claims and p["delta_ref"] not in manifests:
                of.setdefault(p["delta_ref"], m)
    strings: set[str] = set()
    for r in claims.values():
        strings |= {r["id"], *([r["sig"]] if r["sig"] else [])}
        if r["id"] not in of or r["author"] != claims[of[r["id"]]]["author"]:
            strings.add(r["author"])
        for p in r["pointers"]:
            strings |= {x for x in (p["role"], p["context"], p["entity"], p["delta_ref"], p["mime"], p["str"]) if x is not None}
    table = sorted(strings, key=str.encode)
    at = {s: float(i) for i, s in enumerate(table)}
    place = {m: float(k) for k, m in enumerate(manifests)}

    def target(p: Any) -> dict:
        own: dict[str, Any] = {"r": at[p["role"]]}
        if p["kind"] in KIND_KEYS:
            own[p["kind"]] = at[p[KIND_KEYS[p["kind"]]]]
        elif p["kind"] == "y":
            own |= {"m": at[p["mime"]], "y": bytes(p["bytes"])}
        else:
            own |= [{"b": p["bool"]}, {"n": p["num"]}, {"s": at.get(p["str"])}][int(p["rank"])]
        return own if p["context"] is None else own | {"c": at[p["context"]]}

    def record(r: Any) -> dict:
        out: dict[str, Any] = {"i": at[r["id"]], "p": [target(p) for p in r["pointers"]]}
        if r["id"] in of:
            head = claims[of[r["id"]]]
            out["m"] = place[of[r["id"]]]
            if r["author"] != head["author"]:
                out["a"] = at[r["author"]]
            if r["timestamp"] != head["timestamp"]:
                out["dt"] = r["timestamp"] - head["timestamp"]
        else:
            out |= {"a": at[r["author"]], "t": float(r["timestamp"])}
        return out | ({"s": at[r["sig"]]} if r["sig"] else {})

    parts = {"envelopes": manifests, "members": sorted(of), "loose": [i for i in claims if i not in of and i not in place]}
    return encode({"version": VERSION, "strings": table} | {k: [record(claims[i]) for i in ids] for k, ids in parts.items()})


def unpack(data: bytes) -> list[dict]:
    """Claim rows of a pack; every id is recomputed from its claims and must agree."""
    item = decode(data)
    if not isinstance(item, dict) or item.get("version") != VERSION:
        raise ValueError("not a pack")
    table = item["strings"]

    def name(i: float) -> str:
        if i != int(i) or not 0 <= i < len(table):
            raise ValueError("a string index out of range")
        return table[int(i)]

    def target(raw: dict) -> dict:
        row = dict.fromkeys(LANES) | {"role": name(raw["r"]), "context": name(raw["c"]) if "c" in raw else None}
        for kind, lane in KIND_KEYS.items():
            if kind in raw:
                return row | {"kind": kind, lane: name(raw[kind])}
        if "y" in raw:
            return row | {"kind": "y", "mime": name(raw["m"]), "bytes": raw["y"]}
        lane, value = ("str", name(raw["s"])) if "s" in raw else ("num", raw["n"]) if "n" in raw else ("bool", raw["b"])
        return row | {"kind": "p", "rank": RANKS[lane], lane: value}

    def row(raw: dict, author: str, timestamp: float) -> dict:
        return {"id": name(raw["i"]), "author": author, "timestamp": timestamp, "pointers": [target(p) for p in raw["p"]], "sig": name(raw["s"]) if "s" in raw else None}

    heads = [row(r, name(r["a"]), r["t"]) for r in item["envelopes"]]
    out = heads + [row(r, name(r["a"]), r["t"]) for r in item["loose"]]
    for r in item["members"]:
        head = heads[int(r["m"])]
        out.append(row(r, name(r["a"]) if "a" in r else head["author"], head["timestamp"] + r.get("dt", 0.0)))
    for r, own in zip(out, content_addresses([encode(claim_body(r["author"], r["timestamp"], r["pointers"])) for r in out]), strict=True):
        if r["id"] != own:
            raise ValueError(f"the pack's claim {r['id']} is not what its id says")
    return sorted(out, key=lambda r: r["id"])


def pack_id(data: bytes) -> str:
    return content_address(data)


#: Claims of one pack of a larger set: some megabytes, made in one task.
PACK_CLAIMS = 20_000


def packs(claims: ClaimSet, vocabulary: Vocabulary | None = None, size: int = PACK_CLAIMS) -> DataFrame:
    """``(part, pack)``: a set as packs of about ``size`` claims, dealt by their ids, which are distinct, so that no pack grows with the set. A
    member is written relative to its manifest only where both are dealt to one pack; read together, the packs are the set again. An empty set
    has no packs."""
    parts = -(-claims.df.count() // size)
    of = F.pmod(F.xxhash64("id"), F.lit(max(1, parts))).alias("part")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [r | {"sig": r["sig"] if isinstance(r["sig"], str) else None} for r in pdf[COLUMNS].to_dict("records")]
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "pack": [pack(rows, vocabulary)]})

    return claims.df.select(of, *COLUMNS).groupBy("part").applyInPandas(one, "part long, pack binary")


def read_packs(held: DataFrame, column: str = "pack") -> ClaimSet:
    """The claims of a column of packs (``content`` of files read as ``binaryFile``); every id is recomputed and must agree. A claim of several packs
    counts once."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf[column]:
                yield pd.DataFrame([tuple(r[k] for k in COLUMNS) for r in unpack(bytes(data))], columns=COLUMNS)

    return ClaimSet(held.select(column).mapInPandas(opened, CLAIM_DDL).dropDuplicates(["id"]))
