"""Golden vectors from a folder of JSON files, dispatched by the shape of their records.

``CLAIM_VECTORS`` names the folder and ``CLAIM_VOCABULARY`` the prefix of its reserved roles. Without them, the tests take ``tests/vectors``: scalars are the
examples of RFC 8949; the rest are fixed values that this implementation wrote when it passed a full outside set, so they hold it to what it
computed then.
"""

import json
import os
from pathlib import Path

import pytest

from assertia.functions.blake3 import content_address
from assertia.functions.body import claim_body
from assertia.functions.canon import encode, from_json
from assertia.functions.ed25519 import verify_id
from assertia.operators.alias import relation_signature
from assertia.plans.planner import Planner
from assertia.plans.published import load_program, load_reading, publish_program, publish_reading
from assertia.plans.registry import Program, Registry
from assertia.plans.term import TermError, parse_schema, parse_term, term_hash
from assertia.plans.vocabulary import Vocabulary
from assertia.sources.pack import pack, pack_id, unpack
from assertia.sources.profile import claim_ids, claim_json, claim_row, claim_set

FOLDER = os.environ.get("CLAIM_VECTORS") or Path(__file__).parent / "vectors"
WORDS = Vocabulary(os.environ.get("CLAIM_VOCABULARY", "assertia"))
FILES = [json.loads(p.read_text()) for p in sorted(Path(FOLDER).rglob("*.json"))]


def records(*keys):
    def walk(x):
        if isinstance(x, dict):
            if all(k in x for k in keys):
                yield x
            for v in x.values():
                yield from walk(v)
        elif isinstance(x, list):
            for v in x:
                yield from walk(v)

    return [r for f in FILES for r in walk(f)]


def test_scalars():
    found = [r for r in records("kind", "value", "hex") if r["kind"] not in ("bytes", "bstr")]
    assert found
    for r in found:
        value = float(r["value"]) if isinstance(r["value"], int | float) and not isinstance(r["value"], bool) else r["value"]
        assert encode(from_json(value)).hex() == r["hex"], r


def test_claims():
    found = records("claims", "canonicalCborHex", "id")
    assert found
    for r in found:
        row = claim_row(r["claims"])
        assert encode(claim_body(row["author"], row["timestamp"], row["pointers"])).hex() == r["canonicalCborHex"]
        assert claim_ids([row]) == [r["id"]]
        assert claim_row(claim_json(row)) == row
        if "sig" in r:
            assert verify_id(row["author"], r["id"], r["sig"])


def test_invalid_claims():
    found = [r for r in records("claims", "reason") if "id" not in r]
    assert found
    for r in found:
        with pytest.raises((ValueError, TypeError)):
            claim_ids([claim_row(r["claims"])])


def test_signatures():
    for r in records("claims", "sig", "verdict"):
        assert verify_id(r["claims"]["author"], r["id"], r["sig"]) == (r["verdict"] == "verified"), r["name"]


def test_digests_and_packs():
    for r in records("ids", "digest"):
        assert content_address(encode(sorted(r["ids"]))) == r["digest"]
    for r in records("packHex", "packId"):
        rows = [claim_row(d["claims"]) | {"sig": d.get("sig")} for d in r["deltas"]]
        rows = [row | {"id": i} for row, i in zip(rows, claim_ids(rows), strict=True)]
        data = pack(rows, WORDS)
        assert data.hex() == r["packHex"] and pack_id(data) == r["packId"]
        assert unpack(data) == sorted(rows, key=lambda x: x["id"])


def test_evaluation(spark):
    count = 0
    for f in FILES:
        if not isinstance(f, dict) or "cases" not in f or "fixture" not in f:
            continue
        claims = claim_set(spark, [{"claims": d["claims"], "id": d["id"]} for d in f["fixture"]["deltas"]])
        planner = Planner(claims, Registry.from_json(f.get("schemas") or [], f.get("readings") or []), WORDS)
        for c in f["cases"]:
            term = parse_term(c["term"])
            if "termHash" in c:
                assert term_hash(term) == c["termHash"]
            roots = spark.createDataFrame([(c["root"],)], "root string") if "root" in c else None
            assert planner.canonical_bytes(planner.plan(term, roots)).hex() == c["expectedCanonicalHex"], c["name"]
            count += 1
        by_name = {d["name"]: claim_row(d["claims"]) for d in f["fixture"]["deltas"]}
        for s in f.get("signatures") or []:
            assert relation_signature(by_name[s["delta"]]["pointers"]) == s["signature"]
    assert count


def test_rejects(spark):
    claims = claim_set(spark, [{"timestamp": 0, "author": "a", "pointers": [{"role": "r", "target": "x"}]}])
    roots = spark.createDataFrame([("x",)], "root string")
    for r in records("name", "reason", "term"):
        with pytest.raises(TermError):
            Planner(claims).plan(parse_term(r["term"]), roots)


def test_published(spark):
    for r in records("termJson", "termHash"):
        assert term_hash(parse_term(r["termJson"])) == r["termHash"]
    for r in records("schemaEntity", "claims", "deltaId"):
        claims = claim_set(spark, [{"claims": r["claims"], "id": r["deltaId"]}])
        at, who = r["claims"]["timestamp"], r["claims"]["author"]
        if "schemaJson" in r:
            loaded = load_reading(claims, r["schemaEntity"], WORDS)
            assert loaded == parse_schema(r["schemaJson"])
            again = publish_reading(loaded, r["schemaEntity"], who, at, WORDS)
        else:
            loaded = load_program(claims, r["schemaEntity"], WORDS)
            assert isinstance(loaded, Program)
            again = publish_program(loaded, r["schemaEntity"], who, at, WORDS)
        assert claim_ids([claim_row(again)]) == [r["deltaId"]]
