"""Programs and readings as claims: published under an entity, and loaded back from the latest standing definition."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from assertia.functions.canon import decode
from assertia.operators.claims import ClaimSet
from assertia.operators.views import View
from assertia.plans.planner import Planner
from assertia.plans.registry import Program
from assertia.plans.term import TermError, canonical_bytes, parse_schema, parse_term, schema_bytes
from assertia.plans.vocabulary import Vocabulary

CONTEXT = "definition"
#: The body that gathers definitions: what stands and points at the root, by context.
BOOTSTRAP = parse_term({"op": "group", "key": "byTargetContext", "in": {"op": "select", "pred": {"hasPointer": {"targetEntity": {"var": "root"}}}, "in": {"op": "mask", "policy": "drop", "in": "input"}}})


def _claims(kind: str, entity: str, name: str, alg: float, blob: bytes, author: str, timestamp: float, v: Vocabulary) -> dict:
    role = {k: v.role(f"{kind}.{k}") for k in ("defines", "name", "alg", "term")}
    pointers = [(role["defines"], {"id": entity, "context": CONTEXT}), (role["name"], name), (role["alg"], float(alg)), (role["term"], blob.hex())]
    return {"timestamp": timestamp, "author": author, "pointers": [{"role": r, "target": t} for r, t in pointers]}


def publish_program(program: Program, entity: str, author: str, timestamp: float, vocabulary: Vocabulary | None = None) -> dict:
    return _claims("hyperschema", entity, program.name, program.alg, canonical_bytes(program.body), author, timestamp, vocabulary or Vocabulary())


def publish_reading(schema: dict, entity: str, author: str, timestamp: float, vocabulary: Vocabulary | None = None) -> dict:
    if "name" not in schema or "alg" not in schema:
        raise TermError("a published reading has a name and a version")
    return _claims("schema", entity, schema["name"], schema["alg"], schema_bytes(schema), author, timestamp, vocabulary or Vocabulary())


def _latest(claims: ClaimSet, entity: str, kind: str, v: Vocabulary) -> tuple[str, float, bytes]:
    roots = claims.df.sparkSession.createDataFrame([(entity,)], "root string")
    view = Planner(claims, vocabulary=v).plan(BOOTSTRAP, roots)
    assert isinstance(view, View)
    found = view.entries.where(F.col("prop") == CONTEXT).orderBy(F.col("timestamp").desc(), "id").limit(1).collect()
    if not found:
        raise TermError(f"no standing definition of {entity}")

    def value(name: str) -> Any:
        for p in found[0].pointers:
            if p.role == v.role(f"{kind}.{name}") and p.kind == "p" and p["rank"] != 0:
                return p.num if p["rank"] == 1 else p.str
        return None

    name, alg, term = value("name"), value("alg"), value("term")
    if not isinstance(name, str) or not isinstance(alg, float) or not isinstance(term, str):
        raise TermError(f"malformed definition {found[0].id}")
    return name, alg, bytes.fromhex(term)


def load_program(claims: ClaimSet, entity: str, vocabulary: Vocabulary | None = None) -> Program:
    name, alg, blob = _latest(claims, entity, "hyperschema", vocabulary or Vocabulary())
    body = parse_term(decode(blob))
    if canonical_bytes(body) != blob:
        raise TermError("the published term is not in canonical form")
    return Program(name, body, alg)


def load_reading(claims: ClaimSet, entity: str, vocabulary: Vocabulary | None = None) -> dict:
    name, alg, blob = _latest(claims, entity, "schema", vocabulary or Vocabulary())
    body = parse_schema(decode(blob))
    if schema_bytes(body) != blob:
        raise TermError("the published reading is not in canonical form")
    return body | {"name": name, "alg": alg}
