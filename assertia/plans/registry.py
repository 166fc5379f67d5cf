"""Named programs: gather schemas and readings, indexed by name and by content address, free of reference cycles."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from assertia.plans.term import SETS, TermError, operator_of, parse_schema, parse_term, references, schema_hash, term_hash


@dataclass(frozen=True)
class Program:
    """A gather schema: a name, a version and a body that makes a view of a root."""

    name: str
    body: Any
    alg: float = 1.0


class Registry:
    def __init__(self, programs: list[Program] | tuple = (), readings: list[dict] | tuple = ()):
        self.by_name: dict[str, Program] = {}
        self.by_hash: dict[str, Program] = {}
        self.readings: dict[str, dict] = {}
        self.readings_by_hash: dict[str, dict] = {}
        for p in programs:
            if p.name in self.by_name:
                raise TermError(f"two schemas are named {p.name!r}")
            self.by_name[p.name] = p
            self.by_hash.setdefault(term_hash(p.body), p)
        for r in readings:
            if "name" not in r:
                raise TermError("a reading needs a name")
            if r["name"] in self.readings:
                raise TermError(f"two readings are named {r['name']!r}")
            self.readings[r["name"]] = r
            self.readings_by_hash.setdefault(schema_hash(r), r)
        state: dict[str, int] = {}

        def visit(p: Program) -> None:
            if state.get(p.name) == 1:
                raise TermError(f"schema {p.name!r} refers to itself")
            if p.name in state:
                return
            state[p.name] = 1
            if operator_of(p.body) in (*SETS, "resolve"):
                raise TermError(f"the body of {p.name!r} must make a view")
            for key, ref in references(p.body):
                if key == "reading":
                    self.reading(ref)
                else:
                    visit(self.program(ref))
            state[p.name] = 2

        for p in programs:
            visit(p)

    @classmethod
    def from_json(cls, schemas: list[dict] | tuple = (), readings: list[dict] | tuple = ()) -> Registry:
        return cls([Program(s["name"], parse_term(s["body"]), float(s.get("alg", 1))) for s in schemas], [parse_schema(r) for r in readings])

    def program(self, ref: Any) -> Program:
        found = self.by_name.get(ref) if isinstance(ref, str) else self.by_hash.get(ref["pinned"])
        if found is None:
            raise TermError(f"unknown schema {ref!r}")
        return found

    def reading(self, ref: Any) -> dict:
        found = self.readings.get(ref) if isinstance(ref, str) else self.readings_by_hash.get(ref["pinned"])
        if found is None:
            raise TermError(f"unknown reading {ref!r}")
        return found
