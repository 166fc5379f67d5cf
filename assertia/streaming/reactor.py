"""Incremental views: claims arrive in micro-batches, and only what a batch touches is resolved again.

All state is files below one folder: per batch, the accepted claims (dealt by a hash of their id), three indexes (claims by the entity they point at,
negations by their target, values by role), and for each registered view the rows of the roots that the batch
touched. What became of each claim, and why one was turned away, is returned as a written table. A batch counts once its version of the state is written: what an interrupted attempt left is never read, a batch that comes again after that changes nothing,
and a reactor opened on the folder goes on where the last one ended. Arrival order never matters and nothing arrives too late, so there is no watermark.

A root's view is the rows of the last batch that touched it, so a batch writes in proportion to what it touches; every ``COMPACT`` batches a view's parts become one.
Index tables are partitioned by buckets, and a lookup reads only the buckets of what it looks up. ``attach`` drives ``ingest`` from a stream's ``foreachBatch``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assertia.functions.blake3 import content_addresses
from assertia.functions.body import claim_body
from assertia.functions.canon import encode
from assertia.functions.ed25519 import verify_id
from assertia.operators.claims import CLAIM_DDL, COLUMNS, POINTER, ClaimSet
from assertia.operators.mask import NEGATES
from assertia.operators.predicates import pointer_matches, str_match
from assertia.operators.views import View
from assertia.plans.planner import Planner, Resolved
from assertia.plans.registry import Registry
from assertia.plans.tables import dealt, fresh_path, written
from assertia.plans.term import nodes, parse_schema, parse_term
from assertia.plans.vocabulary import Vocabulary

#: Buckets of the index tables; a large log wants about as many as a day's batches have gigabytes.
BUCKETS = 8
#: Parts of a view that are read together at most.
COMPACT = 16
ROWS_DDL = "root string, prop string, value struct<rank:int,bool:boolean,num:double,str:string,cbor:binary>, items array<struct<rank:int,bool:boolean,num:double,str:string,cbor:binary>>"
CHANGES_DDL = "root string, prop string, hash string"
LANE = {"e": "entity", "d": "delta_ref", "y": "bytes"}


def fault() -> Column:
    """Why a claim row is outside the data model, but for what its id and signature say; null for a sound one."""

    def wrong(p: Column) -> Column:
        number = p["num"].isNotNull() & ~F.isnan(p["num"]) & (F.abs(p["num"]) < float("inf"))
        primitive = F.when(p["rank"] == 0, p["bool"].isNotNull()).when(p["rank"] == 1, number).when(p["rank"] == 2, p["str"].isNotNull())
        filled = F.when(p["kind"] == "p", primitive).when(p["kind"] == "y", p["bytes"].isNotNull() & (F.length(p["mime"]) > 0)).when(p["kind"] == "e", p["entity"].isNotNull()).when(p["kind"] == "d", p["delta_ref"].isNotNull())
        return ~F.coalesce(filled, F.lit(False))

    at = F.col("timestamp")
    return (
        F.when(F.col("id").isNull() | (F.col("id") == ""), "there is no id")
        .when(F.col("author").isNull() | (F.col("author") == ""), "author must be a non-empty string")
        .when(at.isNull() | F.isnan(at) | (F.abs(at) == float("inf")), "timestamp must be a finite number")
        .when(F.col("pointers").isNull() | (F.size("pointers") == 0), "claims have at least one pointer")
        .when(F.exists("pointers", lambda p: p.isNull() | p["role"].isNull() | (p["role"] == "")), "role must be a non-empty string")
        .when(F.exists("pointers", wrong), "a target is a boolean, a finite number, a string, an entity, a claim or bytes")
    )


def validated(batch: DataFrame, verify: bool = True) -> DataFrame:
    """Claim rows with ``reason``, null for a valid one: its shape is right and, if ``verify``, its id is its content's address and a signature, if there is one, is its author's."""
    checked = batch.select(*COLUMNS, fault().alias("reason"))
    if not verify:
        return checked

    def reasons(rows: list[dict]) -> list[str | None]:
        out = [r["reason"] for r in rows]
        able = [i for i, x in enumerate(out) if x is None]
        for i, own in zip(able, content_addresses([encode(claim_body(rows[i]["author"], rows[i]["timestamp"], rows[i]["pointers"])) for i in able]), strict=True):
            r = rows[i]
            if r["id"] != own:
                out[i] = "the id is not the address of the claims"
            elif r["sig"] is not None and not verify_id(r["author"], r["id"], r["sig"]):
                out[i] = "signature does not verify"
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(reasons(b.to_pylist()), pa.string())], b.schema.names)

    return checked.mapInArrow(run, f"{CLAIM_DDL}, reason string")


def targets_of(kind: str, role: str | None = None) -> Column:
    """What a claim's pointers of a kind (and role) name."""
    mine = F.filter("pointers", lambda p: (p["kind"] == kind) & (F.lit(True) if role is None else p["role"] == role))
    return F.array_distinct(F.transform(mine, lambda p: p[LANE[kind]]))


def negated_by() -> Column:
    return targets_of("d", NEGATES)


def at_a_root(term: Any, registry: Registry | None) -> bool:
    """Whether a change can only touch roots that its entity pointers (or a negation chain's) name, or that read such an entity by an expansion."""
    for n in nodes(term):
        if "inView" in n or "aliased" in n or (n.get("op") == "group" and isinstance(n["key"], dict)):
            return False
        if n.get("op") in ("expand", "fix") and (registry is None or not at_a_root(registry.program(n["schema"]).body, registry)):
            return False
    return True


def expands(term: Any) -> bool:
    return any(n.get("op") in ("expand", "fix") for n in nodes(term))


def support(view: View) -> DataFrame:
    """``(root, entity)``: the entities, besides itself, whose views a root's view reads."""
    out = view.entries.select("root", F.col("root").alias("entity")).where(F.lit(False))
    for e in view.expansions:
        named = targets_named(view, e.role)
        below = support(e.child).select(F.col("root").alias("through"), F.col("entity").alias("deeper"))
        out = out.unionByName(named).unionByName(named.join(below, named.entity == F.col("through")).select("root", F.col("deeper").alias("entity")))
    return out.distinct()


def targets_named(view: View, role: dict) -> DataFrame:
    """``(root, entity)`` of pointers of matching roles."""
    if view.layout is not None:
        return targets_named(View(view.entries.select("root", "prop", "id", "pointers"), view.roots), role)
    mine = F.filter("pointers", lambda p: (p["kind"] == "e") & str_match(p["role"], role))
    return view.entries.select("root", F.explode(F.transform(mine, lambda p: p["entity"])).alias("entity")).distinct()


class Reactor:
    """A log of claims with its indexes and registered views, kept in a folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, registry: Registry | None = None, vocabulary: Vocabulary | None = None, verify: bool = True, buckets: int = BUCKETS):
        self.spark, self.registry, self.vocabulary, self.verify = spark, registry, vocabulary or Vocabulary(), verify
        self.path = (path or fresh_path(spark, "reactor")).rstrip("/")
        self.followers: dict[str | None, list[Callable]] = {}
        self.last: dict[str, DataFrame] = {}
        self.state = self._load() or {"version": 0, "buckets": buckets, "batches": [], "views": {}, "negations": False, "more": {}}

    # --- state ---------------------------------------------------------------------------------------------------

    def _load(self) -> dict | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        found = self.spark.read.schema("version long, state string").json(f"{self.path}/state").orderBy(F.col("version").desc()).limit(1).collect()
        return json.loads(found[0].state) if found else None

    def commit(self) -> None:
        """Writes the state's next version: one small file that appears as a whole."""
        self.state["version"] += 1
        self.spark.createDataFrame([(self.state["version"], json.dumps(self.state))], "version long, state string").coalesce(1).write.mode("append").json(f"{self.path}/state")

    def _bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.state["buckets"])).cast("int")

    def _read(self, table: str, keys: DataFrame | None = None) -> DataFrame:
        """A table of all batches; with ``keys`` (a frame of one column), only the buckets of these."""
        schema = {"log": CLAIM_DDL, "targets": f"entity string, {CLAIM_DDL}", "negations": f"target string, {CLAIM_DDL}", "values": f"id string, p {POINTER}"}[table] + ", bucket int"
        paths = [f"{b['path']}/{table}" for b in self.state["batches"]]
        if not paths:
            return self.spark.createDataFrame([], schema).drop("bucket")
        parts = [self.spark.read.schema(schema).option("basePath", p).parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if keys is not None:
            wanted = [r[0] for r in keys.select(self._bucket(F.col(keys.columns[0]))).distinct().collect()]  # at most as many as there are buckets
            out = out.where(F.col("bucket").isin(wanted) if wanted else F.lit(False))
        return out.drop("bucket")

    # --- the log and its indexes -------------------------------------------------------------------------------------

    def log(self) -> ClaimSet:
        """All claims so far."""
        return ClaimSet(self._read("log"))

    def snapshot(self) -> ClaimSet:
        """The claims as of now: later batches are other files."""
        return self.log()

    def eval(self, term: Any, roots: DataFrame | str | None = None) -> Any:
        """Batch evaluation over the log."""
        return Planner(self.log(), self.registry, self.vocabulary).plan(parse_term(term), roots)

    def digest(self) -> str:
        from assertia.streaming.federation import digest

        return digest(self.log())

    def by_target(self, entity: str) -> DataFrame:
        """Ids of claims that point at an entity, from the index."""
        return self._read("targets", self._one(entity)).where(F.col("entity") == entity).select("id")

    def negations_of(self, id: str) -> DataFrame:
        return self._read("negations", self._one(id)).where(F.col("target") == id).select("id")

    def by_value(self, role: str, match: dict) -> DataFrame:
        """Ids of claims that have a primitive under a role which a match (``vcmp``, ``between`` or ``inSet``) admits."""
        found = self._read("values", self._one(role)).where(pointer_matches(F.col("p"), {"role": {"exact": role}, "targetValue": match}, None))
        return found.select("id").distinct()

    def holds_all_members(self, manifest: str) -> bool:
        """Whether the log has every claim that a manifest lists; False for an unknown manifest."""
        head = self._read("log", self._one(manifest)).where(F.col("id") == manifest)
        listed = head.select(F.explode(targets_of("d", self.vocabulary.member)).alias("id"))
        return not head.isEmpty() and listed.join(self._read("log", listed).select("id"), "id", "left_anti").isEmpty()

    def _one(self, key: str) -> DataFrame:
        return self.spark.createDataFrame([(key,)], "key string")

    # --- views ---------------------------------------------------------------------------------------------------------

    def register(self, name: str, term: Any, schema: dict, roots: Iterable[str] | None = None) -> None:
        """A view that is kept equal to batch evaluation: a term that groups claims and a schema that resolves them, at given roots or all."""
        term, schema = parse_term(term), parse_schema(schema)
        mine = {"term": term, "schema": schema, "roots": None if roots is None else sorted(roots)}
        if name in self.state["views"]:
            if {k: self.state["views"][name][k] for k in mine} != json.loads(json.dumps(mine)):
                raise ValueError(f"another view is named {name!r}")
            return
        view = json.loads(json.dumps(mine)) | {"parts": []}
        rows = self._resolve(view, self.log(), None)
        view["parts"].append(self._part(rows, None, view))
        self.state["views"][name] = view
        self.commit()

    def _resolve(self, view: dict, claims: ClaimSet, roots: DataFrame | None) -> Resolved:
        if roots is None and view["roots"] is not None:
            roots = self.spark.createDataFrame([(r,) for r in view["roots"]], "root string")
        out = Planner(claims, self.registry, self.vocabulary).plan({"op": "resolve", "schema": view["schema"], "in": view["term"]}, "all" if roots is None else roots)
        assert isinstance(out, Resolved)
        return out

    def _part(self, found: Resolved, roots: DataFrame | None, view: dict, many: int | None = None) -> dict:
        """Writes one part of a view: the rows of its roots, which (and how many) roots these are (None: all), and what entities they read."""
        path, part = f"{self.path}/views/{uuid.uuid4().hex}", {}
        found.rows.select("root", "prop", "value", "items").write.parquet(f"{path}/rows")
        part["rows"] = f"{path}/rows"
        if roots is not None:
            roots.select("root").write.parquet(f"{path}/roots")
            part["roots"], part["many"] = f"{path}/roots", many
        if expands(view["term"]):
            support(found.view).write.parquet(f"{path}/support")
            part["support"] = f"{path}/support"
        return part

    def _latest(self, view: dict, table: str, ddl: str) -> DataFrame:
        """A table of a view's parts: of each root, what the last part that covers it says."""
        out = self.spark.createDataFrame([], ddl)
        for part in view["parts"]:
            if "roots" in part:
                out = out.join(dealt(self.spark.read.schema("root string").parquet(part["roots"]), part.get("many")), "root", "left_anti")
                out = out.unionByName(self.spark.read.schema(ddl).parquet(part[table]))
            else:
                out = self.spark.read.schema(ddl).parquet(part[table])
        return out

    def view(self, name: str) -> DataFrame:
        """``(root, prop, value, items)`` as of the last batch."""
        return self._latest(self.state["views"][name], "rows", ROWS_DDL)

    # --- ingest --------------------------------------------------------------------------------------------------------

    def subscribe(self, name: str | None, follower: Callable[[DataFrame], None]) -> None:
        """Calls ``follower`` after each batch: with its changes ``(root, prop, hash)`` of a view, if it has any, or (name None) with the accepted claims."""
        self.followers.setdefault(name, []).append(follower)

    def ingest(self, batch: DataFrame, number: int | None = None) -> dict[str, DataFrame]:
        """Appends what is valid and new and refreshes what it touches. Returns the outcomes ``(id, status, reason)`` under ``""`` and each view's changes under its name."""
        number = number if number is not None else max((b["number"] for b in self.state["batches"]), default=-1) + 1
        if any(b["number"] == number for b in self.state["batches"]):
            return {}
        return self._admit(written(validated(batch, self.verify), "checked"), number)

    def ingest_bundle(self, manifest: str, batch: DataFrame) -> str | None:
        """A manifest and claims that it lists, as one step: all become visible together, or none. Returns why not, or None."""
        checked = written(validated(batch, self.verify), "checked")
        bad = checked.where("reason is not null").orderBy("id").limit(1).collect()
        if bad:
            return f"bundle member {bad[0].id}: {bad[0].reason}"
        held = checked.where(F.col("id") == manifest).unionByName(self._read("log", self._one(manifest)).where(F.col("id") == manifest).withColumn("reason", F.lit(None).cast("string")))
        listed = held.select(F.explode(targets_of("d", self.vocabulary.member)).alias("id")).distinct()
        stray = checked.where(F.col("id") != manifest).join(listed, "id", "left_anti").orderBy("id").limit(1).collect()
        if held.isEmpty() or stray:
            return f"member {stray[0].id} is not claimed by the manifest" if stray else "the manifest is not there"
        self._admit(checked, max((b["number"] for b in self.state["batches"]), default=-1) + 1)
        return None

    def _admit(self, checked: DataFrame, number: int) -> dict[str, DataFrame]:
        path = f"{self.path}/batches/{number}-{uuid.uuid4().hex}"
        known = self.log().df.select("id")
        good = checked.where("reason is null").select(*COLUMNS).dropDuplicates(["id"])
        self._write(good.join(dealt(known), "id", "left_anti"), "id", f"{path}/log")
        new = self.spark.read.schema(f"{CLAIM_DDL}, bucket int").parquet(f"{path}/log").drop("bucket")
        many = new.count()
        fresh = new.select("id", F.lit(True).alias("fresh"))
        outcomes = checked.select("id", "reason").distinct().join(dealt(fresh, many), "id", "left")
        status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("fresh"), "accepted").otherwise("duplicate")
        outcomes = written(outcomes.select("id", status.alias("status"), "reason"), "outcomes")
        self.last = {"": outcomes}
        if not many:
            return self.last
        self._write(new.select(F.explode(targets_of("e")).alias("entity"), *COLUMNS), "entity", f"{path}/targets")
        self._write(new.select(F.explode(negated_by()).alias("target"), *COLUMNS), "target", f"{path}/negations")
        values = new.select("id", F.explode(F.filter("pointers", lambda p: p["kind"] == "p")).alias("p"))
        self._write(values, "p.role", f"{path}/values")
        self.state["negations"] = self.state["negations"] or not new.where(F.size(negated_by()) > 0).limit(1).isEmpty()
        self.state["batches"].append({"number": number, "path": path})
        named = written(self.touched(new), "touched")
        for name, view in self.state["views"].items():
            self.last[name] = self._refresh(view, named)
        self.commit()
        for name, changed in self.last.items():
            if name and not changed.isEmpty():
                for follower in self.followers.get(name, ()):
                    follower(changed)
        for follower in self.followers.get(None, ()):
            follower(new)
        return self.last

    def _write(self, rows: DataFrame, key: str, path: str) -> None:
        rows.withColumn("bucket", self._bucket(F.col(key))).repartition("bucket").write.partitionBy("bucket").parquet(path)

    def touched(self, new: DataFrame) -> DataFrame:
        """``(root, id)``: entities that new claims name, or that the claims name which new negations reach down their chain, and the new claims responsible."""
        found = new.select(F.explode(targets_of("e")).alias("root"), "id")
        if not self.state["negations"]:
            return found.distinct()
        reached = seen = written(new.select(F.explode(negated_by()).alias("target"), "id").distinct(), "reached")
        met = 0
        while many := reached.count():  # chains have no cycles, so this ends
            met += many
            said = self._read("log", reached.select("target")).select("id", targets_of("e").alias("entities"), negated_by().alias("targets"))
            claims = written(said.join(dealt(reached.select(F.col("target").alias("id"), F.col("id").alias("by")), many), "id"), "chain")
            found = found.unionByName(claims.select(F.explode("entities").alias("root"), F.col("by").alias("id")))
            further = claims.select(F.explode("targets").alias("target"), F.col("by").alias("id")).distinct()
            reached = written(further.join(dealt(seen, met), ["target", "id"], "left_anti"), "reached")
            seen = seen.unionByName(reached)
        return found.distinct()

    def relevant(self, roots: DataFrame, many: int | None = None) -> ClaimSet:
        """The claims that decide what stands at given roots (``many``, if that is known): those that point at them, and all negations above these. From the indexes."""
        claims = self._read("targets", roots).join(dealt(roots.select(F.col("root").alias("entity")), many), "entity", "left_semi").drop("entity").dropDuplicates(["id"])
        if not self.state["negations"]:
            return ClaimSet(claims)
        claims = last = written(claims, "relevant")
        held = many = claims.count()
        while True:
            ids = last.select(F.col("id").alias("target"))
            above = self._read("negations", ids).join(dealt(ids, many), "target", "left_semi").drop("target").dropDuplicates(["id"])
            last = written(above.join(dealt(claims.select("id"), held), "id", "left_anti"), "relevant")
            many = last.count()
            if not many:
                return ClaimSet(claims)
            claims, held = claims.unionByName(last), held + many

    def _refresh(self, view: dict, named: DataFrame) -> DataFrame:
        """Resolves again the roots that a batch touched, appends them to the view and returns what changed."""
        roots, many = named.select("root").distinct(), None
        if not at_a_root(view["term"], self.registry):
            roots = None
        elif expands(view["term"]):
            by = self._latest(view, "support", "root string, entity string")
            roots = roots.unionByName(by.join(dealt(roots.select(F.col("root").alias("entity"))), "entity", "left_semi").select("root")).distinct()
        if roots is not None:
            if view["roots"] is not None:
                roots = roots.where(F.col("root").isin(view["roots"]))
            roots = written(roots, "roots")
            many = roots.count()
            if not many:
                return self.spark.createDataFrame([], CHANGES_DDL)
        before = self._latest(view, "rows", ROWS_DDL)
        near = roots is not None and not expands(view["term"])
        found = self._resolve(view, self.relevant(roots, many) if near else self.log(), roots if roots is None else dealt(roots, many))
        part = self._part(found, roots, view, many)
        rows = self.spark.read.schema(ROWS_DDL).parquet(part["rows"])
        old = before if roots is None else before.join(dealt(roots, many), "root", "left_semi")
        changed = written(self._changed(old, rows), "changes")
        view["parts"] = [*view["parts"], part] if roots is not None else [part]
        if len(view["parts"]) > COMPACT:
            self._compact(view)
        return changed

    def _compact(self, view: dict) -> None:
        path, part = f"{self.path}/views/{uuid.uuid4().hex}", {}
        for table, ddl in (("rows", ROWS_DDL), ("support", "root string, entity string")):
            if table in view["parts"][-1]:
                self._latest(view, table, ddl).write.parquet(f"{path}/{table}")
                part[table] = f"{path}/{table}"
        view["parts"] = [part]

    def _changed(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """``(root, prop, hash)`` of properties whose value is another now; the hash is of the new value, null where there is none any more."""
        a, b = (x.select("root", "prop", F.struct("value", "items").alias(n)) for x, n in ((old, "was"), (new, "now")))
        differ = a.join(b, ["root", "prop"], "full").where(~F.col("was").eqNullSafe(F.col("now")))
        return differ.select("root", "prop", F.when(F.col("now").isNotNull(), F.sha2(F.to_json("now"), 256)).alias("hash"))

    def attach(self, stream: DataFrame, checkpoint: str | None = None) -> StreamingQuery:
        """Ingests a stream of claim rows until it has no more input."""

        def take(batch: DataFrame, number: int) -> None:
            self.ingest(batch, number)

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint or f"{self.path}/checkpoint").trigger(availableNow=True).start()
