"""Laws and edge cases of the algebra on small sets, against plain Python."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from assertia.functions.ed25519 import PREFIX, public_key, sign_id
from assertia.operators.claims import CLAIM_DDL, LANES, ClaimSet, intersect, union
from assertia.operators.derive import Derivation, reproduces
from assertia.operators.predicates import predicate
from assertia.plans.planner import Planner
from assertia.plans.registry import Registry
from assertia.plans.term import TermError, parse_pred, parse_term
from assertia.plans.vocabulary import Vocabulary
from assertia.sources.profile import claim_ids, claim_json, claim_row, claim_set, read_claims
from assertia.streaming.derivation import Binding, emissions, reproduced, signed
from assertia.streaming.federation import completeness, digest, offer, pull
from assertia.streaming.peer import Peer, manifest
from assertia.streaming.reactor import Reactor


def claim(author, at, *pointers):
    return {"timestamp": at, "author": author, "pointers": [{"role": r, "target": t} for r, t in pointers]}


def about(entity, context, value, author="ann", at=1):
    return claim(author, at, ("subject", {"id": entity, "context": context}), ("value", value))


def address(c):
    return claim_ids([claim_row(c)])[0]


def negation(target, author="ann", at=9):
    return claim(author, at, ("negates", {"delta": target}))


def ids(claims):
    return {r.id for r in claims.df.select("id").collect()}


MIXED = [about("m", "size", v, at=i) for i, v in enumerate(["large", 3, True, False, 2.5, "10", -1])] + [claim("bob", 50, ("tag", "x")), claim("bob", 51, ("ref", {"delta": "1e20aa", "context": "size"}), ("blob", {"mime": "image/png", "value": "AAEC"}))]


def ordered(v):
    return (0, v) if isinstance(v, bool) else (1, float(v)) if isinstance(v, int | float) else (2, v.encode())


@pytest.mark.parametrize("cmp", ["eq", "neq", "lt", "lte", "gt", "gte"])
def test_canonical_order_and_two_valued_logic(spark, cmp):
    import operator

    ops = {"eq": operator.eq, "neq": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}
    claims = claim_set(spark, MIXED)
    for constant in (True, 2.5, "10"):
        pred = parse_pred({"hasPointer": {"targetValue": {"vcmp": {"cmp": cmp, "value": constant}}}})
        want = {address(c) for c in MIXED for p in c["pointers"] if not isinstance(p["target"], dict) and ops[cmp](ordered(p["target"]), ordered(constant))}
        assert ids(claims.where(predicate(pred))) == want
        assert ids(claims.where(predicate({"not": pred}))) == {address(c) for c in MIXED} - want


def test_not_over_every_pointer_field(spark):
    claims = claim_set(spark, MIXED)
    everything = ids(claims)
    for field in ({"role": {"exact": "tag"}}, {"role": {"inSet": []}}, {"targetEntity": "m"}, {"targetDelta": "1e20aa"}, {"context": {"prefix": "si"}}, {"targetIsPrimitive": False}, {"targetValue": {"between": [False, 3]}}, {"targetValue": {"inSet": [3, "x"]}}, {"targetEntity": {"var": "root"}}):
        pred = parse_pred({"hasPointer": field})
        yes, no = ids(claims.where(predicate(pred))), ids(claims.where(predicate({"not": pred})))
        assert yes | no == everything and not yes & no


def plain_negated(edges, all_ids):
    by = {}
    for n, t in edges:
        by.setdefault(t, []).append(n)
    memo = {}

    def struck(i):
        if i not in memo:
            memo[i] = any(not struck(n) for n in by.get(i, []))
        return memo[i]

    return {i for i in all_ids if struck(i)}


def test_mask_against_plain_python(spark):
    rng = random.Random(4)
    claims, edges = [about("e", "p", i) for i in range(12)], []
    for i in range(40):
        t = address(rng.choice(claims))
        n = negation(t, author=rng.choice(["ann", "bob"]), at=100 + i)
        claims.append(n)
        edges.append((address(n), t))
    frame = claim_set(spark, claims)
    everything = {address(c) for c in claims}
    got = Planner(frame).plan(parse_term({"op": "mask", "policy": "drop", "in": "input"}))
    assert ids(got) == everything - plain_negated(edges, everything)
    bob = {address(c) for c in claims if c["author"] == "bob"}
    trusted = Planner(frame).plan(parse_term({"op": "mask", "policy": {"trust": {"match": {"field": "author", "cmp": "eq", "const": "bob"}}}, "in": "input"}))
    assert ids(trusted) == everything - plain_negated([e for e in edges if e[0] in bob], everything)


def test_set_identity_is_the_id(spark):
    row = claim_row(MIXED[0])
    at = [tuple(p[k] for k in LANES) for p in row["pointers"]]
    a, b = (ClaimSet(spark.createDataFrame([("i", "ann", 1.0, at, sig)], CLAIM_DDL)) for sig in ("ff", None))
    assert [r.sig for r in union(a, b).df.collect()] == ["ff"] and [r.sig for r in intersect(b, a).df.collect()] == [None]


def test_select_stays_above_mask(spark):
    one = about("e", "p", 1)
    frame = claim_set(spark, [one, negation(address(one), "bob")])
    ann = {"match": {"field": "author", "cmp": "eq", "const": "ann"}}
    inside = Planner(frame).plan(parse_term({"op": "mask", "policy": "drop", "in": {"op": "select", "pred": ann, "in": "input"}}))
    outside = Planner(frame).plan(parse_term({"op": "select", "pred": ann, "in": {"op": "mask", "policy": "drop", "in": "input"}}))
    assert ids(inside) == {address(one)} and ids(outside) == set()


def test_errors(spark):
    frame = claim_set(spark, MIXED)
    group = {"op": "group", "key": "byRole", "in": "input"}
    for bad in ({"op": "select", "pred": "true", "in": group}, {"op": "prune", "keep": "all", "in": "input"}, {"op": "fix", "schema": "none", "entity": "e"}, group):
        with pytest.raises(TermError):
            Planner(frame).plan(parse_term(bad))
    with pytest.raises(TermError, match="unbound"):
        Planner(frame).plan(parse_term({"op": "select", "pred": {"match": {"field": "author", "cmp": "eq", "const": {"hole": "x"}}}, "in": "input"}))
    with pytest.raises(TermError, match="did you mean 'reading'"):
        parse_term({"op": "expand", "role": {"exact": "r"}, "schema": "S", "readng": "R", "in": "input"})
    body = {"op": "expand", "role": {"exact": "r"}, "schema": "S", "in": {"op": "group", "key": "byRole", "in": "input"}}
    with pytest.raises(TermError, match="itself"):
        Registry.from_json([{"name": "S", "body": body}])


def test_json_lines(spark):
    good = MIXED[1]
    lines = [json.dumps(good), json.dumps({"claims": good, "id": "1e20ff"}), "{", json.dumps({"timestamp": 1, "author": "", "pointers": []}), json.dumps({"claims": good, "id": address(good)}), "null"]
    rows = read_claims(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.reason is None for r in rows] == [True, False, False, False, True, False]
    assert rows[0].id == address(good) and claim_json(rows[0]) == good | {"timestamp": 1.0, "pointers": [good["pointers"][0], {"role": "value", "target": 3.0}]}


TERM = {"op": "group", "key": "byTargetContext", "in": {"op": "mask", "policy": "drop", "in": "input"}}
SCHEMA = {"props": {}, "default": {"all": {"order": {"byTimestamp": "asc"}}}}


def test_incremental_equals_batch_in_any_order(spark):
    base = [about("a", "x", 1), about("b", "x", 2), about("a", "y", "s")]
    first = negation(address(base[0]))
    claims = [*base, first, negation(address(first), at=10)]
    whole = Planner(claim_set(spark, claims)).plan(parse_term({"op": "resolve", "schema": SCHEMA, "in": TERM}), "all")
    want = sorted(map(repr, whole.rows.collect()))
    for order in list(itertools.permutations(range(len(claims))))[5::59][:2]:
        reactor = Reactor(spark, buckets=2)
        reactor.register("v", TERM, SCHEMA)
        for k in range(0, len(order), 2):
            reactor.ingest(claim_set(spark, [claims[i] for i in order[k : k + 2]]).df)
        assert sorted(map(repr, reactor.view("v").collect())) == want
    out = reactor.ingest(claim_set(spark, claims).df)
    assert {r.status for r in out[""].collect()} == {"duplicate"} and "v" not in out
    at = {r.id for r in reactor.by_target("a").collect()}
    assert at == {address(base[0]), address(base[2])}
    assert [r.id for r in reactor.negations_of(address(base[0])).collect()] == [address(first)]
    assert {r.id for r in reactor.by_value("value", {"between": [1, 2]}).collect()} == {address(base[0]), address(base[1])}
    assert reactor.digest() == digest(claim_set(spark, claims))


def test_a_reactor_broadcasts_no_side_that_grows(spark, broadcast_joins):
    base = [about("a", "x", 1), about("b", "x", 2), about("a", "y", "s")]
    first = negation(address(base[0]))
    second = negation(address(first), at=10)
    reactor = Reactor(spark, buckets=2)
    reactor.register("v", TERM, SCHEMA)
    for claims in ([base[0], base[2], first], [base[1], second], [negation(address(second), at=20)]):
        reactor.ingest(claim_set(spark, claims).df)
    assert sorted((r.root, r.prop) for r in reactor.view("v").collect()) == [("a", "y"), ("b", "x")]
    assert broadcast_joins() == []


def test_state_outlives_the_reactor(spark):
    reactor = Reactor(spark, buckets=2)
    reactor.register("v", TERM, SCHEMA)
    reactor.ingest(claim_set(spark, [about("a", "x", 1)]).df, 0)
    again = Reactor(spark, reactor.path)
    assert again.ingest(claim_set(spark, [about("a", "x", 7)]).df, 0) == {}  # that batch is in already
    seen = []
    again.subscribe("v", lambda changes: seen.extend((r.root, r.prop) for r in changes.collect()))
    again.subscribe(None, lambda claims: seen.append(claims.count()))
    again.ingest(claim_set(spark, [about("b", "x", 2)]).df)
    assert seen == [("b", "x"), 1]
    assert {r.root for r in Reactor(spark, reactor.path).view("v").collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="another view"):
        again.register("v", TERM, {"props": {}, "default": {"merge": "count"}})


def test_bundles_and_rejections(spark):
    seed = bytes(range(32))
    author = PREFIX + public_key(seed).hex()
    one, two, own = about("e", "p", 1), about("e", "p", 2), about("e", "p", 3, author)
    head = manifest("ann", 9, [address(one), address(two)], intent="both")
    reactor = Reactor(spark, buckets=2)
    forged = [{"claims": own, "sig": "0" + sign_id(seed, author, address(own))[1:]}] if sign_id(seed, author, address(own))[0] != "0" else [{"claims": own, "sig": "1" + sign_id(seed, author, address(own))[1:]}]
    assert [r.reason for r in reactor.ingest(claim_set(spark, forged).df)[""].collect()] == ["signature does not verify"]
    frame = claim_set(spark, [one, two, head]).df
    assert reactor.ingest_bundle(address(head), frame.withColumn("timestamp", F.when(F.col("id") == address(two), 8.0).otherwise(F.col("timestamp")))).startswith(f"bundle member {address(two)}")
    assert reactor.ingest_bundle(address(head), frame.unionByName(claim_set(spark, [about("x", "y", 5)]).df)).endswith("is not claimed by the manifest")
    assert reactor.log().df.isEmpty()
    reactor.ingest(claim_set(spark, [one, head]).df)
    assert not reactor.holds_all_members(address(head))
    assert reactor.ingest_bundle(address(head), claim_set(spark, [two]).df) is None and reactor.holds_all_members(address(head))


def test_expanded_views_follow_what_they_read(spark):
    """A change below an expansion reaches the roots that read it, and only these."""
    ref = claim("ann", 1, ("subject", {"id": "m", "context": "actor"}), ("who", {"id": "p"}))
    other = claim("ann", 1, ("subject", {"id": "n", "context": "actor"}), ("who", {"id": "q"}))
    body = {"op": "group", "key": "byTargetContext", "in": {"op": "mask", "policy": "drop", "in": "input"}}
    registry = Registry.from_json([{"name": "Person", "alg": 1, "body": body}], [{"name": "R", "alg": 1, "props": {}, "default": {"pick": {"order": {"byTimestamp": "desc"}}}}])
    reactor = Reactor(spark, registry=registry, buckets=2)
    reactor.register("deep", {"op": "expand", "role": {"exact": "who"}, "schema": "Person", "reading": "R", "in": body}, SCHEMA, roots=["m", "n"])
    reactor.ingest(claim_set(spark, [ref, other, about("p", "name", "Ann"), about("q", "name", "Bo")]).df)
    out = reactor.ingest(claim_set(spark, [about("p", "name", "Anna", at=2)]).df)
    assert {(r.root, r.prop) for r in out["deep"].collect()} == {("m", "actor")}
    assert reactor.ingest(claim_set(spark, [about("z", "name", "Zoe")]).df)["deep"].isEmpty()


def test_stream(spark, tmp_path):
    claims = claim_set(spark, [about("a", "x", i, at=i) for i in range(5)])
    claims.df.write.parquet(str(tmp_path / "in"))
    reactor = Reactor(spark, buckets=2)
    reactor.register("n", TERM, {"props": {}, "default": {"merge": "count"}})
    q = reactor.attach(spark.readStream.schema(CLAIM_DDL).parquet(str(tmp_path / "in")))
    q.awaitTermination(120)
    assert [(r.root, r.prop, r.value.num) for r in reactor.view("n").collect()] == [("a", "x", 5.0)]


def test_federation(spark):
    seed = bytes(range(32))
    author = PREFIX + public_key(seed).hex()
    v = Vocabulary()
    member, loose, bare = about("e", "p", 1), about("e", "p", 2, author), about("e", "p", 3)
    head = claim(author, 5, (v.member, {"delta": address(member)}))
    signed = [{"claims": c, "sig": sign_id(seed, author, address(c))} for c in (loose, head)]
    forged = about("e", "p", 4, author)
    theirs = claim_set(spark, [*signed, member, bare, {"claims": forged, "sig": "00" * 64}])
    own = claim_set(spark, [about("own", "p", 0)])
    got = {r.id: r.bundle for r in offer(theirs, own.df.select("id")).collect()}
    assert got == {address(loose): None, address(head): address(head), address(member): address(head)}
    assert ids(pull(own, theirs)) == ids(own) | set(got)
    barred = pull(own, theirs, ~F.col("author").isin("ann"))
    assert ids(barred) == ids(own) | {address(loose)}
    assert [(r.manifest, r.complete) for r in completeness(theirs).collect()] == [(address(head), True)]
    assert digest(own) != digest(theirs) and digest(pull(own, theirs)) == digest(pull(pull(own, theirs), theirs))


@pytest.mark.parametrize(("part", "fan"), [(1024, 2), (4096, 4), (1 << 20, 1 << 14)])
def test_digest_in_parts(spark, monkeypatch, part, fan):
    from pyspark.sql import functions as F

    from assertia.functions.blake3 import content_address
    from assertia.functions.canon import encode
    from assertia.streaming import federation

    monkeypatch.setattr(federation, "PART", part)
    monkeypatch.setattr(federation, "FAN", fan)
    df = spark.range(700).select(F.concat(F.lit("i"), F.repeat(F.lit("\u00e9"), F.pmod(F.col("id") * 7, F.lit(150)).cast("int")), F.col("id").cast("string")).alias("id"))
    want = content_address(encode(sorted((r.id for r in df.collect()), key=str.encode)))
    assert digest(ClaimSet(df.union(df.limit(3)))) == want
    assert digest(ClaimSet(df.where("false"))) == content_address(encode([]))


def test_packs_and_lines_of_a_set(spark, tmp_path):
    from assertia.sources.pack import packs, read_packs
    from assertia.sources.profile import write_claims

    claims = claim_set(spark, [*MIXED, negation(address(MIXED[0]))])
    want = sorted(claims.df.collect())
    got = packs(claims, size=3)
    assert got.count() > 1 and sorted(read_packs(got.union(got)).df.collect()) == want
    assert packs(ClaimSet(claims.df.where("false"))).count() == 0
    write_claims(claims, str(tmp_path / "lines"))
    back = read_claims(spark.read.text(str(tmp_path / "lines")))
    assert sorted(back.where("reason is null").drop("reason").collect()) == want


def test_derivation_modes(spark):
    made = Derivation("sum", {"of": ("e", "str", "total"), "total": ("p", "num", None)}, key=("of",))
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "of string, total double")
    first = ClaimSet(made.emit(rows).general().df)
    assert reproduces(made, rows, first)
    later = ClaimSet(made.emit(spark.createDataFrame([("a", 5.0)], "of string, total double")).general().df)
    mask = parse_term({"op": "mask", "policy": "drop", "in": {"op": "select", "pred": {"hasPointer": {"role": {"exact": "total"}}}, "in": "input"}})
    standing = {"append": 3, "keyed": 2, "supersede": 1}
    for mode, n in standing.items():
        log = made.replace(first, later, mode)
        kept = Planner(log).plan(parse_term({"op": "select", "pred": {"hasPointer": {"role": {"exact": "total"}}}, "in": {"op": "mask", "policy": "drop", "in": "input"}}))
        assert kept.df.count() == n, mode
    assert Planner(first).plan(mask).df.count() == 2


def test_touched_follows_chains_to_their_end(spark):
    chain = [about("a", "x", 1)]
    for i in range(6):
        chain.append(negation(address(chain[-1]), at=10 + i))
    reactor = Reactor(spark, buckets=1)
    reactor.ingest(claim_set(spark, chain).df)
    assert [r.root for r in reactor.touched(claim_set(spark, chain[-1:]).df).select("root").distinct().collect()] == ["a"]


def test_replay_of_a_derivation(spark):
    def counted(rows):
        return rows.where("prop = 'x'").select("root", F.col("root").alias("of"), F.col("value.num").alias("total"))

    binding = Binding("b", "fn", "v", counted, {"of": ("e", "str", "total"), "total": ("p", "num", None)}, budget=3)
    rows = Planner(claim_set(spark, [about("a", "x", 2), about("b", "x", 3)])).plan(parse_term({"op": "resolve", "schema": {"props": {}, "default": {"merge": "sum"}}, "in": TERM}), "all").rows
    seed = bytes(range(32))
    made = signed(emissions(binding, PREFIX + public_key(seed).hex(), rows, Vocabulary()).general().df, seed)
    made = spark.createDataFrame(made.collect(), CLAIM_DDL)
    assert [r.reproduced for r in reproduced(binding, rows, made).collect()] == [True, True]
    assert not any(r.reproduced for r in reproduced(binding, rows.where("root = 'none'"), made).collect())
    assert not any(r.reproduced for r in reproduced(binding, rows, made.withColumn("sig", F.lit(None).cast("string"))).collect())


def test_peers(spark):
    lens = {"op": "select", "pred": {"hasPointer": {"targetEntity": "public"}}, "in": "input"}
    a, b = Peer(spark, bytes([1] * 32), lens), Peer(spark, bytes([2] * 32))
    pointers = [[{"role": "subject", "target": {"id": e, "context": "c"}}] for e in ("public", "secret")]
    a.author_claims([{"timestamp": 1, "pointers": p} for p in pointers])
    member = claim("ann", 3, ("subject", {"id": "public", "context": "d"}))
    a.reactor.ingest(claim_set(spark, [member]).df)
    assert (b.pull_from(a).withheld, b.reactor.log().df.count()) == (1, 1)
    again = b.pull_from(a)
    assert again.accepted == 0


def test_long_chains_of_negations(spark):
    chain = [about("a", "x", 1)]
    for i in range(60):
        chain.append(negation(address(chain[-1]), at=10 + i))
    got = ids(Planner(claim_set(spark, chain)).plan(parse_term({"op": "mask", "policy": "drop", "in": "input"})))
    assert got == {address(c) for c in chain[::2]}
