"""Registered queries of the claim algebra over the test tables, each with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assertia.operators.claims import ClaimSet, PointerSpec
from assertia.operators.derive import Derivation
from assertia.operators.predicates import predicate
from assertia.operators.resolve import resolve_rows
from assertia.operators.views import View, expanded_entities
from assertia.plans.planner import Planner, Resolved
from assertia.plans.registry import Registry
from assertia.plans.term import parse_pred, parse_term
from assertia.plans.vocabulary import Vocabulary
from assertia.sources.relation import claim_frame, decode_relation, encode_relation, lane_column
from assertia.streaming.federation import completeness, digest, federate
from assertia.streaming.reactor import Reactor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- claims from tables ------------------------------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, d: str) -> tuple[DataFrame, ClaimSet]:
    df = read(spark, d, "orders")
    return df, encode_relation(df, "orders", id=F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")))


def lineitems(spark: SparkSession, d: str) -> tuple[DataFrame, ClaimSet]:
    df = read(spark, d, "lineitem")
    return df, encode_relation(df, "lineitem", id=F.concat_ws("|", F.lit("lineitem"), *(F.col(c).cast("string") for c in df.columns)))


def events(spark: SparkSession, d: str, author: str = "type", flag: bool = False, negating: bool = False) -> ClaimSet:
    """Event claims: the user under the event's type, and its value (or whether it is over 50); errors may negate the user's last event."""
    df = read(spark, d, "events")
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    lane, value = ("bool", F.col("value") > 50) if flag else ("num", F.col("value"))
    layout = [PointerSpec("user", "e", column="c_user", context_column="c_type"), PointerSpec("value", "p", lane, "c_value")]
    columns = {"c_user": user, "c_type": F.col("event_type"), "c_value": value}
    ident = F.concat(F.lit("ev:"), F.col("event_id").cast("string"))
    if negating:
        last = F.lag(ident).over(W.partitionBy("user_id").orderBy("ts"))
        df = df.withColumn("__target", F.when(F.col("event_type") == "error", last))
        layout.append(PointerSpec("negates", "d", column="c_target"))
        columns["c_target"] = F.col("__target")
    return claim_frame(df, layout, id=ident, author=F.col("event_type") if author == "type" else user, timestamp=lane_column(df, "ts")[1], columns=columns)


def customer_orders(spark: SparkSession, d: str) -> ClaimSet:
    """Order claims that file under their customer with the order's priority."""
    df = read(spark, d, "orders")
    layout = [PointerSpec("customer", "e", column="c_customer", context="orders"), PointerSpec("priority", "p", "str", "c_priority")]
    columns = {"c_customer": F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")), "c_priority": F.col("o_orderpriority")}
    return claim_frame(df, layout, id=F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")), author=F.col("o_orderstatus"), timestamp=lane_column(df, "o_orderdate")[1], columns=columns)


def references(spark: SparkSession, d: str) -> ClaimSet:
    """Orders that refer to customers, customers to nations, nations by name: one set of claims without a common layout."""
    o, c, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))

    def entity(prefix: str, column: str) -> Any:
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    def laid(df: DataFrame, name: str, key: str, specs: list[PointerSpec], columns: dict) -> DataFrame:
        return claim_frame(df, specs, id=entity(f"{name}:claim:", key), author=F.lit(name), timestamp=F.lit(0.0), columns=columns).general().df

    sets = [
        laid(o, "order", "o_orderkey", [PointerSpec("order", "e", column="c_o", context="customer"), PointerSpec("customer", "e", column="c_c", context="orders")], {"c_o": entity("order:", "o_orderkey"), "c_c": entity("customer:", "o_custkey")}),
        laid(c, "customer", "c_custkey", [PointerSpec("customer", "e", column="c_c", context="nation"), PointerSpec("nation", "e", column="c_n", context="customers")], {"c_c": entity("customer:", "c_custkey"), "c_n": entity("nation:", "c_nationkey")}),
        laid(n, "nation", "n_nationkey", [PointerSpec("nation", "e", column="c_n", context="name"), PointerSpec("name", "p", "str", "c_x")], {"c_n": entity("nation:", "n_nationkey"), "c_x": F.col("n_name")}),
    ]
    return ClaimSet(sets[0].unionByName(sets[1]).unionByName(sets[2]))


# --- helpers -------------------------------------------------------------------------------------------------------------


def has(**fields: Any) -> dict:
    return {"hasPointer": fields}


def attribute(name: str, cmp: str, value: Any) -> dict:
    return has(role={"exact": name}, targetValue={"vcmp": {"cmp": cmp, "value": value}})


def select(pred: Any, of: Any = "input") -> dict:
    return {"op": "select", "pred": pred, "in": of}


def run(claims: ClaimSet, term: Any, roots: Any = None, registry: Registry | None = None, vocabulary: Vocabulary | None = None) -> Any:
    return Planner(claims, registry, vocabulary).plan(parse_term(term), roots)


ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ORDER_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def order_query(spark: SparkSession, d: str, term: Any) -> DataFrame:
    df, claims = orders(spark, d)
    return decode_relation(run(claims, term), df, ORDER)


# --- select ----------------------------------------------------------------------------------------------------------------


@query(f"{ORDER_SQL} WHERE o_orderstatus = 'F'")
def select_eq(spark, d):
    return order_query(spark, d, select(attribute("o_orderstatus", "eq", "F")))


@query(f"{ORDER_SQL} WHERE o_orderstatus <> 'F'")
def select_neq(spark, d):
    return order_query(spark, d, select(attribute("o_orderstatus", "neq", "F")))


@query(f"{ORDER_SQL} WHERE o_totalprice < 50000")
def select_lt(spark, d):
    return order_query(spark, d, select(attribute("o_totalprice", "lt", 50000)))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def select_between(spark, d):
    df, claims = lineitems(spark, d)
    found = run(claims, select(has(role={"exact": "l_quantity"}, targetValue={"between": [10, 12]})))
    return decode_relation(found, df, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"])


@query(f"{ORDER_SQL} WHERE starts_with(o_orderpriority, '1')")
def select_prefix(spark, d):
    return order_query(spark, d, select(attribute("o_orderpriority", "prefix", "1")))


@query(f"{ORDER_SQL} WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('F', 'P')")
def select_inset(spark, d):
    return order_query(spark, d, select({"and": [has(role={"exact": "o_orderpriority"}, targetValue={"inSet": ["1-URGENT", "5-LOW"]}), has(role={"inSet": ["o_orderstatus", "status"]}, targetValue={"inSet": ["F", "P"]})]}))


@query(f"{ORDER_SQL} WHERE (o_orderstatus = 'F' AND NOT o_totalprice > 100000) OR o_orderpriority = '1-URGENT'")
def select_bool(spark, d):
    return order_query(spark, d, select({"or": [{"and": [attribute("o_orderstatus", "eq", "F"), {"not": attribute("o_totalprice", "gt", 100000)}]}, attribute("o_orderpriority", "eq", "1-URGENT")]}))


@query(f"{ORDER_SQL} WHERE o_totalprice > 400000 OR o_orderstatus >= 'O'")
def select_mixed_rank(spark, d):
    """Numbers come before strings: over any attribute, ``gte "O"`` holds for later strings only; ``gt`` of a number for all strings."""
    ranked = {"and": [has(role={"inSet": ["o_totalprice", "o_orderstatus"]}, targetValue={"vcmp": {"cmp": "gte", "value": "O"}}), has(role={"exact": "o_orderstatus"}, targetValue={"vcmp": {"cmp": "gt", "value": 1e12}})]}
    return order_query(spark, d, select({"or": [ranked, attribute("o_totalprice", "gt", 400000)]}))


@query(f"{ORDER_SQL} WHERE o_orderstatus = 'F' AND o_totalprice < 50000")
def select_over_pointer_array(spark, d):
    """The same terms without a layout: predicates over the pointer array."""
    df, claims = orders(spark, d)
    return decode_relation(run(claims.general(), select({"and": [attribute("o_orderstatus", "eq", "F"), attribute("o_totalprice", "lt", 50000)]})), df, ORDER)


@query("SELECT event_id, value FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00'")
def select_timestamp_asof(spark, d):
    found = run(events(spark, d), select({"match": {"field": "timestamp", "cmp": "lte", "const": 1704844800000}}))
    return event_rows(found)


def event_rows(found: ClaimSet) -> DataFrame:
    return found.df.select(F.substring("id", 4, 20).cast("long").alias("event_id"), F.col("c_value").alias("value"))


@query("SELECT event_id, value FROM events WHERE event_type IN ('click', 'error') AND starts_with('ev:' || event_id, 'ev:1')")
def select_fields(spark, d):
    return event_rows(run(events(spark, d), select({"and": [{"match": {"field": "author", "cmp": "inSet", "const": ["click", "error"]}}, {"match": {"field": "id", "cmp": "prefix", "const": "ev:1"}}]})))


@query("SELECT event_id, value FROM events WHERE user_id = 7")
def select_target_entity(spark, d):
    return event_rows(run(events(spark, d), select(has(targetEntity="user:7", role={"prefix": "us"}))))


# --- set algebra -----------------------------------------------------------------------------------------------------------


FINISHED, DEAR = select(attribute("o_orderstatus", "eq", "F")), select(attribute("o_totalprice", "gt", 200000))


@query(f"{ORDER_SQL} WHERE o_orderstatus = 'F' OR o_totalprice > 200000")
def union_sets(spark, d):
    return order_query(spark, d, {"op": "union", "left": FINISHED, "right": DEAR})


@query(f"{ORDER_SQL} WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def intersect_sets(spark, d):
    return order_query(spark, d, {"op": "intersect", "left": FINISHED, "right": DEAR})


@query(f"{ORDER_SQL} WHERE o_orderstatus = 'F' AND NOT o_totalprice > 200000")
def difference_sets(spark, d):
    return order_query(spark, d, {"op": "difference", "of": FINISHED, "without": DEAR})


@query(f"{ORDER_SQL} WHERE NOT (o_orderstatus = 'F' AND NOT o_totalprice > 200000)")
def difference_nested(spark, d):
    return order_query(spark, d, {"op": "difference", "of": "input", "without": {"op": "difference", "of": FINISHED, "without": DEAR}})


# --- mask ----------------------------------------------------------------------------------------------------------------------

# an event is negated iff the run of errors right after it in its user's order is of odd length; `{ok}` restricts which errors count
_CHAIN = """
WITH e AS (SELECT *, {ok} AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM {base}),
stop AS (SELECT *, min(CASE WHEN NOT ok THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next,
  count(*) OVER (PARTITION BY user_id) AS total FROM e),
r AS (SELECT event_id, value, event_type, user_id, (coalesce(next, total + 1) - n - 1) % 2 = 1 AS negated FROM stop)
"""
_ALL = _CHAIN.format(ok="event_type = 'error'", base="events")


@query(f"{_ALL} SELECT event_id, value FROM r WHERE NOT negated")
def mask_drop(spark, d):
    return event_rows(run(events(spark, d, negating=True), {"op": "mask", "policy": "drop", "in": "input"}))


@query(f"{_ALL} SELECT event_id, negated FROM r")
def mask_annotate(spark, d):
    found = run(events(spark, d, negating=True), {"op": "mask", "policy": "annotate", "in": "input"})
    return found.df.select(F.substring("id", 4, 20).cast("long").alias("event_id"), "negated")


@query(f"{_CHAIN.format(ok='''event_type = 'error' AND value > 20''', base='events')} SELECT event_id, value FROM r WHERE NOT negated")
def mask_trust(spark, d):
    return event_rows(run(events(spark, d, negating=True), {"op": "mask", "policy": {"trust": attribute("value", "gt", 20)}, "in": "input"}))


_BAND = "value > 20 AND value <= 40"


@query(f"{_CHAIN.format(ok=f'event_type = {chr(39)}error{chr(39)} AND {_BAND}', base='events')} SELECT event_id, value FROM r WHERE {_BAND} AND NOT negated")
def select_then_mask(spark, d):
    """The mask sees only its operand: negations outside the band of values do not count."""
    band = select({"and": [attribute("value", "gt", 20), attribute("value", "lte", 40)]})
    return event_rows(run(events(spark, d, negating=True), {"op": "mask", "policy": "drop", "in": band}))


# --- group and prune -------------------------------------------------------------------------------------------------------


GROUPED = {"op": "group", "key": "byTargetContext", "in": "input"}


def membership(view: View) -> DataFrame:
    return view.entries.groupBy("root", "prop").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'user:' || user_id AS root, event_type AS prop, count(*) AS n FROM events GROUP BY ALL")
def group_ctx(spark, d):
    return membership(run(events(spark, d), GROUPED, "all"))


@query("SELECT 'user:' || user_id AS root, 'user' AS prop, count(*) AS n FROM events GROUP BY ALL")
def group_role(spark, d):
    return membership(run(events(spark, d), {"op": "group", "key": "byRole", "in": "input"}, "all"))


@query("SELECT 'user:' || r AS root, 'all' AS prop, count(*) AS n FROM events, (VALUES (1), (2), (3)) t(r) WHERE value > 90 GROUP BY ALL")
def group_const(spark, d):
    roots = spark.createDataFrame([("user:1",), ("user:2",), ("user:3",)], "root string")
    return membership(run(events(spark, d), {"op": "group", "key": {"const": "all"}, "in": select(attribute("value", "gt", 90))}, roots))


@query("SELECT 'user:' || user_id AS root, event_type AS prop, count(*) AS n FROM events WHERE user_id IN (3, 5, 8) GROUP BY ALL")
def group_at_roots(spark, d):
    """The canonical body: mask, select what points at the root, file by context; over claims without a layout."""
    roots = spark.createDataFrame([("user:3",), ("user:5",), ("user:8",)], "root string")
    body = {"op": "group", "key": "byTargetContext", "in": select(has(targetEntity={"var": "root"}), {"op": "mask", "policy": "drop", "in": "input"})}
    return membership(run(events(spark, d).general(), body, roots))


def pruned(spark, d, keep):
    return membership(run(events(spark, d), {"op": "prune", "keep": keep, "in": GROUPED}, "all"))


_PRUNED = "SELECT 'user:' || user_id AS root, event_type AS prop, count(*) AS n FROM events WHERE {} GROUP BY ALL"


@query(_PRUNED.format("event_type = 'click'"))
def prune_exact(spark, d):
    return pruned(spark, d, {"exact": "click"})


@query(_PRUNED.format("starts_with(event_type, 'p')"))
def prune_prefix(spark, d):
    return pruned(spark, d, {"prefix": "p"})


@query(_PRUNED.format("event_type IN ('error', 'signup')"))
def prune_inset(spark, d):
    return pruned(spark, d, {"inSet": ["error", "signup"]})


# --- fix, holes, expand ------------------------------------------------------------------------------------------------------

PICK = {"pick": {"order": "lexById"}}
AT_ROOT = {"op": "group", "key": "byTargetContext", "in": select(has(targetEntity={"var": "root"}))}
REFERENCES = Registry.from_json(
    [
        {"name": "Nation", "alg": 1, "body": {"op": "prune", "keep": {"exact": "name"}, "in": AT_ROOT}},
        {"name": "Customer", "alg": 1, "body": {"op": "expand", "role": {"exact": "nation"}, "schema": "Nation", "reading": "NationReading", "in": {"op": "prune", "keep": {"exact": "nation"}, "in": AT_ROOT}}},
        {"name": "Order", "alg": 1, "body": {"op": "expand", "role": {"exact": "customer"}, "schema": "Customer", "reading": "CustomerReading", "in": {"op": "prune", "keep": {"exact": "customer"}, "in": AT_ROOT}}},
    ],
    [{"name": "NationReading", "alg": 1, "props": {}, "default": PICK}, {"name": "CustomerReading", "alg": 1, "props": {}, "default": PICK}],
)


def hops(view: View) -> DataFrame:
    """``(root, entity)``: which entities a view's last expansion reads for each root."""
    role = view.expansions[-1].role
    named = F.transform(F.filter("pointers", lambda p: (p["kind"] == "e") & (p["role"] == F.lit(role["exact"]))), lambda p: p["entity"])
    return view.entries.select("root", F.explode(named).alias("entity")).distinct()


@query("SELECT 'customer:' || c_custkey AS customer, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def expand_one(spark, d):
    claims = references(spark, d)
    view = Planner(claims, REFERENCES).plan(REFERENCES.program("Customer").body, read(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("root")))
    child = resolve_rows(view.expansions[-1].child, view.expansions[-1].reading, lambda v, r: None)
    return hops(view).join(child.select(F.col("root").alias("entity"), F.col("value.str").alias("name")), "entity").select(F.col("root").alias("customer"), "name")


@query("SELECT 'order:' || o_orderkey AS order_, n_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'")
def expand_two(spark, d):
    claims = references(spark, d)
    roots = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("root"))
    view = Planner(claims, REFERENCES).plan(REFERENCES.program("Order").body, roots)
    customer = view.expansions[-1].child
    nation = resolve_rows(customer.expansions[-1].child, customer.expansions[-1].reading, lambda v, r: None)
    names = hops(customer).join(nation.select(F.col("root").alias("entity"), F.col("value.str").alias("name")), "entity").select(F.col("root").alias("entity"), "name")
    return hops(view).join(names, "entity").select(F.col("root").alias("order_"), "name")


@query("SELECT 'customer:' || o_custkey AS root, count(*) AS n FROM orders GROUP BY ALL")
def expand_children(spark, d):
    """The entities an expansion would read, with how many entries name them."""
    claims = references(spark, d)
    view = run(claims, GROUPED, "all")
    named = expanded_entities(View(view.entries.where("prop = 'customer'"), None), {"exact": "customer"})
    return view.entries.where("prop = 'orders'").join(named, "root", "left_semi").groupBy("root").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS prop, count(*) AS n FROM events WHERE user_id = 5 AND ts <= TIMESTAMP '2024-01-15 00:00:00' AND value >= 30 GROUP BY ALL")
def fix_holes(spark, d):
    body = {"op": "group", "key": "byTargetContext", "in": select({"and": [has(targetEntity={"var": "root"}), {"and": [{"match": {"field": "timestamp", "cmp": "lte", "const": {"hole": "asof"}}}, has(role={"exact": "value"}, targetValue={"vcmp": {"cmp": "gte", "value": {"hole": "least"}}})]}]})}
    registry = Registry.from_json([{"name": "Events", "alg": 1, "body": body}])
    view = run(events(spark, d), {"op": "fix", "schema": "Events", "entity": "user:5", "bindings": {"asof": 1705276800000, "least": 30}}, registry=registry)
    return view.entries.groupBy("prop").agg(F.count(F.lit(1)).alias("n"))


# --- resolve -------------------------------------------------------------------------------------------------------------------


def resolved(claims: ClaimSet, default: dict, props: dict | None = None, group: Any = "byTargetContext", roots: Any = "all") -> DataFrame:
    out = run(claims, {"op": "resolve", "schema": {"props": props or {}, "default": default}, "in": {"op": "group", "key": group, "in": "input"}}, roots)
    assert isinstance(out, Resolved)
    return out.rows


def numbers(rows: DataFrame) -> DataFrame:
    return rows.select("root", "prop", F.round("value.num", 2).alias("value"))


def items(rows: DataFrame) -> DataFrame:
    return rows.select("root", "prop", F.posexplode("items").alias("idx", "v")).select("root", "prop", "idx", F.col("v.str").alias("value"))


_USER = "'user:' || user_id AS root, event_type AS prop"


@query(f"SELECT {_USER}, round(arg_max(value, ts), 2) AS value FROM events GROUP BY ALL")
def resolve_pick_latest(spark, d):
    return numbers(resolved(events(spark, d), {"pick": {"order": {"byTimestamp": "desc"}}}))


_RANKED = "SELECT root, 'user' AS prop, round(value, 2) AS value FROM (SELECT 'user:' || user_id AS root, value, row_number() OVER (PARTITION BY user_id ORDER BY {}, 'ev:' || event_id) AS n FROM events) WHERE n = 1"
_BY_TYPE = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END"


@query(_RANKED.format(_BY_TYPE))
def resolve_pick_author_rank(spark, d):
    return numbers(resolved(events(spark, d), {"pick": {"order": {"byAuthorRank": ["purchase", "error"]}}}, group="byRole"))


@query(_RANKED.format("CASE WHEN value > 50 THEN 0 ELSE 1 END, ts"))
def resolve_pick_bypred(spark, d):
    return numbers(resolved(events(spark, d).general(), {"pick": {"order": {"byPred": {"pred": attribute("value", "gt", 50), "then": {"byTimestamp": "asc"}}}}}, group="byRole"))


@query(_RANKED.format(f"{_BY_TYPE}, ts DESC"))
def resolve_chain(spark, d):
    return numbers(resolved(events(spark, d), {"pick": {"order": {"chain": [{"byAuthorRank": ["purchase", "error"]}, {"byTimestamp": "desc"}]}}}, group="byRole"))


_CUSTOMER = "SELECT 'customer:' || o_custkey AS root, 'orders' AS prop, o_orderpriority AS value, o_orderdate AS ts, 'orders:' || o_orderkey AS id FROM orders"


@query(f"SELECT root, prop, (row_number() OVER (PARTITION BY root ORDER BY ts, id) - 1)::INTEGER AS idx, value FROM ({_CUSTOMER})")
def resolve_all(spark, d):
    return items(resolved(customer_orders(spark, d), {"all": {"order": {"byTimestamp": "asc"}}}))


_FIRST = f"SELECT * FROM ({_CUSTOMER}) QUALIFY row_number() OVER (PARTITION BY root, value ORDER BY ts, id) = 1"


@query(f"SELECT root, prop, (row_number() OVER (PARTITION BY root ORDER BY ts, id) - 1)::INTEGER AS idx, value FROM ({_FIRST})")
def resolve_all_distinct(spark, d):
    return items(resolved(customer_orders(spark, d), {"all": {"order": {"byTimestamp": "asc"}, "distinct": True}}))


@query(f"SELECT root, prop, (row_number() OVER (PARTITION BY root ORDER BY ts, id) - 1)::INTEGER AS idx, value FROM ({_FIRST}) QUALIFY count(*) OVER (PARTITION BY root) >= 2")
def resolve_conflicts(spark, d):
    return items(resolved(customer_orders(spark, d), {"conflicts": {"order": {"byTimestamp": "asc"}}}))


@query(f"SELECT root, prop, (row_number() OVER (PARTITION BY root ORDER BY value) - 1)::INTEGER AS idx, value FROM ({_CUSTOMER})")
def resolve_concat_sorted(spark, d):
    return items(resolved(customer_orders(spark, d), {"merge": "concatSorted"}))


@query(f"SELECT {_USER}, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def resolve_sum(spark, d):
    return numbers(resolved(events(spark, d), {"merge": "sum"}))


@query(f"SELECT {_USER}, count(*)::DOUBLE AS value FROM events GROUP BY ALL")
def resolve_count(spark, d):
    return numbers(resolved(events(spark, d), {"merge": "count"}))


@query(f"SELECT {_USER}, round(min(value), 2) AS value FROM events GROUP BY ALL")
def resolve_min(spark, d):
    return numbers(resolved(events(spark, d), {"merge": "min"}))


@query(f"SELECT {_USER}, round(max(value), 2) AS value FROM events GROUP BY ALL")
def resolve_max(spark, d):
    return numbers(resolved(events(spark, d), {"merge": "max"}))


@query(f"SELECT {_USER}, bool_and(value > 50) AS value FROM events GROUP BY ALL")
def resolve_and(spark, d):
    return resolved(events(spark, d, flag=True), {"merge": "and"}).select("root", "prop", F.col("value.bool").alias("value"))


@query(f"SELECT {_USER}, bool_or(value > 50) AS value FROM events GROUP BY ALL")
def resolve_or(spark, d):
    return resolved(events(spark, d, flag=True), {"merge": "or"}).select("root", "prop", F.col("value.bool").alias("value"))


@query("SELECT root, 'nothing' AS prop, -1.0::DOUBLE AS value FROM (SELECT DISTINCT 'user:' || user_id AS root FROM events) UNION ALL SELECT u.root, 'purchase', round(coalesce(s, 0), 2) FROM (SELECT DISTINCT 'user:' || user_id AS root FROM events) u LEFT JOIN (SELECT 'user:' || user_id AS root, sum(value) AS s FROM events WHERE event_type = 'purchase' GROUP BY ALL) USING (root)")
def resolve_absent_as(spark, d):
    props = {"purchase": {"absentAs": {"const": 0, "then": {"merge": "sum"}}}, "nothing": {"absentAs": {"const": -1, "then": PICK}}}
    return numbers(resolved(events(spark, d), {"merge": "max"}, props).where("prop in ('purchase', 'nothing')"))


# --- reflection and aliases ------------------------------------------------------------------------------------------------------


BUYERS = {"inView": {"term": select({"and": [has(context={"exact": "purchase"}), attribute("value", "gt", 100)]}), "field": "author", "extract": {"field": "author"}}}


@query("SELECT event_id, value FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)")
def inview_roster(spark, d):
    return event_rows(run(events(spark, d, author="user"), select(BUYERS)))


@query("SELECT event_id, value FROM events WHERE NOT (user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100) OR value < 10)")
def inview_in_not(spark, d):
    return event_rows(run(events(spark, d, author="user"), select({"not": {"or": [BUYERS, attribute("value", "lt", 10)]}})))


@query(f"{_CHAIN.format(ok='''event_type = 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)''', base='events')} SELECT event_id, value FROM r WHERE NOT negated")
def inview_trust_mask(spark, d):
    return event_rows(run(events(spark, d, author="user", negating=True), {"op": "mask", "policy": {"trust": BUYERS}, "in": "input"}))


def alias_claims(spark, d) -> ClaimSet:
    """Nation names as fragments of their region's slot, and customers filed under their nation's name."""
    v = Vocabulary()
    n = read(spark, d, "nation")
    named = claim_frame(n, [PointerSpec(v.fragment, "p", "str", "c_f"), PointerSpec(v.slot, "e", column="c_s", context=v.role("alias.mappings"))], id=F.concat(F.lit("map:"), F.col("n_name")), author=F.lit("librarian"), timestamp=F.lit(0.0), columns={"c_f": F.col("n_name"), "c_s": F.concat(F.lit("region:"), F.col("n_regionkey").cast("string"))})
    c = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    filed = claim_frame(c, [PointerSpec("customer", "e", column="c_c", context_column="c_x")], id=F.concat(F.lit("customer:claim:"), F.col("c_custkey").cast("string")), author=F.lit("registry"), timestamp=F.lit(0.0), columns={"c_c": F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), "c_x": F.col("n_name")})
    return ClaimSet(named.general().df.unionByName(filed.general().df))


_SAME_REGION = "SELECT n_name FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation ORDER BY n_nationkey LIMIT 1)"


def first_nation(spark, d) -> str:
    return read(spark, d, "nation").orderBy("n_nationkey").first().n_name


@query(f"SELECT n_name AS name FROM ({_SAME_REGION})")
def alias_closure(spark, d):
    from assertia.operators.alias import closure

    return closure(alias_claims(spark, d), {"name": first_nation(spark, d)}, Vocabulary())


@query(f"SELECT 'customer:claim:' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ({_SAME_REGION})")
def alias_recall(spark, d):
    term = select(has(role={"exact": "customer"}, context={"aliased": {"name": first_nation(spark, d)}}))
    return run(alias_claims(spark, d), term).df.select("id")


# --- federation, bundles, derivation -----------------------------------------------------------------------------------------------


@query(f"{ORDER_SQL} WHERE o_orderstatus = 'F' OR o_totalprice > 200000")
def federate_filtered(spark, d):
    df, claims = orders(spark, d)
    pred = parse_pred(attribute("o_totalprice", "gt", 200000))
    return decode_relation(federate(run(claims, FINISHED), claims, predicate(pred, layout=claims.layout)), df, ORDER)


@query("WITH m AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'P' AS here FROM orders) SELECT 'customer:' || o_custkey AS manifest, count(*) AS members, count(*) FILTER (WHERE here) AS held, bool_and(here) AS complete FROM m GROUP BY o_custkey")
def bundle_complete(spark, d):
    """A manifest for each customer lists its orders; pending orders have not arrived."""
    v = Vocabulary()
    o = read(spark, d, "orders")
    grouped = o.groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string"))).alias("m"))
    from assertia.operators.claims import pointer

    heads = grouped.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("id"), F.lit("clerk").alias("author"), F.lit(0.0).alias("timestamp"), F.transform("m", lambda x: pointer(F.lit(v.member), "d", value=x)).alias("pointers"), F.lit(None).cast("string").alias("sig"))
    held = encode_relation(o.where("o_orderstatus <> 'P'"), "orders", id=F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string"))).general()
    return completeness(ClaimSet(heads.unionByName(held.df)), v)


@query("SELECT o_orderpriority AS priority, l_returnflag AS flag, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 300000 GROUP BY ALL")
def derive_join(spark, d):
    """A join as a derivation: its pairs are claims, read again by the algebra."""
    _, o = orders(spark, d)
    _, li = lineitems(spark, d)
    dear = run(o, select(attribute("o_totalprice", "gt", 300000))).df.select("c_o_orderkey", F.col("c_o_orderpriority").alias("priority"))
    pairs = dear.join(li.df.select("c_l_orderkey", F.col("c_l_returnflag").alias("flag"), F.col("id").alias("line")), F.col("c_o_orderkey") == F.col("c_l_orderkey"))
    made = Derivation("order-lines", {"priority": ("p", "str", None), "flag": ("p", "str", None), "line": ("d", "str", None)}).emit(pairs.select("priority", "flag", "line"), id=F.concat(F.lit("pair:"), F.col("line"), F.col("priority")))
    return run(made, select(has(role={"exact": "line"}))).df.groupBy(F.col("c_priority").alias("priority"), F.col("c_flag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = l_linenumber")
def derive_attr_eq(spark, d):
    df, claims = lineitems(spark, d)
    made = Derivation("equal", {"of": ("d", "str", None)}).emit(claims.df.where("c_l_quantity = c_l_linenumber").select(F.col("id").alias("of")), id=F.concat(F.lit("eq:"), F.col("of")))
    kept = ClaimSet(claims.df.join(made.df.select(F.col("c_of").alias("id")), "id", "left_semi"), claims.layout)
    return decode_relation(kept, df, ["l_orderkey", "l_linenumber", "l_quantity"])


SUMS = {"props": {}, "default": {"merge": "sum"}}


def thirds(claims: DataFrame, part: int) -> DataFrame:
    return claims.where(F.pmod(F.substring("id", 4, 20).cast("long"), F.lit(3)) == part)


@query(f"SELECT {_USER}, round(sum(value), 2) AS value, count(*) AS n FROM events GROUP BY ALL")
def reactor_incremental(spark, d):
    """Event claims in three micro-batches; the view after the last one."""
    reactor = Reactor(spark, verify=False)
    reactor.register("sums", GROUPED, SUMS)
    claims = events(spark, d).general().df
    for part in range(3):
        reactor.ingest(thirds(claims, part))
    reactor.ingest(claims.where("author = 'error'"))  # repeats change nothing
    n = reactor.log().df.select(F.get("pointers", F.lit(0)).alias("p")).groupBy(F.col("p.entity").alias("root"), F.col("p.context").alias("prop")).agg(F.count(F.lit(1)).alias("n"))
    return reactor.view("sums").select("root", "prop", F.round("value.num", 2).alias("value")).join(n, ["root", "prop"])


@query(f"{_ALL} SELECT 'user:' || user_id AS root, event_type AS prop, count(*)::DOUBLE AS value FROM r WHERE NOT negated GROUP BY ALL")
def reactor_restart(spark, d):
    """A view under negation, over batches that a second reactor, opened on the first one's folder, completes."""
    claims = events(spark, d, negating=True).general().df
    first = Reactor(spark, verify=False)
    first.register("standing", {"op": "group", "key": "byTargetContext", "in": {"op": "mask", "policy": "drop", "in": "input"}}, {"props": {}, "default": {"merge": "count"}})
    first.ingest(thirds(claims, 2))
    second = Reactor(spark, first.path, verify=False)
    second.ingest(thirds(claims, 0))
    second.ingest(thirds(claims, 1))
    return numbers(Reactor(spark, first.path).view("standing"))


@query("SELECT DISTINCT 'user:' || user_id AS root, event_type AS prop FROM events WHERE event_id % 3 = 1")
def change_events(spark, d):
    """What the last batch changed of a view of counts: the properties that it adds to."""
    reactor = Reactor(spark, verify=False)
    reactor.register("counts", GROUPED, {"props": {}, "default": {"merge": "count"}})
    claims = events(spark, d).general().df
    reactor.ingest(claims.where(F.pmod(F.substring("id", 4, 20).cast("long"), F.lit(3)) != 1))
    return reactor.ingest(thirds(claims, 1))["counts"].select("root", "prop")


def customer_claims(spark, d) -> DataFrame:
    """Customers' balances under their nation, addressed by content, as claim rows with the customer's and the region's key."""
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    layout = [PointerSpec("nation", "e", column="c_n", context="customers"), PointerSpec("balance", "p", "num", "c_b")]
    columns = {"c_n": F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")), "c_b": F.col("c_acctbal"), "c_key": F.col("c_custkey"), "c_region": F.col("n_regionkey")}
    return claim_frame(c, layout, id=None, author=F.lit("registry"), timestamp=F.col("c_custkey"), columns=columns).df


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 7 < 2 THEN 'rejected' ELSE 'accepted' END AS status, CASE c_custkey % 7 WHEN 0 THEN 'the id is not the address of the claims' WHEN 1 THEN 'author must be a non-empty string' END AS reason FROM customer")
def ingest_rejects(spark, d):
    """Forged ids and claims without an author are turned away with the reason."""
    claims = customer_claims(spark, d)
    kind = F.pmod(F.col("c_key"), F.lit(7))
    sent = claims.withColumn("id", F.when(kind == 0, F.concat(F.substring("id", 1, 60), F.lit("00000000"))).otherwise(F.col("id"))).withColumn("author", F.when(kind == 1, "").otherwise(F.col("author")))
    return Reactor(spark).ingest(sent)[""].join(sent.select("id", F.col("c_key").alias("key")), "id").select("key", "status", "reason")


@query("SELECT n_nationkey AS key FROM nation WHERE n_regionkey IN (0, 1, 4)")
def bundle_atomic(spark, d):
    """A bundle for each region; one holds a forged claim and one a claim that its manifest does not list, and neither leaves a trace."""
    from assertia.streaming.peer import manifests

    n = read(spark, d, "nation")
    claims = claim_frame(n, [PointerSpec("nation", "e", column="c_n", context="name"), PointerSpec("name", "p", "str", "c_x")], id=None, author=F.lit("clerk"), timestamp=F.lit(0.0), columns={"c_n": F.col("n_nationkey").cast("string"), "c_x": F.col("n_name"), "c_region": F.col("n_regionkey")}).df
    heads = manifests(claims.where("not (c_region = 3 and c_n = (select cast(max(n_nationkey) as string) from {n} where n_regionkey = 3))".replace("{n}", "parquet.`" + f"{d}/nation.parquet" + "`")).select(F.col("c_region").alias("bundle"), "id"), "clerk", 1.0)
    reactor = Reactor(spark)
    for head in heads.collect():  # one for each region
        sent = claims.where(F.col("c_region") == head.bundle)
        if head.bundle == 2:
            sent = sent.withColumn("timestamp", F.lit(5.0))
        reactor.ingest_bundle(head.id, sent.select("id", "author", "timestamp", "pointers", "sig").unionByName(heads.where(F.col("id") == head.id).drop("bundle")))
    return reactor.log().df.where("author = 'clerk' and timestamp = 0").select(F.get("pointers", F.lit(0))["entity"].cast("long").alias("key"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.where("prop = 'customers'").select("root", F.col("root").alias("nation"), F.col("value.num").alias("total"))


def derived(spark, d, emit: str, batches: list[str], budget: int = 9) -> tuple:
    """A binding that keeps each nation's total, over batches of customers that conditions choose."""
    from assertia.streaming.derivation import Binding, Host

    reactor = Reactor(spark)
    reactor.register("nations", {"op": "group", "key": "byTargetContext", "in": {"op": "select", "pred": has(role={"exact": "nation"}), "in": {"op": "mask", "policy": "drop", "in": "input"}}}, SUMS)
    host = Host(reactor)
    author = host.install(Binding("binding:totals", "fn:totals", "nations", totals, {"nation": ("e", "str", "derived:total"), "total": ("p", "num", None)}, budget, emit, ("nation",)), bytes(range(32)))
    claims = customer_claims(spark, d)
    for condition in batches:
        host.ingest(claims.where(condition))
    return reactor, author


def standing_totals(reactor: Reactor, author: str) -> DataFrame:
    view = reactor.eval({"op": "group", "key": "byTargetContext", "in": select({"and": [{"match": {"field": "author", "cmp": "eq", "const": author}}, has(role={"exact": "total"})]}, {"op": "mask", "policy": "drop", "in": "input"})}, "all")
    total = F.get(F.filter("pointers", lambda p: p["role"] == "total"), F.lit(0))["num"]
    return view.entries.where("prop = 'derived:total'").select("root", F.round(total, 2).alias("total"))


_TOTALS = "SELECT 'nation:' || c_nationkey AS root, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {} GROUP BY ALL"


@query(f"{_TOTALS.format('true')} HAVING bool_or(c_custkey % 2 = 1)")
def derive_supersede(spark, d):
    """Each batch's totals take back all that the binding said before: nations that the second batch does not reach have none."""
    return standing_totals(*derived(spark, d, "supersede", ["c_key % 2 = 0", "c_key % 2 = 1"]))


@query(f"{_TOTALS.format('c_custkey % 2 = 0 OR n_regionkey = 1')}")
def derive_keyed(spark, d):
    """The second batch reaches one region's nations: only these nations' totals are replaced."""
    return standing_totals(*derived(spark, d, "keyed", ["c_key % 2 = 0", "c_key % 2 = 1 and c_region = 1"]))


@query(f"SELECT * FROM ({_TOTALS.format('c_custkey % 2 = 0')}) UNION ALL SELECT 'binding:totals', NULL")
def derive_budget(spark, d):
    """A second trigger beyond the budget suspends the binding, which a claim says; the third batch finds it suspended."""
    reactor, author = derived(spark, d, "supersede", ["c_key % 2 = 0", "c_key % 2 = 1 and c_region = 1", "c_key % 2 = 1 and c_region = 2"], budget=1)
    said = reactor.log().df.where(F.exists("pointers", lambda p: p["context"] == "suspensions")).select(F.get("pointers", F.lit(0))["entity"].alias("root"), F.lit(None).cast("double").alias("total"))
    return standing_totals(reactor, author).unionByName(said)


@query("SELECT n_name AS name, n_regionkey < 2 AS here FROM nation WHERE n_regionkey < 4")
def sync_both(spark, d):
    """Two peers with half of the nations each; one keeps a region to itself by its lens, and one does not admit another region."""
    from assertia.streaming.peer import Peer
    from assertia.streaming.peer import sync_both as both

    of = {b: [{"timestamp": float(r.n_nationkey), "pointers": [{"role": "region", "target": {"id": f"region:{r.n_regionkey}", "context": "nations"}}, {"role": "name", "target": r.n_name}]} for r in read(spark, d, "nation").where(f"(n_regionkey < 2) = {b}").collect()] for b in (True, False)}
    a = Peer(spark, bytes([1] * 32), admission={"not": has(targetEntity="region:4")})
    b = Peer(spark, bytes([2] * 32))
    a.author_claims(of[True])
    b.author_claims(of[False])
    both(a, b)
    return a.reactor.log().df.select(F.get("pointers", F.lit(1))["str"].alias("name"), (F.col("author") == a.author).alias("here"))


# --- predicates and readings that the queries above do not reach -----------------------------------------------------------------------


@query(f"{ORDER_SQL} WHERE o_totalprice > 200000")
def select_constants(spark, d):
    dear = attribute("o_totalprice", "gt", 200000)
    return order_query(spark, d, select({"and": [{"or": ["false", dear]}, {"not": {"and": [{"not": "true"}, "true"]}}]}))


@query("SELECT 'orders:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def select_is_primitive(spark, d):
    """A pointer that is a primitive and not just one of its role."""
    claims = customer_orders(spark, d).general()
    pred = {"and": [{"and": [has(role={"exact": "customer"}, targetIsPrimitive=False), {"not": has(role={"exact": "priority"}, targetIsPrimitive=False)}]}, {"and": [has(targetIsPrimitive=True, targetValue={"vcmp": {"cmp": "eq", "value": "1-URGENT"}}), {"match": {"field": "author", "cmp": "eq", "const": "F"}}]}]}
    return run(claims, select(pred)).df.select("id")


_LAST = "SELECT event_id, value, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS last FROM events"


@query(f"SELECT event_id, value FROM ({_LAST}) WHERE event_type = 'error' AND last = (SELECT min(last) FROM ({_LAST}) WHERE event_type = 'error')")
def select_target_delta(spark, d):
    claims = events(spark, d, negating=True)
    first = claims.df.agg(F.min(F.substring("c_target", 4, 20).cast("long")).alias("x")).first().x
    return event_rows(run(claims, select(has(targetDelta=f"ev:{first}", role={"exact": "negates"}))))


@query("SELECT event_id, value FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)")
def inview_role(spark, d):
    """Entities that a role names, against the author."""
    view = {"inView": BUYERS["inView"] | {"extract": {"role": "user"}}}
    return event_rows(run(events(spark, d, author="user"), select(view)))


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 100 AND event_id % 2 = 0")
def inview_id(spark, d):
    view = {"inView": {"term": select({"and": [has(context={"exact": "purchase"}), attribute("value", "gt", 100)]}), "field": "id", "extract": {"field": "id"}}}
    return event_rows(run(events(spark, d), select(view))).where("event_id % 2 = 0")


@query(f"SELECT 'customer:' || c_custkey AS root, n_name AS prop, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ({_SAME_REGION}) GROUP BY ALL")
def alias_prune(spark, d):
    return membership(run(alias_claims(spark, d), {"op": "prune", "keep": {"aliased": {"name": first_nation(spark, d)}}, "in": GROUPED}, "all"))


@query("SELECT c_name AS name, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def nested_reading(spark, d):
    """Customers whose nation, and whose nation's region, are read in place: canonical bytes, decoded."""
    from assertia.functions.canon import decode

    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))

    def laid(df: DataFrame, name: str, key: str, specs: list, columns: dict) -> DataFrame:
        return claim_frame(df, specs, id=F.concat(F.lit(f"{name}:"), F.col(key).cast("string")), author=F.lit(name), timestamp=F.lit(0.0), columns=columns).general().df

    def entity(prefix: str, key: str):
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    sets = [
        laid(c, "customer", "c_custkey", [PointerSpec("self", "e", column="c_c", context="about"), PointerSpec("name", "p", "str", "c_x"), PointerSpec("nation", "e", column="c_n")], {"c_c": entity("c", "c_custkey"), "c_x": F.col("c_name"), "c_n": entity("n", "c_nationkey")}),
        laid(n, "nation", "n_nationkey", [PointerSpec("self", "e", column="c_n", context="about"), PointerSpec("name", "p", "str", "c_x"), PointerSpec("region", "e", column="c_r")], {"c_n": entity("n", "n_nationkey"), "c_x": F.col("n_name"), "c_r": entity("r", "n_regionkey")}),
        laid(r, "region", "r_regionkey", [PointerSpec("self", "e", column="c_r", context="about"), PointerSpec("name", "p", "str", "c_x")], {"c_r": entity("r", "r_regionkey"), "c_x": F.col("r_name")}),
    ]
    registry = Registry.from_json(
        [
            {"name": "Region", "alg": 1, "body": AT_ROOT},
            {"name": "Nation", "alg": 1, "body": {"op": "expand", "role": {"exact": "region"}, "schema": "Region", "reading": "One", "in": AT_ROOT}},
            {"name": "Customer", "alg": 1, "body": {"op": "expand", "role": {"exact": "nation"}, "schema": "Nation", "reading": "One", "in": AT_ROOT}},
        ],
        [{"name": "One", "alg": 1, "props": {}, "default": PICK}],
    )
    term = parse_term({"op": "resolve", "schema": {"props": {}, "default": PICK}, "in": registry.program("Customer").body})
    out = Planner(ClaimSet(sets[0].unionByName(sets[1]).unionByName(sets[2])), registry).plan(term, c.select(entity("c", "c_custkey").alias("root")))

    def opened(batches):
        import pandas as pd

        for pdf in batches:
            found = [decode(bytes(x)) for x in pdf["cbor"]]
            yield pd.DataFrame({"name": [x["name"] for x in found], "nation": [x["nation"]["about"]["name"] for x in found], "region": [x["nation"]["about"]["region"]["about"] for x in found]})

    return out.rows.select("value.cbor").mapInPandas(opened, "name string, nation string, region string")


@query()
def set_digest(spark, d):
    """One digest of all orders."""
    return spark.createDataFrame([(digest(orders(spark, d)[1]),)], "digest string")


_ADDRESSED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def addressed_orders(spark, d) -> tuple[DataFrame, ClaimSet]:
    df = read(spark, d, "orders")
    return df, encode_relation(df, "orders", _ADDRESSED)


@query(f"SELECT {', '.join(_ADDRESSED)} FROM orders")
def pack_roundtrip(spark, d):
    """All orders as written packs, read back: ids are recomputed from what the packs hold."""
    from assertia.plans.tables import written
    from assertia.sources.pack import packs, read_packs

    df, claims = addressed_orders(spark, d)
    return decode_relation(read_packs(written(packs(claims), "packs")), df, _ADDRESSED)


@query(f"SELECT {', '.join(_ADDRESSED)} FROM orders")
def json_roundtrip(spark, d):
    """All orders as JSON lines, read back and verified."""
    from assertia.plans.tables import fresh_path
    from assertia.sources.profile import read_claims, write_claims

    df, claims = addressed_orders(spark, d)
    path = fresh_path(spark, "lines")
    write_claims(claims, path)
    return decode_relation(ClaimSet(read_claims(spark.read.text(path)).where("reason is null").drop("reason")), df, _ADDRESSED)
