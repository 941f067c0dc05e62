"""The queries over the shared tables: each with the SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..console import Console
from ..functions.columns import named
from ..generate import Workload
from ..plans.dag import INDEXED
from ..plans.expr import And, Const, Expr, Leaf, Not, Or, Xnor, Xor
from ..plans.parser import parse
from ..registry import Config, Registry
from ..schema import AttrType, Schema
from ..sources.events import accepted, decoded, rejected
from ..streaming.tables import stream_to_table
from .deliver import deliver
from .match import evaluate, exists, match, match_ids, match_lists, match_stats

EVENTS = Schema([("user_id", "int"), ("value", "float"), ("event_type", "string"), ("k", "int"), ("hot", "bool"), ("tags", "string_list"), ("ks", "int_list")])
#: The events with attributes of every type; some are left undefined by rule, so that three-valued logic shows.
EVENTS_SQL = """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value, CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 <> 0 THEN value > 100 END AS hot,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 6 = 0 THEN [] ELSE list_sort(list_distinct([event_type, 'u' || (user_id % 4)])) END AS tags,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 8 = 0 THEN [] ELSE list_sort(list_distinct([user_id % 5, event_id % 9])) END AS ks
FROM events"""


def derived(e: DataFrame) -> DataFrame:
    unless = lambda n, c: F.when(F.col("event_id") % n != 0, c)
    tags = F.when(F.col("event_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))))
    ks = F.when(F.col("event_id") % 8 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("user_id") % 5, F.col("event_id") % 9))
    return e.select(
        "event_id", unless(7, F.col("user_id")).alias("user_id"), unless(5, F.col("value")).alias("value"), unless(11, F.col("event_type")).alias("event_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), unless(3, F.col("value") > 100).alias("hot"), unless(13, tags).alias("tags"), unless(17, ks).alias("ks"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark.read.parquet(f"{sf_dir}/events.parquet"))


Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}

#: name: rule, the same predicate in SQL
PREDICATES = {
    "pred_var": ("hot", "hot"),
    "pred_not_var": ("not hot", "NOT hot"),
    "cmp_int_lt": ("user_id < 20", "user_id < 20"),
    "cmp_int_le": ("user_id <= 20", "user_id <= 20"),
    "cmp_int_gt": ("20 < user_id", "user_id > 20"),
    "cmp_int_ge": ("20 <= user_id", "user_id >= 20"),
    "cmp_int_eq": ("user_id == 3", "user_id = 3"),
    "cmp_int_ne": ("user_id <> 3", "user_id <> 3"),
    "cmp_float_lt": ("value < 50", "value < 50"),
    "cmp_float_le": ("value <= 50.5", "value <= 50.5"),
    "cmp_float_gt": ("value > 1.0e2", "value > 100"),
    "cmp_float_ge": ("value >= 100", "value >= 100"),
    "cmp_float_eq": ("value = 100.25", "value = 100.25"),
    "cmp_float_ne": ("value != 100.25", "value <> 100.25"),
    "cmp_str_eq": ("event_type = 'click'", "event_type = 'click'"),
    "cmp_str_ne": ("event_type <> 'click'", "event_type <> 'click'"),
    "in_int": ("user_id in [1, 2, 3, 5, 8, 13]", "user_id IN (1, 2, 3, 5, 8, 13)"),
    "not_in_int": ("user_id not in (1, 2, 3)", "user_id NOT IN (1, 2, 3)"),
    "in_str": ("event_type in ['click', 'view']", "event_type IN ('click', 'view')"),
    "not_in_str": ("event_type not in ['click']", "event_type NOT IN ('click')"),
    "between_int": ("user_id between 5 and 9", "user_id BETWEEN 5 AND 9"),
    "between_float": ("value between 20 and 30.5", "value BETWEEN 20 AND 30.5"),
    "between_empty": ("user_id between 9 and 5", "user_id BETWEEN 9 AND 5"),
    "one_of_int": ("ks one of [1, 3]", "list_has_any(ks, [1, 3])"),
    "one_of_str": ("tags one of ['u1', 'click']", "list_has_any(tags, ['u1', 'click'])"),
    "value_in_list": ("3 in ks", "list_contains(ks, 3)"),
    "none_of_int": ("ks none of [1, 3]", "NOT list_has_any(ks, [1, 3])"),
    "none_of_str": ("tags none of ['u1']", "NOT list_has_any(tags, ['u1'])"),
    "all_of_int": ("ks all of [1, 3]", "list_has_all(ks, [1, 3])"),
    "all_of_str": ("tags all of ['u1', 'click']", "list_has_all(tags, ['u1', 'click'])"),
    "not_all_of": ("not (tags all of ['u1', 'click'])", "NOT list_has_all(tags, ['u1', 'click'])"),
    "is_null": ("event_type is null", "event_type IS NULL"),
    "is_not_null": ("value is not null", "value IS NOT NULL"),
    "is_empty": ("tags is empty", "len(tags) = 0"),
    "is_not_empty": ("ks is not empty", "len(ks) > 0"),
    "and_or_not": ("hot and user_id > 5 or not (event_type = 'view')", "(hot AND user_id > 5) OR NOT (event_type = 'view')"),
    "symbols": ("hot && !(user_id > 5) || event_type == 'view'", "(hot AND NOT (user_id > 5)) OR event_type = 'view'"),
    "xor": ("hot xor user_id > 10", "hot <> (user_id > 10)"),
    "xnor": ("hot xnor user_id > 10", "hot = (user_id > 10)"),
    "xor_chain": ("hot xor user_id > 10 xnor value > 50", "(hot <> (user_id > 10)) = (value > 50)"),
    "precedence": ("hot or user_id > 10 xor value > 50 and k = 1", "hot OR ((user_id > 10) <> (value > 50 AND k = 1))"),
    "demorgan": ("not (hot or user_id > 10 and ks is empty)", "NOT (hot OR (user_id > 10 AND len(ks) = 0))"),
    "undefined_negation": ("not (user_id > 10)", "NOT (user_id > 10)"),
    "constants": ("hot or true and not false", "hot OR true"),
    "no_match": ("false or user_id < -1", "user_id < -1"),
}
#: id: rule, the same in SQL; id 9 repeats 3's rule, 10 matches always, 11 never
MANY = {
    1: ("value > 100 and user_id = 3", "value > 100 AND user_id = 3"),
    2: ("event_type = 'click' and value < 30", "event_type = 'click' AND value < 30"),
    3: ("tags one of ['click', 'u2'] and not hot", "list_has_any(tags, ['click', 'u2']) AND NOT hot"),
    4: ("user_id in [1, 2, 3] or ks all of [2, 4]", "user_id IN (1, 2, 3) OR list_has_all(ks, [2, 4])"),
    5: ("not (value between 10 and 90) and event_type is not null", "NOT (value BETWEEN 10 AND 90) AND event_type IS NOT NULL"),
    6: ("hot xor user_id > 10", "hot <> (user_id > 10)"),
    7: ("tags is empty or user_id is null", "len(tags) = 0 OR user_id IS NULL"),
    8: ("(user_id in [1, 2, 3] or ks all of [2, 4]) and value >= 50 and event_type <> 'view'", "(user_id IN (1, 2, 3) OR list_has_all(ks, [2, 4])) AND value >= 50 AND event_type <> 'view'"),
    9: ("not hot and tags one of ['u2', 'click']", "list_has_any(tags, ['click', 'u2']) AND NOT hot"),
    10: ("true or hot", "true"),
    11: ("false and hot", "false"),
}


def registry(rules: dict[int, tuple[str, str]] = MANY, config: Config | None = None) -> Registry:
    out = Registry(EVENTS, config)
    for sub, (rule, _) in rules.items():
        out.insert(sub, rule)
    return out


def union_sql(rules: dict[int, str], table: str = "e", id_column: str = "event_id") -> str:
    return " UNION ALL ".join(f"SELECT {id_column} AS event_id, CAST({s} AS BIGINT) AS sub_id FROM {table} WHERE {p}" for s, p in rules.items())


def many_sql(ids: tuple[int, ...] | None = None) -> str:
    return f"WITH e AS ({EVENTS_SQL}) " + union_sql({s: p for s, (_, p) in MANY.items() if ids is None or s in ids})


def duck(expr: Expr) -> str:
    """A rule in DuckDB's SQL."""

    def value(x: object) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    if isinstance(expr, Const):
        return "true" if expr.value else "false"
    if not isinstance(expr, Leaf):
        own = [f"({duck(c)})" for c in expr.children]
        return f"NOT {own[0]}" if isinstance(expr, Not) else {And: " AND ", Or: " OR ", Xor: " <> ", Xnor: " = "}[type(expr)].join(own)
    c, many = f'"{expr.attr}"', isinstance(expr.operand, tuple)
    listed = ", ".join(map(value, expr.operand)) if many else ""
    signs = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "<>"}
    if expr.kind in signs:
        return f"{c} {signs[expr.kind]} {value(expr.operand)}"
    return {
        "var": c, "not_var": f"NOT {c}", "in": f"{c} IN ({listed})", "not_in": f"{c} NOT IN ({listed})", "one_of": f"list_has_any({c}, [{listed}])", "none_of": f"NOT list_has_any({c}, [{listed}])",
        "all_of": f"list_has_all({c}, [{listed}])", "not_all_of": f"NOT list_has_all({c}, [{listed}])", "is_null": f"{c} IS NULL", "is_not_null": f"{c} IS NOT NULL", "is_empty": f"len({c}) = 0", "is_not_empty": f"len({c}) > 0",
    }[expr.kind]


def values_sql(rows: list[tuple], *columns: str) -> str:
    """A fixed table: text and whole numbers."""
    told = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x} AS BIGINT)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) AS t({', '.join(columns)})"


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def keep(f: Run) -> Run:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _single(name: str, rule: str, predicate: str) -> None:
    @query(name, f"WITH e AS ({EVENTS_SQL}) SELECT event_id, CAST(7 AS BIGINT) AS sub_id FROM e WHERE {predicate}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match(events(spark, sf_dir), registry({7: (rule, predicate)}))


for _name, (_rule, _predicate) in PREDICATES.items():
    _single(_name, _rule, _predicate)


def _way(how: str) -> None:
    @query(f"match_many_{how}", many_sql())
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match(events(spark, sf_dir), registry(), how)


for _how in ("compiled", "indexed", "relational"):
    _way(_how)


#: All single predicates as the rules of one registry.
ALL = {100 + i: x for i, x in enumerate(PREDICATES.values())}


def _predicates(how: str) -> None:
    @query(f"predicates_{how}", f"WITH e AS ({EVENTS_SQL}) " + union_sql({s: p for s, (_, p) in ALL.items()}))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match(events(spark, sf_dir), registry(ALL), how)


for _how in ("compiled", "indexed", "relational"):
    _predicates(_how)


@query("match_many_indexed_off", many_sql())
def match_many_indexed_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(events(spark, sf_dir), registry(config=Config(reorganize=False, self_adjust=False, on_demand=False, indexed=False)), "indexed")


_LISTS = "CASE WHEN {p} THEN CAST({s} AS BIGINT) END"


@query("match_lists", f"WITH e AS ({EVENTS_SQL}) SELECT event_id, array_to_string(list_filter([{', '.join(_LISTS.format(p=p, s=s) for s, (_, p) in MANY.items())}], lambda x: x IS NOT NULL), ',') AS sub_ids FROM e")
def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_lists(events(spark, sf_dir), registry(), "indexed")
    return found.select("event_id", F.array_join(F.transform("sub_ids", lambda x: x.cast("string")), ",").alias("sub_ids"))


_SOME = {s: MANY[s] for s in (1, 2, 3)}


@query("exists", f"WITH e AS ({EVENTS_SQL}) SELECT event_id, coalesce(({') OR ('.join(p for _, p in _SOME.values())}), false) AS matched FROM e")
def any_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exists(events(spark, sf_dir), registry(_SOME))


@query("match_ids", many_sql((2, 4, 10)))
def allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_ids(events(spark, sf_dir), registry(), [2, 4, 10, 99], "indexed")


@query("always", many_sql((10,)))
def always(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(events(spark, sf_dir), registry({s: MANY[s] for s in (10, 11)}), "relational")


@query("shared_expression_ids", many_sql((3, 9)))
def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = registry({s: MANY[s] for s in (3, 9)})
    assert own.at[3] == own.at[9]
    return match(events(spark, sf_dir), own, "indexed")


@query("after_delete", many_sql((1, 2, 3, 5, 6, 7, 8, 10)))
def after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = registry()
    for sub in (4, 9, 11):
        own.delete(sub)
    own.validate()
    return match(events(spark, sf_dir), own, "indexed")


@query("after_reinsert", many_sql())
def after_reinsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = registry()
    for sub in (4, 9, 1):
        own.delete(sub)
    for sub in (9, 1, 4):
        own.insert(sub, MANY[sub][0])
    own.validate()
    return match(events(spark, sf_dir), own, "relational")


@query("tri_eval", f"WITH e AS ({EVENTS_SQL}) SELECT event_id, (hot AND user_id > 10) OR NOT (value < 50) AS value FROM e")
def tri_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(events(spark, sf_dir), registry(), "hot and user_id > 10 or not (value < 50)")


@query("nan_undefined", "SELECT event_id, CAST(1 AS BIGINT) AS sub_id FROM events WHERE event_id % 4 <> 0 AND NOT (value > 50) UNION ALL SELECT event_id, CAST(2 AS BIGINT) FROM events WHERE event_id % 4 = 0")
def nan_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return match(e, registry({1: ("not (value > 50)", ""), 2: ("value is null", "")}), "indexed")


@query("infinity", "SELECT event_id, CAST(1 AS BIGINT) AS sub_id FROM events WHERE event_id % 4 = 0 OR value > 120")
def infinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"))
    return match(e, registry({1: ("value > 120", "")}))


_PAYLOAD = Schema([("user_id", "int"), ("value", "float"), ("event_type", "string"), ("seen", "int_list")])
_INGESTED = "SELECT event_id, CAST(1 AS BIGINT) AS sub_id FROM events WHERE event_id % 10 <> 0 AND user_id > 5 AND event_type = 'click' UNION ALL SELECT event_id, CAST(2 AS BIGINT) FROM events WHERE event_id % 10 <> 0 AND event_id % 3 = 1"


def _payloads(spark: SparkSession, sf_dir: str, as_json: bool) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bad = F.col("event_id") % 10 == 0
    user = F.when(bad, F.lit('"x"') if as_json else F.lit("1.5")).otherwise(F.col("user_id").cast("string"))
    sep, sign, quote = (",", ":", '"') if as_json else (";", "=", "")
    name = lambda n: F.lit(f"{quote}{n}{quote}{sign}")
    item = [F.concat(name("user_id"), user), F.concat(name("value"), F.col("value").cast("string")), F.concat(name("event_type"), F.lit('"'), F.col("event_type"), F.lit('"')), F.concat(name("seen"), F.lit("["), (F.col("event_id") % 3).cast("string"), F.lit(", 7]"))]
    text = F.concat_ws(sep, *item)
    return e.select("event_id", (F.concat(F.lit("{"), text, F.lit("}")) if as_json else text).alias("payload"))


def _ingest(name: str, as_json: bool) -> None:
    @query(f"{name}_ingest", _INGESTED)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = Registry(_PAYLOAD)
        own.insert(1, "user_id > 5 and event_type = 'click'")
        own.insert(2, "1 in seen")
        return match(accepted(decoded(_payloads(spark, sf_dir, as_json), _PAYLOAD)), own)

    @query(f"{name}_rejects", "SELECT event_id, 'invalid argument: bad item ''user_id'': unknown attribute or a value of the wrong type' AS error FROM events WHERE event_id % 10 = 0")
    def bad(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rejected(decoded(_payloads(spark, sf_dir, as_json), _PAYLOAD)).select("event_id", "error")


_ingest("json", True)
_ingest("line", False)

_SUBSCRIBERS = [("a", "push", 1), ("a", "push", 1), ("b", "push", 1), ("b", "row", 2), ("c", "push", None), ("d", "row", 77)]


def _deliver(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Registry(_PAYLOAD)
    own.insert(1, "user_id = 3 and event_type = 'click'")
    own.insert(2, "user_id = 4")
    told = _payloads(spark, sf_dir, True)
    matches = match(accepted(decoded(told, _PAYLOAD)), own)
    subs = spark.createDataFrame(_SUBSCRIBERS, "subscriber_id string, kind string, sub_id bigint")
    out = deliver(matches, told, subs)
    return out.select("subscriber_id", "kind", "event_id", F.col("sub_id").cast("bigint").alias("sub_id"), F.sha2("message", 256).alias("message_sha256"))


_TOLD = """WITH p AS (SELECT event_id, user_id, event_type, '{"user_id":' || user_id || ',"value":' || CAST(value AS VARCHAR) || ',"event_type":"' || event_type || '","seen":[' || (event_id % 3) || ', 7]}' AS payload FROM events WHERE event_id % 10 <> 0),
m AS (SELECT event_id, CAST(1 AS BIGINT) AS sub_id, payload FROM p WHERE user_id = 3 AND event_type = 'click' UNION ALL SELECT event_id, CAST(2 AS BIGINT), payload FROM p WHERE user_id = 4)
"""


@query("deliver_per_id", _TOLD + "SELECT s.subscriber_id, s.kind, m.event_id, m.sub_id, sha256(m.payload) AS message_sha256 FROM m JOIN (VALUES ('a', 'push', 1), ('b', 'push', 1), ('b', 'row', 2)) AS s(subscriber_id, kind, sub_id) ON s.sub_id = m.sub_id")
def deliver_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deliver(spark, sf_dir).where("subscriber_id <> 'c'")


@query("deliver_catch_all", _TOLD + """SELECT 'c' AS subscriber_id, 'push' AS kind, event_id, sub_id, sha256('{"id":' || sub_id || ',"event":' || payload || '}') AS message_sha256 FROM m""")
def deliver_catch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deliver(spark, sf_dir).where("subscriber_id = 'c'")


#: Wider rows as events: table, id column, schema, rules
WIDE = {
    "lineitem_rules": (
        "lineitem",
        "l_orderkey * 10 + l_linenumber",
        Schema([("l_quantity", "float"), ("l_discount", "float"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_suppkey", "int")]),
        {
            1: ("l_quantity < 10 and l_discount >= 0.05", "l_quantity < 10 AND l_discount >= 0.05"),
            2: ("l_returnflag in ['R', 'A'] and l_linestatus <> 'O'", "l_returnflag IN ('R', 'A') AND l_linestatus <> 'O'"),
            3: ("l_suppkey between 1 and 5 xor l_returnflag <> 'N'", "(l_suppkey BETWEEN 1 AND 5) <> (l_returnflag <> 'N')"),
            4: ("not (l_quantity > 5 or l_returnflag = 'A')", "NOT (l_quantity > 5 OR l_returnflag = 'A')"),
        },
    ),
    "orders_rules": (
        "orders",
        "o_orderkey",
        Schema([("o_totalprice", "float"), ("o_orderstatus", "string"), ("o_orderpriority", "string"), ("o_custkey", "int")]),
        {
            1: ("o_totalprice > 200000 and o_orderstatus = 'O'", "o_totalprice > 200000 AND o_orderstatus = 'O'"),
            2: ("o_orderpriority in ['1-URGENT', '2-HIGH'] or o_custkey < 10", "o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_custkey < 10"),
            3: ("o_orderstatus <> 'F' and not (o_custkey in [1, 2, 3])", "o_orderstatus <> 'F' AND o_custkey NOT IN (1, 2, 3)"),
        },
    ),
}


def _wide(name: str, table: str, key: str, schema: Schema, rules: dict[int, tuple[str, str]]) -> None:
    @query(name, union_sql({s: p for s, (_, p) in rules.items()}, table, f"CAST({key} AS BIGINT)"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        typed = [named(n).cast(t.spark).alias(n) for n, t in schema if n in rows.columns]
        own = Registry(schema)
        for sub, (rule, _) in rules.items():
            own.insert(sub, rule)
        return match(rows.select(F.expr(key).cast("bigint").alias("event_id"), *typed), own, "indexed")


for _name, _spec in WIDE.items():
    _wide(_name, *_spec)


@query("stream_match", many_sql())
def stream_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, matched micro-batch by micro-batch into a table of the shared folder, to its end."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return stream_to_table(source, lambda batch: match(derived(batch), registry()))


def _stats_sql() -> str:
    """The counters of a search, node by node: a level is a subquery that adds its nodes' truth."""
    own = registry()
    d, told = own.dag, {n: f"coalesce({duck(x)}, false) AS n{n}" for x, n in own.dag.leaves.items()}
    steps = [f"WITH e AS ({EVENTS_SQL}), s1 AS (SELECT *, {', '.join(told.values())} FROM e)"]
    last = 1
    for level, nodes in d.levels():
        if level > 1:
            joined = ", ".join(f"({(' AND ' if d.nodes[n].kind == 'and' else ' OR ').join(f'n{c}' for c in sorted(d.nodes[n].children))}) AS n{n}" for n in nodes)
            steps.append(f"s{level} AS (SELECT *, {joined} FROM s{last})")
            last = level
    count = lambda parts: " + ".join(f"CAST({p} AS BIGINT)" for p in parts) or "CAST(0 AS BIGINT)"
    tried = [f"n{n}" if x.kind in INDEXED else "true" if x.kind == "is_not_null" else f'("{x.attr}" IS NOT NULL)' for x, n in d.leaves.items()]
    ands, ors = ([n for n, x in d.nodes.items() if x.kind == k] for k in ("and", "or"))
    woken = [f"n{d.nodes[n].access}" for n in ands]
    seen = [f"({' OR '.join(f'n{c}' for c in sorted(d.nodes[n].children))})" for n in ors]
    always = ["true"] * len(own.always)
    columns = {"matches": [f"n{n}" for n in own.at.values()] + always, "predicates_evaluated": tried, "predicates_true": [f"n{n}" for n in d.leaves.values()], "nodes_visited": woken + seen, "and_woken": woken, "and_true": [f"n{n}" for n in ands], "or_visited": seen}
    return f"{', '.join(steps)} SELECT event_id, {', '.join(f'{count(v)} AS {k}' for k, v in columns.items())} FROM s{last}"


@query("report_stats", _stats_sql())
def report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_stats(events(spark, sf_dir), registry())


#: What the graph of MANY has.
_DAG_STATS = [("edges", 23), ("indexed_leaves", 14), ("leaves", 18), ("max_level", 3), ("nodes", 29), ("reorganized", 0), ("scanned_leaves", 4), ("self_adjusted", 0), ("strings", 3), ("subscriptions", 11)]


@query("dag_stats", values_sql(_DAG_STATS, "name", "value"))
def dag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sorted(registry().stats().items()), "name string, value bigint")


def _large() -> Registry:
    """MANY, all predicates and generated rules, after some were deleted."""
    w = Workload(dims=30, seed=5)
    out = Registry(Schema([*EVENTS, *w.schema]))
    for sub, (rule, _) in {**MANY, **ALL}.items():
        out.insert(sub, rule)
    for sub in range(300):
        out.insert(1000 + sub, w.rule(2))
    for sub in (3, 5, 104, 120, *range(1000, 1300, 7)):
        out.delete(sub)
    return out


#: Laws of the graph's tables, and rows that break each.
_LAWS = ("unused", "few_children", "leaf_shape", "level", "access", "lost_node", "identity", "edges", "always", "unrouted")


@query("dag_validate", values_sql([(x, 0) for x in _LAWS], "law", "broken"))
def dag_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the graph's tables that break each of its laws."""
    own = _large()
    t = own.tables(spark)
    nodes, edges, subs, leaves, rules = (t[x] for x in ("nodes", "edges", "subs", "leaves", "rules"))
    used = edges.select(F.col("child").alias("node")).union(subs.select("node")).distinct()
    above = edges.groupBy(F.col("parent").alias("node")).agg(F.countDistinct("child").alias("n"), F.sum(F.col("is_access").cast("int")).alias("accesses"))
    low = edges.join(nodes.select(F.col("node").alias("child"), F.col("level").alias("below")), "child").groupBy(F.col("parent").alias("node")).agg(F.max("below").alias("below"))
    inner, leaf = nodes.where("kind <> 'leaf'"), nodes.where("kind = 'leaf'")
    broken = {
        "unused": nodes.join(used, "node", "left_anti"),
        "few_children": inner.join(above, "node", "left").where("coalesce(n, 0) < 2 OR n <> n_children"),
        "leaf_shape": leaf.join(above, "node", "left").where("level <> 1 OR n IS NOT NULL OR n_children <> 0"),
        "level": inner.join(low, "node", "left").where("below IS NULL OR level <> below + 1"),
        "access": inner.join(above, "node", "left").where("(kind = 'and') <> (coalesce(accesses, 0) = 1)"),
        "lost_node": subs.join(nodes, "node", "left_anti").select("node").union(edges.select(F.col("child").alias("node")).join(nodes, "node", "left_anti")),
        "identity": nodes.groupBy("identity").count().where("count > 1"),
        "edges": nodes.agg(F.sum("n_children").alias("n")).join(edges.agg(F.count("*").alias("m")), F.col("n") != F.col("m")),
        "always": rules.join(subs, "sub_id", "left").where("constant = (node IS NOT NULL)").select("sub_id").union(rules.where("always AND NOT constant").select("sub_id")),
        "unrouted": leaf.join(leaves.where(F.col("route") == F.when(F.col("kind").isin(*INDEXED), "indexed").otherwise("scanned")), "node", "left_anti"),
    }
    own.validate()
    out = None
    for law in _LAWS:
        row = broken[law].agg(F.count("*").alias("broken")).select(F.lit(law).alias("law"), "broken")
        out = row if out is None else out.unionAll(row)
    return out


#: The drawing of rules 1, 3, 9 and 10.
_DOT = [
    'digraph rulesieve {',
    '  // level 1',
    '  n0 [shape=note label="user_id = 3"]',
    '  n1 [shape=note label="value > 100.0"]',
    '  n3 [shape=note label="not hot"]',
    '  n4 [shape=note label="tags one of [\\"click\\", \\"u2\\"]"]',
    '  // level 2',
    '  n2 [shape=oval label="and [1]"]',
    '  n2 -> n0 [style=bold]',
    '  n2 -> n1',
    '  n5 [shape=oval label="and [3, 9]"]',
    '  n5 -> n3',
    '  n5 -> n4 [style=bold]',
    '  true [shape=note label="true [10]"]',
    '}',
]


@query("dot", values_sql(list(enumerate(_DOT)), "line", "text"))
def dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(registry({s: MANY[s] for s in (1, 3, 9, 10)}).dot().splitlines())), "line bigint, text string")


#: Commands and their answers.
_SESSION = [
    ("DEFINE price int", "OK price int"),
    ("DEFINE country string", "OK country string"),
    ("SUBSCRIBE 1 price > 10 and country in ['US', 'CA']", "OK subscribed 1"),
    ("SUBSCRIBE 1 price > 11", "ERR duplicate subscription id: subscription id already present"),
    ("LISTEN 1", "OK 1"),
    ("EVENT price=12;country=US", "MATCH 1: 1\nSTATS predicates_evaluated=2 predicates_true=2 nodes_visited=1 and_woken=1 and_true=1 or_visited=0\nOK"),
    ('EVENT {"price": 3}', "MATCH 0:\nSTATS predicates_evaluated=0 predicates_true=0 nodes_visited=0 and_woken=0 and_true=0 or_visited=0\nOK"),
    ("PARSE not (price > 10)", "not price > 10\nOK"),
    ("COUNT", "OK 1"),
    ("VALIDATE", "OK valid"),
    ("UNSUBSCRIBE 1", "OK unsubscribed 1"),
    ("COUNT", "OK 0"),
    ("PING", "PONG"),
]


@query("console", values_sql([(i, *x) for i, x in enumerate(_SESSION)], "line", "command", "answer"))
def console(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Console()
    out = [(i, line, "\n".join(c.run(line))) for i, (line, _) in enumerate(_SESSION)]
    return spark.createDataFrame(out, "line bigint, command string, answer string")


_SYNTHETIC = 2000


def _synthetic() -> Registry:
    w = Workload(dims=60, seed=3)
    own = Registry(w.schema)
    for sub in range(400):
        own.insert(sub, w.rule(2) if sub % 4 == 0 else w.selective_rule())
    return own


def _drawn(schema: Schema, listed: Callable[[list[str]], str]) -> list[str]:
    """Attributes of event_id as SQL that both engines read: a third of each is undefined, small values come oftener."""
    out = ["event_id"]
    for d, (name, kind) in enumerate(schema):
        v = lambda k, d=d: f"((event_id * {7 * d + 11} + {d * d + 31 * k}) % 10007 * ((event_id + {13 * k + d}) % 97) % 100)"
        own = {AttrType.STRING: f"concat('v', CAST({v(0)} AS VARCHAR(9)))", AttrType.BOOL: f"({v(0)} % 2 = 0)", AttrType.INT_LIST: listed([v(0), v(1), v(2)])}.get(kind, f"CAST({v(0)} AS BIGINT)")
        out.append(f"CASE WHEN (event_id + {d}) % 3 <> 0 THEN {own} END AS {name}")
    return out


def _synthetic_sql() -> str:
    own = _synthetic()
    drawn = _drawn(own.schema, lambda x: f"[{', '.join(f'CAST({v} AS BIGINT)' for v in x)}]")
    return f"WITH e AS (SELECT {', '.join(drawn)} FROM (SELECT range AS event_id FROM range({_SYNTHETIC}))) " + union_sql({s: duck(r) for s, r in own.given.items()})


@query("synthetic_workload", _synthetic_sql())
def synthetic_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of generated events against generated rules, indexed."""
    own = _synthetic()
    rows = spark.range(_SYNTHETIC).withColumnRenamed("id", "event_id")
    return match(rows.selectExpr(*_drawn(own.schema, lambda x: f"array({', '.join(f'CAST({v} AS BIGINT)' for v in x)})")), own, "indexed")


def rules_of(n: int) -> dict[int, Expr]:
    """n rules over the events, dense: an OR of two pairs of conditions."""
    kinds = ("click", "view", "purchase", "login", "logout")
    return {i: parse(EVENTS, f"(value > {i % 40 * 5} and user_id = {i % 97}) or (event_type = '{kinds[i % 5]}' and value < {i % 23})") for i in range(n)}
