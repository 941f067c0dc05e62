"""Matching by joins over the graph's tables."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from ..functions.columns import leaf_sql, named, true_ones
from ..plans.expr import Leaf
from ..registry import Registry
from ..schema import AttrType

CHUNK = 200
#: Bytes of a graph's table up to which it may be broadcast; beyond, joins shuffle.
BROADCAST_BYTES = 32 << 20
#: Thresholds in a bin of the range join.
BIN = 256
#: Nodes that may be true in one task, so that its counts take a stated share of memory, and the least of its events.
TASK_NODES, TASK_EVENTS = 1 << 20, 1000
_EQUAL = ("var", "not_var", "eq", "in", "one_of")
_RANGE = ("lt", "le", "gt", "ge")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the graph, to be broadcast if it is small enough."""
    size = sum(8 + (4 * len(x) if isinstance(x, str) else 8) for r in rows for x in r)
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _spread(events: DataFrame, registry: Registry) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The events by id, in as many partitions as bound a task's counts, and what brings rows there; counts the events in a job of its own.

    The number is given, so that Spark neither merges partitions by their bytes nor keeps it while the input grows.  What is
    found of an event stays where the event is, hence nothing shuffles again but after joins with tables that aren't broadcast:
    Spark leaves out a repartition of rows that lie so already.
    """
    if events.isStreaming or not registry.dag.nodes:
        return events, lambda df: df
    own = max(TASK_EVENTS, TASK_NODES // len(registry.dag.nodes))
    tasks = max(1, -(-events.count() // own))
    return events.repartition(tasks, "event_id"), lambda df: df.repartition(tasks, "event_id")


def _text(kind: AttrType, c: Column) -> Column:
    """A value as a join key; equal values, and only those, have equal texts."""
    if kind is AttrType.FLOAT:
        return F.when(c == 0, F.lit(0.0)).otherwise(c).cast("string")
    return c.cast("string")


def _leaf_text(kind: AttrType, value: object) -> tuple[str | None, float | None]:
    if isinstance(value, bool):
        return ("true" if value else "false"), None
    return (None, value) if kind is AttrType.FLOAT else (str(value), None)


def _pairs(attr: str, kind: AttrType) -> Column:
    """(attribute, value) of a scalar, or the array of them of a list; an undefined list has none."""
    pair = lambda c: F.struct(F.lit(attr).alias("attr"), _text(kind, c).alias("v"))
    if kind.is_list:
        return F.coalesce(F.transform(named(attr), pair), F.array().cast("array<struct<attr:string,v:string>>"))
    return pair(named(attr))


def _true_ranges(events: DataFrame, attrs: dict[str, list[tuple[object, str, int]]], kind: str) -> DataFrame:
    """event_id, node of the true comparisons of numbers of one type; attrs: bounds, signs and nodes by attribute.

    The bounds of an attribute's two directions are cut into bins in their order.  A value meets the bins that hold a true
    comparison, which are whole but for one, and then their bounds: two equi-joins, whose rows are those that come out and a bin's.
    """
    bins, bounds = [], []
    for attr, own in sorted(attrs.items()):
        for below in (True, False):
            ordered = sorted(x for x in own if (x[1] in ("lt", "le")) == below)
            for i in range(0, len(ordered), BIN):
                part = ordered[i : i + BIN]
                bounds += [(len(bins), *x) for x in part]
                bins.append((attr, len(bins), below, part[0][0], part[-1][0]))
    value = lambda a: F.struct(F.lit(a).alias("attr"), named(a).alias("v"))
    probe = events.select("event_id", F.explode(F.array(*[value(a) for a in sorted(attrs)])).alias("p")).select("event_id", "p.attr", "p.v").where("v IS NOT NULL")
    met = probe.join(_table(events.sparkSession, bins, f"attr string, bin int, below boolean, low {kind}, high {kind}"), "attr").where("if(below, v <= high, v >= low)")
    found = met.join(_table(events.sparkSession, bounds, f"bin int, bound {kind}, sign string, node bigint"), "bin")
    return found.where("CASE sign WHEN 'lt' THEN v < bound WHEN 'le' THEN v <= bound WHEN 'gt' THEN v > bound ELSE v >= bound END").select("event_id", "node")


def true_leaves(events: DataFrame, registry: Registry, together: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """event_id, node of every leaf that is true; together: see _spread."""
    spark = events.sparkSession
    by_value: dict[str, list[tuple[int, str | None, float | None]]] = defaultdict(list)
    ranges: dict[AttrType, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    scanned: list[tuple[int, Leaf]] = []
    for own, n in sorted(registry.dag.leaves.items(), key=lambda x: x[1]):
        if own.kind in _RANGE:
            of = registry.schema.types[own.attr]
            ranges[of][own.attr].append((float(own.operand) if of is AttrType.FLOAT else own.operand, own.kind, n))
            continue
        if own.kind not in _EQUAL:
            scanned.append((n, own))
            continue
        values = {"var": (True,), "not_var": (False,)}.get(own.kind) or (own.operand if isinstance(own.operand, tuple) else (own.operand,))
        by_value[own.attr] += [(n, *_leaf_text(registry.schema.types[own.attr], v)) for v in values]
    parts = []
    for lists in (False, True):
        attrs = [a for a in by_value if registry.schema.types[a].is_list == lists]
        if not attrs:
            continue
        rows = [(a, *row) for a in attrs for row in by_value[a]]
        table = _table(spark, rows, "attr string, node bigint, t string, d double").select("attr", "node", F.coalesce("t", _text(AttrType.FLOAT, F.col("d"))).alias("v"))
        # one scan: an event's values as rows (attribute, value)
        pairs = [_pairs(a, registry.schema.types[a]) for a in attrs]
        probe = events.select("event_id", F.explode(F.concat(*pairs) if lists else F.array(*pairs)).alias("p")).select("event_id", "p.attr", "p.v").where("v IS NOT NULL")
        found = probe.join(table, ["attr", "v"]).select("event_id", "node")
        parts.append(together(found).distinct() if lists else found)  # a list may hold several values of one leaf
    parts += [_true_ranges(events, dict(own), "double" if of is AttrType.FLOAT else "bigint") for of, own in ranges.items()]
    for i in range(0, len(scanned), CHUNK):
        hits = true_ones([(leaf_sql(registry.schema, own), f"CAST('{n}' AS BIGINT)") for n, own in scanned[i : i + CHUNK]])
        parts.append(events.select("event_id", F.explode_outer(hits).alias("node")).where("node IS NOT NULL"))
    out = parts[0] if parts else events.select("event_id", F.lit(None).cast("bigint").alias("node")).where("false")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _found(events: DataFrame, registry: Registry, together: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """event_id, sub_id of events that are spread.  A level is one join and one count; the number of levels is known.

    A true node counts for its parents of the level and, if it is needed further up or has subscriptions, for itself, so
    that each level's plan holds the one before it once.
    """
    spark, dag = events.sparkSession, registry.dag
    nodes = true_leaves(events, registry, together)
    steps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    top = max((x.level for x in dag.nodes.values()), default=1)
    for n, node in dag.nodes.items():
        above = {p: dag.nodes[p] for p in node.parents}
        for p, parent in above.items():
            steps[parent.level].append((n, p, len(parent.children) if parent.kind == "and" else 1))
        last = top if node.subs else max(p.level for p in above.values()) - 1
        for level in range(node.level + 1, last + 1):
            steps[level].append((n, n, 1))
    for level in sorted(steps):
        met = together(nodes.join(_table(spark, steps[level], "node bigint, target bigint, need int"), "node").drop("node")).groupBy("event_id", "target").agg(F.count("*").alias("n"), F.first("need").alias("need"))
        nodes = met.where("n >= need").select("event_id", F.col("target").alias("node"))
    subs = [(n, Decimal(s)) for s, n in registry.at.items()]
    found = nodes.join(_table(spark, subs, "node bigint, sub_id decimal(20,0)"), "node").select("event_id", "sub_id")
    if always := [Decimal(s) for s in registry.always]:
        ids = F.array(*[F.lit(s).cast("decimal(20,0)") for s in always])
        found = found.unionByName(events.select("event_id", F.explode(ids).alias("sub_id")))
    return found


def match(events: DataFrame, registry: Registry) -> DataFrame:
    """event_id, sub_id."""
    own, together = _spread(events, registry)
    return _found(own, registry, together)


def match_lists(events: DataFrame, registry: Registry, kind: DataType) -> DataFrame:
    """A row for each event: event_id and sub_ids of the given type, ascending."""
    own, together = _spread(events, registry)
    found = together(_found(own, registry, together)).groupBy("event_id").agg(F.sort_array(F.collect_list(F.col("sub_id").cast(kind))).alias("sub_ids"))
    return own.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("sub_ids", F.array().cast(ArrayType(kind))).alias("sub_ids"))
