"""Matching events against the registered rules: (event_id, sub_id) for every rule that is true for an event.

Three ways, with equal results:

compiled    Every rule as a Catalyst column, CHUNK rules a projection.  Right for few rules: all of it is code inside one scan.
indexed     The shared graph as a numpy kernel over Arrow batches; work follows the values that occur.  The graph is broadcast
            in blocks of BLOCK rules.  match() goes through the events once a block, and a worker holds one block; lists and
            stats need all blocks at once, so there a worker holds the whole graph (about 1 KB a rule).  No shuffle.
relational  The graph as tables: leaves found by equi-joins of the events' values, thresholds by joins with bins of them, the
            others by compiled predicates; AND nodes by counting true children, level by level, in one unrolled plan.  All in
            the JVM; tables are broadcast up to a stated size, beyond it joins shuffle.  The events are counted first, and dealt
            by id over tasks of a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RuleError, Status
from ..functions.columns import column, sql, true_ones
from ..plans.expr import INT_MAX, Const, Expr, Leaf
from ..registry import Registry
from ..sources.events import normalized
from ..workers import importable
from . import kernel, relational

CHUNK = 100
BLOCK = 100_000
#: Events that the kernel takes at once: the more, the less its work on each node weighs.
ROWS = 16_384
#: Up to this number of rules, auto compiles them.
FEW = 32


def attributes(expr: Expr) -> set[str]:
    if isinstance(expr, Leaf):
        return {expr.attr}
    return set().union(*(attributes(c) for c in getattr(expr, "children", ())))


def used(registry: Registry) -> list[str]:
    """The attributes that rules use, in the schema's order; only these are read."""
    own = set().union(*(attributes(r) for r in registry.given.values()))
    return [n for n, _ in registry.schema if n in own]


def _wide(ids: Iterable[int]) -> bool:
    return any(i > INT_MAX for i in ids)


def _id_type(registry: Registry) -> T.DataType:
    return T.DecimalType(20, 0) if _wide(registry.rules) else T.LongType()


def _events(events: DataFrame, registry: Registry, event_id: str) -> DataFrame:
    return normalized(events, registry.schema, event_id).select("event_id", *[f"`{n}`" for n in used(registry)])


def _compiled(events: DataFrame, registry: Registry) -> DataFrame:
    """event_id and the array of matching ids."""
    kind = _id_type(registry).simpleString()
    live = [(s, registry.given[s]) for s, r in sorted(registry.rules.items()) if not (isinstance(r, Const) and not r.value)]
    parts = [true_ones([(sql(registry.schema, r), f"CAST('{s}' AS {kind})") for s, r in live[i : i + CHUNK]]) for i in range(0, len(live), CHUNK)]
    return events.select("event_id", (F.concat(*parts) if parts else F.array().cast(f"array<{kind}>")).alias("sub_ids"))


def _blocks(registry: Registry) -> Iterator[tuple[Registry, list[int]]]:
    ids = sorted(registry.rules)
    if len(ids) <= BLOCK:
        yield registry, ids
        return
    for i in range(0, len(ids), BLOCK):
        yield registry.subset(ids[i : i + BLOCK]), ids[i : i + BLOCK]


def _graphs(sc, registry: Registry) -> list[tuple]:
    """The blocks' compiled graphs and ids as broadcasts, made once for as long as the rules stay the same."""
    key = (registry.version, BLOCK, sc.applicationId)
    if registry.made is None or registry.made[0] != key:
        out = []
        for part, ids in _blocks(registry):
            dense = {s: i for i, s in enumerate(ids)}
            out.append((sc.broadcast(kernel.compiled(part.schema, part.dag, dense, part.always)), sc.broadcast(ids)))
        registry.made, registry.last_subset = (key, out), None
    return registry.made[1]


def _indexed(events: DataFrame, registry: Registry, lists: bool) -> DataFrame:
    blocks = _graphs(events.sparkSession.sparkContext, registry)
    parts = [blocks] if lists else [[b] for b in blocks]
    return reduce(DataFrame.unionAll, [_through(events, _id_type(registry), own, lists) for own in parts])


def _through(events: DataFrame, kind: T.DataType, blocks: list[tuple], lists: bool) -> DataFrame:
    """The matches of some blocks in one pass over the events."""
    arrow_id = pa.decimal128(20, 0) if isinstance(kind, T.DecimalType) else pa.int64()

    def ids_of(dense: np.ndarray, ids: list[int]) -> pa.Array:
        if arrow_id == pa.int64():
            return pa.array(np.array(ids, np.int64)[dense])
        return pa.array([Decimal(ids[i]) for i in dense.tolist()], arrow_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows, subs = [], []
                for own, ids in blocks:
                    r, d = kernel.matched(own.value, batch, ordered=lists)
                    if lists:
                        rows.append(r)
                        subs.append(ids_of(d, ids.value))
                    elif len(r):
                        yield pa.record_batch([batch.column(0).take(pa.array(r)), ids_of(d, ids.value)], ["event_id", "sub_id"])
                if lists:
                    row, sub = np.concatenate(rows), pa.concat_arrays(subs)
                    order = np.argsort(row, kind="stable")  # blocks hold ascending ids
                    ends = np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32)
                    yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), sub.take(pa.array(order)))], ["event_id", "sub_ids"])

    id_field = events.schema["event_id"]
    schema = T.StructType([id_field, T.StructField("sub_ids", T.ArrayType(kind)) if lists else T.StructField("sub_id", kind)])
    importable(events.sparkSession)
    return events.mapInArrow(work, schema)


def _way(registry: Registry, how: str) -> str:
    if how not in ("auto", "compiled", "indexed", "relational"):
        raise RuleError(Status.INVALID_ARG, f"unknown way '{how}'")
    return how if how != "auto" else "compiled" if len(registry) <= FEW else "indexed"


def match(events: DataFrame, registry: Registry, how: str = "auto", event_id: str = "event_id") -> DataFrame:
    """event_id, sub_id; sub_id is a bigint, or decimal(20,0) if an id needs it."""
    own, way = _events(events, registry, event_id), _way(registry, how)
    if way == "indexed":
        return _indexed(own, registry, lists=False)
    if way == "relational":
        return relational.match(own, registry).withColumn("sub_id", F.col("sub_id").cast(_id_type(registry)))
    # the outer form: from the plain one a filter on the array's size is inferred, which evaluates every rule twice
    return _compiled(own, registry).select("event_id", F.explode_outer("sub_ids").alias("sub_id")).where("sub_id IS NOT NULL")


def match_lists(events: DataFrame, registry: Registry, how: str = "auto", event_id: str = "event_id") -> DataFrame:
    """A row for each event: event_id and sub_ids, ascending, empty where nothing matches."""
    own, way = _events(events, registry, event_id), _way(registry, how)
    if way == "indexed":
        return _indexed(own, registry, lists=True)
    if way == "relational":
        return relational.match_lists(own, registry, _id_type(registry))
    return _compiled(own, registry)


def exists(events: DataFrame, registry: Registry, how: str = "auto", event_id: str = "event_id") -> DataFrame:
    """event_id, matched: whether any rule is true."""
    return match_lists(events, registry, how, event_id).select("event_id", (F.size("sub_ids") > 0).alias("matched"))


def match_ids(events: DataFrame, registry: Registry, allow: Iterable[int], how: str = "auto", event_id: str = "event_id") -> DataFrame:
    """As match, for an allow list of ids; rules outside it are left out before matching."""
    return match(events, registry.subset(allow), how, event_id)


def match_stats(events: DataFrame, registry: Registry, event_id: str = "event_id") -> DataFrame:
    """event_id, matches and what a search looked at: the counters of plans.dag.Found, event by event."""
    own = _events(events, registry, event_id)
    dense = {s: i for i, s in enumerate(sorted(registry.rules))}
    graph = own.sparkSession.sparkContext.broadcast(kernel.compiled(registry.schema, registry.dag, dense, registry.always))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                counters = {c: np.zeros(batch.num_rows, np.int64) for c in kernel.COUNTERS}
                rows, _ = kernel.matched(graph.value, batch, counters, ordered=False)
                yield pa.record_batch([batch.column(0), pa.array(np.bincount(rows, minlength=batch.num_rows).astype(np.int64)), *map(pa.array, counters.values())], names)

    schema = T.StructType([own.schema["event_id"], *[T.StructField(n, T.LongType()) for n in ("matches", *kernel.COUNTERS)]])
    names = schema.fieldNames()
    importable(own.sparkSession)
    return own.mapInArrow(work, schema)


def evaluate(events: DataFrame, registry: Registry, rule: str | Expr, event_id: str = "event_id") -> DataFrame:
    """event_id, value: true, false or null for undefined."""
    expr = registry.parse(rule) if isinstance(rule, str) else rule
    own = normalized(events, registry.schema, event_id).select("event_id", *[f"`{n}`" for n in sorted(attributes(expr))])
    return own.select("event_id", column(registry.schema, expr).alias("value"))


def for_each(events: DataFrame, registry: Registry, call: Callable[[object, int], object], how: str = "auto") -> None:
    """Calls with each event's matches, ascending, event by event; a true return stops with CANCELLED.  Rows are streamed."""
    for row in match_lists(events, registry, how).toLocalIterator():
        for sub in row["sub_ids"]:
            if call(row["event_id"], int(sub)):
                raise RuleError(Status.CANCELLED, "")
