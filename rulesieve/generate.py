"""Synthetic rules and events, seeded."""

from __future__ import annotations

import random
from bisect import bisect
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .plans.expr import Builder, Expr
from .schema import AttrType, Schema
from .workers import importable


def dimension_type(d: int) -> AttrType:
    """Of ten dimensions two are strings, one is a bool, one a list of ints, the others ints."""
    return {6: AttrType.STRING, 7: AttrType.STRING, 8: AttrType.BOOL, 9: AttrType.INT_LIST}.get(d % 10, AttrType.INT)


class Workload:
    def __init__(self, dims: int = 100, cardinality: int = 100, alpha: float = 0.6, depth: int = 3, fan_out: int = 4, pairs: int = 20, seed: int = 1):
        self.schema = Schema([(f"d{d}", dimension_type(d)) for d in range(dims)])
        self.build, self.rnd, self.depth, self.fan_out, self.pairs, self.seed = Builder(self.schema), random.Random(seed), depth, fan_out, pairs, seed
        self.dims, self.cardinality = dims, cardinality
        self.dim_sums = list(accumulate((k + 1) ** -alpha for k in range(dims)))
        self.value_sums = list(accumulate((k + 1) ** -alpha for k in range(cardinality)))
        self.pools: dict[int, list[Expr]] = {}

    def _drawn(self, sums: list[float]) -> int:
        return min(bisect(sums, self.rnd.random() * sums[-1]), len(sums) - 1)

    def leaf(self) -> Expr:
        d, v, b, pick = self._drawn(self.dim_sums), self._drawn(self.value_sums), self.build, self.rnd.random()
        name, kind = f"d{d}", dimension_type(d)
        some = [self._drawn(self.value_sums) for _ in range(3)]
        if kind is AttrType.BOOL:
            return b.var(name)
        if kind is AttrType.INT_LIST:
            return b.one_of(name, some) if pick < 0.7 else b.all_of(name, some[:2]) if pick < 0.85 else b.none_of(name, some)
        if kind is AttrType.STRING:
            return b.eq(name, f"v{v}") if pick < 0.6 else b.is_in(name, [f"v{x}" for x in some]) if pick < 0.9 else b.ne(name, f"v{v}")
        return b.eq(name, v) if pick < 0.5 else b.compare(name, self.rnd.choice(["<", "<=", ">", ">="]), v) if pick < 0.7 else b.is_in(name, some) if pick < 0.95 else b.ne(name, v)

    def rule(self, depth: int | None = None) -> Expr:
        depth = self.depth if depth is None else depth
        pool = self.pools.setdefault(depth, [])
        if pool and self.rnd.random() < 0.5:
            return self.rnd.choice(pool)
        if depth == 0:
            out = self.leaf()
        else:
            children = [self.rule(depth - 1) for _ in range(self.rnd.randint(2, 2 * self.fan_out - 2))]
            pick, b = self.rnd.random(), self.build
            out = b.and_(*children) if pick < 0.4 else b.or_(*children) if pick < 0.8 else b.not_(children[0]) if pick < 0.9 else b.xor(*children[:2]) if pick < 0.95 else b.xnor(*children[:2])
        if len(pool) < 4096:
            pool.append(out)
        return out

    def selective_rule(self) -> Expr:
        """An AND of equalities on different dimensions: few events match."""
        ints = self.rnd.sample([d for d in range(self.dims) if dimension_type(d) is AttrType.INT], 3)
        return self.build.and_(*[self.build.eq(f"d{d}", self._drawn(self.value_sums)) for d in ints])

    def events(self, spark: SparkSession, n: int, parts: int = 8) -> DataFrame:
        """event_id and the attributes, made on the executors; a part's rows depend only on the seed and its number."""
        schema, pairs, seed = self.schema, min(self.pairs, self.dims), self.seed
        weights = (np.arange(1, self.dims + 1) ** -0.6, np.arange(1, self.cardinality + 1) ** -0.6)
        out = T.StructType([T.StructField("event_id", T.LongType()), *schema.struct().fields])

        def work(batches):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                columns: dict[str, list] = {name: [None] * len(ids) for name, _ in schema}
                for i, own in enumerate(ids):
                    rng = np.random.default_rng((seed, own))
                    for d in rng.choice(len(weights[0]), pairs, replace=False, p=weights[0] / weights[0].sum()):
                        v = [int(x) for x in rng.choice(len(weights[1]), 3, p=weights[1] / weights[1].sum())]
                        kind = dimension_type(int(d))
                        columns[f"d{d}"][i] = {AttrType.STRING: f"v{v[0]}", AttrType.BOOL: v[0] % 2 == 0, AttrType.INT_LIST: sorted(set(v)), AttrType.INT: v[0]}[kind]
                arrow = {AttrType.STRING: pa.string(), AttrType.BOOL: pa.bool_(), AttrType.INT_LIST: pa.list_(pa.int64()), AttrType.INT: pa.int64()}
                yield pa.record_batch([batch.column(0), *[pa.array(columns[n], arrow[k]) for n, k in schema]], ["event_id", *columns])

        importable(spark)
        return spark.range(0, n, 1, parts).mapInArrow(work, out)
