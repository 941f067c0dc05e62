"""Subscriptions: ids and their rules, kept on the driver, with the graph over all of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from .errors import RuleError, Status
from .plans.dag import INDEXED, Dag, Found
from .plans.expr import Const, Expr, Leaf
from .plans.normalize import MAX_NODES, normalize
from .plans.parser import parse
from .schema import Schema

ID_MAX = (1 << 64) - 1


@dataclass(frozen=True)
class Config:
    """The four switches change how rules are held and looked up, never what matches."""

    max_depth: int = 64
    max_nodes: int = MAX_NODES
    reorganize: bool = True
    self_adjust: bool = True
    on_demand: bool = True
    indexed: bool = True


def _strings(expr: Expr) -> Iterator[str]:
    if isinstance(expr, Leaf):
        yield from (v for v in (expr.operand if isinstance(expr.operand, tuple) else (expr.operand,)) if isinstance(v, str))
    for c in getattr(expr, "children", ()):
        yield from _strings(c)


class Registry:
    """A change is made as a whole or not at all."""

    def __init__(self, schema: Schema, config: Config | None = None):
        self.schema, self.config = schema, config or Config()
        c = self.config
        self.dag = Dag(c.reorganize, c.self_adjust, c.on_demand, c.indexed)
        self.rules: dict[int, Expr] = {}  # in normal form
        self.given: dict[int, Expr] = {}  # as they came; shorter where xor is used
        self.at: dict[int, int] = {}  # of those in the graph
        self.strings: set[str] = set()
        self.unread: list[Expr] = []  # rules whose strings aren't counted yet
        #: Counts changes; what matching made of the rules is kept with the count at which it was made.
        self.version, self.made, self.last_subset = 0, None, None

    def parse(self, text: str) -> Expr:
        return parse(self.schema, text, self.config.max_depth)

    def insert(self, sub: int, rule: str | Expr) -> None:
        """Errors in the rule come before one about the id."""
        given = self.parse(rule) if isinstance(rule, str) else rule
        normal = normalize(given, self.config.max_nodes)
        if isinstance(sub, bool) or not isinstance(sub, int) or not 0 <= sub <= ID_MAX:
            raise RuleError(Status.INVALID_ARG, "an id is an integer from 0 to 2^64 - 1")
        if sub in self.rules:
            raise RuleError(Status.DUPLICATE_ID, "subscription id already present")
        if not isinstance(normal, Const):
            try:
                self.at[sub] = self.dag.add(normal, sub)
            except BaseException:
                self._made_again()
                raise
        self.rules[sub], self.given[sub] = normal, given
        self.version += 1
        self.unread.append(normal)

    def _made_again(self) -> None:
        """Undoes a change that failed half-way: the graph of the rules that are registered, made anew."""
        c = self.config
        dag, at = Dag(c.reorganize, c.self_adjust, c.on_demand, c.indexed), {}
        for own, rule in self.rules.items():
            if not isinstance(rule, Const):
                at[own] = dag.add(rule, own)
        self.dag, self.at = dag, at
        self.version += 1

    def insert_many(self, rows: Iterable[tuple[int, str]]) -> list[tuple[int, str, RuleError]]:
        """Inserts what can be; the rows that can't, with their errors."""
        rejected = []
        for sub, text in rows:
            try:
                self.insert(sub, text)
            except RuleError as e:
                rejected.append((sub, text, e))
        return rejected

    def insert_table(self, df: DataFrame, limit: int = 5_000_000) -> list[tuple[int, str, RuleError]]:
        """Inserts a table (sub_id, rule); the driver holds rules, so a table of more than limit rows is refused."""
        if df.limit(limit + 1).count() > limit:
            raise RuleError(Status.LIMIT, f"more than {limit} rules for one registry")
        return self.insert_many((int(r[0]), r[1]) for r in df.select("sub_id", "rule").toLocalIterator())

    def delete(self, sub: int) -> None:
        if sub not in self.rules:
            raise RuleError(Status.NOT_FOUND, "")
        del self.rules[sub], self.given[sub]
        self.version += 1
        if sub in self.at:
            self.dag.remove(self.at.pop(sub), sub)

    def __contains__(self, sub: int) -> bool:
        return sub in self.rules

    def __len__(self) -> int:
        return len(self.rules)

    @property
    def always(self) -> list[int]:
        return sorted(s for s, r in self.rules.items() if isinstance(r, Const) and r.value)

    def subset(self, ids: Iterable[int]) -> Registry:
        """A registry of those of the ids that are present, not to be changed: matching it is matching with an allow list.  The latest is kept."""
        wanted = frozenset(ids) & self.rules.keys()
        if self.last_subset is not None and self.last_subset[:2] == (self.version, wanted):
            return self.last_subset[2]
        out = Registry(self.schema, self.config)
        for sub in sorted(wanted):
            out.insert(sub, self.given[sub])
        self.last_subset = (self.version, wanted, out)
        return out

    def search(self, event: dict[str, object]) -> Found:
        """One event, without Spark."""
        found = self.dag.search(event)
        found.ids = sorted([*found.ids, *self.always])
        return found

    def validate(self) -> None:
        self.dag.validate()
        held = {s: n for n, node in self.dag.nodes.items() for s in node.subs}
        if held != self.at or set(self.at) | {s for s, r in self.rules.items() if isinstance(r, Const)} != set(self.rules):
            raise RuleError(Status.CORRUPT, "subscriptions and nodes don't agree")

    def stats(self) -> dict[str, int]:
        for rule in self.unread:
            self.strings.update(_strings(rule))
        self.unread.clear()
        return {"subscriptions": len(self.rules)} | self.dag.stats() | {"strings": len(self.strings)}

    def dot(self) -> str:
        return self.dag.dot(self.always)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The graph as tables: subs, nodes, edges, leaves (with how a search finds them), rules (with those that match always)."""
        d = self.dag
        subs = [(Decimal(s), n) for s, n in sorted(self.at.items())]
        nodes = [(n, x.kind, x.level, len(x.children), repr(x.leaf) if x.leaf else f"{x.kind} {sorted(x.members)}") for n, x in d.nodes.items()]
        edges = [(n, c, c == x.access) for n, x in d.nodes.items() for c in x.children]
        leaves = [(n, x.attr, x.kind, "indexed" if d.indexed and x.kind in INDEXED else "scanned") for x, n in d.leaves.items()]
        rules = [(Decimal(s), isinstance(r, Const) and r.value, isinstance(r, Const)) for s, r in sorted(self.rules.items())]
        return {
            "subs": spark.createDataFrame(subs, "sub_id decimal(20,0), node bigint"), "nodes": spark.createDataFrame(nodes, "node bigint, kind string, level int, n_children int, identity string"),
            "edges": spark.createDataFrame(edges, "parent bigint, child bigint, is_access boolean"), "leaves": spark.createDataFrame(leaves, "node bigint, attr string, kind string, route string"),
            "rules": spark.createDataFrame(rules, "sub_id decimal(20,0), always boolean, constant boolean"),
        }
