"""One graph for many rules: equal parts are one node, and a node may be built from others.

A node is a leaf, an AND or an OR.  Inner nodes are known by their members, what they hold once nested nodes of their own
kind are taken apart, so an expression is found however it was put together.  Reorganising builds a new node from existing
ones that hold parts of it (greedily, the largest first); self-adjusting lets existing nodes use a new one for the children
that it covers.  Neither changes a result.  Each AND has one access child, its rarest by rank: a search looks at an AND
only once that child is true.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from ..errors import RuleError, Status
from ..functions.evaluate import holds
from .expr import And, Expr, Leaf
from .printer import leaf_text

INDEXED = frozenset(("var", "not_var", "lt", "le", "gt", "ge", "eq", "in", "one_of", "is_null"))
_RANK = dict.fromkeys(("eq", "in", "one_of"), 0) | dict.fromkeys(("lt", "le", "gt", "ge", "all_of", "is_empty"), 1) | dict.fromkeys(("var", "not_var", "is_null"), 4)
SHOWN = 8


@dataclass
class Node:
    kind: str  # leaf, and, or
    level: int
    leaf: Leaf | None = None
    members: frozenset[int] = frozenset()
    children: set[int] = field(default_factory=set)
    parents: set[int] = field(default_factory=set)
    subs: set[int] = field(default_factory=set)
    access: int | None = None
    anchor: int = -1  # the member by which larger nodes find this one


@dataclass
class Found:
    """What a search of one event met."""

    ids: list[int]
    predicates_evaluated: int = 0
    predicates_true: int = 0
    nodes_visited: int = 0
    and_woken: int = 0
    and_true: int = 0
    or_visited: int = 0


class Dag:
    def __init__(self, reorganize: bool = True, self_adjust: bool = True, on_demand: bool = True, indexed: bool = True):
        self.reorganize, self.self_adjust, self.on_demand, self.indexed = reorganize, self_adjust, on_demand, indexed
        self.nodes: dict[int, Node] = {}
        self.leaves: dict[Leaf, int] = {}
        self.inner: dict[tuple[str, frozenset[int]], int] = {}
        self.holders: dict[tuple[str, int], set[int]] = {}  # (kind, member) to nodes of that kind with the member
        self.anchored: dict[tuple[str, int], set[int]] = {}  # each inner node once, under its member with the fewest holders
        self.reorganized = self.self_adjusted = self.next = 0

    # ---- building -----------------------------------------------------------------------------------------------

    def add(self, expr: Expr, sub: int) -> int:
        """Enters a rule in normal form, not a constant, for a subscription; its node."""
        node = self._enter(expr)
        self.nodes[node].subs.add(sub)
        return node

    def _new(self, node: Node) -> int:
        own, self.next = self.next, self.next + 1
        self.nodes[own] = node
        return own

    def _enter(self, expr: Expr) -> int:
        if isinstance(expr, Leaf):
            if expr not in self.leaves:
                self.leaves[expr] = self._new(Node("leaf", 1, leaf=expr))
            return self.leaves[expr]
        kind = "and" if isinstance(expr, And) else "or"
        members = frozenset(self._enter(c) for c in expr.children)
        known = self.inner.get((kind, members))
        return self._inner(kind, members) if known is None else known

    def _inner(self, kind: str, members: frozenset[int]) -> int:
        children = self._covered(kind, members) if self.reorganize else set(members)
        own = self._new(Node(kind, 1 + max(self.nodes[c].level for c in children), members=members, children=children))
        for c in children:
            self.nodes[c].parents.add(own)
        self.inner[kind, members] = own
        for m in members:
            self.holders.setdefault((kind, m), set()).add(own)
        self.nodes[own].anchor = min(members, key=lambda m: (len(self.holders[kind, m]), m))
        self.anchored.setdefault((kind, self.nodes[own].anchor), set()).add(own)
        self._choose(own)
        if self.self_adjust:
            self._adjust(own)
        return own

    def _covered(self, kind: str, members: frozenset[int]) -> set[int]:
        within = (n for m in members for n in self.anchored.get((kind, m), ()))
        parts = {n: self.nodes[n].members for n in within if self.nodes[n].members < members}
        left, out = set(members), set()
        while parts:
            best = max(parts, key=lambda n: (len(parts[n] & left), -n))
            if len(parts.pop(best) & left) < 2:
                break
            out.add(best)
            left -= self.nodes[best].members
            self.reorganized += 1
        return out | left

    def _adjust(self, own: int) -> None:
        node = self.nodes[own]
        for n in sorted(self.holders[node.kind, node.anchor]):
            other = self.nodes[n]
            if n == own or not node.members <= other.members:
                continue
            inside = {c for c in other.children if ({c} if c in other.members else self.nodes[c].members) <= node.members}
            covered = frozenset().union(*({c} if c in other.members else self.nodes[c].members for c in inside))
            if len(inside) < 2 or covered != node.members or self._reaches(own, n):
                continue
            for c in inside:
                self.nodes[c].parents.discard(n)
            other.children = (other.children - inside) | {own}
            node.parents.add(n)
            self.self_adjusted += 1
            self._relevel(n)

    def _reaches(self, top: int, goal: int) -> bool:
        todo = [top]
        while todo:
            if (n := todo.pop()) == goal:
                return True
            todo += self.nodes[n].children
        return False

    def _relevel(self, start: int) -> None:
        todo = [start]
        while todo:
            n = todo.pop()
            node = self.nodes[n]
            self._choose(n)
            level = 1 + max(self.nodes[c].level for c in node.children)
            if level != node.level:
                node.level = level
                todo += node.parents

    def rank(self, n: int) -> int:
        node = self.nodes[n]
        return {"and": 2, "or": 3}.get(node.kind) if node.kind != "leaf" else _RANK.get(node.leaf.kind, 5)

    def _choose(self, n: int) -> None:
        node = self.nodes[n]
        if node.kind == "and" and self.on_demand:
            node.access = min(node.children, key=lambda c: (self.rank(c), len(self.nodes[c].parents), c))

    def remove(self, node: int, sub: int) -> None:
        """Takes a subscription from its node; what nothing uses any more goes."""
        self.nodes[node].subs.discard(sub)
        todo = [node]
        while todo:
            n = todo.pop()
            own = self.nodes.get(n)
            if own is None or own.subs or own.parents:
                continue
            del self.nodes[n]
            if own.kind == "leaf":
                del self.leaves[own.leaf]
                continue
            del self.inner[own.kind, own.members]
            self.anchored[own.kind, own.anchor].discard(n)
            for m in own.members:
                self.holders[own.kind, m].discard(n)
            for c in own.children:
                self.nodes[c].parents.discard(n)
                todo.append(c)

    # ---- search of one event ------------------------------------------------------------------------------------

    def search(self, event: Mapping[str, object]) -> Found:
        found, true, by_level = Found([]), set(), {}
        for own, n in self.leaves.items():
            value = holds(own, event)
            if not (self.indexed and own.kind in INDEXED) and (value is not None):
                found.predicates_evaluated += 1
            elif value:
                found.predicates_evaluated += 1
            if value:
                true.add(n)
        found.predicates_true = len(true)

        def wake(n: int) -> None:
            for p in self.nodes[n].parents:
                if self.nodes[p].kind == "or" or self.nodes[p].access in (n, None):
                    by_level.setdefault(self.nodes[p].level, set()).add(p)

        for n in true:
            wake(n)
        while by_level:
            for n in sorted(by_level.pop(min(by_level))):
                node = self.nodes[n]
                found.nodes_visited += 1
                if node.kind == "and":
                    found.and_woken += 1
                    if not node.children <= true:
                        continue
                    found.and_true += 1
                else:
                    found.or_visited += 1
                true.add(n)
                wake(n)
        found.ids = sorted(s for n in true for s in self.nodes[n].subs)
        return found

    # ---- tables and looks ---------------------------------------------------------------------------------------

    def stats(self) -> dict[str, int]:
        leaves = list(self.leaves)
        indexed = sum(x.kind in INDEXED for x in leaves) if self.indexed else 0
        return {
            "nodes": len(self.nodes), "leaves": len(leaves), "edges": sum(len(n.children) for n in self.nodes.values()), "max_level": max((n.level for n in self.nodes.values()), default=0),
            "indexed_leaves": indexed, "scanned_leaves": len(leaves) - indexed, "reorganized": self.reorganized, "self_adjusted": self.self_adjusted,
        }

    def levels(self) -> Iterator[tuple[int, list[int]]]:
        by: dict[int, list[int]] = {}
        for n, node in self.nodes.items():
            by.setdefault(node.level, []).append(n)
        return iter(sorted(by.items()))

    def validate(self) -> None:
        """Raises CORRUPT with the first rule of the structure that is broken."""

        def need(holds_: bool, what: str) -> None:
            if not holds_:
                raise RuleError(Status.CORRUPT, what)

        for n, node in self.nodes.items():
            need(bool(node.parents or node.subs), f"node {n} is not used")
            need(all(n in self.nodes[p].children for p in node.parents), f"node {n} has a parent that doesn't know it")
            if node.kind == "leaf":
                need(not node.children and node.level == 1 and self.leaves.get(node.leaf) == n, f"leaf {n} is wrong")
                continue
            need(len(node.children) >= 2 and all(n in self.nodes[c].parents for c in node.children), f"node {n} has wrong children")
            need(node.level == 1 + max(self.nodes[c].level for c in node.children), f"node {n} has a wrong level")
            need(self.inner.get((node.kind, node.members)) == n, f"node {n} is not found by its members")
            held = frozenset().union(*({c} if c in node.members else self.nodes[c].members for c in node.children))
            need(held == node.members and all(c in node.members or self.nodes[c].kind == node.kind for c in node.children), f"node {n} doesn't hold its members")
            need((node.access in node.children) if node.kind == "and" and self.on_demand else node.access is None, f"node {n} has a wrong access child")
        need(len(self.leaves) + len(self.inner) == len(self.nodes), "an identity is missing")

    def dot(self, always: Iterable[int] = ()) -> str:
        """The graph in Graphviz's language, by levels: the rules' ids in brackets, at most SHOWN of them; bold edges lead to access children."""

        def ids(own: Iterable[int]) -> str:
            own = sorted(own)
            return ", ".join(map(str, own[:SHOWN])) + (", ..." if len(own) > SHOWN else "")

        quoted = lambda text: '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
        out = ["digraph rulesieve {"]
        for level, own in self.levels():
            out.append(f"  // level {level}")
            for n in own:
                node = self.nodes[n]
                told = f" [{ids(node.subs)}]" if node.subs else ""
                shape = "note" if node.leaf else "oval"
                out.append(f"  n{n} [shape={shape} label={quoted((leaf_text(node.leaf) if node.leaf else node.kind) + told)}]")
                out += [f"  n{n} -> n{c}" + (" [style=bold]" if c == node.access else "") for c in sorted(node.children)]
        if always := ids(always):
            out.append(f"  true [shape=note label={quoted(f'true [{always}]')}]")
        return "\n".join([*out, "}"]) + "\n"
