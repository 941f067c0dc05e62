"""The graph over batches of events, in numpy: which rows each rule is true for.

As in a search of one event, only true nodes are touched: values that occur in a batch find the leaves that they make true,
thresholds stand in order, so that a batch's values cut off those that hold, and inner nodes are looked at when their access child (AND) or any child (OR) has rows.  A node's rows are a sorted array.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..plans.dag import INDEXED, Dag
from ..plans.expr import Leaf
from ..schema import AttrType, Schema

_NONE = np.zeros(0, np.int32)


@dataclass
class Compiled:
    """What a worker needs of a registry: leaves by how they are found, inner nodes in order, subscriptions by node."""

    types: dict[str, AttrType]
    equal: dict[str, dict[object, list[int]]]
    other: dict[str, list[tuple[int, Leaf]]]
    #: By attribute and sign: ordered thresholds and their leaves.
    ranges: dict[str, dict[str, tuple[np.ndarray, list[int]]]]
    inner: list[tuple[int, bool, tuple[int, ...], int | None]]
    wakes: dict[int, list[int]]
    subs: dict[int, np.ndarray]
    always: np.ndarray
    #: For the counters: leaves that an index finds, and by attribute how many others are tried where it is known, and everywhere.
    indexed: frozenset[int]
    tried: dict[str, tuple[int, int]]


def compiled(schema: Schema, dag: Dag, dense: dict[int, int], always: list[int]) -> Compiled:
    """dense: the small number of each subscription id."""
    equal: dict[str, dict[object, list[int]]] = defaultdict(lambda: defaultdict(list))
    other: dict[str, list[tuple[int, Leaf]]] = defaultdict(list)
    bounds: dict[str, dict[str, list[tuple[float, int]]]] = defaultdict(lambda: defaultdict(list))
    for own, n in dag.leaves.items():
        if own.kind in ("eq", "in", "one_of", "var", "not_var"):
            values = {"var": (True,), "not_var": (False,)}.get(own.kind) or (own.operand if isinstance(own.operand, tuple) else (own.operand,))
            for v in values:
                equal[own.attr][v].append(n)
        elif own.kind in ("lt", "le", "gt", "ge"):
            bounds[own.attr][own.kind].append((own.operand, n))
        else:
            other[own.attr].append((n, own))
    indexed = frozenset(n for x, n in dag.leaves.items() if dag.indexed and x.kind in INDEXED)
    tried: dict[str, tuple[int, int]] = {}
    for x, n in dag.leaves.items():
        if n not in indexed:
            known, all_ = tried.get(x.attr, (0, 0))
            tried[x.attr] = (known, all_ + 1) if x.kind in ("is_null", "is_not_null") else (known + 1, all_)
    inner, wakes = [], defaultdict(list)
    for _, level in dag.levels():
        for n in level:
            node = dag.nodes[n]
            if node.kind != "leaf":
                inner.append((n, node.kind == "and", tuple(sorted(node.children, key=lambda c: (c != node.access, dag.rank(c)))), node.access))
    for k, (_, conj, children, access) in enumerate(inner):
        for c in children[:1] if conj and access is not None else children:
            wakes[c].append(k)
    subs = {n: np.array(sorted(dense[s] for s in node.subs), np.int32) for n, node in dag.nodes.items() if node.subs}
    types = dict(schema)
    ranges = {a: {k: (np.array([x for x, _ in sorted(v)], np.float64 if types[a] is AttrType.FLOAT else np.int64), [n for _, n in sorted(v)]) for k, v in own.items()} for a, own in bounds.items()}
    return Compiled(types, {a: dict(v) for a, v in equal.items()}, dict(other), ranges, inner, dict(wakes), subs, np.array(sorted(dense[s] for s in always), np.int32), indexed, tried)


def _merged(parts: list[np.ndarray], size: int) -> np.ndarray:
    """The union of sorted rows of a batch of the given size."""
    if len(parts) == 1:
        return parts[0]
    if sum(map(len, parts)) * 16 < size:
        return np.unique(np.concatenate(parts))
    mark = np.zeros(size, bool)
    for p in parts:
        mark[p] = True
    return np.flatnonzero(mark).astype(np.int32)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return a[b[at] == a]


class _Column:
    """One attribute's values in a batch."""

    def __init__(self, kind: AttrType, array: pa.Array):
        self.kind, self.size = kind, len(array)
        self.known = np.asarray(pc.is_valid(array))
        self.rows = np.flatnonzero(self.known).astype(np.int32)
        flat = array
        if kind.is_list:
            ends = np.asarray(array.offsets)
            lengths = np.where(self.known, np.diff(ends), 0)
            self.lengths, self.of = lengths, np.repeat(np.arange(self.size, dtype=np.int32), np.diff(ends))
            flat = array.values[ends[0] : ends[-1]] if len(ends) else array.values
        else:
            self.of = self.rows
            flat = array.drop_null()
        if kind in (AttrType.STRING, AttrType.STRING_LIST):
            codes = pc.dictionary_encode(flat)
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            self.words = {w: i for i, w in enumerate(codes.dictionary.to_pylist())}
            self.values = np.asarray(codes.indices)
        else:
            self.words = None
            self.values = np.asarray(flat)
        order = np.argsort(self.values, kind="stable")
        self.sorted, self.placed = self.values[order], self.of[order]
        new = np.flatnonzero(np.concatenate([[True], self.sorted[1:] != self.sorted[:-1]])) if len(order) else np.zeros(0, np.int64)
        found = self.sorted[new].tolist()
        if self.words is not None:
            names = {i: w for w, i in self.words.items()}
            found = [names[i] for i in found]
        #: The rows with each value, or with it in their list, in order.
        self.at: dict[object, np.ndarray] = dict(zip(found, np.split(self.placed, new[1:]), strict=True)) if found else {}

    def holding(self, value: object) -> np.ndarray:
        return self.at.get(value, _NONE)

    def within(self, sign: str, bounds: np.ndarray, leaves: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves `value sign bound` that are true somewhere, with their rows; bounds in order.  Equal sets of rows are one array."""
        cuts = np.searchsorted(self.sorted, bounds, "left" if sign in ("lt", "ge") else "right")
        low = sign in ("lt", "le")
        known: dict[int, np.ndarray] = {}
        some = np.flatnonzero(cuts > 0 if low else cuts < len(self.sorted))
        for i, cut in zip(some.tolist(), cuts[some].tolist(), strict=True):
            rows = known.get(cut)
            if rows is None:
                rows = known[cut] = np.sort(self.placed[:cut] if low else self.placed[cut:])
            yield leaves[i], rows

    def _not(self, rows: np.ndarray) -> np.ndarray:
        left = self.known.copy()
        left[rows] = False
        return np.flatnonzero(left).astype(np.int32)

    def true_rows(self, own: Leaf) -> np.ndarray:
        k = own.kind
        if k == "is_null":
            return np.flatnonzero(~self.known).astype(np.int32)
        if k == "is_not_null":
            return self.rows
        if k in ("is_empty", "is_not_empty"):
            return np.flatnonzero(self.known & ((self.lengths == 0) == (k == "is_empty"))).astype(np.int32)
        values = own.operand if isinstance(own.operand, tuple) else (own.operand,)
        if k in ("all_of", "not_all_of"):
            rows = self.holding(values[0])
            for v in values[1:]:
                rows = _common(rows, self.holding(v)) if len(rows) else rows
            return rows if k == "all_of" else self._not(rows)
        return self._not(_merged([self.holding(v) for v in values], self.size))  # ne, not_in, none_of


COUNTERS = ("predicates_evaluated", "predicates_true", "nodes_visited", "and_woken", "and_true", "or_visited")


def matched(own: Compiled, batch: pa.RecordBatch, counters: dict[str, np.ndarray] | None = None, ordered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row and dense subscription of each match, if ordered by row and then subscription.  The batch's columns: the attributes used.

    counters: an array of the batch's length for each of COUNTERS, added to.
    """
    size = batch.num_rows
    true: dict[int, np.ndarray] = {}
    woken: set[int] = set()
    for name, kind in own.types.items():
        equal, other, ranges = own.equal.get(name, {}), own.other.get(name, ()), own.ranges.get(name, {})
        if not equal and not other and not ranges:
            continue
        column = _Column(kind, batch.column(batch.schema.get_field_index(name)))
        parts: dict[int, list[np.ndarray]] = defaultdict(list)
        for value, rows in column.at.items() if equal else ():
            for n in equal.get(value, ()):
                parts[n].append(rows)
        for sign, (bounds, leaves) in ranges.items():
            for n, rows in column.within(sign, bounds, leaves):
                parts[n].append(rows)
        for n, leaf in other:
            rows = column.true_rows(leaf)
            if len(rows):
                parts[n].append(rows)
        for n, rows in parts.items():
            true[n] = _merged(rows, size)
            woken.update(own.wakes.get(n, ()))
            if counters is not None:
                counters["predicates_true"][true[n]] += 1
                counters["predicates_evaluated"][true[n]] += n in own.indexed
        if counters is not None:
            known, all_ = own.tried.get(name, (0, 0))
            counters["predicates_evaluated"] += all_ + known * column.known
    # by levels: a node wakes only nodes of higher levels, which stand behind it
    todo = sorted(woken)
    heapq.heapify(todo)
    seen = set(todo)
    while todo:
        n, conj, children, access = own.inner[heapq.heappop(todo)]
        held = [true.get(c, _NONE) for c in children]
        if counters is not None:
            seen_by = held[0] if conj and access is not None else _merged([_NONE, *held], size)
            for name in ("nodes_visited", "and_woken" if conj else "or_visited"):
                counters[name][seen_by] += 1
        if conj:
            rows = held[0]
            for other_rows in held[1:]:
                if not len(rows) or not len(other_rows):
                    rows = _NONE
                    break
                rows = _common(rows, other_rows)
        else:
            rows = _merged([h for h in held if len(h)], size)
        if counters is not None and conj:
            counters["and_true"][rows] += 1
        if len(rows):
            true[n] = rows
            for k in own.wakes.get(n, ()):
                if k not in seen:
                    seen.add(k)
                    heapq.heappush(todo, k)
    rows_out, subs_out = [_NONE], [_NONE]
    for n, rows in true.items():
        subs = own.subs.get(n)
        if subs is not None:
            rows_out.append(np.repeat(rows, len(subs)))
            subs_out.append(np.tile(subs, len(rows)))
    if len(own.always):
        everything = np.arange(batch.num_rows, dtype=np.int32)
        rows_out.append(np.repeat(everything, len(own.always)))
        subs_out.append(np.tile(own.always, batch.num_rows))
    rows, subs = np.concatenate(rows_out), np.concatenate(subs_out)
    if ordered:
        both = np.sort(rows.astype(np.int64) << 32 | subs)
        rows, subs = (both >> 32).astype(np.int32), (both & 0xFFFFFFFF).astype(np.int32)
    return rows, subs
