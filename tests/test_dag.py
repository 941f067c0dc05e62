"""Graphs over small rule sets with known structure, and random ones against the plain meaning."""

import itertools
import random

import pytest

from rulesieve.errors import RuleError, Status
from rulesieve.functions.evaluate import evaluate
from rulesieve.plans.printer import text
from rulesieve.registry import Config, Registry
from rulesieve.schema import Schema
from tests.test_parser import AD, GEN, random_event, random_rule

P = Schema([(f"p{i}", "bool") for i in range(1, 9)])
FLAGS = [Config(reorganize=a, self_adjust=b, on_demand=c, indexed=d) for a, b, c, d in itertools.product((True, False), repeat=4)]


def _registry(rules, config=None, schema=P):
    out = Registry(schema, config)
    for sub, rule in rules.items():
        out.insert(sub, rule)
        out.validate()
    return out


def _event(*true):
    return {f"p{i}": f"p{i}" in true for i in range(1, 9)}


def _stats(own, *names):
    return tuple(own.stats()[n] for n in names)


SHAPES = ("leaves", "nodes", "edges", "max_level")
TWO = {1: "(p1 or p2 or p3) and p4 and (p5 or p6)", 2: "(p5 or p6) and (p7 or p8)"}


def test_shared_parts():
    own = _registry(TWO)
    assert _stats(own, *SHAPES) == (8, 13, 12, 3)
    assert own.search(_event("p5", "p7")).ids == [2] and own.search(_event("p5", "p7", "p2", "p4")).ids == [1, 2]
    own.delete(1)
    own.validate()
    assert _stats(own, "leaves", "nodes") == (4, 7) and own.search(_event("p5", "p7")).ids == [2]


def test_search_touches_little():
    own = _registry(TWO | {3: "p1 or p2 or p3 or p4", 4: "(p1 or p2 or p3) and p4", 5: TWO[2], 6: "not (p7 or p8)"})
    assert _stats(own, *SHAPES) == (10, 18, 17, 4)
    found = own.search(_event("p1"))
    assert (found.ids, found.nodes_visited, found.or_visited, found.and_woken, found.and_true) == ([3, 6], 4, 2, 2, 1)


def test_reorganising():
    rules = {1: "(p1 or p2 or p3) and p4", 2: "p1 or p2 or p3 or p4"}
    for on, edges, times in ((True, 7, 1), (False, 9, 0)):
        own = _registry(rules, Config(reorganize=on))
        assert _stats(own, "nodes", "edges", "reorganized", "max_level") == (7, edges, times, 3)
        assert own.search(_event("p4")).ids == [2] and own.search(_event("p4", "p2")).ids == [1, 2]
        own.delete(1)
        own.validate()
        assert own.search(_event("p2")).ids == [2]


def test_self_adjusting():
    for on, edges in ((True, 13), (False, 14)):
        own = _registry(TWO | {3: "(p1 or p2 or p3) and p4"}, Config(self_adjust=on))
        assert _stats(own, "nodes", "edges") == (14, edges)
        assert own.search(_event("p1", "p4")).ids == [3] and own.search(_event("p1", "p4", "p6", "p8")).ids == [1, 2, 3]


def test_arrival_order_does_not_matter():
    rules = TWO | {3: "p1 or p2 or p3 or p4", 4: "(p1 or p2 or p3) and p4", 6: "not (p7 or p8)"}
    for order in itertools.permutations(rules):
        own = _registry({k: rules[k] for k in order})
        assert own.search(_event("p1")).ids == [3, 6]


def test_constants_ids_and_errors():
    own = _registry({1: "true", 2: "false", 3: "private or true", 4: "private and false", 5: "not (private and false)"}, schema=AD)
    assert own.search({}).ids == [1, 3, 5] and _stats(own, "nodes", "subscriptions") == (0, 5) and own.always == [1, 3, 5]
    for sub, rule, status in ((1, "private", Status.DUPLICATE_ID), (1, "private =", Status.SYNTAX), (-1, "private", Status.INVALID_ARG), (1 << 64, "private", Status.INVALID_ARG), (9, "nope", Status.UNKNOWN_ATTR)):
        with pytest.raises(RuleError) as e:
            own.insert(sub, rule)
        assert e.value.status is status and len(own) == 5
    with pytest.raises(RuleError) as e:
        own.delete(77)
    assert e.value.status is Status.NOT_FOUND
    own.insert((1 << 64) - 1, "private")
    assert (1 << 64) - 1 in own and own.search({"private": True}).ids == [1, 3, 5, (1 << 64) - 1]
    assert [(s, e.status) for s, _, e in own.insert_many([(50, "test"), (50, "test"), (51, "(")])] == [(50, Status.DUPLICATE_ID), (51, Status.SYNTAX)]


def test_known_events():
    rules = {1: "exchange_id = 1", 2: "private", 3: "not private", 4: "deal_ids one of ['deal-1','deal-2'] and country in ['CA','US']"}
    own = _registry(rules, schema=AD)
    base = {"exchange_id": 1, "private": False}
    assert own.search(base).ids == [1, 3] and own.search(base | {"private": True}).ids == [1, 2] and own.search({"exchange_id": 1}).ids == [1]
    assert own.search(base | {"deal_ids": ["deal-2", "deal-9"], "country": "US"}).ids == [1, 3, 4]
    assert own.subset([2, 3, 50]).search(base).ids == [3] and own.subset([]).search(base).ids == []


def test_dense_sharing():
    schema = Schema([("p", "bool"), ("q", "bool"), ("x", "int")])
    own = _registry({}, schema=schema)
    for i in range(1000):
        own.insert(i, f"(p or q) and x = {i}")
    assert _stats(own, "leaves", "nodes", "edges") == (1002, 2003, 2002)
    found = own.search({"p": True, "x": 7})
    assert (found.ids, found.and_woken) == ([7], 1)


@pytest.mark.parametrize("config", FLAGS, ids=lambda c: "".join("rson"[i] if x else "-" for i, x in enumerate((c.reorganize, c.self_adjust, c.on_demand, c.indexed))))
def test_random_rules_with_deletes(config):
    rnd, rules = random.Random(21), {}
    own = Registry(GEN, config)

    def fill():
        while len(rules) < 90:
            rule, sub = random_rule(rnd, 3), rnd.randrange(10**6)
            try:
                own.insert(sub, rule)
            except RuleError:
                continue
            rules[sub] = rule

    fill()
    for _ in range(3):
        own.validate()
        for _ in range(15):
            event = random_event(rnd)
            assert own.search(event).ids == sorted(s for s, r in rules.items() if evaluate(r, event) is True)
        for sub in rnd.sample(sorted(rules), 40):
            own.delete(sub)
            del rules[sub]
        own.validate()
        fill()
    for sub in list(rules):
        own.delete(sub)
    assert not own.dag.nodes and not own.dag.leaves and not own.dag.inner


def test_a_broken_structure_is_found():
    own = _registry(TWO)
    own.dag.nodes[max(own.dag.nodes)].level = 9
    with pytest.raises(RuleError) as e:
        own.validate()
    assert e.value.status is Status.CORRUPT


def test_dot():
    own = _registry(TWO | {s: "p1" for s in range(10, 20)} | {99: "true"})
    out = own.dot()
    assert out.startswith("digraph rulesieve {") and "[10, 11, 12, 13, 14, 15, 16, 17, ...]" in out and 'label="true [99]"' in out and out.count("style=bold") == 2
