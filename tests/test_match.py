"""All ways of matching give what the plain meaning gives."""

import random

import pytest
from pyspark.sql import functions as F

from rulesieve.errors import RuleError, Status
from rulesieve.functions.evaluate import evaluate as meaning
from rulesieve.operators import match as m
from rulesieve.operators.kernel import COUNTERS
from rulesieve.operators.match import evaluate, exists, for_each, match, match_ids, match_lists, match_stats
from rulesieve.registry import Config, Registry
from rulesieve.schema import Schema
from rulesieve.sources.events import from_rows
from tests.test_parser import GEN, random_event, random_rule

WAYS = ("compiled", "indexed", "relational")


@pytest.fixture(scope="module")
def case(spark):
    rnd, own = random.Random(1), Registry(GEN)
    while len(own) < 70:
        try:
            own.insert(len(own) * 3 + (1 << 63 if len(own) % 9 == 0 else 0), random_rule(rnd, 2))
        except RuleError:
            pass
    events = [random_event(rnd) for _ in range(50)]
    want = sorted((i, s) for i, e in enumerate(events) for s, r in own.given.items() if meaning(r, e) is True)
    return own, events, from_rows(spark, GEN, events), want


@pytest.mark.parametrize("how", WAYS)
def test_ways(case, how):
    own, events, df, want = case
    assert sorted((r[0], int(r[1])) for r in match(df, own, how).collect()) == want
    rows = match_lists(df, own, how).collect()
    assert len(rows) == len(events) and sorted((r[0], int(x)) for r in rows for x in r[1]) == want
    assert all([int(x) for x in r[1]] == sorted(int(x) for x in r[1]) for r in rows)


def test_blocks(case, monkeypatch):
    own, _, df, want = case
    monkeypatch.setattr(m, "BLOCK", 16)
    assert sorted((r[0], int(r[1])) for r in match(df, own, "indexed").collect()) == want
    assert sorted((r[0], int(x)) for r in match_lists(df, own, "indexed").collect() for x in r[1]) == want


def test_conveniences(case):
    own, events, df, want = case
    hit = {i for i, _ in want}
    assert {r[0] for r in exists(df, own).collect() if r[1]} == hit
    allow = sorted(own.rules)[::7] + [12345]
    assert sorted((r[0], int(r[1])) for r in match_ids(df, own, allow).collect()) == [x for x in want if x[1] in allow]
    assert match_ids(df, own, []).collect() == []
    sub = sorted(own.rules)[3]
    assert {r[0]: r[1] for r in evaluate(df, own, own.given[sub]).collect()} == {i: meaning(own.given[sub], e) for i, e in enumerate(events)}
    told = []
    for_each(df, own, lambda e, s: told.append((e, s)))
    assert sorted(told) == want
    with pytest.raises(RuleError) as e:
        for_each(df, own, lambda *_: True)
    assert e.value.status is Status.CANCELLED
    with pytest.raises(RuleError):
        match(df, own, "other")


@pytest.mark.parametrize("config", [Config(), Config(on_demand=False), Config(indexed=False), Config(reorganize=False, self_adjust=False)])
def test_counters_are_those_of_single_searches(case, config):
    own, events, df, _ = case
    other = Registry(GEN, config)
    for sub, rule in own.given.items():
        other.insert(sub, rule)
    for r in match_stats(df, other).collect():
        found = other.search(events[r["event_id"]])
        assert r["matches"] == len(found.ids) and all(r[c] == getattr(found, c) for c in COUNTERS), r


def test_no_rules_no_events_no_attributes(spark):
    schema = Schema([("a", "int")])
    none, some = from_rows(spark, schema, []), from_rows(spark, schema, [{"a": 1}, {}])
    for how in WAYS:
        own = Registry(schema)
        assert match(some, own, how).collect() == [] and [r[1] for r in match_lists(some, own, how).collect()] == [[], []]
        own.insert(1, "true")
        assert sorted(r[0] for r in match(some, own, how).collect()) == [0, 1]
        own.insert(2, "a is null")
        assert match(none, own, how).collect() == []
        assert sorted((r[0], r[1]) for r in match(some, own, how).collect()) == [(0, 1), (1, 1), (1, 2)]
    empty = Registry(Schema([]))
    empty.insert(5, "not false")
    assert [r[1] for r in match(some.select("event_id"), empty).collect()] == [5, 5]


def test_numbers_at_the_edges(spark):
    schema = Schema([("i", "int"), ("f", "float")])
    own = Registry(schema)
    for s, rule in enumerate(["i = -9223372036854775808", "i >= 9223372036854775807", "f = 0", "f > 1.0e300", "f < 0.5", "f is null", "f <> 0.0", "i in [-9223372036854775808, 5]"]):
        own.insert(s, rule)
    events = [{"i": -(1 << 63), "f": -0.0}, {"i": (1 << 63) - 1, "f": float("inf")}, {"i": 5, "f": float("nan")}, {"f": float("-inf")}]
    want = sorted((i, s) for i, e in enumerate(events) for s, r in own.given.items() if meaning(r, e) is True)
    for how in WAYS:
        assert sorted((r[0], r[1]) for r in match(from_rows(spark, schema, events), own, how).collect()) == want, how


def test_plans(case, spark, tmp_path):
    """Few rules read only what they use and never shuffle; the indexed way never shuffles."""
    own, _, df, _ = case
    df.write.parquet(f"{tmp_path}/events")
    df = spark.read.parquet(f"{tmp_path}/events")
    one = Registry(GEN)
    one.insert(1, "i0 = 1 or s0 = 'alpha'")
    plan = match(df, one, "compiled")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "il0" not in plan
    assert "Exchange" not in match(df, own, "indexed")._jdf.queryExecution().executedPlan().toString()


def test_a_failed_insert_leaves_nothing(monkeypatch):
    own = Registry(Schema([("a", "int"), ("b", "bool"), ("c", "bool")]))
    own.insert(1, "a > 1 and b")
    before = own.dag.search({"a": 2, "b": True}).ids

    calls, whole = [], type(own.dag)._adjust

    def broken(self, node):
        calls.append(node)
        if len(calls) == 1:
            raise RuntimeError("half-way")
        whole(self, node)

    monkeypatch.setattr(type(own.dag), "_adjust", broken)
    with pytest.raises(RuntimeError):
        own.insert(2, "(a > 1 or c) and (b or c)")
    monkeypatch.undo()
    own.validate()
    assert 2 not in own and len(own) == 1 and own.dag.search({"a": 2, "b": True}).ids == before
    own.insert(2, "(a > 1 or c) and (b or c)")
    own.validate()
    assert own.search({"a": 2, "b": True}).ids == [1, 2]


def test_events_by_attribute_number(spark):
    schema = Schema([("a", "int"), ("b", "string_list")])
    rows = from_rows(spark, schema, [{0: 5, "b": ["x"]}, {1: ["y", "y"]}, {"a": None}]).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(5, ["x"]), (None, ["y"]), (None, None)]
    for bad in ({2: 1}, {-1: 1}, {"z": 1}):
        with pytest.raises(RuleError):
            from_rows(spark, schema, [bad])


def test_several_blocks_and_a_kept_subset(spark, monkeypatch):
    from rulesieve.operators import match as m

    own = Registry(Schema([("a", "int")]))
    for i in range(25):
        own.insert(i, f"a > {i}")
    events = spark.createDataFrame([(i, i) for i in range(30)], "event_id bigint, a bigint")
    want = sorted((e, s) for e in range(30) for s in range(25) if e > s)
    monkeypatch.setattr(m, "BLOCK", 10)
    got = m.match(events, own, "indexed")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 3
    assert sorted(map(tuple, got.collect())) == want
    assert {r["event_id"]: r["sub_ids"] for r in m.match_lists(events, own, "indexed").collect()} == {e: [s for x, s in want if x == e] for e in range(30)}
    assert own.subset([1, 2]) is own.subset([2, 1, 99])
    own.delete(3)
    assert sorted(own.subset([1, 3]).rules) == [1]


def test_many_thresholds_are_joined_not_scanned(spark):
    own, rnd = Registry(Schema([("a", "int"), ("f", "float")])), random.Random(3)
    signs = ["<", "<=", ">", ">="]
    for i in range(700):
        own.insert(i, f"{rnd.choice('af')} {rnd.choice(signs)} {rnd.randrange(-50, 50)}")
    big = 2**53
    own.insert(9000, f"a > {big}")
    own.insert(9001, f"a >= {big + 1} and f < 0.5")
    rows = [(i, rnd.choice([None, rnd.randrange(-60, 60)]), rnd.choice([None, float("nan"), rnd.uniform(-60, 60), float("inf"), float(rnd.randrange(-50, 50))])) for i in range(60)] + [(100, big + 1, 0.0), (101, big, 0.0)]
    events = spark.createDataFrame(rows, "event_id bigint, a bigint, f double")
    got = match(events, own, "relational")
    assert got._jdf.queryExecution().analyzed().toString().count("Generate explode") <= 3  # one pass a type, not one for each few hundred
    assert sorted((r[0], int(r[1])) for r in got.collect()) == sorted(map(tuple, match(events, own, "indexed").collect())) == sorted(map(tuple, match(events, own, "compiled").collect()))


def test_relational_tasks_stay_small_as_events_grow(case, spark, monkeypatch):
    """A task counts the nodes of a bounded number of events, however many there are, with tables broadcast or not."""
    import re

    from rulesieve.operators import relational

    own, events, df, want = case
    monkeypatch.setattr(relational, "TASK_NODES", 1, raising=False)
    monkeypatch.setattr(relational, "TASK_EVENTS", 10, raising=False)
    shuffled = lambda x: re.findall(r"Exchange (\w+\(.*\)), [A-Z_]+, ", re.sub(r"#\d+L?", "", x._jdf.queryExecution().executedPlan().toString()))
    for times in (1, 4):
        more = df.crossJoin(spark.range(times).withColumnRenamed("id", "r")).withColumn("event_id", F.col("event_id") + F.col("r") * 1000).drop("r")
        expected = sorted((i + 1000 * r, s) for r in range(times) for i, s in want)
        tasks = len(events) * times // 10
        found = match(more, own, "relational")
        assert set(shuffled(found)) == {f"hashpartitioning(event_id, {tasks})"}
        assert sorted((r[0], int(r[1])) for r in found.collect()) == expected
        lists = match_lists(more, own, "relational")
        assert set(shuffled(lists)) == {f"hashpartitioning(event_id, {tasks})"}
        rows = lists.collect()
        assert len(rows) == len(events) * times and sorted((r[0], int(x)) for r in rows for x in r[1]) == expected
    monkeypatch.setattr(relational, "BROADCAST_BYTES", 0)
    found = match(df, own, "relational")
    by_event = {x for x in shuffled(found) if "event_id" in x}
    assert by_event == {"hashpartitioning(event_id, 5)"} and any("node" in x for x in shuffled(found))
    assert sorted((r[0], int(r[1])) for r in found.collect()) == want
