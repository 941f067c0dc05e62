"""Decoders, checked columns, files, delivery and streams."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from rulesieve import filebench
from rulesieve.errors import RuleError, Status
from rulesieve.operators.deliver import deliver
from rulesieve.operators.match import match
from rulesieve.registry import Registry
from rulesieve.schema import Schema
from rulesieve.sources import files
from rulesieve.sources.events import accepted, decode, decoded, event_from_pairs, from_rows, normalized, rejected
from rulesieve.streaming.continuous import continuous

S = Schema([("flag", "bool"), ("age", "int"), ("price", "float"), ("country", "string"), ("segments", "int_list"), ("deals", "string_list")])

GOOD = [
    ('{"price": 12, "country": "US"}', {"price": 12.0, "country": "US"}),
    (' {"age": null, "flag": true}', {"age": None, "flag": True}),
    ('{"segments": [3, 1, 3], "deals": []}', {"segments": [1, 3], "deals": []}),
    ('{"age": 1, "age": 2}', {"age": 2}),
    ('{"price": 99999999999999999999}', {"price": 1e20}),
    ('{"country": "\\u00e9"}', {"country": "é"}),
    ("age=12;country=\"U;S\"; price=1e3", {"age": 12, "country": "U;S", "price": 1000.0}),
    ("deals=['b', \"a,x\", b];segments=[]", {"deals": ["a,x", "b"], "segments": []}),
    ("price=nan;flag=false", {"price": None, "flag": False}),
    ("price=inf;country=plain text", {"price": float("inf"), "country": "plain text"}),
    ("", {}),
]
BAD = [
    '{"age": 1.5}', '{"age": "1"}', '{"age": true}', '{"age": 9223372036854775808}', '{"nope": 1}', '{"country": 1}', '{"segments": [1, "a"]}', '{"segments": [1, null]}', '{"deals": {"a": 1}}', '{"price": "NaN"}', '{"price": NaN}', '{"age": 1', '{"segments": [true]}',
    "age=1.5", "age=12abc", "age=", "age", "bogus=1", "flag=yes", "age=9223372036854775808", "price=0x10", 'segments=["a"]', "segments=1", "country='a", "country=",
]


@pytest.mark.parametrize(("payload", "event"), GOOD)
def test_decodes(payload, event):
    assert decode(S, payload) == event


@pytest.mark.parametrize("payload", BAD)
def test_rejects(payload):
    with pytest.raises(RuleError):
        decode(S, payload)


def test_pairs():
    assert event_from_pairs(S, "age", "3", "country", "US") == {"age": 3, "country": "US"}
    with pytest.raises(RuleError):
        event_from_pairs(S, "age", "3", "country")


def test_decoded_table(spark):
    rows = [(i, p) for i, (p, _) in enumerate(GOOD)] + [(100 + i, p) for i, p in enumerate(BAD)] + [(500, None)]
    out = decoded(spark.createDataFrame(rows, "event_id bigint, payload string"), S).persist()
    kept = {r["event_id"]: r.asDict() for r in accepted(out).collect()}
    for i, (_, event) in enumerate(GOOD):
        assert {k: kept[i][k] for k, _ in S} == dict.fromkeys((k for k, _ in S)) | event
    assert 500 in kept and {r["event_id"] for r in rejected(out).collect()} == set(range(100, 100 + len(BAD)))
    assert all(r["error"] for r in rejected(out).collect())


def test_both_decoders_agree(spark):
    """Catalyst's and the plain one on random payloads, right and wrong, in usual and unusual forms."""
    rnd = random.Random(12)
    values = ["1", "-3", "+4", "1.5", "1e3", "-0.0", "true", "false", "null", '"x"', '"1"', '"a{b"', '"\\u00e9"', "[]", "[1, 2, 1]", "[1,null]", "[null]", '["b","a"]', '["a",1]', "[1.0]", "{}", "9223372036854775807", "9223372036854775808", "1e400", "01", "'q'", "x y", "['a', \"b\"]", "[a,b]", "[ ]", "nan", "inf", "", '"a;b"', '"a"b', '[a"b"]', '["a"b]', "é", "\u00a0x", ".5", "5.", "tRue", '["a,b"]', "[" + ",".join(["7"] * 256) + "]", "[" + ",".join(["7"] * 257) + "]"]
    names = [n for n, _ in S] * 4 + ["nope", "Age", "a b", ""]
    payloads = []
    for _ in range(2500):
        pairs = [(rnd.choice(names), rnd.choice(values)) for _ in range(rnd.choice([0, 1, 1, 1, 2, 3]))]
        body = rnd.choice([", ", ","]).join(f'"{n}"{rnd.choice([":", " : "])}{v}' for n, v in pairs)
        payloads.append(rnd.choice(["", "", " \n"]) + "{" + body + "}" + rnd.choice(["", "", "", " ", " x", "{}", ","]))
        payloads.append(rnd.choice(["", "", " "]) + rnd.choice([";", "; ", " ;"]).join(f"{n}{rnd.choice(['=', ' = '])}{v}" for n, v in pairs) + rnd.choice(["", "", ";", ";;", "\t"]))
    got = {r["event_id"]: r for r in decoded(spark.createDataFrame(list(enumerate(payloads)), "event_id bigint, payload string"), S).collect()}
    right = 0
    for i, text in enumerate(payloads):
        try:
            own, error = decode(S, text), None
        except RuleError as e:
            own, error = {}, e.describe()
        right += error is None
        assert got[i]["error"] == error and {n: got[i][n] for n, _ in S} == dict.fromkeys(n for n, _ in S) | own, text
    assert 500 < right < 4500


def test_usual_payloads_need_no_python(spark, monkeypatch):
    from rulesieve.sources import events as module

    def never(*_):
        raise AssertionError("decoded in Python")

    rows = [(1, '{"age": 3, "price": 1.5, "deals": ["b", "a"], "segments": [], "flag": true, "country": "x"}'), (2, "age=3; price=1.5;deals=['b', a];segments=[2,1];flag=true;country='x;y'")]
    monkeypatch.setattr(module, "decode", never)  # what a worker would get by pickle
    out = decoded(spark.createDataFrame(rows, "event_id bigint, payload string"), S).drop("event_id", "payload", "error").collect()
    assert tuple(out[0]) == (True, 3, 1.5, "x", [], ["a", "b"]) and tuple(out[1]) == (True, 3, 1.5, "x;y", [1, 2], ["a", "b"])
    monkeypatch.undo()
    assert decoded(spark.createDataFrame([(1, "{}"), (2, "a=1")], "event_id bigint, payload string"), Schema([])).where("error IS NULL").count() == 1


def test_normal_columns(spark):
    df = spark.createDataFrame([(1, float("nan"), ["b", "a", "b"], 3), (2, None, None, None)], "event_id bigint, price double, deals array<string>, age int")
    first, second = normalized(df, S).orderBy("event_id").collect()
    assert (first["price"], first["deals"], first["age"], first["flag"]) == (None, ["a", "b"], 3, None) and second["deals"] is None
    for columns in ("event_id bigint, age double", "event_id bigint, country bigint", "event_id bigint, segments array<string>", "event_id bigint, price bigint"):
        with pytest.raises(RuleError) as e:
            normalized(spark.createDataFrame([], columns), S)
        assert e.value.status is Status.TYPE_MISMATCH
    with pytest.raises(PySparkException):
        normalized(spark.createDataFrame([(1, [1, None])], "event_id bigint, segments array<bigint>"), S).collect()
    with pytest.raises(RuleError):
        from_rows(spark, S, [{"age": 1.5}])


def test_files(spark, tmp_path):
    (tmp_path / "defs").write_text("# attributes\nprice\tfloat\n\ncountry\tstring\n")
    (tmp_path / "rules").write_text("1\tprice > 10\n2\tcountry = 'US'\nx\tprice > 1\n3\tprice >\n2\tprice < 1\n18446744073709551615\tprice < 1\n")
    (tmp_path / "events").write_text('price=12;country="US"\n{"price": 0.5}\nprice=x\n\n')
    schema = files.read_schema(spark, str(tmp_path / "defs"))
    own = Registry(schema)
    bad = files.load_rules(own, files.read_rules(spark, str(tmp_path / "rules"))).collect()
    assert sorted((r["status"], r["offset"]) for r in bad) == [("DUPLICATE_ID", None), ("SYNTAX", 0), ("SYNTAX", 7)]
    out = files.read_events(spark, str(tmp_path / "events"), schema)
    assert sorted(int(r["sub_id"]) for r in match(accepted(out), own).collect()) == [1, 2, (1 << 64) - 1] and rejected(out).count() == 1


def test_file_benchmark(spark, tmp_path):
    (tmp_path / "defs").write_text("price\tfloat\ncountry\tstring\n")
    (tmp_path / "rules").write_text("1\tprice > 10\n2\tcountry = 'US' or price < 1\n3\tprice >\n")
    (tmp_path / "events").write_text("price=12;country=US\nprice=0.5\nprice=x\n")
    got = filebench.run(spark, *(str(tmp_path / x) for x in ("defs", "rules", "events")), runs=2)
    assert {k: got[k] for k in ("attributes", "rules", "rules_rejected", "events", "events_rejected", "matches", "leaves")} == {"attributes": 2, "rules": 2, "rules_rejected": 1, "events": 2, "events_rejected": 1, "matches": 3, "leaves": 3}


def test_a_stream_of_files_has_the_same_ids_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("age=1\nage=2\r\n\nage=1\n")
    seen = []
    for k in range(2):
        stream = files.stream_events(spark, str(tmp_path / "in"), S).writeStream.foreachBatch(lambda b, _: seen.append(sorted((r["event_id"], r["age"]) for r in b.collect())))
        stream.option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start().awaitTermination()
    assert seen[0] == seen[1] and sorted(a for _, a in seen[0]) == [1, 1, 2] and len({i for i, _ in seen[0]}) == 3


def test_saved_rules(spark, tmp_path):
    own = Registry(S)
    for sub, rule in ((1, "age > 3 xor not (price between 1 and 2)"), ((1 << 64) - 1, "deals all of ['a\\n', \"'\"]"), (5, "true")):
        own.insert(sub, rule)
    files.save_rules(own, spark, f"{tmp_path}/rules")
    again = files.restored(spark, f"{tmp_path}/rules", S)
    assert again.rules == own.rules and again.given == own.given


def test_delivery(spark):
    events = spark.createDataFrame([(1, '{"price": 12}'), (2, 'price=12;country="a"')], "event_id bigint, payload string")
    matches = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "event_id bigint, sub_id bigint")
    subs = spark.createDataFrame([("a", "push", 7), ("a", "push", 7), ("a", "row", 7), ("c", "push", None), ("d", "push", 9)], "subscriber_id string, kind string, sub_id bigint")
    got = sorted((r["subscriber_id"], r["kind"], r["event_id"], int(r["sub_id"]), r["message"]) for r in deliver(matches, events, subs).collect())
    assert [x[:4] for x in got] == [("a", "push", 1, 7), ("a", "push", 2, 7), ("a", "row", 1, 7), ("a", "row", 2, 7), ("c", "push", 1, 7), ("c", "push", 1, 8), ("c", "push", 2, 7)]
    assert got[0][4] == '{"price": 12}' and json.loads(got[4][4]) == {"id": 7, "event": {"price": 12}} and json.loads(got[6][4]) == {"id": 7, "event": 'price=12;country="a"'}
    none = spark.createDataFrame([], subs.schema)
    assert deliver(matches, events, none).collect() == []


def test_continuous(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text('age=5\n{"age": 50}\nage=x\n')
    own = Registry(S)
    own.insert(1, "age > 10")
    subs = spark.createDataFrame([("a", "push", 1)], "subscriber_id string, kind string, sub_id bigint")
    told, bad = [], []

    def run():
        stream = files.stream_events(spark, str(tmp_path / "in"), S)
        writer = continuous(stream, lambda: own, lambda: subs, lambda df, n: told.extend(r["message"] for r in df.collect()), lambda df, n: bad.extend(r["payload"] for r in df.collect()))
        writer.option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()

    run()
    assert told == ['{"age": 50}'] and bad == ["age=x"]
    own.insert(2, "age < 3")  # seen from the next micro-batch on
    subs = subs.union(spark.createDataFrame([("b", "push", 2)], subs.schema))
    (tmp_path / "in" / "b").write_text("age=2\n")
    run()
    assert told == ['{"age": 50}', "age=2"]


def test_stream_to_table(spark, tmp_path):
    from rulesieve.streaming.tables import stream_to_table

    spark.createDataFrame([(1, 5), (2, 50)], "event_id bigint, age bigint").write.parquet(f"{tmp_path}/full")
    spark.createDataFrame([], "event_id bigint, age bigint").write.parquet(f"{tmp_path}/none")
    own = Registry(S)
    own.insert(1, "age > 10")
    for name, want in (("full", [(2, 1)]), ("none", [])):
        source = spark.readStream.schema("event_id bigint, age bigint").parquet(f"{tmp_path}/{name}")
        assert [tuple(r) for r in stream_to_table(source, lambda b: match(b, own)).collect()] == want
