"""Texts, errors and prints of rules."""

import random

import pytest

from rulesieve.errors import RuleError, Status
from rulesieve.functions.evaluate import evaluate
from rulesieve.plans.expr import And, Builder, Const, Leaf, Not, Or, Xnor, Xor
from rulesieve.plans.normalize import normalize
from rulesieve.plans.parser import parse
from rulesieve.plans.printer import text
from rulesieve.schema import Schema

AD = Schema([("private", "bool"), ("test", "bool"), ("exchange_id", "int"), ("price", "float"), ("country", "string"), ("city", "string"), ("segment_ids", "int_list"), ("deal_ids", "string_list")])

# fixed values: texts and how they print
PRINTS = [
    ("exchange_id < 10", "exchange_id < 10"), ("10 < exchange_id", "exchange_id > 10"), ("10 <= exchange_id", "exchange_id >= 10"), ("10 >= exchange_id", "exchange_id <= 10"),
    ("price > 2", "price > 2.0"), ("price >= -0.5", "price >= -0.5"), ("price < 1.0e+20", "price < 1.0e+20"), ("price = 1.25", "price = 1.25"),
    ("exchange_id != 1", "exchange_id <> 1"), ("1 <> exchange_id", "exchange_id <> 1"), ("country = 'CA'", 'country = "CA"'), ('country <> "a\\"b"', 'country <> "a\\"b"'),
    ("deal_ids is not empty", "deal_ids is not empty"), ("country is null", "country is null"), ("exchange_id in [3, 1, 2, 1]", "exchange_id in [1, 2, 3]"), ("exchange_id not in (1, 2)", "exchange_id not in [1, 2]"),
    ("country in ['US', \"CA\"]", 'country in ["CA", "US"]'), ("segment_ids none of [2, 1]", "segment_ids none of [1, 2]"), ("deal_ids all of ('x')", 'deal_ids all of ["x"]'),
    ("FALSE", "false"), ("price BETWEEN 1 AND 2.5", "price >= 1.0 and price <= 2.5"), ("3 in segment_ids", "segment_ids one of [3]"), ("country Is Not Null", "country is not null"),
    ("private && test", "private and test"), ("private || test", "private or test"), ("!private", "not private"), ("not not private", "not not private"),
    ("private or test and exchange_id = 1", "private or (test and exchange_id = 1)"), ("not private and test", "not private and test"), ("not (private and test)", "not (private and test)"),
    ("private and test xor exchange_id = 1 or price > 1.5", "((private and test) xor exchange_id = 1) or price > 1.5"), ("private xor test xnor exchange_id = 1", "(private xor test) xnor exchange_id = 1"),
    ("((((private))))", "private"), ("exchange_id between 1 and 5 and private", "(exchange_id >= 1 and exchange_id <= 5) and private"), ("  \t private\n and\r\n test  ", "private and test"),
]
# fixed values: texts, status and offset of the first error
ERRORS = [
    ("", "SYNTAX", 0), ("   ", "SYNTAX", 0), ("invalid in (1, 2, 3 and", "UNKNOWN_ATTR", 0), ("exchange_id in (1, 2, 3 and", "SYNTAX", 24), ("exchange_id in []", "INVALID_LITERAL", 15), ("exchange_id in ()", "INVALID_LITERAL", 15),
    ("exchange_id in [1, 'a']", "SYNTAX", 19), ("exchange_id in [1.5]", "SYNTAX", 16), ("exchange_id in [1 2]", "SYNTAX", 18), ("exchange_id in [1, 2)", "SYNTAX", 20), ("()", "SYNTAX", 0), ("(private", "SYNTAX", 8),
    ("private)", "SYNTAX", 7), ("private and", "SYNTAX", 11), ("and private", "SYNTAX", 0), ("private test", "SYNTAX", 8), ("exchange_id =", "SYNTAX", 13), ("exchange_id = private", "SYNTAX", 14), ("exchange_id is", "SYNTAX", 14),
    ("exchange_id is maybe", "SYNTAX", 15), ("exchange_id between 1 or 2", "SYNTAX", 22), ("exchange_id between 'a' and 2", "SYNTAX", 20), ("1 + exchange_id", "SYNTAX", 2), ("1 = 2", "SYNTAX", 4), ("'x' in exchange_id", "TYPE_MISMATCH", 0),
    ("1.5 in segment_ids", "SYNTAX", 0), ("nope = 1", "UNKNOWN_ATTR", 0), ("private and nope", "UNKNOWN_ATTR", 12), ("exchange_id = 'x'", "TYPE_MISMATCH", 0), ("exchange_id = 1.5", "TYPE_MISMATCH", 0), ("country < 'a'", "TYPE_MISMATCH", 0),
    ("private = 1", "TYPE_MISMATCH", 0), ("exchange_id", "TYPE_MISMATCH", 0), ("segment_ids in [1]", "TYPE_MISMATCH", 0), ("exchange_id one of [1]", "TYPE_MISMATCH", 0), ("segment_ids one of ['a']", "TYPE_MISMATCH", 0),
    ("segment_ids is null", "TYPE_MISMATCH", 0), ("country is empty", "TYPE_MISMATCH", 0), ("private and country = 'a' and city < 2", "TYPE_MISMATCH", 30), ("price > 9007199254740993", "INVALID_LITERAL", 0),
    ("exchange_id = 99999999999999999999", "INVALID_LITERAL", 14), ("price = 1e999", "INVALID_LITERAL", 8), ("price = 1e-400", "INVALID_LITERAL", 8), ("price = 0.000001e-400", "INVALID_LITERAL", 8), ("country = 'abc", "SYNTAX", 10),
    ('country = "abc\\', "SYNTAX", 10), ("private @ test", "SYNTAX", 8), ("private & test", "SYNTAX", 8), ("and = 1", "SYNTAX", 0), ("exchange_id = 12abc", "SYNTAX", 14), ("not", "SYNTAX", 3),
]


@pytest.mark.parametrize(("source", "printed"), PRINTS)
def test_prints(source, printed):
    assert text(parse(AD, source)) == printed
    assert text(parse(AD, printed)) == printed


@pytest.mark.parametrize(("source", "status", "offset"), ERRORS)
def test_errors(source, status, offset):
    with pytest.raises(RuleError) as e:
        parse(AD, source)
    assert (e.value.status.name, e.value.offset) == (status, offset)


def test_unknown_attribute_message():
    with pytest.raises(RuleError) as e:
        parse(AD, "a_b-c = 1")
    assert (e.value.message, e.value.offset, e.value.length) == ("unknown attribute 'a_b-c'", 0, 5)


def test_depth():
    assert text(parse(AD, "((((private))))", 4)) == "private"
    assert text(parse(AD, "not not not not private", 4)) == "not not not not private"
    for source, offset in (("(((((private)))))", 4), ("not not not not not private", 16)):
        with pytest.raises(RuleError) as e:
            parse(AD, source, 4)
        assert (e.value.status, e.value.offset) == (Status.TOO_DEEP, offset)
    chain = " xor ".join(["private"] * 66)
    with pytest.raises(RuleError) as e:
        parse(AD, chain)
    assert e.value.status is Status.TOO_DEEP
    normalize(parse(AD, "not " * 64 + "private"))  # what parses at the limit also goes into an index


def test_names():
    for bad in ("", "and", "1a", "a.b", "Null"):
        with pytest.raises(RuleError) as e:
            Schema([(bad, "int")])
        assert e.value.status is Status.INVALID_ARG
    with pytest.raises(RuleError) as e:
        Schema([("a", "int"), ("a", "bool")])
    assert e.value.status is Status.DUPLICATE_ATTR
    assert len(Schema([])) == 0 and list(Schema.from_lines(["# x", "", "a\tinteger_list"]))[0][1].value == "int_list"


def test_normal_forms():
    same = lambda a, b: normalize(parse(AD, a)) == normalize(parse(AD, b))
    assert same("private and (test and exchange_id = 1)", "exchange_id = 1 and test and private")
    assert same("not (private or test)", "not private and not test")
    assert same("private xor test", "(private and not test) or (not private and test)")
    assert same("not (private xor test)", "private xnor test")
    assert same("exchange_id between 1 and 5", "1 <= exchange_id and exchange_id <= 5")
    assert not same("private and test", "private or test")
    assert normalize(parse(AD, "not (private and false)")) == Const(True)
    with pytest.raises(RuleError) as e:
        normalize(parse(AD, " xor ".join(["private", "test"] * 10)))
    assert e.value.status is Status.LIMIT


GEN = Schema([("b0", "bool"), ("b1", "bool"), ("i0", "int"), ("i1", "int"), ("f0", "float"), ("s0", "string"), ("s1", "string"), ("il0", "int_list"), ("sl0", "string_list")])
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "unknown-1"]


def random_rule(rnd, depth=5):
    b = Builder(GEN)
    pick = rnd.random()
    if depth and pick < 0.02:
        return rnd.choice([b.true(), b.false()])
    if depth and pick > 0.32:
        if pick < 0.42:
            return b.not_(random_rule(rnd, depth - 1))
        if pick < 0.52:
            return rnd.choice([b.xor, b.xnor])(random_rule(rnd, depth - 1), random_rule(rnd, depth - 1))
        return rnd.choice([b.and_, b.or_])(*[random_rule(rnd, depth - 1) for _ in range(rnd.randint(2, 4))])
    ints, words = (lambda: rnd.sample(range(6), rnd.randint(1, 3))), (lambda: rnd.sample(WORDS, rnd.randint(1, 3)))
    op = rnd.choice(["<", "<=", ">", ">=", "=", "<>"])
    return rnd.choice([
        lambda: b.var(rnd.choice(["b0", "b1"])), lambda: b.compare(rnd.choice(["i0", "i1"]), op, rnd.randint(0, 5)), lambda: b.compare("f0", op, rnd.randint(0, 4) / 2), lambda: b.compare(rnd.choice(["s0", "s1"]), rnd.choice(["=", "<>"]), rnd.choice(WORDS)),
        lambda: rnd.choice([b.is_in, b.not_in])("i0", ints()), lambda: rnd.choice([b.is_in, b.not_in])("s0", words()), lambda: rnd.choice([b.one_of, b.none_of, b.all_of])("il0", ints()), lambda: rnd.choice([b.one_of, b.none_of, b.all_of])("sl0", words()),
        lambda: b.is_null(rnd.choice(["b0", "i1", "f0", "s1"]), rnd.random() < 0.5), lambda: b.is_empty(rnd.choice(["il0", "sl0"]), rnd.random() < 0.5), lambda: b.between("i1", rnd.randint(0, 5), rnd.randint(0, 5)),
    ])()


def random_event(rnd):
    own = {"b0": rnd.random() < 0.5, "b1": rnd.random() < 0.5, "i0": rnd.randint(0, 5), "i1": rnd.randint(0, 5), "f0": float("nan") if rnd.random() < 0.05 else rnd.randint(0, 4) / 2, "s0": rnd.choice(WORDS), "s1": rnd.choice(WORDS), "il0": sorted(rnd.sample(range(6), rnd.randint(0, 4))), "sl0": sorted(rnd.sample(WORDS, rnd.randint(0, 4)))}
    return {k: None if rnd.random() < 0.2 else v for k, v in own.items()}


def test_random_rules_print_and_normalize():
    rnd = random.Random(5)
    for _ in range(300):
        rule = random_rule(rnd)
        assert text(parse(GEN, text(rule))) == text(rule)
        try:
            normal = normalize(rule)
        except RuleError:
            continue
        assert normalize(normal) == normal
        for _ in range(20):
            event = random_event(rnd)
            assert evaluate(rule, event) is evaluate(normal, event), (text(rule), event)


def test_three_values():
    b = Builder(GEN)
    event = {"b0": True, "i0": 3, "s0": "alpha", "s1": "unknown-2", "sl0": ["alpha", "beta"]}
    u, t, f = b.eq("i1", 1), b.var("b0"), b.eq("i0", 0)
    table = [(b.and_(u, t), None), (b.and_(u, f), False), (b.or_(u, t), True), (b.or_(u, f), None), (b.not_(u), None), (b.xor(u, t), None), (b.xnor(u, f), None), (b.xor(t, f), True), (b.xnor(t, f), False), (b.is_null("i1"), True), (b.is_null("i1", True), False), (b.eq("s1", "unknown-2"), True), (b.all_of("sl0", ["alpha", "x"]), False), (b.none_of("sl0", ["x"]), True)]
    for rule, value in table:
        assert evaluate(rule, event) is value, text(rule)
    assert {type(x) for x in (And(()), Or(()), Not(()), Xor(()), Xnor(()))} and Leaf("a", "all_of", (1,)).negated().negated() == Leaf("a", "all_of", (1,))
