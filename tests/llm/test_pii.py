import hashlib
import random
import re
import time

import pytest

from rulesieve.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def _brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            own, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and not all(int(x) <= 255 for x in own.split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and _luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def _texts():
    rnd = random.Random(9)
    pool = ["a", "Z", "9", "0", "1", "4", "5", "@", ".", ".", "-", " ", "%", "+", "(", ")", "é", "🙂", "\n", "4111 1111 1111 1111", "255.0.1.2", "x@y.zz", "+1 (555) 123-4567", "_"]
    noise = ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    digits = ["".join(rnd.choice("0123456789- ") for _ in range(rnd.randint(10, 60))) for _ in range(500)]
    fixed = ["", "a@b.c%d@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "001.002.0003.255", "1.2.3.256", "1.2.3.99999999999999999999", "4111111111111111", "4111-1111-1111-1111 4111 1111 1111 1111", "+1234567890", "++12345678901", "+1 234 567 890 ", "x" * 20000, "1" * 20000, "a@" * 5000, "1." * 5000, "+1" * 3000, "4111111111111111 x " * 700]
    return fixed + noise + digits


def test_base_spans_are_those_of_the_plain_patterns(docs):
    texts = _texts()
    got = {r["doc_id"]: r for r in pii.query(docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        want = _brute(text)
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(k == s[0] for s in want) for k in PLAIN], text[:100]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest(), (text[:100], told, got[i]["spans"])
        assert [s for s in got[i]["spans"].split(",") if s.split(":")[0] in PLAIN] == [s for s in told.split(",") if s] or not told


def test_further_kinds_need_a_checksum_or_context(docs):
    rows = [(1, "IBAN: GB82 WEST 1234 5698 7654 32."), (2, "GB82 WEST 1234 5698 7654 33"), (3, "my SSN 123-45-6789"), (4, "part 123-45-6789"), (5, "DE89370400440532013000")]
    got = {r["doc_id"]: r["spans"] for r in pii.query(docs(rows)).collect()}
    assert got[1] == "iban:6:33" and got[2] == "" and got[3] == "ssn:7:18" and got[4] == "" and got[5] == "iban:0:22"
    texts = ["card 4111111111111111", "4111111111111111", "4111111111111111 is my visa", "an example: 4111111111111111", "mail a@b.c", "an example is GB82 WEST 1234 5698 7654 32", "an example bank account is GB82 WEST 1234 5698 7654 32"]
    scores = {r["doc_id"]: r["scores"] for r in pii.query(docs(list(enumerate(texts)))).collect()}
    assert [scores[i] for i in range(len(texts))] == ["100", "90", "100", "60", "70", "", "90"]


def test_secrets_need_entropy_and_context(docs):
    hexed = hashlib.sha1(b"x").hexdigest()
    texts = [f'token = "{hexed}"', f"{hexed} is the API_KEY", hexed, "token = " + "ab1" * 9, "secret: aaaabbbb" + "1" * 30, "my key " + "x" * 19 + "1", "token " + "k3" * 65, f"password={hexed[:20]}, user"]
    got = {r["doc_id"]: r["spans"] for r in pii.query(docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == ["secret:9:49", "secret:0:40", "", "", "", "", "", "secret:9:29"]
    out = {r["doc_id"]: r["text"] for r in pii.stage(docs(list(enumerate(texts)))).collect()}
    assert out[0] == 'token = "[secret]"' and out[2] == hexed


def _redacted(text, spans):
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_redaction_is_that_of_the_spans(docs):
    texts = _texts()
    rows = docs(list(enumerate(texts)))
    spans = {r["doc_id"]: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)] for r in pii.query(rows).collect()}
    got = {r["doc_id"]: r["text"] for r in pii.stage(rows).collect()}
    for i, text in enumerate(texts):
        assert got[i] == _redacted(text, spans[i]), text[:100]


def test_many_spans_in_one_text_take_time_in_proportion(docs):
    """A text of 384,000 characters with 32,000 spans; quadratic work would take minutes."""
    text = "ab@cd.ef 12 " * 32_000
    start = time.perf_counter()
    (row,) = pii.query(docs([(1, text)])).collect()
    assert row["n_email"] == 32_000 and row["spans"].startswith("email:0:8,email:12:20") and row["spans"].endswith("email:383988:383996")
    (row,) = pii.stage(docs([(1, text)])).collect()
    assert row["text"] == "[email] 12 " * 32_000
    assert time.perf_counter() - start < 40


def test_nulls_empty_tables_and_stage(docs):
    assert pii.query(docs([])).collect() == []
    rows = docs([(1, None), (None, "a@b.cc"), (2, "call +1 555 123 4567 or a@b.cc!"), (2, "call +1 555 123 4567 or a@b.cc!"), (3, "clean text")])
    assert [r["spans"] for r in pii.query(rows.where("doc_id = 1")).collect()] == [""]
    out = pii.stage(rows)
    assert out.columns == rows.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == [("1", None), ("2", "call [phone] or [email]!"), ("2", "call [phone] or [email]!"), ("3", "clean text"), ("None", "[email]")]


def test_sql_gives_the_same(spark, docs, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [t for t in _texts() if len(t) < 2000] + ["GB82 WEST 1234 5698 7654 32", "my SSN 123-45-6789 and ssn 000-12-3456", "DE89370400440532013000 DE89370400440532013000", "x BE68 5390 0754 7034 BIC KREDBEBB", f"é token: {hashlib.sha1(b'y').hexdigest()} fake", f"🙂 token: {hashlib.sha1(b'y').hexdigest()}", "Key " + "q7" * 40, None]
    docs(list(enumerate(texts))).select("doc_id", "text").write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = sorted(map(tuple, pii.query(spark.read.parquet(f"{tmp_path}/d")).collect()))
    assert got == sorted(con.execute(pii.sql()).fetchall())


def test_what_follows_an_iban_is_not_taken_into_it(docs):
    rows = [
        ("IBAN: BE68 5390 0754 7034 BIC KREDBEBB", "iban:6:25"),
        ("ES9121000418450200051332 EUR 500", "iban:0:24"),
        ("AT61 1904 3002 3457 3201 SWIFT", "iban:0:24"),
        ("é🙂 PL61109010140000071219812874 BANK", "iban:3:31"),
        ("ES91 2100 0418 4502 0005 1332 ES91 2100 0418 4502 0005 1332 AND BE68 5390 0754 7034 1234", "iban:0:29,iban:30:59,iban:64:83"),
        ("AT12 3456 7890 ES91 2100 0418 4502 0005 1332 EUR", "iban:15:44"),
        ("BE68 5390 0754 7035 BIC KREDBEBB", ""),
        ("GB82 WEST 1234 5698 7654 32 OK DE89370400440532013000", "iban:0:27,iban:31:53"),
        ("xGB82 WEST 1234 5698 7654 32 _DE89370400440532013000 DE893704004405320130001", ""),
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.query(docs([(i, t) for i, (t, _) in enumerate(rows)])).collect()}
    assert [got[i] for i in range(len(rows))] == [x for _, x in rows]
    out = {r["doc_id"]: r["text"] for r in pii.stage(docs([(1, rows[0][0])])).collect()}
    assert out == {1: "IBAN: [iban] BIC KREDBEBB"}
