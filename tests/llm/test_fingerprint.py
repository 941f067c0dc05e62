import hashlib
import random
import re
import zlib

import pytest

from rulesieve.llm import fingerprint as fp

P = fp.PRIME


def _brute(text, k=fp.K, w=fp.WINDOW):
    """(position, hash) of the chosen grams in order of choice."""
    alone = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
    words = re.findall(rf"[{alone}]|[^\x00-\x20\x7f{alone}]{{1,32}}", text.lower())
    h = [zlib.crc32(x.encode()) % P for x in words]

    def poly(xs):
        out = 0
        for x in xs:
            out = (out * fp.BASE + x) % P
        return out

    grams = [poly(h[i : i + k]) for i in range(len(h) - k + 1)] if len(h) >= k else [poly(h)] if h else []
    chosen = []
    for i in range(max(1, len(grams) - w + 1)) if grams else []:
        win = list(enumerate(grams[i : i + w], i))
        pick = min(win, key=lambda x: (x[1], -x[0]))
        if pick not in chosen:
            chosen.append(pick)
    return chosen


def _likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return 1.0 if not a and not b else len(a & b) / max(1, len(a | b))


def _rows():
    rnd = random.Random(8)
    pool = ["the", "of", "Ünï", "🙂x", "a", "zz", "q" * 30]
    text = lambda n: rnd.choice([" ", "\n", "  "]).join(rnd.choice(pool) for _ in range(n))
    rows = [(i * 3, text(rnd.choice([0, 1, 2, 3, 4, 5, 9, 11, 12, 40, 200]))) for i in range(80)]
    return rows + [(500, None), (501, ""), (502, "  \n"), (503, "same same " * 60), (504, "same same " * 60), (505, "w " * 20000), (-5, "a b c d e f g h i j k l m")]


def test_chosen_grams(docs):
    rows = _rows()
    got = {r["doc_id"]: [(x["position"], x["hash"]) for x in r["fingerprint"]] for r in fp.winnow(docs(rows)).collect()}
    for doc, text in rows:
        assert got[doc] == _brute(text or ""), doc


def test_query(docs):
    rows = _rows()
    got = {r["doc_id"]: r for r in fp.query(docs(rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), doc
        a, b, c = _brute(text), _brute(edited), _brute(after)
        assert abs(r["near_edited"] - _likeness(a, b)) < 1e-12 and abs(r["near_next"] - _likeness(a, c)) < 1e-12
    assert got[503]["fingerprint"] == got[504]["fingerprint"] != got[505]["fingerprint"]


def test_match_guarantee():
    rnd = random.Random(1)
    common = [f"c{i}" for i in range(fp.WINDOW + fp.K - 1)]
    for _ in range(50):
        a, b = ([f"{s}{rnd.random()}" for _ in range(rnd.randint(0, 30))] for s in "ab")
        one, two = _brute(" ".join(a + common + b)), _brute(" ".join(b + common + a[:3]))
        assert {h for _, h in one} & {h for _, h in two}


def test_few_empty_and_repeated_rows(docs):
    assert fp.query(docs([])).collect() == []
    (one,) = fp.query(docs([(1, "a b c d e f")])).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b c d a b").hexdigest() and one["n_chars"] == 11
    rows = [(1, "x y z w v"), (1, "x y z w v"), (2, "p q"), (None, "n n n"), (None, None)]
    assert sorted(str(r["doc_id"]) for r in fp.query(docs(rows)).collect()) == ["1", "1", "2", "None", "None"]


def _query_brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        a, b, c = _brute(text), _brute(edited), _brute(after)
        out.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest(), round(_likeness(a, b), 9), round(_likeness(a, c), 9)))
    return sorted(out)


def test_one_id_for_a_third_of_the_rows_and_equal_rows(docs, words):
    rows = [(None if i % 3 == 0 else i, " ".join(words(20 + i % 7, i % 11))) for i in range(90)] + [(7, "q r s t u v")] * 40 + [(None, None)] * 5 + [(-(1 << 63), "q r s t u v"), (-(1 << 63), None)]
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fp.query(docs(rows)).collect()]
    assert sorted(got) == _query_brute(rows)


def test_long_texts_of_distinct_words_and_without_blanks(docs):
    rnd = random.Random(5)
    chinese = "".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(3000))
    unbroken = "".join(rnd.choice("abcdefgh") for _ in range(30_000))
    rows = [(1, " ".join(f"w{rnd.random()}" for _ in range(60_000))), (2, chinese), (3, "一" + chinese), (4, unbroken)]
    out = {r["doc_id"]: r for r in fp.query(docs(rows)).collect()}
    assert _query_brute(rows) == sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out.values())
    assert out[3]["near_next"] > 0.9 and all(r["near_edited"] > 0.1 for r in out.values())


def test_sql_gives_the_same(spark, docs, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs([r for r in _rows() if r[0] != 505] + [(None, "n n n"), (6, "again")]).select("doc_id", "text").write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = sorted(map(str, map(tuple, fp.query(spark.read.parquet(f"{tmp_path}/d")).collect())))
    assert got == sorted(map(str, con.execute(fp.sql()).fetchall()))
