import random
import zlib

import numpy as np

from rulesieve.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ö"], "cc": ["el", "os", "ción", "ña"]}


def _text(lang, rnd, n=30):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def _rows(n=240):
    rnd = random.Random(4)
    return [(i, _text(lang, rnd, rnd.randint(3, 40)), lang) for i, lang in enumerate(rnd.choice(list(SYLLABLES)) for _ in range(n))]


def test_held_out_accuracy(docs):
    rows = _rows() + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !?", "bb"), (1003, "ka lo", None), (None, "ka lo mi", "aa"), (1003, "ka lo", None), (1004, "中文", None), (1005, "ka lo mi " * 20000, "aa")]
    got = langid.query(docs(rows)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    usual = [r for r in held if r["doc_id"] < 1000]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in usual]) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and by[1000]["score"] == 0
    assert by[1003]["lang_pred"] == by[1005]["lang_pred"] == by[None]["lang_pred"] == "aa" and by[1004]["lang_pred"] in SYLLABLES
    assert all(0 <= r["score"] <= 1 for r in got)


def test_vectors_bind_and_bundle():
    a, b, c = 3, 7, 11
    code = np.array([a << 14 | b << 7 | c])
    own = langid.letters()
    assert (langid.bound(code)[0] == np.roll(own[a], 2) * np.roll(own[b], 1) * own[c]).all()
    text, codes = langid.trigrams(["ab1c", None, "", "ö"])
    assert text.tolist() == [0, 0, 0, 3] and codes[2] == 3 << 7  # a gap, the letter, a gap
    model = langid.Profiles(["x"], np.ones((1, langid.DIM), np.float32))
    codes = np.array([5 << 7, 6 << 7 | 1], np.int32)
    assert np.allclose(model.vector(codes, np.array([2, 3])), langid.bundled(codes, np.array([2, 3])))


def test_learning_adds_up_over_partitions(docs):
    rows = docs(_rows(90))
    one, many = langid.learn(rows.coalesce(1)), langid.learn(rows.repartition(7))
    assert one[0] == many[0] == sorted(SYLLABLES) and np.array_equal(one[1], many[1])


def test_nothing_learned_empty_tables_and_stage(docs):
    assert langid.query(docs([])).collect() == []
    assert [r["lang_pred"] for r in langid.query(docs([(1, "abc", None)])).collect()] == ["und"]
    rows = docs(_rows(60) + [(100, "123", "aa"), (101, None, "aa")])
    kept = langid.stage(rows)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(60))


def test_stage_keeps_texts_where_nothing_could_be_learned(docs):
    rows = [(1, "abc", None), (2, "123", None), (3, None, None), (4, "", None), (None, "some é text", None), (5, "é", None)]
    kept = langid.stage(docs(rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "5", "None"]
    assert langid.stage(docs(rows), least=0.5).count() == 3 and langid.stage(docs([])).collect() == []


def test_stage_goes_by_the_prototypes(docs):
    rnd = random.Random(5)
    rows = _rows(120)
    strange = [(500 + i, " ".join("".join(rnd.choice("wxyzjqvåßþðæ") for _ in range(9)) for _ in range(40)), "aa") for i in range(5)]
    labelled = docs(rows + [(i, t, None) for i, t, _ in strange])
    assert sorted(r["doc_id"] for r in langid.stage(labelled).collect()) == list(range(120))
    only = langid.stage(labelled, wanted=("bb",)).collect()
    assert sorted(r["doc_id"] for r in only) == [i for i, _, lang in rows if lang == "bb"]


def _naive(rows, texts):
    """Prototypes and predictions by loops over letters."""
    own = langid.letters().astype(int)

    def vector(text):
        total, row = np.zeros(langid.DIM, int), [0]
        for char in (text or "").lower():
            c = langid.letter_class(ord(char))
            if c or row[-1]:
                row.append(c)
        row += [0] if row[-1] else []
        for a, b, c in zip(row, row[1:], row[2:]):
            if b:
                for k in range(langid.DIM):
                    total[k] += own[a][k - 2] * own[b][k - 1] * own[c][k]
        return total

    sums = {}
    for doc, text, lang in rows:
        if doc is not None and lang is not None and text is not None and zlib.crc32(str(doc).encode()) % 5:
            sums[lang] = sums.get(lang, 0) + vector(text)
    out = []
    for text in texts:
        v = vector(text)
        if not v.any():
            out.append(("und", 0.0))
            continue
        cos = {n: float(s @ v) / (np.linalg.norm(s) * np.linalg.norm(v)) for n, s in sums.items()}
        best = max(sorted(cos), key=lambda n: cos[n])
        out.append((best, max(0.0, cos[best])))
    return out


def test_query_is_that_of_loops_over_letters(docs, monkeypatch):
    rows = [(i, t[:60], lang) for i, t, lang in _rows(24)] + [(100, None, "aa"), (101, "12", "bb"), (102, "É ñ; Ka lo-ka", None), (103, "ka\n\nlo", "aa")]
    want = _naive(rows, [t for _, t, _ in rows])
    monkeypatch.setattr(langid, "HELD", 50)
    got = {r["doc_id"]: r for r in langid.query(docs(rows)).collect()}
    for (doc, _, _), (lang, score) in zip(rows, want, strict=True):
        assert got[doc]["lang_pred"] == lang and abs(got[doc]["score"] - score) < 1e-5, doc


def test_a_word_beyond_the_cut(docs):
    text = "ka lo " * 80_000 + "kalomitu" * 5000
    whole = {i: dict(zip(c.tolist(), n.tolist(), strict=True)) for i, c, n in langid.counted([text])}
    (of, code), found = langid.trigrams([text]), {}
    for x in code.tolist():
        found[x] = found.get(x, 0) + 1
    assert len(text) > langid.PIECE and whole == {0: found} and set(of.tolist()) == {0}


def test_learning_holds_a_bounded_number_of_trigrams(docs, monkeypatch):
    rows = docs(_rows(90))
    one = langid.learn(rows.coalesce(1))
    monkeypatch.setattr(langid, "HELD", 10)
    monkeypatch.setattr(langid, "PIECE", 50)
    parts = list(langid._learn(iter(rows.select("text", "lang").toArrow().to_batches(max_chunksize=7))))
    assert np.array_equal(one[1], np.array([p.column(2).to_numpy() / np.linalg.norm(p.column(2).to_numpy()) for p in sorted(parts, key=lambda p: p.column(0)[0].as_py())], np.float32))


def test_pieces_change_no_count(monkeypatch):
    rnd = random.Random(6)
    texts = [_text(rnd.choice(list(SYLLABLES)), rnd, rnd.choice([0, 1, 5, 40])) + rnd.choice(["", " 1!", "\n"]) for _ in range(60)] + [None, "", "ka lo " * 200, "x", "kalo" * 100, "ΑΣ ΣΑΣ" * 60, "1" * 500 + "é", "é" + "1" * 89 + "ñ"]
    whole = {i: dict(zip(c.tolist(), n.tolist(), strict=True)) for i, c, n in langid.counted(texts)}
    monkeypatch.setattr(langid, "PIECE", 90)
    parts = {i: dict(zip(c.tolist(), n.tolist(), strict=True)) for i, c, n in langid.counted(texts)}
    assert parts == whole and sum(map(len, whole.values())) > 100
