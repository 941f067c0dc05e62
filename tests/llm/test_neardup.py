import hashlib
import random

import numpy as np

from rulesieve.llm import neardup


def _sets(text, k):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    w = [x for x in w if x]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def _brute(rows, k, percent=80):
    sets = [_sets(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), low[root(i)]) for i, (doc, _) in enumerate(rows))


def _rows(words):
    rnd = random.Random(3)
    rows, base = [], [words(n, 100 + n) for n in (2, 5, 12, 30, 60, 120)]
    for i in range(140):
        own = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            own[rnd.randrange(len(own))] = rnd.choice(["new", "other", f"w{i}"])
        rows.append((i * 2 + 1, rnd.choice([" ", "\n", "\t\t "]).join(own)))
    return rows + [(1000, None), (1002, ""), (1003, " \n"), (1004, "One"), (1005, "one"), (1006, "One two"), (1007, "É x y"), (1008, "é x y"), (1009, "z " * 9000)]


def test_components_are_those_of_brute_force(docs, words):
    rows = _rows(words)
    for k in (2, 5):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.groups(docs(rows), k).collect())
        assert got == _brute(rows, k)


def test_a_group_beyond_one_block(docs, words, monkeypatch):
    """Many texts that share half of their words, in blocks of four: all links are found, none too many."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    half, rnd = words(60, 1), random.Random(2)
    rows = [(i, " ".join(half + words(rnd.choice([5, 9, 12]), i % 40) + [f"x{i % 3}"])) for i in range(120)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.groups(docs(rows), 2).collect())
    assert got == _brute(rows, 2)


def test_query_repeats_and_nulls(docs, words):
    text = " ".join(words(50, 1))
    got = neardup.query(docs([(5, text), (3, text), (3, text), (None, text), (None, "solo text"), (9, "solo")])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("3", "3", True), ("3", "3", True), ("5", "3", False), ("9", "9", True), ("None", "3", False), ("None", "None", False)]
    assert neardup.query(docs([])).collect() == []
    assert [(r["n_shingles"], r["component_id"]) for r in neardup.query(docs([(1, None)])).collect()] == [(0, 1)]


def test_stage_keeps_one_of_each_group(docs, words):
    a, b = " ".join(words(60, 1)), " ".join(words(60, 2))
    rows = docs([(4, a), (2, a + " more"), (7, b), (8, None), (9, None), (None, b)])
    kept = neardup.stage(rows)
    assert kept.columns == rows.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "7", "8", "9"]


def test_stage_with_null_and_repeated_ids(docs, words):
    a, b, c = (" ".join(words(60, n)) for n in (1, 2, 3))
    rows = docs([(None, a), (None, a), (None, a + " more"), (3, b), (3, c), (2, c), (5, b), (5, b), (7, None), (7, None), (None, ""), (3, b)])
    kept = neardup.stage(rows)
    assert kept.columns == rows.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("2", c), ("3", b), ("7", ""), ("7", ""), ("None", "")] + [("None", r) for r in {a, a + " more"} if sorted([a, a + " more"], key=lambda t: hashlib.md5(t.encode()).hexdigest())[0] == r])
    assert neardup.stage(docs([])).collect() == []


def test_exactly_at_the_threshold(docs):
    """Pairs at 0.8 and just below: 400 pairs of one similarity each, with the estimate and without."""
    rows, rnd = [], random.Random(6)
    for i in range(200):
        pool = [f"p{i}x{j}" for j in range(60)]
        rnd.shuffle(pool)
        # two-word shingles of texts that share a prefix: n of n + 2 k are common
        rows += [(4 * i, " ".join(pool[:41])), (4 * i + 1, " ".join(pool[:37] + [f"y{i}{j}" for j in range(4)])), (4 * i + 2, f"z{i} " * 3 + " ".join(pool[:41][::-1]))]
    sets = {d: _sets(t, 2) for d, t in rows}
    near = [100 * len(sets[4 * i] & sets[4 * i + 1]) / len(sets[4 * i] | sets[4 * i + 1]) for i in range(200)]
    assert all(80 <= x < 82 for x in near)
    want = _brute(rows, 2)
    for agree in (neardup.AGREE, 0):
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.groups(docs(rows), 2, agree=agree).collect()) == want


def test_a_bucket_beyond_the_real_block_and_a_long_text(docs, words):
    """700 texts of one half, of which many link, and a text of 120,000 distinct shingles with its copy."""
    half, rnd = words(300, 1), random.Random(2)
    rows = [(i, " ".join(half + words(rnd.choice([20, 40, 300]), 50 + i % 60) + [f"x{i % 3}"])) for i in range(700)]
    long = [f"n{i}" for i in range(120_000)]
    rows += [(2000, " ".join(long)), (2001, " ".join(long[:-9] + ["end"]))]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.groups(docs(rows), 2).collect())
    assert got == _brute(rows, 2)


def test_components_of_chains(spark, tmp_path):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)] + [(200, x) for x in range(201, 240)]
    got = dict(neardup.components(spark.createDataFrame(links, "a bigint, b bigint"), tmp_path.as_uri(), "c").collect())
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100 and all(got[i] == 200 for i in range(201, 240))
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint"), tmp_path.as_uri(), "d").collect() == []


def test_links_are_written_in_few_files(spark, docs, words, monkeypatch):
    """Also where partitions aren't coalesced: each file costs a task up to three processes."""
    rows, files, plain = _rows(words), {}, neardup.stored

    def stored(df, folder, name):
        out = plain(df, folder, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(neardup, "stored", stored)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.groups(docs(rows), 2).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == _brute(rows, 2)
    steps = {n: f for n, f in files.items() if n.rsplit("_", 1)[0] in ("first", "second", "all") and not n.endswith("_0")}
    assert steps and max(steps.values()) <= spark.sparkContext.defaultParallelism and not any(n.startswith("links") for n in files)


def test_tables_meet_and_estimate():
    rng, multipliers, met = np.random.default_rng(1), neardup._multipliers(), 0
    for _ in range(60):
        both = rng.integers(0, 1 << 63, 160, np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, 20, np.uint64)]) for _ in range(2))  # similarity 0.8
        h = np.stack([neardup.minhashes(x, multipliers) for x in (a, b)])
        assert abs((h[0] == h[1]).mean() - 0.8) < 0.2
        met += bool((neardup.left_keys(h)[0] == neardup.left_keys(h)[1]).any() and neardup.alike(*neardup.right_bytes(h)[:, None])[0])
    assert met == 60
