import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rulesieve.llm import sharding


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**63 - 1))
def test_a_permutation_that_can_be_undone(n, key):
    rows = np.arange(n)
    out = sharding.permuted(rows.copy(), n, key)
    assert sorted(out.tolist()) == rows.tolist()
    assert (sharding.permuted(out.copy(), n, key, back=True) == rows).all()


def test_it_shuffles():
    out = sharding.permuted(np.arange(10_000), 10_000)
    assert abs(np.corrcoef(np.arange(10_000), out)[0, 1]) < 0.05
    assert np.abs(np.bincount(out[:1000] // 1000, minlength=10) - 100).max() < 50


def test_place_and_row():
    for row in (0, 5, 999):
        shard, slot = sharding.place(row, 1000)
        assert sharding.row_at(shard, slot, 1000) == row


def test_query(docs):
    rows = [(i * 7, f"téxt {i}" * (i % 5)) for i in range(500)] + [(3, None), (4, ""), (None, "n"), (7, "téxt 1"), (7, "téxt 1")]
    got = sharding.query(docs(rows)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = np.bincount([r["shard"] for r in got], minlength=24)
    assert counts.max() - counts.min() <= 1 and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]), r["row_number"]) for r in got)
    assert [n for _, n in order] == list(range(len(got)))
    for r in got:
        assert sharding.place(r["row_number"], len(got)) == (r["shard"], r["slot"])
    again = sharding.query(docs(rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.query(docs([])).collect() == []


def test_few_rows(docs):
    assert sorted((r["shard"], r["slot"]) for r in sharding.query(docs([(1, "a"), (2, "b")])).collect()) == sorted(sharding.place(row, 2) for row in (0, 1))
    (one,) = sharding.query(docs([(1, "é" * 2_000_000)])).collect()
    assert (one["size"], one["text_crc32"], one["shard"], one["slot"]) == (4_000_008, zlib.crc32("é".encode() * 2_000_000), 0, 0)


def test_sql_gives_the_same(spark, docs, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i * 7 - 50, f"téxt {i}" * (i % 5)) for i in range(150)] + [(3, None), (4, ""), (None, "n"), (7, "téxt 1"), (7, "téxt 1"), (9, "\x00é\U0010ffff")]
    docs(rows).select("doc_id", "text").write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(map(str, map(tuple, sharding.query(spark.read.parquet(f"{tmp_path}/d")).collect()))) == sorted(map(str, con.execute(sharding.sql()).fetchall()))
