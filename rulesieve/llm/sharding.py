"""Reproducible shuffled shards: a Feistel permutation over global row numbers.

Rows get gapless numbers 0 to N-1 in the order of their ids (ties by checksum and size).  A mixed-radix Feistel network
over [0, a*b), a*b >= N, permutes them; a value outside [0, N) is sent through it again until it falls inside (cycle
walking).  The permuted number p gives shard p mod S and slot p div S, so shards' row counts differ by one at most, slots
are gapless, and place() and row_at() compute either direction without any table.

Numbering: the ids are dealt by range and sorted inside partitions; that narrow table is checkpointed, so numbers
survive lost executors; a row's number is its place inside its partition plus the rows of the partitions before it.
Only one count a partition reaches the driver.

Defined results: a null text counts as no bytes, size 8 and checksum 0; null ids come first; rows that are equal in
all they show share their numbers in any order, which the result cannot tell; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import importable
from .common import numbered

ROUNDS = 6
KEY = 0x5EED_0009
SHARDS = 24
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    z = x.astype(np.uint64) + np.uint64(k)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _round_keys(key: int) -> list[int]:
    return [int(_mixed(np.array([key], np.uint64), (0x9E3779B97F4A7C15 * (i + 1)) & int(_M))[0]) for i in range(ROUNDS)]


def _radices(n: int) -> tuple[int, int]:
    a = max(1, int(np.ceil(np.sqrt(n))))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def _network(x: np.ndarray, n: int, key: int, back: bool) -> np.ndarray:
    a, b = _radices(n)
    left, right = x // b, x % b
    for i, k in sorted(enumerate(_round_keys(key)), reverse=back):
        if i % 2:
            move = (_mixed(left, k) % np.uint64(b)).astype(np.int64)
            right = (right - move if back else right + move) % b
        else:
            move = (_mixed(right, k) % np.uint64(a)).astype(np.int64)
            left = (left - move if back else left + move) % a
    return left * b + right


def permuted(rows: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The permutation of [0, n), or its inverse; only values inside may be given."""
    out = _network(np.asarray(rows, np.int64), n, key, back) if n else np.asarray(rows, np.int64)
    while (outside := out >= n).any():
        out[outside] = _network(out[outside], n, key, back)
    return out


def place(row: int, n: int, shards: int = SHARDS, key: int = KEY) -> tuple[int, int]:
    p = int(permuted(np.array([row]), n, key)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, key: int = KEY) -> int:
    return int(permuted(np.array([slot * shards + shard]), n, key, back=True)[0])


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, row, shard and slot of every document."""
    importable(docs.sparkSession)
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8).alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint").alias("text_crc32"))
    rows, n = numbered(narrow, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("bigint")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permuted(row.to_numpy(np.int64).copy(), n, key))

    p = rows.withColumn("__rs_p", position("__rs_row"))
    return p.select("doc_id", "size", "text_crc32", F.col("__rs_row").alias("row"), (F.col("__rs_p") % shards).cast("int").alias("shard"), F.floor(F.col("__rs_p") / shards).cast("bigint").alias("slot"))


def query(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("row").alias("row_number"))


def sql(shards: int = SHARDS, key: int = KEY) -> str:
    """The same rows: CRC-32 by its table, and the network's rounds as steps of a recursion that ends inside [0, N)."""
    keys = ", ".join(f"CAST({k} AS UBIGINT)" for k in _round_keys(key))
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS tab),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a // 256, tab[xor(a, b) % 256 + 1])), 4294967295) END AS text_crc32
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents), crc),
n AS (SELECT d.*, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM d),
c AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b, [{keys}] AS keys FROM (SELECT count(*) AS n, greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS a FROM n)),
w AS (
  SELECT row_number, row_number // b AS l, row_number % b AS r, 0 AS i FROM n, c
  UNION ALL
  SELECT row_number, CASE WHEN i % 2 = 0 THEN (l + CAST(xor(z3, z3 >> 31) % a AS BIGINT)) % a ELSE l END, CASE WHEN i % 2 = 1 THEN (r + CAST(xor(z3, z3 >> 31) % b AS BIGINT)) % b ELSE r END, i + 1
  FROM (SELECT *, CAST(CAST(xor(z2, z2 >> 27) AS UHUGEINT) * CAST({0x94D049BB133111EB} AS UHUGEINT) % CAST({1 << 64} AS UHUGEINT) AS UBIGINT) AS z3
    FROM (SELECT *, CAST(CAST(xor(z1, z1 >> 30) AS UHUGEINT) * CAST({0xBF58476D1CE4E5B9} AS UHUGEINT) % CAST({1 << 64} AS UHUGEINT) AS UBIGINT) AS z2
      FROM (SELECT w.*, a, b, CAST((CAST(CASE WHEN i % 2 = 0 THEN r ELSE l END AS UHUGEINT) + CAST(keys[i % {ROUNDS} + 1] AS UHUGEINT)) % CAST({1 << 64} AS UHUGEINT) AS UBIGINT) AS z1
        FROM w, c WHERE NOT (i > 0 AND i % {ROUNDS} = 0 AND l * b + r < c.n))))),
p AS (SELECT row_number, l * b + r AS p FROM w, c WHERE i > 0 AND i % {ROUNDS} = 0 AND l * b + r < c.n)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, CAST(p // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(row_number AS BIGINT) AS row_number
FROM n JOIN p USING (row_number)
"""
