"""Document fingerprints by winnowing, in DataFrame operations only.

A text's lower-cased words are hashed: runs of up to LONGEST characters other than white space and control characters, and
each character of a script that sets no blanks on its own.  The hash of K consecutive words is a polynomial over their hashes
modulo a prime, built for all places at once by doubling (from 1 word to 2 to 4), which is the rolling hash without its
loop.  Of any WINDOW consecutive gram hashes the smallest is chosen, of equal ones the rightmost, again by doubling; the
chosen hashes with their word positions are the fingerprint.  Any WINDOW + K - 1 words that two texts share therefore give a
common hash.  A text of fewer than K words, but not none, is one gram; one of fewer grams than a window is one window.

Neighbours in doc_id order: a narrow table of ids and digests of texts is numbered, and number n is joined with n + 1, which
tells each row whose neighbour it is and how much of its text that one needs.  Texts are dealt once, by id and digest; what
moves further is the part of a text, and the hashes, that its neighbour needs.  Equal rows are one row with a count until
the end.  Only the count of rows in each partition of the narrow table reaches the driver.

Defined results: a null text counts as empty; an empty text has an empty fingerprint, like only to another empty one; rows
that repeat an id follow each other in order of their text's MD5, null ids come last; with one row, the next document is the
row itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

K = 4
WINDOW = 8
#: A longer run without a blank is cut into words of this length.
LONGEST = 32
#: Thai to Khmer and Chinese, Japanese characters: each is a word.
_ALONE = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}"
_WORDS = rf"[{_ALONE}]|[^\x00-\x20\x7f{_ALONE}]{{1,{LONGEST}}}"
PRIME = 2147483647
BASE = 1000003
_POS = 2147483647


def _shifted(a: Column, by: int, n: Column) -> tuple[Column, Column]:
    """The array without its last, and without its first, `by` elements; n: its size, over by."""
    return F.slice(a, 1, n - by), F.slice(a, 1 + by, n - by)


def add_fingerprint(df: DataFrame, text: Column, name: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds `name`: array of 64-bit numbers, each a chosen gram's hash times 2^31 plus 2^31 - 1 minus its word position.

    k and window are powers of 2.  Steps are columns of their own so that each array is computed once.
    """
    h, n = f"{name}_h", f"{name}_n"
    own = df.withColumn(h, F.transform(F.regexp_extract_all(F.lower(text), F.lit(_WORDS), F.lit(0)), lambda w: F.crc32(w) % PRIME))
    whole = F.array(F.aggregate(F.col(h), F.lit(0).cast("bigint"), lambda a, b: (a * BASE + b) % PRIME))
    own = own.withColumn(h, F.when(F.size(h).between(1, k - 1), whole).otherwise(F.col(h)))
    width, power = 1, BASE
    while width < k:
        own = own.withColumn(n, F.size(h))
        low, high = _shifted(F.col(h), width, F.col(n))
        mult = power
        own = own.withColumn(h, F.when(F.col(n) > width, F.zip_with(low, high, lambda a, b: (a * mult + b) % PRIME)).otherwise(F.col(h)))
        power, width = power * power % PRIME, width * 2
    own = own.withColumn(h, F.transform(h, lambda x, i: x * (_POS + 1) + (_POS - i)))
    width = 1
    while width < window:
        own = own.withColumn(n, F.size(h))
        low, high = _shifted(F.col(h), width, F.col(n))
        own = own.withColumn(h, F.when(F.col(n) > width, F.zip_with(low, high, lambda a, b: F.least(a, b))).when(F.col(n) > 1, F.array(F.array_min(h))).otherwise(F.col(h)))
        width *= 2
    return own.withColumn(name, F.array_distinct(h)).drop(h, n)


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 31).cast("int")))


def positions(fingerprint: Column) -> Column:
    """Pairs of word position and gram hash, by position."""
    return F.transform(fingerprint, lambda x: F.struct((_POS - x.bitwiseAND(F.lit(_POS))).alias("position"), F.shiftright(x, 31).alias("hash")))


def likeness(a: Column, b: Column) -> Column:
    """Common hashes over all hashes of two texts; a and b: distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def digest(fingerprint: Column) -> Column:
    return F.sha2(F.array_join(fingerprint.cast("array<string>"), ","), 256)


def winnow(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fingerprint: array of (position, hash)."""
    return add_fingerprint(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("__rs_text")), F.col("__rs_text"), "__rs_fp").select("doc_id", positions(F.col("__rs_fp")).alias("fingerprint"))


def followed(narrow: DataFrame) -> tuple[DataFrame, int]:
    """For each row key, tag whose neighbour it is: to_key, to_tag and what that one needs of it; and the most copies of a row.

    narrow: key, tag, need, copies; the order is key descending, then tag.  After the last row the first follows.
    """
    rows, total = numbered(narrow, [F.col("key").desc(), F.col("tag")])
    most = rows.agg(F.max("copies")).first()[0] or 1
    own = rows.select(F.col("__rs_row").alias("row"), "key", "tag")
    before = rows.select(((F.col("__rs_row") + 1) % max(total, 1)).alias("row"), F.col("key").alias("to_key"), F.col("tag").alias("to_tag"), "need")
    return own.join(before, "row").drop("row"), most


def query(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.concat(F.when(F.col("doc_id").isNull(), "~").otherwise(""), F.md5(text.cast("binary"))).alias("tag"))
    own = own.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    third = F.floor(F.length("text") / 3).cast("int")
    narrow = own.groupBy("key", "tag").agg(F.count("*").alias("copies"), F.min(third).alias("need"))
    links, most = followed(narrow)
    if most > 1:  # only then, as it sorts all texts once more
        own = own.groupBy("key", "tag").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    else:
        own = own.withColumn("copies", F.lit(1).cast("bigint"))
    rows = add_fingerprint(own, F.col("text"), "fp").select("key", "tag", "doc_id", "text", "copies", digest(F.col("fp")).alias("fingerprint"), hashes(F.col("fp")).alias("a"))
    # the condition never holds; with it both uses of rows read the same columns, so texts are dealt, and hashed, once for both
    head = F.expr("if(length(fingerprint) + copies < 0, cast(doc_id as string), substring(text, 1, need))")
    heads = rows.join(links, ["key", "tag"]).select(F.col("to_key").alias("key"), F.col("to_tag").alias("tag"), head.alias("head"), F.col("a").alias("c"))
    near = rows.join(heads, ["key", "tag"])
    # of equal rows all but the last are followed by themselves
    after = F.struct(F.col("head"), F.col("c"), F.lit(1).cast("bigint").alias("copies"))
    itself = F.struct(F.expr("substring(text, 1, cast(floor(length(text) / 3) as int))").alias("head"), F.col("a").alias("c"), (F.col("copies") - 1).alias("copies"))
    near = near.withColumn("after", F.explode(F.when(F.col("copies") > 1, F.array(after, itself)).otherwise(F.array(after)))) if most > 1 else near.withColumn("after", after)
    near = near.withColumn("n_chars", F.length("text").cast("bigint"))
    near = near.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 3) as int)), after.head)"))
    near = add_fingerprint(near, F.col("edited"), "efp")
    out = near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", digest(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("a"), hashes(F.col("efp"))).alias("near_edited"), likeness(F.col("a"), F.col("after.c")).alias("near_next"), F.col("after.copies").alias("copies"),
    )
    return (out.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))) if most > 1 else out).drop("copies")


def sql() -> str:
    """The same rows with window functions over words, for K = 4 and WINDOW = 8."""
    return rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS tab),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, ''))) AS id FROM documents),
n AS (SELECT d.*, e.text AS after, e.id AS after_id, length(d.text) AS n_chars FROM d JOIN d e ON e.id = CASE WHEN d.id = (SELECT max(id) FROM d) THEN 1 ELSE d.id + 1 END),
x AS (SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(after, 1, n_chars // 3) AS edited FROM n),
t AS (SELECT id, 0 AS k, text FROM x UNION ALL SELECT id, 1, edited FROM x),
w AS (SELECT id, k, i - 1 AS i, w[i] AS w, len(w) AS m FROM (SELECT id, k, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT id, k, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM t))),
h AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda y: CAST('0x' || y AS BIGINT))), lambda a, b: xor(a // 256, tab[xor(a, b) % 256 + 1])), 4294967295) % {PRIME} AS h
  FROM (SELECT DISTINCT w FROM w), crc),
l AS (SELECT id, k, i, m, h.h AS a, lead(h.h, 1) OVER o AS b, lead(h.h, 2) OVER o AS c, lead(h.h, 3) OVER o AS e FROM w JOIN h ON h.w = w.w WINDOW o AS (PARTITION BY id, k ORDER BY i)),
g AS (SELECT id, k, i, greatest(m - 3, 1) AS m, CASE
    WHEN m = 1 THEN a WHEN m = 2 THEN (a * {BASE} + b) % {PRIME} WHEN m = 3 THEN ((a * {BASE} + b) % {PRIME} * {BASE} + c) % {PRIME}
    ELSE (((a * {BASE} + b) % {PRIME} * {BASE} + c) % {PRIME} * {BASE} + e) % {PRIME} END AS g FROM l WHERE i < greatest(m - 3, 1)),
v AS (SELECT id, k, i, m, min(g * {_POS + 1} + {_POS} - i) OVER (PARTITION BY id, k ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS v FROM g),
f AS (SELECT DISTINCT id, k, v FROM v WHERE i <= greatest(m - 8, 0)),
p AS (SELECT id, k, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v % {_POS + 1} DESC) AS p FROM f GROUP BY ALL),
s AS (SELECT DISTINCT id, k, v // {_POS + 1} AS h FROM f),
z AS (SELECT id, k, count(*) AS n FROM s GROUP BY ALL),
ea AS (SELECT a.id, count(*) AS n FROM s a JOIN s b ON a.id = b.id AND a.h = b.h WHERE a.k = 0 AND b.k = 1 GROUP BY a.id),
na AS (SELECT x.id, count(*) AS n FROM x JOIN s a ON a.id = x.id AND a.k = 0 JOIN s b ON b.id = x.after_id AND b.k = 0 AND b.h = a.h GROUP BY x.id),
r AS (SELECT x.*, coalesce(z0.n, 0) AS s0, coalesce(z1.n, 0) AS s1, coalesce(z2.n, 0) AS s2, coalesce(ea.n, 0) AS e, coalesce(na.n, 0) AS nx, p0.p AS p0, p1.p AS p1 FROM x
  LEFT JOIN z z0 ON z0.id = x.id AND z0.k = 0 LEFT JOIN z z1 ON z1.id = x.id AND z1.k = 1 LEFT JOIN z z2 ON z2.id = x.after_id AND z2.k = 0
  LEFT JOIN ea ON ea.id = x.id LEFT JOIN na ON na.id = x.id LEFT JOIN p p0 ON p0.id = x.id AND p0.k = 0 LEFT JOIN p p1 ON p1.id = x.id AND p1.k = 1)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, sha256(coalesce(p0, '')) AS fingerprint, sha256(coalesce(p1, '')) AS edited_fingerprint,
  CASE WHEN s0 = 0 AND s1 = 0 THEN 1.0::DOUBLE ELSE e / greatest(s0 + s1 - e, 1) END AS near_edited, CASE WHEN s0 = 0 AND s2 = 0 THEN 1.0::DOUBLE ELSE nx / greatest(s0 + s2 - nx, 1) END AS near_next
FROM r
"""
