"""Personal data: regular expressions propose, checksums confirm, nearby words move the score.  DataFrame operations only.

Base kinds (email, ip, card, phone) are reported whenever they pass their rule.  Three further kinds are reported if their
score reaches LEAST: iban (the length of its country, mod-97), ssn (three, two and four digits) and secret (a run of 20 to
128 characters of keys and tokens, with letters, digits and an entropy of at least ENTROPY bits a character).

A score, 0 to 100, is 40 for the form, what CHECKED gives for a test that holds, 30 more for a word of the kind within NEAR
characters before or after the span, and 30 less for a word that says that the value is made up.  Base spans carry one too.

Offsets: split() on a pattern gives what stands between the matches that regexp_extract_all() gives, so running sums of
their lengths are the matches' places in code points.  Sums run over chunks of SCAN elements, so that no array is copied for
each of its elements.  What stands near a span, and between spans, is taken from the text cut into pieces of CUT characters:
nothing is looked up from the start of the text, and the work grows in proportion to text and matches.  Patterns use
possessive repeats and look behind, so that a long run of one kind of character is not tried from each of its places; they
match what the plain forms match.

Nothing is shuffled.  Defined results: a null text counts as empty and has no span; repeated rows each get their result; an
empty table gives no rows; other columns are ignored (query) or kept (stage).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "secret")
KINDS = BASE + MORE
LEAST = 70
NEAR = 40
ENTROPY = 2.9
#: Elements of a scan's chunk, and code points of a piece of text.
SCAN, CUT = 64, 256
_LOCAL = "A-Za-z0-9._%+-"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word's bound among ASCII letters, digits and underscores, whatever the engine's own is.
_BOUND = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SN SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _of_length(n: int, countries: str) -> str:
    groups, rest = divmod(n - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}" + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else "")


_IBAN = "(?:" + "|".join(_of_length(n, c) for n, c in IBAN_LENGTHS.items()) + ")"
PATTERNS = {
    # a match may start inside a run of local characters only where the match before it ended
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of digits, single blanks or hyphens between them, of 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # group 1 is the IBAN; only its country is consumed, so another may begin within a wrong one
    "iban": rf"(?<!\w)(?=[A-Z]{{2}}[0-9]{{2}})(?=({_IBAN}(?!\w)))[A-Z]{{2}}",
    "ssn": r"(?<!\w)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w)",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,128}+(?![A-Za-z0-9+/_-])",
}
#: What the test of a kind's own adds to the score.
CHECKED = {"email": 30, "ip": 30, "card": 50, "phone": 30, "iban": 50, "ssn": 0, "secret": 0}
#: Words that make a kind likelier, and words that make any less likely.
CONTEXT = {
    "email": r"e-?mail|contact|write to|courriel|correo",
    "ip": r"\bip\b|address|server|host",
    "card": r"card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|fax",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|\bsocial\b",
    "secret": r"token|secret|passw|pwd|\bkey\b|[a-z]key\b|_key|credential|bearer|authorization",
}
DOUBT = r"\bexample\b|\bsample\b|dummy|placeholder|invalid|\bfake\b"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once also where use takes it in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(items: Column, first: Column, after: Callable[[Column, Column], Column], told: Callable[[Column, Column], Column], kind: str) -> Column:
    """told(state, item), of type kind, for each item in turn; the state starts as first and becomes after(state, item)."""
    none, parts = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    chunks = _let(items, lambda z: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(z) - 1, F.lit(0)) / SCAN).cast("int")), lambda c: F.slice(z, c * SCAN + 1, F.lit(SCAN))))

    def one(acc: Column, e: Column) -> Column:
        return F.struct(after(acc["at"], e).alias("at"), F.concat(acc["out"], F.array(told(acc["at"], e).cast(kind))).alias("out"))

    def step(acc: Column, chunk: Column) -> Column:  # a chunk's result is kept as it is and taken in with the next: it is computed once
        last = F.aggregate(chunk, F.struct(acc["last"]["at"].alias("at"), none.alias("out")), one)
        return F.struct(last.alias("last"), F.concat(acc["done"], F.array(acc["last"]["out"])).alias("done"))

    init = F.struct(F.struct(first.alias("at"), none.alias("out")).alias("last"), parts.alias("done"))
    return F.aggregate(chunks, init, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["last"]["out"]))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _luhn(x: Column) -> Column:
    """Whether the digits of x pass the Luhn test."""
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    parts = F.transform(_chars(F.reverse(_digits(x))), lambda d, i: F.when(i % 2 == 1, twice(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d) % 10 == 0


def _mod97(x: Column) -> Column:
    """Whether x, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    own = F.regexp_replace(x, "\\x20", "")
    turned = _chars(F.concat(F.substring(own, 5, 64), F.substring(own, 1, 4)))
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + (F.ascii(c) - 48)).otherwise(a * 100 + (F.ascii(c) - 55)) % 97
    return F.aggregate(turned, F.lit(0), step) == 1


def _random(x: Column) -> Column:
    """Whether x has a letter, three digits and an entropy of at least ENTROPY bits a character."""
    n = F.length(x).cast("double")

    def bits(chars: Column) -> Column:
        counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)).cast("double"))
        return F.log2(n) - F.aggregate(F.array_sort(counts), F.lit(0.0), lambda a, k: a + k * F.log2(k)) / n

    return F.rlike(x, F.lit("[A-Za-z]")) & (F.length(_digits(x)) >= 3) & (_let(_chars(x), bits) >= ENTROPY)


def _confirmed(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, "\\."), lambda p: F.rlike(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    if kind == "iban":
        return _mod97(x)
    if kind == "ssn":  # numbers that were never given out
        return ~(F.substring(x, 1, 3).isin("000", "666") | F.startswith(x, F.lit("9")) | (F.substring(x, 5, 2) == "00") | (F.substring(x, 8, 4) == "0000"))
    if kind == "secret":
        return _random(x)
    return F.lit(True)


def _placed(text: Column, kind: str) -> Column:
    """array of (start, end, m) of the kind's proposals; offsets in code points."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if kind == "iban" else 0))
    between = F.split(text, pattern, -1)
    taken = lambda m: F.lit(2) if kind == "iban" else F.length(m)
    pairs = _let(found, lambda f: F.zip_with(f, F.slice(between, F.lit(1), F.size(f)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"), (F.length(g) + taken(m)).alias("len"))))
    told = lambda at, e: F.struct((at + e["gap"]).alias("start"), (at + e["gap"] + F.length(e["m"])).alias("end"), e["m"].alias("m"))
    return _scan(pairs, F.lit(0), lambda at, e: at + e["len"], told, "struct<start:int,end:int,m:string>")


#: A cheap test that every match passes.
_GUARD = {"email": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.contains(t, F.lit("+"))}
_FOUND = "struct<start:int,rank:int,kind:string,end:int,score:int>"


def cut(text: Column) -> Column:
    """The text in pieces of CUT code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))


def between(pieces: Column, start: Column, end: Column | None = None) -> Column:
    """The text from start to end, or to its end, of a text in pieces."""
    first = F.floor(start / CUT).cast("int")
    count = F.size(pieces) if end is None else F.floor((end - 1) / CUT).cast("int") - first + 1
    own = F.array_join(F.slice(pieces, first + 1, F.greatest(count, F.lit(0))), "")
    return F.substring(own, start - first * CUT + 1, F.lit(2147483647) if end is None else end - start)


def _scored(pieces: Column, s: Column) -> Column:
    """A span (start, rank, kind, end, m) with its score instead of its text."""
    near = F.concat(between(pieces, F.greatest(s["start"] - NEAR, F.lit(0)), s["start"]), F.lit("\n"), between(pieces, s["end"], s["end"] + NEAR))

    def score(x: Column) -> Column:
        has = lambda words: F.rlike(x, F.lit(words.replace(r"\b", _BOUND)))
        own, word = F.lit(0), F.lit(False)
        for k in KINDS:
            own, word = F.when(s["kind"] == k, 40 + CHECKED[k]).otherwise(own), F.when(s["kind"] == k, has(CONTEXT[k])).otherwise(word)
        return F.greatest(F.least(own + F.when(word, 30).otherwise(0) - F.when(has(DOUBT), 30).otherwise(0), F.lit(100)), F.lit(0))

    return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), _let(F.translate(near, _UPPER, _LOWER), score).alias("score"))


def add_spans(df: DataFrame, text: str, name: str = "spans") -> DataFrame:
    """Adds `name`: array of (start, rank, kind, end, score), ordered by start, then kind as listed.  text: a column without nulls."""
    out = df
    for kind in KINDS:
        guard = F.rlike(F.col(text), F.lit(PATTERNS[kind]))
        if kind in _GUARD:
            guard = _GUARD[kind](F.col(text)) & guard
        out = out.withColumn(f"__rs_{kind}", F.when(guard, _placed(F.col(text), kind)))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def parts(kind: str) -> Column:
        told = lambda e: F.struct(e["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), e["end"].alias("end"))
        return F.coalesce(F.transform(F.filter(F.col(f"__rs_{kind}"), lambda e: _confirmed(kind, e["m"])), told), none)

    out = out.withColumn("__rs_found", F.array_sort(F.concat(*[parts(k) for k in KINDS])))
    scored = _let(cut(F.col(text)), lambda p: F.filter(F.transform("__rs_found", lambda s: _scored(p, s)), lambda s: (s["rank"] < len(BASE)) | (s["score"] >= LEAST)))
    return out.withColumn(name, F.when(F.size("__rs_found") > 0, scored).otherwise(F.array().cast(f"array<{_FOUND}>"))).drop("__rs_found", *[f"__rs_{k}" for k in KINDS])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (start, rank, kind, end, score); offsets in code points, end exclusive."""
    return add_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__rs_text")), "__rs_text").drop("__rs_text")


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns, and scores: those of spans, in their order, comma-joined."""
    own = find(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return own.select("doc_id", *[count(k) for k in BASE], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), scores.alias("scores"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones as one, replaced by its first kind in brackets; spans: not empty, in order."""
    kind = "struct<start:int,kind:string,before:int>"
    own = _scan(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), at.alias("before")), kind)
    firsts = F.filter(own, lambda s: s["start"] >= s["before"])
    end = F.array_max(F.transform(spans, lambda s: s["end"]))

    def joined(pieces: Column) -> Column:
        parts = F.transform(firsts, lambda s: F.concat(between(pieces, s["before"], s["start"]), F.lit("["), s["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), between(pieces, end))

    return _let(cut(text), joined)


def stage(docs: DataFrame) -> DataFrame:
    """All rows and columns; in the texts each span of personal data is replaced by its kind in brackets."""
    own = add_spans(docs.withColumn("__rs_text", F.coalesce("text", F.lit(""))), "__rs_text", "__rs_spans")
    text = F.when(F.size("__rs_spans") > 0, redacted(F.col("__rs_text"), F.col("__rs_spans"))).otherwise(F.col("text"))
    return own.withColumn("text", text).select(*docs.columns)


def sql() -> str:
    """The same rows with the plain patterns; places are running sums over rows."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": "[A-Z]{2}[0-9]{2}", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "secret": "[A-Za-z0-9+/_-]{20,}",
    }
    found = " UNION ALL ".join(f"SELECT id, '{k}' AS kind, {KINDS.index(k)} AS rank, regexp_extract_all(x, '{p}') AS m, string_split_regex(x, '{p}') AS g FROM t" for k, p in plain.items())
    words = " ".join(f"WHEN '{k}' THEN regexp_matches(near, '{w}')" for k, w in CONTEXT.items())
    checked = " ".join(f"WHEN '{k}' THEN {40 + n}" for k, n in CHECKED.items())
    return rf"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS x FROM documents),
f AS ({found}),
r AS (SELECT id, kind, rank, i, m[i] AS m, length(g[i]) AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)),
s AS (SELECT *, CAST(sum(gap + length(m)) OVER (PARTITION BY id, kind ORDER BY i) - length(m) AS BIGINT) AS a FROM r),
q AS (SELECT s.id, kind, rank, a, CASE WHEN kind <> 'iban' THEN m WHEN a = 0 OR NOT regexp_matches(substr(x, a, 1), '[A-Za-z0-9_]') THEN regexp_extract(substr(x, a + 1, 48), '^({_IBAN})(?:[^A-Za-z0-9_]|$)', 1) ELSE '' END AS m FROM s JOIN t ON t.id = s.id),
v AS (SELECT q.*, a + length(m) AS b, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS own, CAST(length(m) AS DOUBLE) AS n,
  translate(substr(x, greatest(a - {NEAR}, 0) + 1, least(a, {NEAR})) || chr(10) || substr(x, a + length(m) + 1, {NEAR}), '{_UPPER}', '{_LOWER}') AS near FROM q JOIN t ON t.id = q.id WHERE m <> ''),
w AS (SELECT *, least(greatest(CASE kind {checked} END + CASE WHEN CASE kind {words} END THEN 30 ELSE 0 END - CASE WHEN regexp_matches(near, '{DOUBT}') THEN 30 ELSE 0 END, 0), 100) AS score FROM v),
c AS (SELECT id, kind, rank, a, b, score FROM w WHERE (rank < {len(BASE)} OR score >= {LEAST}) AND CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0
  WHEN 'card' THEN length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(d)[i] AS INT) ELSE CAST(reverse(d)[i] AS INT) * 2 - CASE WHEN CAST(reverse(d)[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 'phone' THEN length(d) BETWEEN 10 AND 15
  WHEN 'iban' THEN list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(own, 5) || substr(own, 1, 4), ''), lambda q: CAST(CASE WHEN q BETWEEN '0' AND '9' THEN ascii(q) - 48 ELSE ascii(q) - 55 END AS BIGINT))), lambda y, q: CASE WHEN q < 10 THEN (y * 10 + q) % 97 ELSE (y * 100 + q) % 97 END) = 1
  WHEN 'secret' THEN length(m) <= 128 AND length(d) >= 3 AND regexp_matches(m, '[A-Za-z]') AND log2(n) - list_sum(list_transform(list_distinct(string_split(m, '')), lambda y: (length(m) - length(replace(m, y, ''))) * log2(length(m) - length(replace(m, y, ''))))) / n >= {ENTROPY}
  ELSE substr(m, 1, 3) NOT IN ('000', '666') AND m NOT LIKE '9%' AND substr(m, 5, 2) <> '00' AND substr(m, 8) <> '0000' END),
o AS (SELECT id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY a, rank) AS scores FROM c GROUP BY id)
SELECT doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip, CAST(coalesce(n_card, 0) AS BIGINT) AS n_card, CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM t LEFT JOIN o ON o.id = t.id
"""
