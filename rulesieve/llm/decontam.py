"""Benchmark decontamination with Aho-Corasick automata.

Texts are normalised by lower-casing A-Z and keeping words of digits, a to z and characters beyond ASCII.  An item's
windows are its runs of ten consecutive words; an item of fewer words, but not none, is one window.  A window becomes the
pattern " w1 ... wn ", a text the string " w1 ... wm ", so that a match covers whole words.  Each text is scanned once, and
the place of a match is turned into word numbers and offsets in the original text.

The patterns are a table in the shared folder.  One automaton takes BLOCK_CHARS characters of them; where there are more,
they are dealt to blocks by hash, and a worker goes through the blocks one after another, one automaton alive at a time, for
PASS_BYTES of texts at a time.  So neither a worker's nor the driver's memory grows with the benchmark, and texts aren't
shuffled.

Defined results: a null or empty text has no words and no hit; items without words, or with a null id or text, have no
window; items that repeat count once by id; a window that several items share counts for each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_batches, opened, shared_dir, stored, texts_of

WINDOW = 10
#: Characters of patterns in one automaton; a node is made for each at most.
BLOCK_CHARS = 1_000_000
#: Texts that a worker holds while it goes through several blocks.
PASS_BYTES = 64 << 20
_NO_SPANS = np.zeros((0, 2), np.int64)
_HELD: dict = {}
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def words(text: str | None) -> list[bytes]:
    """The normalised words in UTF-8; bytes from 128 on only occur in characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(own: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    return [own[i : i + size] for i in range(max(1, len(own) - size + 1))] if own else []


def _padded(own: list[bytes]) -> str:
    return (b" " + b" ".join(own) + b" ").decode("latin-1")


def patterns(items: DataFrame, size: int = WINDOW, block_chars: int = BLOCK_CHARS) -> Patterns:
    """Writes the items' windows to the shared folder, in blocks of about block_chars characters; only their total reaches the driver."""
    folder = shared_dir(items.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(texts_of(batch, "item_id"), texts_of(batch, "text"), strict=True):
                own = windows(words(text), size)
                for i in range(0, len(own), 4096):
                    part = own[i : i + 4096]
                    yield pa.record_batch([pa.array([_padded(w) for w in part]), pa.array([len(w) for w in part], pa.int32()), pa.array([item] * len(part))], ["pattern", "n", "item_id"])

    named = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    rows = stored(map_batches(named, work, "pattern string, n int, item_id string").distinct(), folder, "windows")
    chars = rows.select("pattern").distinct().agg(F.sum(F.length("pattern"))).first()[0] or 0
    count = -(-chars // block_chars)
    if count:
        blocked = rows.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(count)).cast("int"))
        blocked.repartition(int(count), "block").write.partitionBy("block").parquet(f"{folder}/blocks")
    dropped(items.sparkSession, f"{folder}/windows")
    return Patterns(folder, int(count))


class Patterns:
    """Blocks of patterns in the shared folder; a worker holds the automaton of one of them at a time."""

    def __init__(self, folder: str, count: int):
        self.folder, self.count = folder, count

    def automaton(self, k: int):
        """The automaton of block k, or None if it has no pattern; the latest is kept for the worker's further batches and tasks."""
        if _HELD.get("key") != (self.folder, k):
            _HELD.clear()
            _HELD.update(key=(self.folder, k), found=automaton(self._read(k)))
        return _HELD["found"]

    def _read(self, k: int) -> dict[str, tuple[int, list[str]]]:
        files, base = opened(f"{self.folder}/blocks/block={k}")
        block: dict[str, tuple[int, list[str]]] = {}
        for info in files.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with files.open_input_file(info.path) as f:
                    for part in pq.ParquetFile(f).iter_batches(columns=["pattern", "n", "item_id"]):
                        for key, n, item in zip(*(texts_of(part, c) for c in ("pattern", "n", "item_id")), strict=True):
                            block.setdefault(key, (n, []))[1].append(item)
        return block

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        """The number of words of each text, the merged word spans that windows cover, and the items, sorted."""
        counts, spans, names = [len(words(t)) for t in texts], [_NO_SPANS] * len(texts), [set() for _ in texts]
        for k in sorted(range(self.count), key=lambda k: (self.folder, k) != _HELD.get("key")):  # the one at hand first
            found = self.automaton(k)
            for i, text in enumerate(texts):
                if found is not None and counts[i]:
                    own, ids = scan(words(text), found)
                    if len(own):
                        spans[i] = merged(np.concatenate([spans[i], own]))
                        names[i] |= ids
        yield from zip(counts, spans, map(sorted, names), strict=True)

    def groups(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches to be scanned at once: with several blocks about PASS_BYTES of them, as each block is built anew for each."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if self.count < 2 or size >= PASS_BYTES:
                yield from held if len(held) == 1 else [joined(held)]
                held, size = [], 0
        if held:
            yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)], schema=batches[0].schema)


def automaton(block: dict[str, tuple[int, list[str]]]):
    if not block:
        return None
    found = ahocorasick.Automaton()
    for key, value in block.items():
        found.add_word(key, value)
    found.make_automaton()
    return found


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows (first, end) in order, joined where they touch or overlap."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > ends[:-1]]))
    return np.stack([spans[new, 0], np.append(ends[new[1:] - 1], ends[-1])], 1)


def scan(own: list[bytes], found) -> tuple[np.ndarray, set[str]]:
    """Word spans that windows cover, and the ids of their items."""
    text = _padded(own)
    hits = list(found.iter(text)) if own else []
    if not hits:
        return _NO_SPANS, set()
    gaps = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
    end = np.searchsorted(gaps, np.array([h[0] for h in hits]))
    spans = np.stack([end - np.array([h[1][0] for h in hits]), end], 1)
    return merged(spans), {i for ids in {id(h[1]): h[1][1] for h in hits}.values() for i in ids}


def original(text: str, spans: np.ndarray) -> list[tuple[int, int]]:
    """Offsets in code points, end exclusive, of spans of words."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans.tolist()]


def find(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit (words inside windows), spans in the original text, items found (sorted)."""
    own = patterns(items, size, block_chars)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in own.groups(batches):
            texts = texts_of(batch, "text")
            counts, hit, chars, ids = [], [], [], []
            for text, (n, span, names) in zip(texts, own.scan(texts), strict=True):
                counts.append(n)
                hit.append(int((span[:, 1] - span[:, 0]).sum()))
                chars.append([{"start": a, "end": b} for a, b in original(text, span)] if len(span) else [])
                ids.append(names)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(chars, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(ids, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "spans", "items"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, work, "doc_id bigint, n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns, and spans: start:end of the covered passages in the original text, comma-joined."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return find(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), spans.alias("spans"))


def stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows, all columns, in which no window of an item occurs."""
    own = patterns(items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in own.groups(batches):
            yield batch.filter(pa.array([not len(span) for _, span, _ in own.scan(texts_of(batch, "text"))], pa.bool_()))

    return map_batches(docs, work, docs.schema)


#: The same rows by joins of unnested windows.
SQL = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
docs AS (
  SELECT doc_id, lowered, regexp_extract_all(lowered, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents)),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.n, p.i, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.s = x.s),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits),
covered AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
runs AS (SELECT doc_id, min(k) AS a, max(k) AS b FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM words) GROUP BY doc_id, r),
spots AS (
  SELECT doc_id, k, sum(length(g[k]) + length(w[k])) OVER (PARTITION BY doc_id ORDER BY k) AS stop, length(w[k]) AS n
  FROM (SELECT doc_id, w, string_split_regex(lowered, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS g, unnest(range(1, len(w) + 1)) AS k FROM docs WHERE doc_id IN (SELECT doc_id FROM runs))),
spans AS (SELECT r.doc_id, string_agg((p.stop - p.n) || ':' || q.stop, ',' ORDER BY r.a) AS spans FROM runs r JOIN spots p ON p.doc_id = r.doc_id AND p.k = r.a JOIN spots q ON q.doc_id = r.doc_id AND q.k = r.b GROUP BY r.doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated, coalesce(p.spans, '') AS spans
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id LEFT JOIN spans p ON p.doc_id = d.doc_id
"""
