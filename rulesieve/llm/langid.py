"""Language identification with hyperdimensional profiles.

A letter has a fixed random vector of +1 and -1.  The vector of a letter trigram binds (multiplies) its three letters'
vectors, the first rotated twice and the second once, so that order counts.  A text bundles (adds) the vectors of its
trigrams, a language those of its texts, and a text gets the language whose prototype has the largest cosine with it.

Learning reads every labelled row: a task adds up its rows' trigrams by language, at most HELD different ones at a time, and
emits one vector a language, so what is shuffled and what reaches the driver has a fixed size (languages x DIM numbers),
however large the corpus is.

Defined results: a null text, an empty one or one without a letter is `und` with score 0; rows with a null language are
not learned from, nor are those without a letter; with nothing learned every text is `und`; repeated rows count as
often as they occur; a long text is gone through in parts, with the same trigrams as in one; ties between languages go to
the first in alphabetical order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

DIM = 1024
SEED = 20240607
#: Letter classes: 0 is a gap, 1 to 26 are a to z, the other letters share the rest.
CLASSES = 128
UNDETERMINED = "und"
#: Cosines of unrelated vectors have a standard deviation of DIM ** -0.5; the stage takes three of them for no likeness.
LEAST = 3 * DIM**-0.5
#: Trigram vectors that a worker keeps, in rows of DIM bytes.
KEPT = 24_000
#: Characters looked at at once; some arrays of that length are held.
PIECE = 500_000
#: Trigrams, over all languages, that a learning task counts before it adds their vectors up.
HELD = 1_000_000
_LOW = 0x3000
_WORKER: dict = {}


def letter_class(code: int) -> int:
    char = chr(code)
    if not char.isalpha():
        return 0
    if "a" <= char <= "z":
        return code - 96
    return 27 + ((code * 2654435761 & 0xFFFFFFFF) >> 7) % (CLASSES - 27)


def _low_classes() -> np.ndarray:
    if "low" not in _WORKER:
        _WORKER["low"] = np.array([letter_class(c) for c in range(_LOW)], np.uint8)
    return _WORKER["low"]


def classes_of(codes: np.ndarray) -> np.ndarray:
    low = _low_classes()
    if not len(codes) or codes.max() < _LOW:
        return low[codes]
    high = codes >= _LOW
    out = low[np.where(high, 0, codes)]
    found, at = np.unique(codes[high], return_inverse=True)
    out[high] = np.array([letter_class(int(c)) for c in found], np.uint8)[at]
    return out


def lowered(text: str) -> str:
    """Lower case, character by character: without the rule for a sigma at a word's end."""
    return text.replace("Σ", "σ").lower()


def _codes_of(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a row's inner places hold a letter, and the codes of the trigrams around these."""
    cls = cls.astype(np.int32)
    inner = cls[1:-1] != 0
    return inner, (cls[:-2] << 14 | cls[1:-1] << 7 | cls[2:])[inner]


def _gaps_joined(cls: np.ndarray) -> np.ndarray:
    """Which classes stay when several gaps in a row are one."""
    keep = np.ones(len(cls), bool)
    keep[1:] = (cls[1:] != 0) | (cls[:-1] != 0)
    return keep


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For all letter trigrams of the texts, words set off by one gap: the text's number and the trigram's code."""
    joined = "\n".join(["", *("" if t is None else lowered(t.replace("\n", " ")) for t in texts), ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.cumsum(codes == 10, dtype=np.int32) - 1
    cls = classes_of(codes)
    keep = _gaps_joined(cls)
    cls, text = cls[keep], text[keep]
    if len(cls) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    inner, code = _codes_of(cls)
    return text[1:-1][inner], code


def _long(text: str) -> Iterator[np.ndarray]:
    """The trigrams' codes of one long text, PIECE characters at a time; the last two classes go over to the next part."""
    tail = np.zeros(1, np.uint8)
    for at in range(0, len(text), PIECE):
        cls = classes_of(np.frombuffer(lowered(text[at : at + PIECE]).encode("utf-32-le", "surrogatepass"), np.uint32))
        row = np.concatenate([tail, cls, np.zeros(int(at + PIECE >= len(text)), np.uint8)])
        row = row[_gaps_joined(row)]
        tail = row[-2:]
        if len(row) > 2:
            yield _codes_of(row)[1]


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """trigrams() of the texts, about PIECE characters at a time; those of a longer text come in parts."""
    held: list[str | None] = []
    first = size = 0
    for i, text in enumerate(texts):
        if held and size + len(text or "") > PIECE:
            of, code = trigrams(held)
            yield of + first, code
            held, size = [], 0
        if text is not None and len(text) > PIECE:
            for code in _long(text):
                yield np.full(len(code), i, np.int32), code
            continue
        if not held:
            first = i
        held.append(text)
        size += len(text or "")
    if held:
        of, code = trigrams(held)
        yield of + first, code


def counted(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The number of each text that has letters, its trigrams' codes and their counts."""
    open_text, codes, counts = -1, np.zeros(0, np.int32), np.zeros(0, np.int64)
    for of, code in pieces(texts):
        if not len(of):
            continue
        pairs, n = np.unique(of.astype(np.int64) << 21 | code, return_counts=True)
        own, text = (pairs & (CLASSES**3 - 1)).astype(np.int32), pairs >> 21
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
            if text[a] == open_text:  # a further part of a long text
                codes, at = np.unique(np.concatenate([codes, own[a:b]]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n[a:b]])).astype(np.int64)
                continue
            if open_text >= 0:
                yield open_text, codes, counts
            open_text, codes, counts = int(text[a]), own[a:b], n[a:b]
    if open_text >= 0:
        yield open_text, codes, counts


def letters() -> np.ndarray:
    if "letters" not in _WORKER:
        _WORKER["letters"] = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, DIM))
    return _WORKER["letters"]


def bound(codes: np.ndarray) -> np.ndarray:
    """The trigrams' vectors, one a row."""
    own = letters()
    return np.roll(own, 2, 1)[codes >> 14] * np.roll(own, 1, 1)[codes >> 7 & 127] * own[codes & 127]


def bundled(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the trigrams' vectors, each times its count."""
    total = np.zeros(DIM, np.int64)
    for i in range(0, len(codes), 4096):
        total += np.rint(counts[i : i + 4096].astype(np.float64) @ bound(codes[i : i + 4096])).astype(np.int64)
    return total


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of codes with their counts as one."""
    codes, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([a[1], b[1]])).astype(np.int64)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    totals: dict[str, np.ndarray] = {}

    def bundle() -> None:
        for name, own in counts.items():
            totals[name] = totals.get(name, 0) + bundled(*own)
        counts.clear()

    for batch in batches:
        texts, langs = texts_of(batch, "text"), np.array(texts_of(batch, "lang"), object)
        names, at = np.unique(langs.astype(str), return_inverse=True)
        for of, code in pieces(texts):
            pairs, n = np.unique(at[of].astype(np.int64) << 21 | code, return_counts=True)
            which, own = pairs >> 21, (pairs & (CLASSES**3 - 1)).astype(np.int32)
            for k in np.unique(which):
                new = own[which == k], n[which == k]
                counts[str(names[k])] = _added(counts[str(names[k])], new) if str(names[k]) in counts else new
            if sum(len(c) for c, _ in counts.values()) > HELD:
                bundle()
    bundle()
    for name, total in totals.items():
        yield pa.record_batch({"lang": pa.array([name] * DIM), "dim": pa.array(np.arange(DIM, dtype=np.int32)), "value": pa.array(total)})


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their prototypes of length 1, one a row."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sums = map_batches(rows, _learn, "lang string, dim int, value bigint").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).collect()  # DIM numbers a language
    found = sorted(((r["lang"], np.array([x["value"] for x in r["v"]], np.float64)) for r in found), key=lambda x: x[0])
    return [n for n, _ in found], np.array([v / max(np.linalg.norm(v), 1e-9) for _, v in found], np.float32).reshape(-1, DIM)


class Profiles:
    """Prototypes, and a worker's store of trigram vectors."""

    def __init__(self, names: list[str], prototypes: np.ndarray):
        self.names, self.prototypes = names, prototypes
        self.row, self.vectors, self.used = np.full(CLASSES**3, -1, np.int32), np.zeros((KEPT, DIM), np.int8), 0

    def rows_of(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self.row[codes] < 0]
        if self.used + len(new) > KEPT:
            self.row[:], self.used, new = -1, 0, codes
        if len(new):
            self.vectors[self.used : self.used + len(new)] = bound(new)
            self.row[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return self.row[codes]

    def vector(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if len(codes) > KEPT // 2:
            return bundled(codes, counts).astype(np.float32)
        return counts.astype(np.float32) @ self.vectors[self.rows_of(codes)].astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and the cosine, 0 where that is negative, of each text."""
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.names:
            return langs, scores
        for i, codes, counts in counted(texts):
            v = self.vector(codes, counts)
            cos = self.prototypes @ v / max(np.linalg.norm(v), 1e-9)
            best = int(np.argmax(cos))
            langs[i], scores[i] = self.names[best], min(1.0, max(0.0, float(cos[best])))
        return langs, scores


def batch_predictor(names: list[str], prototypes: np.ndarray):
    """A function of texts that keeps its store as long as its worker's task runs."""
    own: list[Profiles] = []

    def predict(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not own:
            own.append(Profiles(names, prototypes))
        return own[0].predict(texts)

    return predict


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs, lang_pred and score."""
    fn = batch_predictor(*model)
    rows = docs.select(*keep, F.col(text).alias("__rs_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = fn(texts_of(batch, "__rs_text"))
            yield pa.record_batch([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return map_batches(rows, work, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(False)))


def query(docs: DataFrame) -> DataFrame:
    model = learn(training_rows(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def stage(docs: DataFrame, least: float = LEAST, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The rows, all columns, in a language that was learned: whose nearest prototype has a cosine of at least `least`.

    wanted: only these languages.  Where no language could be learned (no labels, or none in the rows learned from), the rows
    whose text has a letter.
    """
    names, prototypes = learn(training_rows(docs))
    fn = batch_predictor(names, prototypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            if not names:
                told = {i for i, _, _ in counted(texts)}
                yield batch.filter(pa.array([i in told for i in range(len(texts))], pa.bool_()))
                continue
            langs, scores = fn(texts)
            yield batch.filter(pa.array([x != UNDETERMINED and s >= least and (wanted is None or x in wanted) for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return map_batches(docs, work, docs.schema)
