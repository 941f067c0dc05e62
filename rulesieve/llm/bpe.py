"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that the word's merges leave at its end.  Candidates are the tokens
that end at the place, longest first, which a suffix automaton over the vocabulary (tokens as a trie with suffix links)
lists; a candidate is the last token if the merges would not join it, or parts of it, with the last token of the prefix
before it.  That test undoes the two tokens' merges from the latest on and looks for a merge across the seam that comes
earlier than what is undone.  Back-pointers from the whole word give its ids.  Time is linear in the word's length times
the candidates a place, also for a text without any blank.

Read from a tokenizers file: vocabulary, merges, the word-end mark, the normaliser (NFC, white space, lower case) and the
pattern that cuts words, with characters as byte symbols.  Added tokens found in the raw text are single ids.  decode()
joins tokens as the file's library does where no decoder is set: with blanks.

Workers get the file's bytes by broadcast, a few MB, and keep what they made of it for their further tasks; words met lately
are kept, up to twice KEPT words of KEPT_LENGTH characters at most, so memory is bounded.  Nothing is shuffled.

Defined results: a null text counts as empty and has no ids; repeated rows each get their result; characters outside the
vocabulary can't occur, as all bytes are in it; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, texts_of

KEPT = 150_000
KEPT_LENGTH = 64
#: Stands for the mark of a word's end in the automaton; no byte symbol.
_END = "\x00"
_LOADED: dict[str, Bpe] = {}


def byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class _Words(dict):
    """Ids of words met lately: when full, what was not asked for since the last time goes.  A new word is encoded."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = self.bpe.encode_word(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bpe.table))
            if len(word) > KEPT_LENGTH:
                return ids
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Bpe:
    def __init__(self, spec: bytes):
        file = json.loads(spec)
        model = file["model"]
        steps = [x["type"] for x in file["normalizer"]["normalizers"]]
        cut = file["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or cut["behavior"] != "Removed" or not cut["invert"] or file["decoder"] is not None or file["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"]:
            raise ValueError("this kind of tokenizer file isn't known")
        if any(x.get(flag) for x in file["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens are only known where they stand for themselves in the raw text")
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in file["added_tokens"]}
        self.added = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.added_at = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")")
        self.word = regex.compile(cut["pattern"]["Regex"])
        #: (left, right) to (rank, joined); joined to its parts and rank, the earliest if several merges make it
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.joined.setdefault((a, b), (rank, c))
            self.parts.setdefault(c, (a, b, rank))
        symbols = byte_symbols()
        self.symbol_of = {chr(b): s for b, s in enumerate(symbols)}
        self.table = str.maketrans(self.symbol_of)
        self.suffixes = ahocorasick.Automaton()
        units = set(symbols)
        for token, i in self.vocab.items():
            marked = token.endswith(self.suffix) and token != self.suffix
            key = token[: -len(self.suffix)] + _END if marked else token
            if i in self.parts or (key[:-1] if marked else key) in units:
                self.suffixes.add_word(key, (len(key), i))
        self.suffixes.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.kept = _Words(self)
        self.names = [self.tokens.get(i) for i in range(max(self.tokens) + 1)]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' symbols in one row leaves just these two."""
        known = self.compatible.get(left << 20 | right)
        if known is None:
            known = self._fits(left, right)
            if len(self.compatible) >= 4 * KEPT:
                self.compatible.clear()
            self.compatible[left << 20 | right] = known
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Both tokens as they stood before step `now`: of the seam's two neighbours, the one made later is undone first.
        # A merge across the seam wins if it comes before the merge that is next to take one of the neighbours away; of
        # equal pairs the leftmost goes first, so a merge that makes the right neighbour wins only over later ones.
        a, b, limit = left, right, (len(self.joined) + 1, 0)
        while True:
            across = self.joined.get((a, b))
            if across is not None and (across[0], 1) < limit:
                return False
            made_a, made_b = self.parts.get(a), self.parts.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or (made_a is not None and (made_a[2], 0) > (made_b[2], 2)):
                limit, a = (made_a[2], 0), made_a[1]
            else:
                limit, b = (made_b[2], 2), made_b[0]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The ids of one word, as a string of byte symbols."""
        row = word + _END
        n = len(row)
        last, start, known = [-1] * (n + 1), [0] * (n + 1), self.compatible.get
        for end, (size, token) in self.suffixes.iter(row):
            if last[end + 1] < 0:
                before = end + 1 - size
                if before:
                    left = last[before]
                    if left < 0:
                        continue
                    fit = known(left << 20 | token)
                    if not (self.fits(left, token) if fit is None else fit):
                        continue
                last[end + 1], start[end + 1] = token, before
        ids = []
        at = n
        while at > 0:
            ids.append(last[at])
            at = start[at]
        return tuple(reversed(ids))

    def _piece(self, text: str, out: list[int]) -> None:
        # white space only parts words, so making it single blanks first would change nothing
        text = unicodedata.normalize("NFC", text)
        out.extend(chain.from_iterable(map(self.kept.__getitem__, self.word.findall(lowered(text)))))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if not any(x in text for x in self.added):
            self._piece(text, out)
            return out
        for i, piece in enumerate(self.added_at.split(text)):
            if i % 2:
                out.append(self.added[piece])
            elif piece:
                self._piece(piece, out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The ids' tokens joined with blanks; ids that the vocabulary lacks are left out."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except (IndexError, TypeError):
            return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def lowered(text: str) -> str:
    """Lower case character by character: without the rule for a sigma at a word's end."""
    low = text.lower()
    return "".join([c.lower() for c in text]) if "Σ" in text else low


def ids_digest(ids: list[int]) -> str:
    """SHA-256 of the ids as little-endian unsigned 32-bit integers."""
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return hashlib.sha256(own).hexdigest()


class Codec:
    """A vocabulary that a worker reads once and keeps for its further tasks, the latest only."""

    def __init__(self, spec, name: str):
        self.spec, self.name = spec, name

    def __call__(self) -> Bpe:
        if self.name not in _LOADED:
            _LOADED.clear()
            _LOADED[self.name] = Bpe(self.spec.value)
        return _LOADED[self.name]


def codec(docs: DataFrame, path: str) -> Codec:
    with open(path, "rb") as f:  # on the driver; a vocabulary file has a few MB
        data = f.read()
    return Codec(docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest())


def encode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (where keep_ids), ids_sha256 and decoded_sha256."""
    own = codec(docs, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = own()
        for batch in batches:
            texts = texts_of(batch, "text")
            for i in range(0, len(texts), 256):
                ids = [bpe.encode(t) for t in texts[i : i + 256]]
                columns = [batch.column(0).slice(i, 256), pa.array([len(x) for x in ids], pa.int64())]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                columns += [pa.array([ids_digest(x) for x in ids]), pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids])]
                yield pa.record_batch(columns, names)

    schema = docs.select("doc_id").schema.add("n_tokens", "long")
    schema = (schema.add("ids", T.ArrayType(T.IntegerType())) if keep_ids else schema).add("ids_sha256", "string").add("decoded_sha256", "string")
    names = schema.fieldNames()
    return map_batches(docs.select("doc_id", F.col("text")), work, schema)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode(docs, path or vocabulary_path(), keep_ids=False)
