"""Near-duplicate documents: MinHash with tensored banding, exact confirmation, connected components.

Tables.  A plain index of L tables needs L x k minhashes.  Here 2 x SIDE short keys of HASHES minhashes each are made: SIDE
left keys u_i and SIDE right keys v_j; table (i, j) has the key (u_i, v_j), so 120 minhashes give 400 tables of 6.  Two
texts meet in a table if they share some left and some right key: at a similarity of 0.8 a pair misses all with a chance of
2 * (1 - 0.8^3)^20, about 1 in 800,000.  Rows are dealt by u_i only; v_j is compared inside, so a text is sent SIDE times, not
SIDE^2 times.  The right side's minhashes also give an estimate, which drops pairs far below the threshold.

Groups.  Texts with equal sets are one class, by a 128-bit digest, with the smallest doc_id as its node; classes are made
by pre-aggregated counts.  In each left bucket every member is tried against the smallest one; confirmed links are joined to
components.  In buckets that still hold several components, the nodes outside the largest one are tried against a node of
that.  What still holds several is gone through in blocks of about BLOCK nodes, so that no bucket lands in one task: the nodes
outside the bucket's largest component are compared with all others that share a table with them by their sets there and
then, and only links come out, so that pairs are never rows.  No bucket is capped and no pair is dropped but by the size ratio (exact), the tables and the
estimate.  What many rows of one key must be told (of their bucket, component or representative) goes once to each of the
tasks that the key's rows are spread over.

Confirmation compares the full shingle sets (64-bit hashes of all shingles).  Components come from alternating star
contractions over stored tables, which are written in few files, as each may cost a task three processes where Hadoop sets
modes with chmod.  All that is cut off from its lineage lies in the shared checkpoint folder; links and
components never reach the driver, only their counts and checksums.

Defined results: a text without words, or null, has no shingle and is its own component; one of fewer words than a shingle is
one shingle; rows that repeat an id count each; classes whose smallest ids are equal are one node; rows with a null id take
part, but take the component of the rows with ids that they link to, or null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, SALT, dropped, looked_up, map_batches, numbered, salted, salts_met, shared_dir, stored, texts_of, unfolded

SHINGLE = 5
PERCENT = 80
SIDE = 20
HASHES = 3
#: Of the right side's 60 minhashes so many must agree; at 0.8 fewer do with a chance of 1 in 4 million.
AGREE = 31
BLOCK = 256
KEPT_WORDS = 100_000
#: Links in a file of a components' table, where the cluster's cores don't ask for more files.
FILE_LINKS = 100_000
SEED = 20240610
_HALF = SIDE * HASHES
_U64 = np.uint64


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U64(27))) * _U64(0x94D049BB133111EB)
    return z ^ (z >> _U64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        own = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = own
        return own


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, size: int):
        self.size, self.words = size, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
        n = len(words)
        own = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        if n == 0:
            return own
        if n < self.size:
            whole = np.array([n], np.uint64)
            for i in range(n):
                whole = _mixed(whole * _U64(0x9E3779B97F4A7C15) + own[i : i + 1])
            return whole
        out = own[: n - self.size + 1]
        for i in range(1, self.size):
            out = _mixed(out * _U64(0x9E3779B97F4A7C15) + own[i : n - self.size + 1 + i])
        return np.unique(_mixed(out + _U64(self.size)))


def digest(own: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 1 << 32, 2 * _HALF, np.uint32) | np.uint32(1))[:, None], rng.integers(0, 1 << 32, 2 * _HALF, np.uint32)[:, None]


def minhashes(own: np.ndarray, multipliers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    mult, flip = multipliers
    low = (own >> _U64(32)).astype(np.uint32)[None, :]
    out = np.full(2 * _HALF, 0xFFFFFFFF, np.uint32)
    for i in range(0, low.shape[1], 1024):
        np.minimum(out, ((low[:, i : i + 1024] ^ flip) * mult).min(axis=1), out=out)
    return out


def left_keys(hashes: np.ndarray) -> np.ndarray:
    """A row of minhashes each: the SIDE left keys, with their numbers mixed in."""
    side = hashes[:, :_HALF].reshape(-1, SIDE, HASHES).astype(np.uint64)
    key = np.arange(SIDE, dtype=np.uint64)[None, :] * _U64(0xD6E8FEB86659FD93)
    for i in range(HASHES):
        key = _mixed(key * _U64(0x9E3779B97F4A7C15) + side[:, :, i] + _U64(1))
    return key.view(np.int64)


def right_bytes(hashes: np.ndarray) -> np.ndarray:
    """The lowest bytes of the right side's minhashes; HASHES of them are a right key."""
    return (hashes[:, _HALF:] & np.uint32(255)).astype(np.uint8)


def alike(right_a: np.ndarray, right_b: np.ndarray, agree: int = AGREE) -> np.ndarray:
    """Whether two texts share a right key and their estimate allows a link; rows of right_bytes, broadcast."""
    same = right_a == right_b
    return same.reshape(*same.shape[:-1], SIDE, HASHES).all(-1).any(-1) & (same.sum(-1, dtype=np.int16) >= agree)


def sized(a, b, percent: int):
    """Whether sets of these sizes can reach the similarity."""
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, digest (d1, d2), left keys u and right bytes v of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, multipliers = Shingler(size), _multipliers()
        for batch in batches:
            texts = texts_of(batch, "text")
            for i in range(0, len(texts), 1024):
                part = texts[i : i + 1024]
                hashes, n, ds = np.zeros((len(part), 2 * _HALF), np.uint32), np.zeros(len(part), np.int64), []
                for k, text in enumerate(part):
                    own = shingler(text)
                    n[k] = len(own)
                    ds.append(digest(own))
                    if len(own):
                        hashes[k] = minhashes(own, multipliers)
                u, v = left_keys(hashes), right_bytes(hashes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * SIDE + 1, SIDE, dtype=np.int32)), pa.array(u.ravel()))
                yield pa.record_batch([batch.column(0).slice(i, 1024), pa.array(n), pa.array([d[0] for d in ds], pa.int64()), pa.array([d[1] for d in ds], pa.int64()), lists, pa.array([x.tobytes() for x in v], pa.binary())], ["doc_id", "n", "d1", "d2", "u", "v"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), work, "doc_id bigint, n bigint, d1 bigint, d2 bigint, u array<bigint>, v binary")


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node and its full shingle set; nodes: node, d1, d2."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            texts, d1, d2 = texts_of(batch, "text"), texts_of(batch, "d1"), texts_of(batch, "d2")
            for i in range(0, len(texts), 256):
                sets = [shingler(t) for t in texts[i : i + 256]]
                keep = [digest(s) == d for s, d in zip(sets, zip(d1[i : i + 256], d2[i : i + 256], strict=True), strict=True)]
                kept = [s for s, k in zip(sets, keep, strict=True) if k]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32))
                flat = np.concatenate([np.zeros(0, np.uint64), *kept]).view(np.int64)
                yield pa.record_batch([batch.column(0).slice(i, 256).filter(pa.array(keep, pa.bool_())), pa.ListArray.from_arrays(ends, pa.array(flat))], ["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(nodes, F.col("doc_id") == F.col("node")).select("node", "d1", "d2", "text")
    return map_batches(rows, work, "node bigint, shingles array<bigint>")


def _filtered(pairs: DataFrame, percent: int, agree: int) -> DataFrame:
    """Of pairs a, b with sizes and right bytes those that may link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                va, vb = (np.frombuffer(b"".join(texts_of(batch, c)), np.uint8).reshape(-1, _HALF) for c in ("va", "vb"))
                yield batch.select(["a", "b"]).filter(pa.array(alike(va, vb, agree)))

    sides = pairs.where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    return map_batches(sides.select("a", "b", "va", "vb"), work, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs a, b those whose full sets reach the similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    # a representative of many has one set, which goes once to each task that its pairs are spread over
    both = looked_up(pairs, right, ["b"], "a").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    return both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).cast("bigint").alias("t")).where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b")


class _Sets:
    """The sets of a few rows: how many elements others have in common with one of them."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        found, codes = np.unique(flat, return_inverse=True)
        self.codes, self.ends, self.mark = codes, ends, np.zeros(len(found), bool)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.codes[self.ends[i] : self.ends[i + 1]]
        self.mark[own] = True
        sizes = self.ends[others + 1] - self.ends[others]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.arange(sizes.sum()) + np.repeat(self.ends[others] - starts, sizes)
        out = np.add.reduceat(self.mark[self.codes[at]].astype(np.int64), starts)
        self.mark[own] = False
        return out


def _pairs(part: dict[str, np.ndarray], a: slice, percent: int, agree: int) -> Iterator[np.ndarray]:
    """Of the rows of one bucket and pair of blocks, the pairs (larger node, smaller node) that link; see _rest."""
    node, comp, n, v, guest, minor = (part[c][a] for c in ("node", "comp", "n", "v", "guest", "minor"))
    y = np.flatnonzero(~guest)
    sets: _Sets | None = None
    for i in np.flatnonzero(guest):
        k = y[(comp[y] != comp[i]) & (~minor[y] | (node[y] < node[i])) & sized(n[y], n[i], percent)]
        k = k[alike(v[k], v[i], agree)] if len(k) else k
        if len(k):
            if sets is None:
                ends = part["ends"][a.start : a.stop + 1]
                sets = _Sets(part["flat"][ends[0] : ends[-1]], ends - ends[0])
            common = sets.common(i, k)
            k = k[100 * common >= percent * (n[k] + n[i] - common)]
            if len(k):
                yield np.stack([np.maximum(node[k], node[i]), np.minimum(node[k], node[i])], 1)


def _rest(members: DataFrame, percent: int, agree: int) -> DataFrame:
    """All links of one bucket between different components.  members: key, size, most, major, node, comp, n, v, s.

    A bucket's nodes outside its largest component (guests) are compared with all of its nodes (hosts): those that two of the
    largest component would make aren't looked for.  Hosts and guests are dealt to blocks of about BLOCK, and each pair of
    blocks meets once.  s has the set's hashes cut to 31 bits, so what is counted as common is never too little; what is found
    is confirmed on the full sets later.  Only links leave this function, however many pairs a block compares.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = members.withColumn("minor", F.col("comp") != F.col("major")).withColumn("hosts", blocks(F.col("size"))).withColumn("guests", blocks(F.col("size") - F.col("most")))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spot = lambda p, q, guest: F.struct(p.alias("p"), q.alias("q"), F.lit(guest).alias("guest"))
    as_host = F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda q: spot(own("hosts"), q, False))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("hosts") - 1), lambda p: spot(p, own("guests"), True))
    rows = rows.withColumn("at", F.explode(F.when(F.col("minor"), F.concat(as_host, as_guest)).otherwise(as_host)))
    rows = rows.select("key", "at.p", "at.q", "at.guest", "minor", "node", "comp", "n", "v", "s")

    def done(table: pa.Table) -> pa.RecordBatch:
        part = {c: table.column(c).to_numpy() for c in ("key", "p", "q", "guest", "minor", "node", "comp", "n")}
        part["v"] = np.frombuffer(b"".join(table.column("v").to_pylist()), np.uint8).reshape(-1, _HALF)
        lists = table.column("s").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        part["flat"], part["ends"] = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        new = np.any([np.diff(part[c]) != 0 for c in ("key", "p", "q")], axis=0)
        starts = np.flatnonzero(np.concatenate([[True], new]))
        out = [np.zeros((0, 2), np.int64)]
        for s, e in zip(starts, [*starts[1:], table.num_rows], strict=True):
            out += _pairs(part, slice(int(s), int(e)), percent, agree)
        found = np.concatenate(out)
        return pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                held.append(batch.slice(at, 1024))
                keys = {c: held[-1].column(c).to_numpy() for c in ("key", "p", "q")}
                same = np.all([x == x[-1] for x in keys.values()], axis=0)
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:  # what stands before the last group is whole
                    yield done(pa.Table.from_batches([*held[:-1], held[-1].slice(0, cut)]))
                    held = [held[-1].slice(cut)]
                elif len(held) > 1 and any(held[-2].column(c)[-1].as_py() != x[-1] for c, x in keys.items()):
                    yield done(pa.Table.from_batches(held[:-1]))
                    held = held[-1:]
        if held:
            yield done(pa.Table.from_batches(held))

    dealt = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return map_batches(dealt, work, "a bigint, b bigint")


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """node and comp, the smallest node that it reaches, of all nodes that have a link; links: a, b.

    Alternating large-star and small-star steps until the edges stay the same; the edges are then stars around the smallest.
    No step makes more edges than it gets, so the files of a table go by the edges of the one before.
    """
    spark = links.sparkSession
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"{name}_0")

    def told(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    def star(df: DataFrame, large: bool) -> DataFrame:
        ends = df.select("a", "b")
        if large:
            ends = ends.union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = salted(ends, "b")  # the smallest node of a component has a link to all others in the end
        low = ends.groupBy("a").agg(F.min("b").alias("m"), salts_met().alias("salts")).select("a", F.least("a", "m").alias("m"), "salts")
        near = ends.join(low.withColumn(SALT, unfolded("salts")), ["a", SALT])
        low = low.select("a", "m")
        moved = near.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return (moved if large else moved.union(low)).where("a <> b").distinct()

    state, k = told(edges), 0
    while state[0]:
        k += 1
        files = max(spark.sparkContext.defaultParallelism, -(-state[0] // FILE_LINKS))
        new = stored(star(star(edges, True), False).coalesce(files), folder, f"{name}_{k}")
        dropped(spark, f"{folder}/{name}_{k - 1}")
        edges, before, state = new, state, told(new)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _buckets(keyed: DataFrame) -> DataFrame:
    """key, node, size and rep (the smallest node) of buckets with several nodes; a bucket's nodes are spread over tasks."""
    spread = salted(keyed, "node")
    found = spread.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("rep"), salts_met().alias("salts")).where("size > 1")
    return spread.join(found.withColumn(SALT, unfolded("salts")).drop("salts"), ["key", SALT]).drop(SALT)


def _unjoined(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The members (key, node) of buckets that hold several components, with their component and what is known of the bucket:

    size, major (its largest component), most (that one's nodes here) and pivot (a node of it).
    """
    placed = members.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("first"))
    top = F.max(F.struct("c", (-F.col("comp")).alias("o"), "comp", F.col("first.node").alias("pivot"))).alias("t")
    found = parts.groupBy("key").agg(F.sum("c").alias("size"), F.count("*").alias("comps"), top).where("comps > 1")
    return looked_up(placed, found.select("key", "size", F.col("t.comp").alias("major"), F.col("t.c").alias("most"), F.col("t.pivot").alias("pivot")), ["key"], "node")


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, agree: int = AGREE) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    agree: of the estimate's 60 minhashes so many must be equal in a pair; 0 turns the estimate off.  The keys are made for
    similarities of 0.8 and more, so a smaller percent is refused.
    """
    if percent < PERCENT:
        raise ValueError(f"the tables are made for {PERCENT} percent and more")
    spark = docs.sparkSession
    folder = shared_dir(spark)
    rows = stored(_signed(docs, shingle), folder, "rows")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    nodes = rows.join(classes.select("d1", "d2", F.col("node").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi").where("n > 0")
    nodes = stored(nodes.dropDuplicates(["d1", "d2", "doc_id"]).select(F.col("doc_id").alias("node"), "d1", "d2", "n", "u", "v"), folder, "nodes")

    members = stored(_buckets(nodes.select(F.explode("u").alias("key"), "node")), folder, "members")
    involved = nodes.join(members.select("node").distinct(), "node", "left_semi")
    sets = stored(_sets(docs, involved.select("node", "d1", "d2"), shingle), folder, "sets")
    known = involved.select("node", "n", "v")

    def linked(pairs: DataFrame) -> DataFrame:
        """The links among pairs a, b; components() reads them once, so they aren't stored."""
        side = lambda c: known.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("v").alias(f"v{c}"))
        tried = looked_up(pairs.distinct().join(side("a"), "a"), side("b"), ["b"], "a")
        return _confirmed(_filtered(tried, percent, agree), sets, percent)

    links = linked(members.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")))
    comps = components(links, folder, "first")
    more = lambda found: comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(found)

    # what is outside its bucket's largest component is tried against a node of that one, so that little is left to compare
    left = stored(_unjoined(members.where("size > 2"), comps), folder, "left_0")
    links = linked(left.where("comp <> major").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")))
    comps = components(more(links), folder, "second")
    left = stored(_unjoined(left, comps), folder, "left_1")
    cut = sets.join(left.select("node").distinct(), "node", "left_semi").select("node", F.transform("shingles", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("s"))
    found = stored(_rest(left.join(known, "node").join(cut, "node"), percent, agree).distinct(), folder, "found")
    comps = components(more(_confirmed(found, sets, percent)), folder, "all")
    for name in ("sets", "nodes", "members", "left_0", "left_1", "found"):
        dropped(spark, f"{folder}/{name}")

    moved = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).where("copies > 1 OR comp <> node").select("d1", "d2", F.col("comp").alias("component_id"))
    found = looked_up(rows.where("n > 0").select("doc_id", "n", "d1", "d2"), moved, ["d1", "d2"], "doc_id", "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def query(docs: DataFrame) -> DataFrame:
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return groups(docs, shingle=2, percent=80).withColumn("kept", kept)


def stage(docs: DataFrame) -> DataFrame:
    """The rows, all columns, but for one of each component those that link to it: the smallest doc_id stays.

    A null id counts as the largest; rows that repeat an id are told apart by their texts, and of equal rows with words one stays.
    """
    repeated = docs.select(F.col("doc_id").cast("bigint").alias("id")).groupBy("id").count().where("id IS NULL OR count > 1")
    gone = lambda found: found.where("doc_id <> component_id").select(F.col("doc_id").alias(f"{OWN}gone")).distinct()
    if repeated.isEmpty():
        return docs.join(gone(groups(docs)), docs["doc_id"] == F.col(f"{OWN}gone"), "left_anti")
    # ids don't tell the rows apart: numbers of (id, text) do
    own = docs.withColumn(f"{OWN}id", F.col("doc_id").cast("bigint")).withColumn(f"{OWN}tag", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    order = [F.col(f"{OWN}id").asc_nulls_last(), F.col(f"{OWN}tag")]
    rows = numbered(own.select(f"{OWN}id", f"{OWN}tag").distinct(), order)[0].withColumnsRenamed({f"{OWN}id": f"{OWN}i", f"{OWN}tag": f"{OWN}t"})
    own = own.join(rows, F.col(f"{OWN}id").eqNullSafe(F.col(f"{OWN}i")) & (F.col(f"{OWN}tag") == F.col(f"{OWN}t")))
    own = stored(own, shared_dir(docs.sparkSession), "numbered")
    kept = own.join(gone(groups(own.select(F.col(f"{OWN}row").alias("doc_id"), "text"))), own[f"{OWN}row"] == F.col(f"{OWN}gone"), "left_anti")
    worded = F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    return kept.where(worded).dropDuplicates([f"{OWN}row"]).union(kept.where(~worded)).select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id, coalesce(m.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""
