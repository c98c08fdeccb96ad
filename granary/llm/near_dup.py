"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find (operator 2).

1. Each text becomes its set of 5-word shingles (64-bit hashes) and a SuperMinHash signature: every shingle deals
   itself one slot after the other in an order drawn from its hash, with rank + fraction as its value. Ranks are worked
   off level by level over arrays; a text stops at the level that fills its last slot.
2. Rows with the same set are one class, whatever their ids; copies never reach a pair.
3. BANDS bands of ROWS slots put classes into buckets: a pair at the threshold shares none with probability
   (1 - 0.75 ** 4) ** 32 = 5e-6.
4. Candidates stay linear in the buckets' members. First each member meets its bucket's smallest class. Buckets that
   still hold several groups are dealt out in blocks of about BLOCK members, each with the same PIVOTS members from
   outside the bucket's largest group, and the groups of a block are joined by their most alike pairs. Then a bucket of
   one block, or one with no more than PIVOTS members outside its largest group, is finished: its blocks hold every
   pair that could still join groups, members with an alike one in another group (their signatures agree in LEAST of
   the slots, which a linked pair misses with a chance of 5e-8) are compared on full sets by matrix products, and links
   that join groups come out. A bucket that is neither is split by SPLITS bands of further slots, drawn from its key,
   and its parts are worked off alike. After LEVELS such splits the members outside the largest group take turns as
   pivots until each has been one, so the rest is compared in full, in rounds that are each linear.
5. Candidates are confirmed on full sets, cut from the texts again for the classes that are in one. Links grow into
   components by alternating large and small stars, round by round on tables in the shared folder.

Joins by a key that many rows share (a bucket, a pivot) deal that key out over several tasks (`spread_join`).

Defined results: words are what stands between [\\x20\\x09-\\x0D], with A-Z in lower case; fewer than five words are one
shingle; null, empty and blank texts have no shingle, are linked with nothing, and have their own id as component.
Rows are grouped by their texts, so an id that stands in rows of different texts joins nothing, and each of its rows
gets the component of its own text. component_id is the smallest id in a component that isn't null; rows with a null
id take part, and are kept only where their whole component has null ids (component_id is null then). Rows that repeat
id and text each give the same row. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.batches import arrow_schema, id_text, map_texts, released, remembered
from granary.llm.byte_bpe import Pieces
from granary.session import materialize

WIDTH = 5
SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
LEAST = 0.55
BLOCK, PIVOTS = 1024, 128
SPLITS, LEVELS = 6, 4
#: Up to so many ids are broadcast (8 bytes each); beyond, rows are joined by shuffles.
BROADCAST_IDS = 500_000
#: Up to so many links are united in one task (about 100 MB of its memory); beyond, by rounds of joins.
ONE_TASK = 500_000
UNSET = np.uint64(2**64 - 1)
_odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


_steps = np.arange(1, SLOTS + 1, dtype=np.uint64) * _odd[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words() -> Pieces:
    return remembered("near_dup", lambda: Pieces(lambda new: [xxhash.xxh3_64_intdigest(w) for w in new]))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted, distinct shingle hashes of each text."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    known = _words().learn({w for ws in words for w in ws})
    out = []
    for ws in words:
        n = len(ws)
        h = np.fromiter(map(known.__getitem__, ws), np.uint64, n)
        if n >= WIDTH:
            s = h[: n - WIDTH + 1] * _odd[0]
            for k in range(1, WIDTH):
                s = s + h[k : n - WIDTH + 1 + k] * _odd[k]
            out.append(np.unique(mix(s)))
        elif n:
            out.append(mix(np.array([(h * _odd[:n]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], block: int = 32_768) -> np.ndarray:
    """SuperMinHash of each set: SLOTS values, UNSET for an empty set."""
    sig = np.full((len(sets), SLOTS), UNSET)
    lo = 0
    while lo < len(sets):
        hi, held = lo, 0
        while hi < len(sets) and (hi == lo or held + sets[hi].size <= block):
            held += sets[hi].size
            hi += 1
        _sign(sets[lo:hi], sig[lo:hi])
        lo = hi
    return sig


def _sign(sets: list[np.ndarray], sig: np.ndarray) -> None:
    e = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    flat = sig.reshape(-1)
    x = mix(e + _odd[0])
    first = (x >> np.uint64(57)).astype(np.int64)
    np.minimum.at(flat, doc * SLOTS + first, x & np.uint64(2**32 - 1))
    open_ = (sig == UNSET).any(axis=1)
    on = open_[doc]
    e, doc, first = e[on], doc[on], first[on]
    order = np.tile(np.arange(SLOTS, dtype=np.uint8), (e.size, 1))
    row = np.arange(e.size)
    order[row, first] = 0
    order[:, 0] = first
    for level in range(1, SLOTS):
        if not e.size:
            return
        x = mix(e + _steps[level])
        k = level + ((x >> np.uint64(32)) % np.uint64(SLOTS - level)).astype(np.int64)
        slot = order[row, k]
        order[row, k] = order[:, level]
        order[:, level] = slot
        np.minimum.at(flat, doc * SLOTS + slot, (x & np.uint64(2**32 - 1)) | np.uint64(level << 32))
        open_ = (sig == UNSET).any(axis=1)
        on = open_[doc]
        if on.sum() < 0.8 * e.size:
            e, doc, order = e[on], doc[on], order[on]
            row = np.arange(e.size)


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band of each signature."""
    v = mix(sig + _odd[1]).reshape(len(sig), BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)[None, :] * _odd[2]
    for r in range(ROWS):
        out = mix(out * _odd[3] + v[:, :, r])
    return out.view(np.int64)


def text_key(text: str) -> int:
    """What Spark's xxhash64 gives for the text."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - 2**64 if h >= 2**63 else h


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, buckets, sig (a byte for each slot) of each text."""

    def start():
        def work(ids: list, texts: list[str]) -> list:
            sets = shingle_sets(texts)
            sig = signatures(sets)
            small = (mix(sig) & np.uint64(255)).astype(np.uint8)
            bands = bands_of(sig)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            return [ids, [text_key(t) for t in texts], [s.size for s in sets], keys, [b.tolist() if s.size else [] for b, s in zip(bands, sets, strict=True)], [x.tobytes() for x in small]]

        return work

    return map_texts(docs, "doc_id long, text_key long, n_shingles long, set_key binary, buckets array<long>, sig binary", start, id_col, text_col)


def full_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, set_key and the set, as sorted 64-bit hashes, of each text."""

    def start():
        def work(ids: list, texts: list[str]) -> list:
            packed = [s.tobytes() for s in shingle_sets(texts)]
            return [ids, [hashlib.blake2b(p, digest_size=16).digest() for p in packed], packed]

        return work

    return map_texts(docs, "rep long, set_key binary, members binary", start, id_col, text_col)


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


@released
def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sig, sig) to those (a, b) whose signatures agree in LEAST of the slots."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SLOTS) for i in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= LEAST * SLOTS)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


@released
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set, set) to those (a, b) with 100 * intersection >= 75 * union."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = _numbers(x.as_py()), _numbers(y.as_py())
            both = np.sort(np.concatenate([x, y]))
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= 75 * (x.size + y.size - shared))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, sizes: DataFrame | None = None) -> DataFrame:
    """left joined to right, which has one row for each key; rows of left that share a key with many are dealt out.

    A key is spread if it has over a quarter of a task's fair share of left's rows (512 at least), so there are at
    most four such keys for each shuffle partition, whatever the input: these are what is broadcast. `sizes` (key,
    size) saves counting left's keys.
    """
    spark = left.sparkSession
    if sizes is None:
        sizes = materialize(spark, left.groupBy(key).agg(F.count(F.lit(1)).alias("size")).where("size > 512"), "sizes")
        total = left.count() if not sizes.isEmpty() else 0
    else:
        total = sizes.agg(F.sum("size")).first()[0] or 0
    bar = max(512, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = sizes.where(F.col("size") > bar).select(key, F.ceil(F.col("size") / bar).cast("int").alias("parts"))
    if hot.isEmpty():
        return left.join(right, key)
    salted = left.join(F.broadcast(hot), key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by, F.lit(11)), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    each = right.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return salted.join(each, [key, "salt"]).drop("salt")


def _with_both(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
    """a, b and the value of each; a is the smaller one, which may be in very many pairs."""
    one = spread_join(pairs, of.select(F.col("rep").alias("a"), F.col(value).alias("of_a")), "a", "b")
    return one.join(of.select(F.col("rep").alias("b"), F.col(value).alias("of_b")), "b").select("a", "b", "of_a", "of_b")


@released
def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of every linked node that isn't its component's smallest, from all edges (a, b)."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, root (its component's smallest id) of every linked node that isn't a root itself.

    Up to `one_task` edges are united in one task; beyond, and with the same result, large and small stars alternate.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    first = True
    while True:
        edges = materialize(spark, edges, "edges")
        if first and edges.count() <= one_task:
            return materialize(spark, edges.coalesce(1).mapInArrow(_union_find, "node long, root long"), "roots")
        first = False
        # done when they are stars: every child has one parent, and no parent is a child
        ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        knots = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        if knots.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = materialize(spark, both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The rows (bucket, part, rep, root, value), sorted by the first two, of each (bucket, part)."""
    rows: list = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and rows[0][:2] != r[:2]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(map(min, a, b), pa.int64()), pa.array(map(max, a, b), pa.int64())], names=["a", "b"])


@released
def _block_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the most alike pairs that would join its groups: fewer pairs than members (Boruvka's rounds)."""
    for rows in _blocks(batches):
        ids = [r[2] for r in rows]
        _, group = np.unique(np.array([r[3] for r in rows], np.int64), return_inverse=True)
        if not group.max():
            continue
        sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, SLOTS)
        like = np.empty((len(rows), len(rows)), np.uint8)
        for i in range(len(rows)):
            like[i] = (sig == sig[i]).sum(axis=1)
        a, b = [], []
        while group.max():
            best = np.where(group[:, None] != group[None, :], like, 0)
            to = best.argmax(axis=1)
            value = best[np.arange(len(rows)), to]
            found = False
            for g in range(int(group.max()) + 1):
                own = np.flatnonzero(group == g)
                i = own[value[own].argmax()] if own.size else 0
                if own.size and value[i] >= LEAST * SLOTS and group[i] != group[to[i]]:
                    a.append(ids[i])
                    b.append(ids[int(to[i])])
                    group[own] = group[to[i]]
                    found = True
            if not found:
                break
            _, group = np.unique(group, return_inverse=True)
        if a:
            yield _pairs(a, b)


_member = pa.schema([("bucket", pa.int64()), ("part", pa.int32()), ("rep", pa.int64()), ("root", pa.int64())])


@released
def _block_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block those members that have an alike one of another group."""
    for rows in _blocks(batches):
        roots = np.array([r[3] for r in rows], np.int64)
        sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, SLOTS)
        hit = np.zeros(len(rows), bool)
        for k in range(len(rows)):
            if not hit[k]:
                near = np.flatnonzero(roots != roots[k])
                near = near[(sig[near] == sig[k]).sum(axis=1) >= LEAST * SLOTS]
                hit[near] = True
                hit[k] = near.size > 0
        kept = [rows[k][:4] for k in np.flatnonzero(hit).tolist()]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), _member.types, strict=True)], schema=_member)


@released
def _block_links(batches: Iterator[pa.RecordBatch], columns: int = 4096) -> Iterator[pa.RecordBatch]:
    """Links by full sets between members of different groups; as few as join what they join.

    All intersections of a block come from products of its incidence matrix, a strip of shingles at a time; shingles of
    one member alone don't matter.
    """
    for rows in _blocks(batches):
        ids, n = [r[2] for r in rows], len(rows)
        sets = [_numbers(r[4]) for r in rows]
        sizes = np.array([s.size for s in sets])
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times > 1
        place = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(n), sizes)[shared[column]]
        column = place[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((n, n), np.float32)
        for lo in range(0, int(shared.sum()), columns):
            at = slice(*np.searchsorted(column, [lo, lo + columns]).tolist())
            strip = np.zeros((n, columns), np.float32)
            strip[owner[at], column[at] - lo] = 1
            both += strip @ strip.T
        link = 100 * both >= 75 * (sizes[:, None] + sizes[None, :] - both)
        _, group = np.unique(np.array([r[3] for r in rows], np.int64), return_inverse=True)
        a, b = [], []
        for k in range(n):
            for t in np.flatnonzero(link[k] & (group != group[k])).tolist():
                if group[t] != group[k]:
                    a.append(ids[k])
                    b.append(ids[t])
                    group[group == group[t]] = group[k]
        if a:
            yield _pairs(a, b)


@released
def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SPLITS narrower buckets of each (bucket, rep, sig): by ROWS slots each that the bucket's key draws."""
    for batch in batches:
        if batch.num_rows:
            bucket = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, SLOTS)
            for j in range(SPLITS):
                draw = mix(bucket + _steps[j])
                key, row = draw, np.arange(len(sig))
                for r in range(ROWS):
                    slot = ((draw >> np.uint64(8 * r)) % np.uint64(SLOTS)).astype(np.int64)
                    key = mix(key * _odd[3] + sig[row, slot].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(1)], names=["bucket", "rep"])


class _Groups:
    """Classes, the sets that were cut so far, and the groups that links have joined (node, root)."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.spark, self.docs, self.classes = docs.sparkSession, docs, classes
        self.sigs = classes.select("rep", "sig")
        self.sets: list[DataFrame] = []  # in as many parts as rounds
        self.roots: DataFrame | None = None

    def with_sets(self, wanted: DataFrame) -> DataFrame:
        """The sets of all classes so far, with those of `wanted` (rep, distinct)."""
        for s in self.sets:
            wanted = wanted.join(s.select("rep"), "rep", "left_anti")
        wanted = materialize(self.spark, wanted.join(self.classes.select("rep", "set_key", "text_key", "first_id"), "rep"), "wanted")
        if not self.sets or not wanted.isEmpty():
            few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
            one = wanted.select("rep", F.col("text_key").alias("k"), F.col("first_id").alias("i"))
            texts = self.docs.withColumn("text_key", F.xxhash64("text"))
            texts = texts.join(F.broadcast(one) if few else one, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i")))
            cut = full_sets(texts.select("rep", "text"), "rep", "text")
            # a text whose key another one shares isn't the class's; a row that stands twice counts once
            cut = cut.join(wanted.select("rep", "set_key"), ["rep", "set_key"], "left_semi") if not few else cut.join(F.broadcast(wanted.select("rep", "set_key")), ["rep", "set_key"], "left_semi")
            cut = cut.select("rep", "members")
            self.sets.append(materialize(self.spark, cut.dropDuplicates(["rep"]) if self.repeated else cut, "sets"))
        have = self.sets[0]
        for s in self.sets[1:]:
            have = have.unionByName(s)
        return have

    def confirmed(self, pairs: DataFrame, alike: bool) -> DataFrame:
        """The links among pairs (a < b); `alike`: their signatures were compared before."""
        pairs = materialize(self.spark, pairs.distinct(), "pairs")
        if not alike:
            pairs = materialize(self.spark, _with_both(pairs, self.sigs, "sig").mapInArrow(_alike, "a long, b long"), "alike")
        if pairs.isEmpty():
            return pairs
        have = self.with_sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct())
        return materialize(self.spark, _with_both(pairs, have, "members").mapInArrow(_linked, "a long, b long"), "links")

    def join(self, links: DataFrame) -> bool:
        """Whether there are links; they are joined to the groups."""
        if links.isEmpty():
            return False
        if self.roots is not None:
            links = links.unionByName(self.roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        self.roots = components(links)
        return True

    def mixed(self, members: DataFrame) -> DataFrame:
        """The members (bucket, rep) of buckets that hold several groups: bucket, rep, root, size, lesser, less.

        lesser: whether the member is outside the bucket's largest group; less: how many are.
        """
        at = members.select("bucket", "rep")
        if self.roots is None:
            at = at.withColumn("root", F.col("rep"))
        else:
            at = at.join(self.roots, at.rep == self.roots.node, "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
        groups = at.groupBy("bucket", "root").count().groupBy("bucket")
        stats = groups.agg(F.sum("count").alias("size"), F.max(F.struct("count", "root")).alias("top")).where("size > top.count")
        stats = materialize(self.spark, stats.select("bucket", "size", F.col("top.root").alias("top"), (F.col("size") - F.col("top.count")).alias("less")), "stats")
        full = spread_join(at, stats, "bucket", "rep", stats.select("bucket", "size")).select("bucket", "rep", "root", "size", (F.col("root") != F.col("top")).alias("lesser"), "less")
        return materialize(self.spark, full, "mixed")

    def blocks(self, of: DataFrame, turn: int) -> DataFrame:
        """bucket, part, rep, root: members of mixed buckets in blocks, with the same pivots in each block of a bucket."""
        parts, turns = F.ceil(F.col("size") / BLOCK).cast("int"), F.ceil(F.col("less") / PIVOTS)
        own = F.pmod(F.xxhash64("rep", F.lit(turn)), parts).cast("int")
        pivots = of.where("lesser").where(F.pmod(F.xxhash64("rep", F.lit(-1)), turns) == turn % turns)
        others = pivots.select("bucket", F.explode(F.filter(F.sequence(F.lit(0), parts - 1), lambda p: p != own)).alias("part"), "rep", "root")
        return of.select("bucket", own.alias("part"), "rep", "root").unionByName(others)

    def in_blocks(self, of: DataFrame, values: DataFrame, value: str) -> DataFrame:
        keys = ["bucket", "part"]
        return of.join(values.select("rep", value), "rep").repartition(*keys).sortWithinPartitions(*keys).select(*keys, "rep", "root", value)

    def finish(self, of: DataFrame, turn: int) -> None:
        """Join groups by all links inside blocks."""
        ddl = "bucket long, part int, rep long, root long"
        left = materialize(self.spark, self.in_blocks(self.blocks(of, turn), self.sigs, "sig").mapInArrow(_block_members, ddl), "left")
        if not left.isEmpty():
            have = self.with_sets(left.select("rep").distinct())
            self.join(materialize(self.spark, self.in_blocks(left, have, "members").mapInArrow(_block_links, "a long, b long"), "links"))

    def settle(self, members: DataFrame, level: int = 0) -> None:
        """Join the groups of members (bucket, rep) by the links that their buckets hold."""
        if level == 0:
            pivots = members.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
            pivots = materialize(self.spark, pivots, "pivots")
            members = materialize(self.spark, spread_join(members, pivots, "bucket", "rep", pivots.select("bucket", "size")), "buckets")
            pairs = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
            self.join(self.confirmed(pairs, False))
        rest = self.mixed(members)
        if level == 0 and not rest.isEmpty():
            in_blocks = self.in_blocks(self.blocks(rest, 0), self.sigs, "sig")
            if self.join(self.confirmed(in_blocks.mapInArrow(_block_forest, "a long, b long"), True)):
                rest = self.mixed(rest)
        narrow = rest.where((F.col("size") <= BLOCK) | (F.col("less") <= PIVOTS))
        if not narrow.isEmpty():
            self.finish(narrow, 0)
        wide = rest.where((F.col("size") > BLOCK) & (F.col("less") > PIVOTS))
        if wide.isEmpty():
            return
        if level < LEVELS:
            split = wide.select("bucket", "rep").join(self.sigs, "rep").select("bucket", "rep", "sig").mapInArrow(_split, "bucket long, rep long")
            self.settle(materialize(self.spark, split, "split"), level + 1)
            return
        turns = wide.agg(F.max(F.ceil(F.col("less") / PIVOTS)).alias("turns")).first().turns
        for turn in range(turns):
            self.finish(wide.where(F.ceil(F.col("less") / PIVOTS) > turn), turn)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    spark, docs = docs.sparkSession, id_text(docs, id_col, text_col)
    sketches = materialize(spark, sketch(docs, "doc_id", "text"), "sketches")
    filled = sketches.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    classes = filled.groupBy("set_key").agg(first, F.first("buckets").alias("buckets"), F.first("sig").alias("sig"))
    # written with its numbers, which stand for the classes from then on
    classes = classes.select("set_key", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("text_key"), F.monotonically_increasing_id().alias("rep"), "buckets", "sig")
    classes = materialize(spark, classes, "classes")
    groups = _Groups(docs, classes)
    groups.repeated = filled.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count() > 0
    groups.settle(classes.select(F.explode("buckets").alias("bucket"), "rep"))

    of = classes.select("set_key", "first_id", "rep")
    if groups.roots is None:
        grouped = of.select("set_key", F.col("first_id").alias("component"))
    else:
        of = of.join(groups.roots, of.rep == groups.roots.node, "left").select("set_key", "first_id", F.coalesce("root", "rep").alias("root"))
        least = of.groupBy("root").agg(F.min("first_id").alias("component"))
        grouped = of.join(least, "root").select("set_key", "component")
    out = sketches.select("doc_id", "n_shingles", "set_key").join(grouped, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
