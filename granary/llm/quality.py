"""Quality by an interpolated modified Kneser-Ney model over Unicode characters (operator 8).

The model is trained on trusted text: the documents whose label says that their quality is good, but for one in FOLDS,
which are kept aside for the thresholds. Its symbols are the code points of a text as they stand, without an alphabet,
and where a word repeats the one before it a symbol for the number of repetitions so far, so that a run of one word is
as unlikely as it is long. Every n-gram of trusted text counts, so the model grows with it:

1. Each task counts the n-grams of its texts; counts are summed in shards by n-gram. Continuation counts, discounts and
   interpolated probabilities of the lower orders and weights of contexts come from joins of those shards.
2. Documents are taken in blocks of BLOCK rows. Each block asks for its distinct n-grams, once each: the asked ones meet
   the model in shards by their hash, so no worker holds more of the model than a shard, and what was found goes back to
   the block, where it meets the texts, which are moved compressed. A document's bits are summed over its whole text.
3. A document's perplexity has PRIOR symbols of its language's usual perplexity added, so a short text isn't judged by
   a few symbols. It is rejected where its perplexity lies above its language's threshold: the QUANTILE of the trusted
   documents kept aside, times SLACK.

Defined results: null and empty texts have no symbols and their language's usual perplexity, and are kept; a null
language is a language of its own; a language with fewer than LEAST documents kept aside takes the quantile of all;
where none is kept aside, all trusted ones give the quantiles; a perplexity equal to the threshold is kept; with no
trusted text all documents are kept, with a null perplexity; rows with a null id are scored, and never trusted;
repeated rows each give their row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.batches import SLICE_CHARS, released
from granary.session import materialize

ORDER = 5
PRIOR = 60
QUANTILE, SLACK, LEAST, FOLDS = 0.99, 1.25, 30, 5
BLOCK = 8192
#: A shard of the model holds about so many n-grams (24 bytes each).
SHARD = 100_000
#: So many symbols are taken at once; a worker holds some hundred bytes for each.
PART = SLICE_CHARS // 4
#: Up to so many ids of trusted documents are broadcast (8 bytes each); beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 2_000_000

#: The start of a text, and repetitions of a word: code points that aren't characters or are for private use.
START, REPEAT, REPEATS = "\uffff", 0xF0000, 0xFFFD
LEAD = np.full(ORDER - 1, ord(START), np.uint32)
_odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3], np.uint64)
_salt = np.arange(ORDER + 1, dtype=np.uint64) * _odd[5]


# n-grams


def symbols(text: str) -> np.ndarray:
    """The text's code points; where a word repeats the one before it on its line, a symbol for how often by then."""
    words = text.split()
    if any(map(str.__eq__, words, words[1:])):
        lines = []
        for line in text.split("\n"):
            out, before, run = [], "", 0
            for w in line.split():
                run = run + 1 if w == before else 0
                out.append(chr(REPEAT + min(run, REPEATS)) if run else f" {w}")
                before = w
            lines.append("".join(out)[1:])
        text = "\n".join(lines)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x + _salt[k]) ^ (x >> np.uint64(31))
    x = x * _odd[1]
    return x ^ (x >> np.uint64(29))


def keys_of(codes: np.ndarray) -> np.ndarray:
    """64-bit keys of the n-grams in the rows of a matrix of code points."""
    k = codes.shape[1]
    x = np.zeros(len(codes), np.uint64)
    for j in range(k):
        x += codes[:, k - 1 - j].astype(np.uint64) * _odd[j]
    return _mixed(x, k)


def items_of(texts: Iterator[tuple[int, str]], chars: int = PART) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Lists of (owner, symbols before, symbols) of about `chars` symbols in all; long texts come in several parts."""
    held, items = 0, []
    for owner, text in texts:
        codes, lead = symbols(text), LEAD
        for lo in range(0, codes.size, chars):
            part = codes[lo : lo + chars]
            items.append((owner, lead, part))
            lead = codes[max(0, lo + chars - ORDER + 1) : lo + chars] if chars >= ORDER - 1 else LEAD
            held += part.size
            if held >= chars:
                yield items
                held, items = 0, []
    if items:
        yield items


class Windows:
    """The n-grams of highest order of some items: .keys, their code points on demand, and each one's item."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]]):
        self.codes = np.concatenate([c for _, lead, part in items for c in (lead, part)])
        sizes = np.array([part.size for *_, part in items])
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.at = np.arange(sizes.sum()) + (self.item + 1) * (ORDER - 1)
        x = np.zeros(self.codes.size - ORDER + 1, np.uint64)
        wide = self.codes.astype(np.uint64)
        for j in range(ORDER):
            x += wide[ORDER - 1 - j : wide.size - j] * _odd[j]
        self.keys = _mixed(x, ORDER)[self.at - ORDER + 1]

    def rows(self, which: np.ndarray) -> np.ndarray:
        return self.codes[self.at[which][:, None] + np.arange(1 - ORDER, 1)]


class Seen:
    """A direct-mapped memory of keys with a value each, in bounded space: what isn't found may have been there."""

    def __init__(self, bits: int = 20):
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.float32)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """First places of the distinct keys that aren't there."""
        away = np.flatnonzero(self.keys[keys >> self.shift] != keys)
        return away[np.unique(keys[away], return_index=True)[1]]

    def put(self, keys: np.ndarray, values=0) -> None:
        slot = keys >> self.shift
        self.keys[slot] = keys
        self.values[slot] = values


# training


def count_grams(docs: DataFrame, text_col: str = "text", hold: int = 2_000_000) -> DataFrame:
    """gram, n: counts of all n-grams of highest order of all texts, summed in each task before they are shuffled."""
    out = pa.schema([("gram", pa.string()), ("n", pa.int64())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, codes, names, counts, held = Seen(), [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, first = np.unique(np.concatenate(names), return_index=True)
            names.clear()  # each list goes as it is used
            rows = np.concatenate(codes)
            codes.clear()
            rows, n = rows[first], np.zeros(key.size, np.int64)
            while counts:
                k, c = counts.pop()
                n[np.searchsorted(key, k)] += c
            for lo in range(0, key.size, 50_000):
                part = np.ascontiguousarray(rows[lo : lo + 50_000])
                text = part.view(f"<U{ORDER}").ravel().tolist()
                yield pa.RecordBatch.from_arrays([pa.array([t.ljust(ORDER, "\0") for t in text], pa.string()), pa.array(n[lo : lo + 50_000])], schema=out)

        texts = ((0, t) for batch in batches for t in (x.as_py() for x in batch.column(0)) if t)
        for items in items_of(texts):
            w = Windows(items)
            new = seen.missing(w.keys)
            seen.put(w.keys[new])
            names.append(w.keys[new])
            codes.append(w.rows(new))
            counts.append(np.unique(w.keys, return_counts=True))
            held += counts[-1][0].size
            if held > hold:
                yield from flush()
                seen, codes, names, counts, held = Seen(), [], [], [], 0
        if counts:
            yield from flush()

    parts = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "gram string, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(level: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ of modified Kneser-Ney from the counts of counts."""
    n = {r.n: r.m for r in level.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.01), i) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3 if n3 else 0.9)))


def train(trusted: DataFrame, text_col: str = "text") -> tuple[DataFrame, float]:
    """gram, p, w: the interpolated probability of each n-gram of each order, and its weight for lower orders as a context;
    and the probability of a symbol that trusted text doesn't have.
    """
    spark = trusted.sparkSession
    levels = [materialize(spark, count_grams(trusted, text_col), "grams")]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different symbols stand before
        levels.insert(0, materialize(spark, levels[0].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams"))
    parts, lower, unseen = [], None, 0.0
    for k, level in enumerate(levels, 1):
        d1, d2, d3 = discounts(level)
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        level = level.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("cut", cut)
        if lower is None:
            r = level.agg(F.sum("n").alias("total"), F.sum("cut").alias("cut"), F.count(F.lit(1)).alias("kinds")).first()
            unseen = r["cut"] / r["total"] / (r["kinds"] + 1)
            probable = level.select("gram", ((F.col("n") - F.col("cut")) / r["total"] + unseen).alias("p"))
        else:
            contexts = materialize(spark, level.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight")), "contexts")
            parts.append(contexts.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), F.col("weight").alias("w")))
            below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            joined = level.join(contexts, "context").withColumn("suffix", F.substring("gram", 2, k - 1)).join(below, "suffix")
            probable = joined.select("gram", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * F.col("below")).alias("p"))
        lower = materialize(spark, probable, "probabilities")
        parts.append(lower.select("gram", "p", F.lit(None).cast("double").alias("w")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return materialize(spark, whole.groupBy("gram").agg(F.max("p").alias("p"), F.max("w").alias("w")), "model"), unseen


# scoring

_codec = pa.Codec("zstd", compression_level=1)

#: Rows that are dealt out by key: of the model (kind 0) and questions (1) by shard; answers (0) and texts (1) by block.
_packed = "key long, kind int, block long, size long, keys binary, p binary, w binary"
_packed_arrow = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("p", pa.binary()), ("w", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_packed_arrow)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of an array, compressed by their place in its values."""
    return _codec.compress(np.ascontiguousarray(x.view(np.uint8).reshape(x.size, x.itemsize).T), asbytes=True)


def _from_planes(data: bytes, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_codec.decompress(data, n * width), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _keys_row(key: int, kind: int, keys: np.ndarray, p: np.ndarray | None = None, w: np.ndarray | None = None, block: int | None = None) -> dict:
    """A row of sorted keys, as their differences, with their values."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return {"key": key, "kind": kind, "block": block, "size": keys.size, "keys": _planes(gaps)} | ({} if p is None else {"p": _planes(p), "w": _planes(w)})


def _keys(row: dict) -> np.ndarray:
    return np.cumsum(_from_planes(row["keys"], np.uint64, row["size"]), dtype=np.uint64)


def _found(row: dict) -> list[np.ndarray]:
    """keys, p, w of a row."""
    return [_keys(row), *(_from_planes(row[c], np.float32, row["size"]) for c in ("p", "w"))]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """(shard, where) of sorted keys."""
    shard = _shard(keys, shards)
    bounds = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if keys.size else np.zeros(1, np.int64)
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        yield int(shard[lo]), slice(lo, hi)


def _model_keys(shards: int):
    """gram, p, w to rows (key: shard, keys, p, w) of sorted keys."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column(0).to_pylist()
            keys = np.zeros(len(grams), np.uint64)
            by: dict[int, list[int]] = {}
            for i, g in enumerate(grams):
                by.setdefault(len(g), []).append(i)
            for k, which in by.items():
                codes = np.frombuffer("".join(grams[i] for i in which).encode("utf-32-le"), np.uint32).reshape(-1, k)
                keys[which] = keys_of(codes)
            order = np.argsort(keys)
            p, w = (np.array(b.column(c).to_pylist(), np.float64)[order].astype(np.float32) for c in (1, 2))  # None: nan
            keys = keys[order]
            rows = [_keys_row(s, 0, keys[at], p[at], w[at]) for s, at in _by_shard(keys, shards)]
            if rows:
                yield _batch(rows)

    return run


def _asked(shards: int):
    """(block, text) to rows (key: shard, block, keys): all n-grams, and contexts, that each block's texts need."""

    def ask(block: int, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(rows)
        need = [keys_of(codes[:, ORDER - k :]) for k in range(1, ORDER + 1)] + [keys_of(codes[:, ORDER - k : -1]) for k in range(2, ORDER + 1)]
        keys = np.unique(np.concatenate([np.unique(x) for x in need]))
        yield _batch([_keys_row(s, 1, keys[at], block=block) for s, at in _by_shard(keys, shards)])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, seen = None, [], Seen()
        for b in batches:
            blocks = b.column(0).to_numpy(zero_copy_only=False)
            bounds = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True]).tolist() if len(blocks) else []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if now != blocks[lo]:
                    if rows:
                        yield from ask(now, rows)
                    now, rows, seen = int(blocks[lo]), [], Seen()
                for items in items_of((0, t) for t in (x.as_py() for x in b.column(1).slice(lo, hi - lo)) if t):
                    w = Windows(items)
                    new = seen.missing(w.keys)
                    seen.put(w.keys[new])
                    rows.append(w.rows(new))
        if rows:
            yield from ask(now, rows)

    return run


def _columns(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    columns = [batch.column(i) for i in range(batch.num_columns)]
    for i in range(batch.num_rows):
        yield {n: c[i].as_py() for n, c in zip(names, columns, strict=True)}


@released
def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the model, then of questions, shard by shard, to rows (key: block, keys, p, w) of what was found."""
    now, parts, model = None, [], None
    for b in batches:
        for r in _columns(b):
            if r["key"] != now:
                now, parts, model = r["key"], [], None
            if r["kind"] == 0:
                parts.append(_found(r))
                continue
            if model is None:
                if not parts:
                    continue
                model = _merged(parts)
            keys, p, w = model
            at = np.searchsorted(keys, asked := _keys(r))
            at[at == keys.size] = 0
            at = at[keys[at] == asked]
            if at.size:
                yield _batch([_keys_row(r["block"], 0, keys[at], p[at], w[at])])


def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """keys, p, w of all parts by key. Takes the parts, which go column by column, so little is held twice."""
    if not parts:
        return [np.empty(0, np.uint64), np.empty(0, np.float32), np.empty(0, np.float32)]
    columns = [list(x) for x in zip(*parts, strict=True)]
    parts.clear()
    keys = np.concatenate(columns.pop(0))
    order = np.argsort(keys)
    out = [keys[order]]
    del keys
    while columns:
        out.append(np.concatenate(columns.pop(0))[order])
    return out


def bits_of(codes: np.ndarray, model: list[np.ndarray], unseen: float) -> np.ndarray:
    """-log2 of the probability of each n-gram of highest order, in a model of (keys, p, w)."""
    keys, p, w = model

    def looked_up(of: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not keys.size:
            return np.full(len(of), np.nan, np.float32)
        at = np.searchsorted(keys, of)
        at[at == keys.size] = 0
        return np.where(keys[at] == of, values[at], np.nan)

    out = np.full(len(codes), unseen)
    for k in range(1, ORDER + 1):
        own = looked_up(keys_of(codes[:, ORDER - k :]), p)
        if k > 1:  # a context that was never seen leaves all to the lower order
            out = out * np.nan_to_num(looked_up(keys_of(codes[:, ORDER - k : -1]), w), nan=1.0)
        out = np.where(np.isnan(own), out, own)
    return -np.log2(out)


@released
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, row, doc_id, lang, text) to rows (key: block, keys: compressed batches of the other columns, size: plain)."""
    codec = pa.Codec("zstd", compression_level=6)
    for b in batches:
        blocks = b.column(0).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.binary_length(b.column(4)), 0).to_pylist()
        lo = held = 0
        for i in range(b.num_rows + 1):
            if i > lo and (i == b.num_rows or blocks[i] != blocks[lo] or held + sizes[i] > 4 * SLICE_CHARS):
                part = pa.RecordBatch.from_arrays([b.column(k).slice(lo, i - lo) for k in range(1, 5)], names=["row", "doc_id", "lang", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                plain = sink.getvalue()
                yield _batch([{"key": int(blocks[lo]), "kind": 1, "size": plain.size, "keys": codec.compress(plain, asbytes=True)}])
                lo, held = i, 0
            held += sizes[i] if i < b.num_rows else 0


_scored = "row long, doc_id long, lang string, n_symbols long, bits double"


def _scorer(unseen: float):
    """Rows of what was found, then of texts, block by block, to the bits of each text."""
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("bits", pa.float64())])

    def score(rows: list[dict], model: list[np.ndarray], seen: Seen) -> pa.RecordBatch:
        n, bits = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for items in items_of((i, r["text"]) for i, r in enumerate(rows) if r["text"]):
            w = Windows(items)
            slot = w.keys >> seen.shift
            value = seen.values[slot]
            away = np.flatnonzero(seen.keys[slot] != w.keys)
            if away.size:
                key, first, back = np.unique(w.keys[away], return_index=True, return_inverse=True)
                new = bits_of(w.rows(away[first]), model, unseen).astype(np.float32)
                value[away] = new[back]
                seen.put(key, new)
            sums = np.bincount(w.item, value, len(items))
            for (owner, _, part), s in zip(items, sums, strict=True):
                n[owner] += part.size
                bits[owner] += s
        columns = [[r[c] for r in rows] for c in ("row", "doc_id", "lang")] + [n, bits]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out.types, strict=True)], schema=out)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        now, parts, model, seen = None, [], None, None
        for b in batches:
            for r in _columns(b):
                if r["key"] != now:
                    now, parts, model = r["key"], [], None
                if r["kind"] == 0:
                    parts.append(_found(r))
                    continue
                if model is None:
                    model, seen = _merged(parts), Seen()
                texts = pa.ipc.open_stream(codec.decompress(r["keys"], r["size"])).read_next_batch()
                for lo in range(0, texts.num_rows, 2000):
                    yield score(texts.slice(lo, 2000).to_pylist(), model, seen)

    return run


def _in_blocks(docs: DataFrame, row_col: str | None) -> DataFrame:
    """block, row, doc_id, lang, text; a block is a run of rows of one file, the same in each reading."""

    def columns(df: DataFrame, row) -> DataFrame:
        block = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BLOCK))
        return df.select(block.alias("block"), row.cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    row = F.col(f"`{row_col}`") if row_col else F.lit(None)
    try:
        return columns(docs, row)
    except AnalysisException:  # not read from Parquet files: written first
        plain = docs.select(row.cast("long").alias("row"), "doc_id", "lang", "text")
        return columns(materialize(docs.sparkSession, plain, "documents"), F.col("row"))


def perplexities(rows: DataFrame, model: DataFrame, unseen: float) -> DataFrame:
    """row, doc_id, lang, n_symbols and bits (in all) of every whole text of rows (block, row, doc_id, lang, text)."""
    spark = rows.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-model.count() // SHARD))
    known = model.select("gram", "p", "w").mapInArrow(_model_keys(shards), _packed)
    asked = rows.select("block", "text").mapInArrow(_asked(shards), _packed)
    answered = _by_key(known.unionByName(asked)).mapInArrow(_answered, _packed)
    texts = rows.select("block", "row", "doc_id", "lang", "text").mapInArrow(_texts, _packed)
    return _by_key(answered.unionByName(texts)).mapInArrow(_scorer(unseen), _scored)


def _by_key(df: DataFrame) -> DataFrame:
    return df.repartition("key").sortWithinPartitions("key", "kind")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, row_col: str | None = None) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, kept of every document, and `row` where row_col names its number."""
    spark = docs.sparkSession
    columns = ["row", "doc_id"] if row_col else ["doc_id"]
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).dropDuplicates()
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    hint = F.broadcast if few else lambda df: df
    rows = _in_blocks(docs, row_col)
    trusted = rows.select("doc_id", "text").join(hint(good), "doc_id", "left_semi").where("text <> ''")
    fitted = trusted.where(~aside)
    fitted = trusted if fitted.isEmpty() else fitted
    if fitted.isEmpty():
        return rows.select(*columns, "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_symbols"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    model, unseen = train(fitted)
    scored = materialize(spark, perplexities(rows, model, unseen), "bits")
    of = scored.join(hint(good), "doc_id", "left_semi").where("n_symbols > 0")
    held = of.where(aside)
    of = materialize(spark, of if held.isEmpty() else held, "aside")
    usual = of.groupBy("lang").agg((F.sum("bits") / F.sum("n_symbols")).alias("usual"), F.count(F.lit(1)).alias("seen"))
    overall = of.agg((F.sum("bits") / F.sum("n_symbols")).alias("usual")).first().usual

    def with_perplexity(df: DataFrame) -> DataFrame:
        rate = (F.col("bits") + PRIOR * F.coalesce("usual", F.lit(overall))) / (F.col("n_symbols") + PRIOR)
        return df.withColumn("perplexity", F.pow(F.lit(2.0), rate))

    usual = materialize(spark, usual, "languages")
    near = with_perplexity(of.join(usual, of.lang.eqNullSafe(usual.lang), "left").select(of.lang, "bits", "n_symbols", "usual"))
    limits = near.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("limit"))
    limit_all = near.agg(F.percentile_approx("perplexity", quantile, 10_000).alias("limit")).first().limit
    limits = materialize(spark, limits.withColumnRenamed("lang", "lang_"), "limits")
    usual = usual.join(limits, usual.lang.eqNullSafe(limits.lang_), "left").select(F.col("lang").alias("of_lang"), "usual", "seen", "limit")
    full = with_perplexity(scored.join(usual, scored.lang.eqNullSafe(usual.of_lang), "left"))
    limit = F.when(F.col("seen") >= LEAST, F.col("limit")).otherwise(F.lit(limit_all)) * slack
    full = full.withColumn("threshold", limit)
    return full.select(*columns, "lang", "n_symbols", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("kept"))
