"""Order-preserving packing of documents into sequences (operator 1).

The documents of a partition, in the order in which they are read, form one stream of tokens. Windows of at most
`window` tokens are cut from it by dynamic programming over the places where a cut may fall: document ends (free),
sentence ends (a small penalty) and, where neither comes for GRID tokens, places inside a sentence (a larger one).
With f(j) the least cost of everything before place j,

    f(j) = penalty(j) + window - pos(j) + min over i with pos(j) - pos(i) <= window of f(i) + pos(i),

and the minimum slides, so a monotone queue gives it in constant time. Padding counts one for each token. The rest
at the end of a partition is cut into powers of two, which need no padding. The stream is solved in segments of
bounded length; the last, open window of a segment starts the next one, so memory doesn't depend on the input.

There is no shuffle: the number of padded windows grows with partitions, not with documents. A sequence's number holds
the partition's number above SEQUENCE_BITS bits. A partition that is computed again gives the same rows as long as it
reads the same rows in the same order, as it does from files; write other inputs out first.

Defined results: null and empty texts are the end id alone; texts longer than the window are cut; repeated rows each
give their own pieces; an empty table gives an empty table; columns other than the id and the text are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from granary.llm.batches import arrow_schema, id_text, released, remembered, slices
from granary.llm.byte_bpe import byte_chars

#: A place inside a sentence is offered for a cut only after so many tokens without another place.
GRID = 64
#: What a cut costs, in tokens of padding.
AT_SENTENCE, INSIDE = 6, 24
SEQUENCE_BITS = 40
#: Tokens that are solved together.
SEGMENT = 1_000_000
ENDS = set(".!?…。！？")
#: Python splits at these, the tokenizer doesn't.
_separators = re.compile("[\x1c-\x1f]")


#: A word of Latin letters, between other signs. Such a core is one word to the tokenizer, and its case doesn't matter.
_signs = r"[!\"#$%&()*+,\-./:;=>?@\[\\\]^`{|}~]*"
_cored = re.compile(f"({_signs})([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+)({_signs})")


class Remembered(dict):
    """key -> solve(key), in two generations of up to `most` keys; keys of over 100 characters aren't kept."""

    def __init__(self, solve, most: int):
        self.solve, self.most, self.older = solve, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.solve(key)
        if len(key) <= 100:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordTokens:
    """ids of texts by a tokenizer that never joins across white space; ids of words are remembered.

    Most words are a core of Latin letters with signs around it. Cores are remembered apart, and go in lower case, spelled
    in the vocabulary's letters for bytes, straight to the tokenizer's model.
    """

    def __init__(self, path: str | None, end_id: int):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.model.tokenize
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.removesuffix("</w>")[-1:] in ENDS]] = True
        self.letters = {b: c for c, b in byte_chars().items()}
        self.end = np.uint32(end_id).tobytes()
        self.words = Remembered(self._word, 250_000)
        self.cores = Remembered(self._core, 250_000)
        self.signs = Remembered(self._whole, 20_000)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, core: str) -> bytes:
        spelled = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.split(spelled)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.cores[word.lower()]
        m = _cored.fullmatch(word)
        if m is None:
            return self._whole(word)
        before, core, after = m.groups()
        return (self.signs[before] if before else b"") + self.cores[core.lower()] + (self.signs[after] if after else b"")

    def documents(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """For each text its ids with the end id (little-endian 32 bits) and the places after its sentences."""
        known = self.words.__getitem__
        for t in texts:
            coded = (self._whole(t) if _separators.search(t) else b"".join(map(known, t.split()))) + self.end
            yield coded, np.flatnonzero(self.ends[np.frombuffer(coded, "<u4")[:-1]]) + 1


def places_of(sentences: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a document of `total` tokens where a window may end, and their penalties."""
    marks = np.append(sentences[(sentences > 0) & (sentences < total)], total)
    marks = marks[np.append(True, np.diff(marks) > 0)]
    before = np.append(0, marks[:-1])
    extra = (marks - before - 1) // GRID
    if not extra.any():
        pen = np.full(marks.size, AT_SENTENCE)
        pen[-1] = 0
        return marks, pen
    starts = np.repeat(before, extra)
    nth = np.arange(starts.size) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    inner = starts + nth * GRID
    pos = np.concatenate([marks, inner])
    pen = np.concatenate([np.full(marks.size, AT_SENTENCE), np.full(inner.size, INSIDE)])
    pen[marks.size - 1] = 0
    order = np.argsort(pos, kind="stable")
    return pos[order], pen[order]


def cut_windows(pos: list[int], pen: list[int], window: int, last: bool) -> list[int]:
    """Ends of the windows over the stream [0, pos[-1]); unless `last`, the final, open window is left out.

    pos rises and no two neighbours, nor 0 and the first, are more than `window` apart.
    """
    places = [0, *pos]
    price = [0, *pen]
    n = len(places)
    cost, back = [0] * n, [0] * n
    value = [0] * n  # f(i) + pos(i)
    queue, head = [0], 0
    for j in range(1, n):
        p = places[j]
        while p - places[queue[head]] > window:
            head += 1
        i = queue[head]
        f = price[j] + window - p + value[i]
        cost[j], back[j] = f, i
        v = value[j] = f + p
        while len(queue) > head and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
        if head > 4096:
            del queue[:head]
            head = 0
    total = places[-1]
    # the open window starts at one of the places within reach of the end; at the end of the stream it is
    # cut into powers of two, one cut for each
    low = n - 1
    while low and total - places[low - 1] <= window:
        low -= 1
    if last:
        def ending(j: int) -> int:
            rest = total - places[j]
            return cost[j] + INSIDE * max(0, rest.bit_count() - 1)
    else:
        def ending(j: int) -> int:
            return cost[j] if places[j] < total else cost[j] + window
    j = min(range(low, n), key=ending)
    rest, cuts = places[j], []
    while j:
        cuts.append(places[j])
        j = back[j]
    cuts.reverse()
    if last:
        bit = 1 << (total - rest).bit_length()
        while rest < total:
            if total - rest >= bit:
                rest += bit
                cuts.append(rest)
            bit >>= 1
    return cuts


class Packer:
    """Takes documents one by one and gives rows of pieces."""

    def __init__(self, window: int, sequence: int):
        self.window, self.sequence = window, sequence
        self.docs: list[tuple[int, bytes, int, int]] = []  # id, ids, tokens before, tokens in all
        self.pos: list[np.ndarray] = []
        self.pen: list[np.ndarray] = []
        self.length = 0

    def add(self, doc_id: int, ids: bytes, sentences: np.ndarray) -> list[tuple]:
        total = len(ids) >> 2
        pos, pen = places_of(sentences, total)
        self.docs.append((doc_id, ids, self.length, total))
        self.pos.append(pos + self.length)
        self.pen.append(pen)
        self.length += total
        return self.flush(False) if self.length >= SEGMENT else []

    def flush(self, last: bool) -> list[tuple]:
        if not self.length:
            return []
        pos, pen = np.concatenate(self.pos), np.concatenate(self.pen)
        cuts = cut_windows(pos.tolist(), pen.tolist(), self.window, last)
        rows, at, k = [], 0, 0
        for end in cuts:
            begin = at
            while at < end:
                doc_id, ids, before, total = self.docs[k]
                start = at - before
                length = min(end, before + total) - at
                rows.append((doc_id, start, length, zlib.crc32(ids[start * 4 : (start + length) * 4]), total, self.sequence, at - begin))
                at += length
                if at == before + total:
                    k += 1
            self.sequence += 1
        self.docs = [(d, ids, before - at, total) for d, ids, before, total in self.docs[k:]]
        self.pos, self.pen = [pos[pos > at] - at], [pen[pos > at]]
        self.length -= at
        return rows


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    schema = T.StructType.fromDDL("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    out = arrow_schema(schema)

    @functools.partial(released, remembers=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer, end_id)
        packer = Packer(window, TaskContext.get().partitionId() << SEQUENCE_BITS)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=out)

        for ids, texts in slices(batches):
            for doc_id, (coded, sentences) in zip(ids, tokens.documents(texts), strict=True):
                if rows := packer.add(doc_id, coded, sentences):
                    yield batch(rows)
        if rows := packer.flush(True):
            yield batch(rows)

    return id_text(df, id_col, text_col).mapInArrow(run, schema)


def _tokens(path: str | None, end_id: int) -> WordTokens:
    """One for each worker, file and end id."""
    return remembered(("packing", path, end_id), lambda: WordTokens(path, end_id))
