"""Token counts by rank-synchronous array merging (operator 3).

Pre-tokens are held as one ragged numpy array of symbols. Every round finds, for each pre-token, its adjacent pair
of lowest rank and merges all of that pair's occurrences, from left to right, in all pre-tokens at once; a pre-token
without a mergeable pair leaves the round, and its symbols are counted. A merge can't make a pair of lower rank than
its own, so a round does what the library's one-by-one merging does.

Counts of pieces are remembered by each Python worker, in bounded memory; there is no shuffle.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each give their row; a special string
inside a text is one token, as by the library's default; an empty table gives an empty table; columns other than the
id and the text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from granary.llm import byte_bpe
from granary.llm.batches import map_texts

NONE = np.iinfo(np.int64).max


def merge_ragged(seqs: list[bytes], bpe: byte_bpe.ByteBpe) -> np.ndarray:
    """How many symbols each byte sequence is left with."""
    counts = np.zeros(len(seqs), np.int64)
    lengths = np.fromiter(map(len, seqs), np.int64, len(seqs))
    sym = bpe.base[np.frombuffer(b"".join(seqs), np.uint8)]
    seq = np.repeat(np.arange(len(seqs)), lengths)
    while sym.size:
        rank = np.full(sym.size, NONE)
        pair = sym[:-1] * bpe.size + sym[1:]
        at = np.minimum(np.searchsorted(bpe.keys, pair), bpe.keys.size - 1)
        found = (bpe.keys[at] == pair) & (seq[:-1] == seq[1:])
        rank[:-1][found] = bpe.ranks[at[found]]
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        sizes = np.diff(np.r_[starts, sym.size])
        lowest = np.minimum.reduceat(rank, starts)
        counts[seq[starts[lowest == NONE]]] = sizes[lowest == NONE]
        low = np.repeat(lowest, sizes)
        hit = (rank == low) & (low != NONE)
        # in a run such as "aaa" the pairs overlap: every second one is merged
        index = np.arange(hit.size)
        opened = hit & ~np.r_[False, hit[:-1]]
        place = index - np.maximum.accumulate(np.where(opened, index, 0))
        hit &= place % 2 == 0
        sym[hit] = bpe.made[rank[hit]]
        keep = low != NONE
        keep[1:] &= ~hit[:-1]
        sym, seq = sym[keep], seq[keep]
    return counts


def piece_counts(pieces: list[str], bpe: byte_bpe.ByteBpe, symbols: int = 400_000) -> list[int]:
    """Tokens of each piece; pre-tokens are merged in batches of about `symbols` bytes."""
    cuts = [byte_bpe.pretokens(p) for p in pieces]
    owner = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, cuts), np.int64, len(cuts)))
    flat = [t for c in cuts for t in c]
    out, lo, held = [], 0, 0
    for i, t in enumerate(flat):
        held += len(t)
        if held >= symbols or i == len(flat) - 1:
            out.append(merge_ragged(flat[lo : i + 1], bpe))
            lo, held = i + 1, 0
    total = np.bincount(owner, np.concatenate(out) if out else None, len(pieces)) if flat else np.zeros(len(pieces))
    return total.astype(np.int64).tolist()


_memory: dict = {}


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text. vocabulary: path of a byte-level BPE file."""

    def start():
        bpe = byte_bpe.load(vocabulary)
        memory = _memory.setdefault(vocabulary, byte_bpe.Pieces(lambda new: piece_counts(new, bpe)))

        def work(ids: list, texts: list[str]) -> list:
            parts = [bpe.parts(t) for t in texts]
            cut = [[byte_bpe.pieces(p) for p, _ in ps] for ps in parts]
            known = memory.learn({p for doc in cut for part in doc for p in part})
            tokens = [sum(sum(map(known.__getitem__, part)) for part in doc) + len(doc) - 1 for doc in cut]
            return [ids, [len(t.encode("utf-8", "surrogatepass")) for t in texts], tokens, [n > limit for n in tokens]]

        return work

    return map_texts(df, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", start, id_col, text_col)
