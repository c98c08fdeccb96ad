"""Exact BPE encoding by per-prefix dynamic programming, and decoding (operator 9).

For each prefix of a pre-token the encoding's last token is unique. It is found among the vocabulary's tokens that
end the prefix, which a suffix-link automaton over all tokens gives longest first, as the one whose pairing with the
last token of the shorter prefix leaves the boundary between them uncrossed. Back-pointers from the whole pre-token
give the ids. Pairing tests and encoded pieces are remembered in bounded memory; there is no shuffle.

Defined results: null and empty texts have no ids (digests of the empty string); a special string in a text is its
own id; repeated rows each give their row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

from pyspark.sql import DataFrame

from granary.llm import byte_bpe
from granary.llm.batches import map_texts
from granary.llm.token_counts import merge_ragged


class PrefixEncoder:
    def __init__(self, bpe: byte_bpe.ByteBpe, pairs: int = 400_000):
        self.bpe, self.most = bpe, pairs
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(bpe.merges)}
        born = {}
        for r, (a, b, made) in enumerate(bpe.merges):
            born.setdefault(made, (a, b, r))
        whole = list(bpe.vocab)
        alone = merge_ragged(whole, bpe)
        #: tokens that the merges really make of their own bytes; no other can be in an encoding
        self.token = {b: bpe.vocab[b] for b, n in zip(whole, alone.tolist(), strict=True) if n == 1}
        end = len(bpe.merges)
        #: for each token the symbols on its right (left) edge while it is built, each with the rank that ends it
        self.right, self.left = [None] * bpe.size, [None] * bpe.size
        for t in self.token.values():
            for side, edges in ((1, self.right), (0, self.left)):
                edge, x, until = [], t, end
                while True:
                    edge.append((x, until))
                    if x not in born:
                        break
                    until = born[x][2]
                    x = born[x][side]
                edges[t] = edge
        self.fits: dict[int, bool] = {}
        self._automaton()

    def _automaton(self) -> None:
        go: list[dict[int, int]] = [{}]
        ends = [None]
        for b, t in self.token.items():
            at = 0
            for c in b:
                nxt = go[at].get(c)
                if nxt is None:
                    nxt = go[at][c] = len(go)
                    go.append({})
                    ends.append(None)
                at = nxt
            ends[at] = (t, len(b))
        link, out, queue = [0] * len(go), [()] * len(go), [0]
        for at in queue:
            for c, nxt in go[at].items():
                if at:
                    k = link[at]
                    while k and c not in go[k]:
                        k = link[k]
                    link[nxt] = go[k].get(c, 0)
                out[nxt] = ((ends[nxt],) if ends[nxt] else ()) + out[link[nxt]]
                queue.append(nxt)
        self.go, self.link, self.out = go, link, out

    def pair(self, key: int) -> bool:
        """Whether the tokens a and b of key = a * size + b stay two tokens when their bytes are encoded together.

        The boundary is crossed if a symbol of a's right edge and one of b's left edge can merge before either is
        taken up by the merge that ends it; with equal ranks the one further left goes first.
        """
        a, b = divmod(key, self.bpe.size)
        rank, fit = self.rank, True
        for x, until_x in self.right[a]:
            for y, until_y in self.left[b]:
                r = rank.get((x, y))
                if r is not None and r < until_x and r <= until_y:
                    fit = False
        if len(self.fits) >= self.most:
            self.fits.clear()
        self.fits[key] = fit
        return fit

    def encode_sorted(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each of the sorted words; what two neighbours' common prefix has, isn't computed again."""
        go, link, out, pair, fits, size = self.go, self.link, self.out, self.pair, self.fits, self.bpe.size
        last, states, before, result = [(0, 0)], [0], b"", []
        for word in words:
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1 :], states[same + 1 :]
            at = states[same]
            for e in range(same, len(word)):
                c = word[e]
                while at and c not in go[at]:
                    at = link[at]
                at = go[at].get(c, 0)
                states.append(at)
                for found in out[at]:
                    t, n = found
                    if n > e:
                        break
                    key = last[e + 1 - n][0] * size + t
                    ok = fits.get(key)
                    if ok or ok is None and pair(key):
                        break
                last.append(found)
            ids, e = [], len(word)
            while e:
                t, n = last[e]
                ids.append(t)
                e -= n
            ids.reverse()
            result.append(tuple(ids))
            before = word
        return result

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        cuts = [byte_bpe.pretokens(p) for p in pieces]
        words = sorted({w for c in cuts for w in c})
        ids = dict(zip(words, self.encode_sorted(words), strict=True))
        return [ids[c[0]] if len(c) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, c))) for c in cuts]

    def encode_all(self, texts: list[str], memory: byte_bpe.Pieces) -> list[list[int]]:
        """The ids of each text."""
        parts = [[(byte_bpe.pieces(p), special) for p, special in self.bpe.parts(t)] for t in texts]
        known = memory.learn({p for doc in parts for cut, _ in doc for p in cut})
        out = []
        for doc in parts:
            ids: list[int] = []
            for cut, special in doc:
                ids.extend(chain.from_iterable(map(known.__getitem__, cut)))
                if special >= 0:
                    ids.append(special)
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bpe.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_memory: dict = {}


def encoder(vocabulary: str | None) -> tuple[PrefixEncoder, byte_bpe.Pieces]:
    """One for each worker and file."""
    if vocabulary not in _memory:
        made = PrefixEncoder(byte_bpe.load(vocabulary))
        _memory[vocabulary] = made, byte_bpe.Pieces(made.encode_pieces, most=150_000)
    return _memory[vocabulary]


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""

    def start():
        enc, memory = encoder(vocabulary)
        return lambda ids, texts: [ids, enc.encode_all(texts, memory)]

    return map_texts(df, "doc_id long, ids array<int>", start, id_col, text_col)


def digest_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode, then decode from the ids: n_tokens and digests of the ids and of the decoded text."""

    def start():
        enc, memory = encoder(vocabulary)
        spelled = [str(i) for i in range(enc.bpe.size)]

        def work(ids: list, texts: list[str]) -> list:
            tokens, coded, decoded = [], [], []
            for got in enc.encode_all(texts, memory):
                tokens.append(len(got))
                coded.append(hashlib.sha256(",".join(map(spelled.__getitem__, got)).encode()).hexdigest())
                decoded.append(hashlib.sha256(enc.decode(got).encode("utf-8")).hexdigest())
            return [ids, tokens, coded, decoded]

        return work

    return map_texts(df, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", start, id_col, text_col)
