"""Tables of a byte-level BPE file and the cutting of texts into cacheable pieces."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex

#: White space as the tokenizer's own regular expressions know it, and its cutting pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Vocabulary, merges in rank order, and special strings of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = {bytes(chars[c] for c in s): i for s, i in model["vocab"].items() if s not in self.specials}
        self.size = max([*self.vocab.values(), *self.specials.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for b, i in self.vocab.items():
            self.bytes_of[i] = b
        for s, i in self.specials.items():
            self.bytes_of[i] = s.encode()
        self.base = np.array([self.vocab[bytes([b])] for b in range(256)], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        encoded = [(bytes(chars[c] for c in a), bytes(chars[c] for c in b)) for a, b in merges]
        left = np.array([self.vocab[a] for a, _ in encoded], np.int64)
        right = np.array([self.vocab[b] for _, b in encoded], np.int64)
        made = np.array([self.vocab[a + b] for a, b in encoded], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.merges = list(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))
        self._special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def parts(self, text: str) -> list[tuple[str, int]]:
        """The text cut at special strings: (ordinary text, id of the special string after it, or -1)."""
        if self._special is None or not any(s in text for s in self.specials):
            return [(text, -1)]
        out, at = [], 0
        for m in self._special.finditer(text):
            out.append((text[at : m.start()], self.specials[m.group()]))
            at = m.end()
        return [*out, (text[at:], -1)]


@lru_cache(maxsize=4)
def load(path: str | None = None) -> ByteBpe:
    """One worker reads a file once. None: the public 50k byte-level vocabulary of this machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return ByteBpe(path)


_cut = regex.compile(PRETOKEN)
_beside = re.compile(r" \s|\s ")


def pretokens(text: str) -> list[bytes]:
    if text.isalpha() or text[:1] == " " and text[1:].isalpha():  # a word is one pre-token
        return [text.encode()]
    return [p.encode("utf-8", "surrogatepass") for p in _cut.findall(text)]


def pieces(text: str) -> list[str]:
    """The text cut into pieces that can be encoded, and remembered, one by one.

    Neither the cutting pattern nor a merge crosses from a character that isn't white space to a space, so the
    text is cut before each space; where a space stands beside other white space, at each pre-token.
    """
    if _beside.search(text):
        return _cut.findall(text)
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]]


class Pieces:
    """What solve(list of pieces) gives for each piece, remembered.

    Two generations of up to `most` pieces are kept: when the younger is full it becomes the older, whose pieces come
    back as they are met. Pieces of over `longest` characters are remembered until the next call only.
    """

    def __init__(self, solve, most: int = 200_000, longest: int = 100):
        self.solve, self.most, self.longest = solve, most, longest
        self.known: dict = {}
        self.older: dict = {}
        self._passing: list = []

    def learn(self, wanted: set) -> dict:
        for p in self._passing:
            self.known.pop(p, None)
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.older, self.known = self.known, {}
            new = wanted
        if self.older:
            back = new.intersection(self.older)
            self.known.update(zip(back, map(self.older.__getitem__, back), strict=True))
            new = new - back
        new = list(new)
        self._passing = [p for p in new if len(p) > self.longest]
        self.known.update(zip(new, self.solve(new), strict=True))
        return self.known
