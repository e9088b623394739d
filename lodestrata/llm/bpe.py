"""Byte-level BPE of a public vocabulary file, exactly as the tokenizers library encodes.

Pieces
    Texts of plain Latin letters, digits and common punctuation are cut by a pattern of the
    standard library; other texts by the ``regex`` library; texts with a character that this
    Python's Unicode tables do not know by the tokenizers library itself, whose tables differ.
Ids
    A piece's ids come from a cache of pieces, then from the lexicon (a memory-mapped transducer
    of frequent words), then from exact merges in order of rank.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import regex

from lodestrata.llm.lexicon import Lexicon, compile_words

#: The split pattern of the vocabulary, and its reading by the standard library
#: for characters outside ODD.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ODD = re.compile("[^\t\n\r -~À-ɏ‐-‧‰-›€]")
FULL = regex.compile(PATTERN)

CACHED_WORDS = 500_000
CACHED_CHARS = 48


@functools.cache
def _unknown() -> re.Pattern:
    """Code points that are unassigned in this Python's Unicode tables."""
    ranges, start = [], None
    for c in range(sys.maxunicode + 2):
        new = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if new and start is None:
            start = c
        elif not new and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]")


@functools.cache
def _library() -> object:
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def pieces(text: str) -> list[str]:
    if not ODD.search(text):
        return PLAIN.findall(text)
    if not _unknown().search(text):
        return FULL.findall(text)
    return [text[a:b] for _, (a, b) in _library().pre_tokenize_str(text)]


def _alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where printable, else one
    of the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file (JSON, byte-level BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        byte = _alphabet()
        model = data["model"]
        spelled = {token: bytes(byte[c] for c in token) for token in model["vocab"]}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, number in model["vocab"].items():
            if token not in self.special:
                self.bytes_of[number] = spelled[token]
        for token, number in self.special.items():
            self.bytes_of[number] = token.encode()
        self.id_of = {raw: model["vocab"][token] for token, raw in spelled.items() if token not in self.special}
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = self.id_of[spelled[a]], self.id_of[spelled[b]]
            self.merges[left << 20 | right] = rank << 20 | self.id_of[spelled[a] + spelled[b]]
        self._cut = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})")

    def merge(self, word: bytes) -> list[int]:
        """Ids of one piece by merging the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        rank_of, none = self.merges.get, 1 << 60
        ranks = [rank_of(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            new = ids[at] = best & 0xFFFFF
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of(ids[at - 1] << 20 | new, none)
            if at < len(ranks):
                ranks[at] = rank_of(new << 20 | ids[at + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked positions, for pieces of any length."""
        n, rank_of = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank_of(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank & 0xFFFFF, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := rank_of(ids[i] << 20 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank_of(ids[before[i]] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [t for t in ids if t >= 0]

    def segments(self, text: str) -> list[str]:
        """Ordinary text and special tokens by turns; special tokens at the odd places."""
        return self._cut.split(text)

    def decode(self, ids: array) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Words(dict):
    """A bounded cache of pieces' ids (little-endian unsigned 32-bit)."""

    def __init__(self, find: Callable[[str], bytes]) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> bytes:
        ids = self.find(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts to ids; ``merge`` gives the ids of a piece that the lexicon doesn't have."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, merge: Callable[[bytes], list[int]] | None = None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self._merge = merge or vocabulary.merge
        self._words = Words(self._find)
        self._special = {token: array("I", [n]).tobytes() for token, n in vocabulary.special.items()}

    def _find(self, word: str) -> bytes:
        raw = word.encode()
        if self.lexicon and (ids := self.lexicon.get(raw)) is not None:
            return ids
        return array("I", self._merge(raw)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        found = self._words.__getitem__
        if not any(token in text for token in self._special):
            return b"".join(map(found, pieces(text)))
        parts = self.vocabulary.segments(text)
        return b"".join(
            self._special[part] if k % 2 else b"".join(map(found, pieces(part))) for k, part in enumerate(parts)
        )


def ids_of(raw: bytes) -> array:
    out = array("I")
    out.frombytes(raw)
    return out


def lexicon_file(vocabulary: Vocabulary, words: Iterator[str]) -> bytes:
    """Compile ``words``, each with its exact ids, into a lexicon."""
    return compile_words((w, vocabulary.merge(w)) for w in sorted({w.encode() for w in words if w}))
