"""A minimal acyclic transducer: words to id sequences, in one file that is mapped into memory.

Words share prefixes and suffixes in one automaton.  Each edge carries how many words of the
lexicon precede what lies behind it, so the sum along a path is the word's ordinal, and the
ordinal points at its ids.  Built from sorted words one at a time: what can no longer change is
replaced by an equal state that was built before.
"""

from __future__ import annotations

import mmap
import struct
from array import array
from collections.abc import Iterable

MAGIC = b"LXN1"


class _State:
    __slots__ = ("edges", "final", "number", "words")

    def __init__(self) -> None:
        self.edges: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.words = 0

    def signature(self) -> tuple:
        return (self.final, *((label, id(to)) for label, to in self.edges.items()))


def compile_words(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file for ``entries``: different words in ascending order, each with its ids."""
    root, known = _State(), {}
    open_path: list[tuple[_State, int, _State]] = []
    before, starts, ids = b"", array("I", [0]), array("I")

    def close(length: int) -> None:
        while len(open_path) > length:
            parent, label, child = open_path.pop()
            same = known.setdefault(child.signature(), child)
            if same is not child:
                parent.edges[label] = same

    for word, out in entries:
        if word <= before and starts[-1:] != array("I", [0]):
            raise ValueError("words must ascend")
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        close(common)
        state = open_path[-1][2] if open_path else root
        for label in word[common:]:
            new = _State()
            state.edges[label] = new
            open_path.append((state, label, new))
            state = new
        state.final = True
        ids.extend(out)
        starts.append(len(ids))
        before = word
    close(0)

    order: list[_State] = []
    todo = [root]
    while todo:
        state = todo.pop()
        if state.number < 0:
            state.number = len(order)
            order.append(state)
            todo.extend(state.edges.values())

    def words_of(top: _State) -> None:
        stack = [top]
        while stack:
            state = stack[-1]
            if missing := [to for to in state.edges.values() if not to.words]:
                stack.extend(missing)
                continue
            state.words = state.final + sum(to.words for to in state.edges.values())
            stack.pop()

    if starts[-1] or len(starts) > 1:
        words_of(root)
    first, labels, targets, skips = array("I", [0]), bytearray(), array("I"), array("I")
    for state in order:
        passed = int(state.final)
        for label, to in state.edges.items():
            labels.append(label)
            targets.append(to.number)
            skips.append(passed)
            passed += to.words
        first.append(len(labels))
    finals = bytes(s.final for s in order)
    padded = lambda raw: bytes(raw) + b"\0" * (-len(raw) % 4)
    head = struct.pack("<4s4I", MAGIC, len(order), len(labels), len(starts) - 1, len(ids))
    return head + b"".join(
        (first.tobytes(), targets.tobytes(), skips.tobytes(), starts.tobytes(), ids.tobytes(), padded(finals), labels)
    )


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        magic, states, edges, self.words, n_ids = struct.unpack_from("<4s4I", self._map, 0)
        if magic != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        view, at = memoryview(self._map), 20

        def part(n: int) -> memoryview:
            nonlocal at
            at += 4 * n
            return view[at - 4 * n : at].cast("I")

        self._first, self._targets, self._skips = part(states + 1), part(edges), part(edges)
        self._starts, self._ids_at = part(self.words + 1), at
        at += 4 * n_ids
        self._finals = view[at : at + states]
        self._labels_at = at + states + -states % 4
        self.states, self.edges = states, edges

    def get(self, word: bytes) -> bytes | None:
        """The ids of ``word`` as little-endian unsigned 32-bit numbers; None if it isn't there."""
        first, find, base = self._first, self._map.find, self._labels_at
        state = ordinal = 0
        for k in range(len(word)):
            edge = find(word[k : k + 1], base + first[state], base + first[state + 1]) - base
            if edge < 0:
                return None
            ordinal += self._skips[edge]
            state = self._targets[edge]
        if not self._finals[state]:
            return None
        return self._map[self._ids_at + 4 * self._starts[ordinal] : self._ids_at + 4 * self._starts[ordinal + 1]]
