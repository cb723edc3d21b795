"""Weighted acyclic automata over word sequences: built from sorted sequences, united by merging, asked by prefix.

A state knows how many sequences end in it and, by word, where its arcs lead;
states with equal ends and arcs are one. The weight of a state is what ends in it or
behind it, so the weight met after the words of a prefix is the number of
sequences that begin with it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

Words = tuple[bytes, ...]


class Builder:
    """Takes (words, count) in ascending order, a sequence at most once; states become final as soon as the order has passed them."""

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.ends: list[int] = []
        self.weights: list[int] = []
        self.arcs: list[tuple] = []
        self.path: list[list] = [[0, []]]  # (ends, arcs) of the states along the last sequence
        self.last: Words = ()

    def add(self, words: Words, count: int) -> None:
        path, last = self.path, self.last
        common = 0
        for a, b in zip(words, last):
            if a != b:
                break
            common += 1
        if len(last) > common:
            self._close(common)
        path.extend([0, []] for _ in range(len(words) - common))
        path[-1][0] += count
        self.last = words

    def _close(self, depth: int) -> None:
        path, register = self.path, self.register
        while len(path) - 1 > depth:
            ends, arcs = path.pop()
            key = (ends, tuple(arcs))
            state = register.get(key)
            if state is None:
                state = self._state(*key)
            path[-1][1].append((self.last[len(path) - 1], state))

    def _state(self, ends: int, arcs: tuple) -> int:
        found = self.register.setdefault((ends, arcs), len(self.ends))
        if found == len(self.ends):
            weights = self.weights
            self.ends.append(ends)
            self.arcs.append(arcs)
            weights.append(ends + sum([weights[to] for _, to in arcs]))
        return found

    def finish(self) -> Transducer:
        self._close(0)
        ends, arcs = self.path[0]
        root = self._state(ends, tuple(arcs))
        return Transducer(self.ends, self.weights, self.arcs, root)


class Transducer:
    def __init__(self, ends: list[int], weights: list[int], arcs: list[tuple], root: int):
        self.ends, self.weights, self.arcs, self.root = ends, weights, arcs, root
        self._by_word: dict[int, dict[bytes, int]] = {}

    def sequences(self) -> Iterator[tuple[Words, int]]:
        """All (words, count), ascending."""
        stack: list[tuple[int, Words]] = [(self.root, ())]
        while stack:
            state, words = stack.pop()
            if self.ends[state]:
                yield words, self.ends[state]
            stack.extend((to, (*words, word)) for word, to in reversed(self.arcs[state]))

    def prefixes(self, least: int) -> Iterator[tuple[Words, int]]:
        """The prefixes of all lengths from 1 that at least `least` sequences begin with."""
        stack: list[tuple[int, Words]] = [(self.root, ())]
        while stack:
            state, words = stack.pop()
            for word, to in reversed(self.arcs[state]):
                if self.weights[to] >= least:
                    stack.append((to, (*words, word)))
            if words:
                yield words, self.weights[state]

    def weight(self, words: Iterable[bytes]) -> int:
        """How many sequences begin with the words."""
        state = self.root
        for word in words:
            arcs = self._by_word.get(state)
            if arcs is None:
                arcs = self._by_word[state] = dict(self.arcs[state])
            state = arcs.get(word)
            if state is None:
                return 0
        return self.weights[state]

    def dumps(self) -> bytes:
        words = sorted({word for arcs in self.arcs for word, _ in arcs})
        number = {word: i for i, word in enumerate(words)}
        degrees = np.fromiter(map(len, self.arcs), "<i4", len(self.arcs))
        flat = np.array([(number[w], to) for arcs in self.arcs for w, to in arcs], "<i4").reshape(-1, 2)
        ends = np.array(self.ends, "<i8")
        parts = [b"\n".join(words), degrees.tobytes(), flat.T.tobytes(), ends.tobytes()]
        head = struct.pack("<iii", len(self.arcs), len(parts[0]), self.root)
        return zlib.compress(head + b"".join(parts), 1)

    @classmethod
    def loads(cls, blob: bytes) -> Transducer:
        raw = zlib.decompress(blob)
        states, text, root = struct.unpack_from("<iii", raw)
        at = 12
        words = raw[at : at + text].split(b"\n")
        at += text
        degrees = np.frombuffer(raw, "<i4", states, at)
        at += 4 * states
        total = int(degrees.sum())
        flat = np.frombuffer(raw, "<i4", 2 * total, at).reshape(2, total)
        at += 8 * total
        ends = np.frombuffer(raw, "<i8", states, at).tolist()
        pairs = [(words[w], to) for w, to in zip(*flat.tolist())]
        arcs, weights, start = [], [], 0
        for own, degree in zip(ends, degrees.tolist()):
            mine = tuple(pairs[start : start + degree])
            start += degree
            arcs.append(mine)
            weights.append(own + sum(weights[to] for _, to in mine))
        return cls(ends, weights, arcs, root)


def build(sequences: Iterable[tuple[Words, int]]) -> Transducer:
    """From ascending (words, count); counts of equal neighbours are summed."""
    builder, last, total = Builder(), None, 0
    for words, count in sequences:
        if words != last:
            if last is not None:
                builder.add(last, total)
            last, total = words, 0
        total += count
    if last is not None:
        builder.add(last, total)
    return builder.finish()


def union(parts: Iterable[Transducer]) -> Transducer:
    """The automaton of the sums of all counts. Sorting takes the parts' sorted sequences as runs and merges them."""
    merged: list[tuple[Words, int]] = []
    for part in parts:
        merged.extend(part.sequences())
    merged.sort()
    return build(merged)
