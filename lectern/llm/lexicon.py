"""A word lexicon with id outputs as a minimal acyclic transducer.

The automaton is built incrementally from sorted words (each state that can get no
further edge is replaced by an equal one already registered), so common suffixes
share states.  Every edge carries how many words sort before the ones behind it;
the sum along a word's path is the word's number, which points into one flat table
of id sequences.  All parts are plain integer arrays in one file, so that executors
can map it into memory and look up many words at once, one byte position per step.
"""

from __future__ import annotations

import numpy as np

_MAGIC = 0x4C455831


def _minimal(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """States (label -> target) and finality of the minimal automaton of sorted distinct words."""
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, label) along the last word

    def settle(depth: int) -> None:
        while len(path) > depth:
            state, label = path.pop()
            child = edges[state][label]
            shape = (final[child], tuple(edges[child].items()))
            edges[state][label] = register.setdefault(shape, child)

    last = b""
    for word in words:
        same = 0
        for a, b in zip(last, word):
            if a != b:
                break
            same += 1
        settle(same)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[same:]:
            edges.append({})
            final.append(False)
            edges[state][byte] = len(edges) - 1
            path.append((state, byte))
            state = len(edges) - 1
        final[state] = True
        last = word
    settle(0)
    return edges, final


def build(entries: dict[bytes, list[int]]) -> bytes:
    """The lexicon file of ``entries`` (word -> ids).  An empty lexicon is valid."""
    words = sorted(w for w in entries if w)
    edges, final = _minimal(words)
    number = {0: 0}
    order = [0]
    for state in order:
        for target in edges[state].values():
            if target not in number:
                number[target] = len(order)
                order.append(target)
    below = [0] * len(order)  # words accepted from a state on
    stack = [(0, False)]
    done = set()
    while stack:
        state, closed = stack.pop()
        if closed:
            below[number[state]] = int(final[state]) + sum(below[number[t]] for t in edges[state].values())
        elif state not in done:
            done.add(state)
            stack.append((state, True))
            stack += [(t, False) for t in edges[state].values() if t not in done]
    keys, targets, skips = [], [], []
    for state in order:
        seen = int(final[state])
        for label, target in sorted(edges[state].items()):
            keys.append(number[state] * 256 + label)
            targets.append(number[target])
            skips.append(seen)
            seen += below[number[target]]
    ids = [entries[w] for w in words]
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=starts[1:])
    parts = [
        np.asarray(keys, np.int64),
        np.asarray(targets, np.int64),
        np.asarray(skips, np.int64),
        np.asarray([final[s] for s in order], np.int64),
        starts,
        np.asarray([i for x in ids for i in x], np.int64),
    ]
    head = np.asarray([_MAGIC, *[len(p) for p in parts]], np.int64)
    return b"".join(p.tobytes() for p in [head, *parts])


class Lexicon:
    """Look-ups in a lexicon file or its bytes."""

    def __init__(self, source: str | bytes):
        data = np.memmap(source, np.int64, "r") if isinstance(source, str) else np.frombuffer(source, np.int64)
        if data[0] != _MAGIC:
            raise ValueError("not a lexicon")
        at, parts = 7, []
        for n in data[1:7]:
            parts.append(data[at : at + int(n)])
            at += int(n)
        self.keys, self.targets, self.skips, self.final, self.starts, self.ids = parts

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for words that aren't in the lexicon."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        lengths = np.fromiter(map(len, words), np.int64, n)
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        text = np.frombuffer(b"".join(words), np.uint8)
        state, rank = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(lengths > 0)
        step = 0
        while len(live):
            key = state[live] * 256 + text[offsets[live] + step]
            edge = np.searchsorted(self.keys, key)
            edge[edge == len(self.keys)] = 0
            hit = self.keys[edge] == key
            live, edge = live[hit], edge[hit]
            rank[live] += self.skips[edge]
            state[live] = self.targets[edge]
            step += 1
            ended = lengths[live] == step
            stop = live[ended]
            good = stop[self.final[state[stop]] == 1]
            out[good] = rank[good]
            live = live[~ended]
        return out

    def outputs(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()
