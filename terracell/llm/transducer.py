"""Minimal acyclic transducers: sorted terms to their lexicographic ordinals.

Terms are added in byte order. A state whose suffixes are complete is replaced by an equal one that
exists already, so the automaton is minimal while it grows. Every transition carries the number of terms that
come before those it leads to; the sum of these along a path is the term's ordinal.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np


class Transducer:
    """Transitions sorted by (state, byte): target and number of terms to skip; the last state is the root."""

    def __init__(self, edges: np.ndarray, targets: np.ndarray, skips: np.ndarray, final: np.ndarray):
        self.edges, self.targets, self.skips, self.final = edges, targets, skips, final
        self.root = len(final) - 1

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in byte order."""
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        path: list[list] = [[False, bytearray(), []]]  # states of the last term's prefixes: final, bytes, targets
        last = b""

        def settle(depth: int) -> None:
            while len(path) > depth:
                final, labels, targets = path.pop()
                state = (final, bytes(labels), tuple(targets))
                at = known.setdefault(state, len(states))
                if at == len(states):
                    states.append(state)
                if path:
                    path[-1][2].append(at)

        for term in terms:
            if last and term <= last:
                raise ValueError("terms must be distinct and in byte order")
            same = 0
            for a, b in zip(term, last):
                if a != b:
                    break
                same += 1
            settle(same + 1)
            for b in term[same:]:
                path[-1][1].append(b)
                path.append([False, bytearray(), []])
            path[-1][0] = True
            last = term
        settle(0)

        below = np.zeros(len(states), dtype=np.int64)
        edges, skips = [], []
        for i, (final, labels, targets) in enumerate(states):  # targets come first
            n = int(final)
            for b, t in zip(labels, targets):
                edges.append(i << 8 | b)
                skips.append(n)
                n += below[t]
            below[i] = n
        every = [t for _, _, targets in states for t in targets]
        return cls(
            np.array(edges, dtype=np.int64), np.array(every, dtype=np.int32), np.array(skips, dtype=np.int32),
            np.array([s[0] for s in states], dtype=np.uint8),
        )

    def to_bytes(self) -> bytes:
        head = np.array([len(self.edges), len(self.final)], dtype=np.int64)
        return b"".join(x.tobytes() for x in (head, self.edges, self.targets, self.skips, self.final))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Transducer:
        n, m = np.frombuffer(raw, dtype=np.int64, count=2)
        at, parts = 16, []
        for kind, count in ((np.int64, n), (np.int32, n), (np.int32, n), (np.uint8, m)):
            parts.append(np.frombuffer(raw, dtype=kind, count=count, offset=at))
            at += parts[-1].nbytes
        return cls(*parts)

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """Each term's ordinal, -1 for one that isn't in: all terms walk together, a byte at a time."""
        out = np.full(len(terms), -1, dtype=np.int64)
        size = np.fromiter(map(len, terms), dtype=np.int64, count=len(terms))
        data = np.frombuffer(b"".join(terms), dtype=np.uint8)
        at = np.cumsum(size) - size
        who = np.arange(len(terms))
        state = np.full(len(terms), self.root, dtype=np.int64)
        total = np.zeros(len(terms), dtype=np.int64)
        step = 0
        while len(who):
            ended = size[who] == step
            if ended.any():
                good = ended & (self.final[state] == 1)
                out[who[good]] = total[good]
                who, state, total = who[~ended], state[~ended], total[~ended]
            if not len(who) or not len(self.edges):
                break
            edge = state << 8 | data[at[who] + step]
            place = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            on = self.edges[place] == edge
            who, place = who[on], place[on]
            state, total = self.targets[place].astype(np.int64), total[on] + self.skips[place]
            step += 1
        return out

    def terms(self) -> Iterator[bytes]:
        """All terms in the order of their ordinals."""
        first = np.searchsorted(self.edges, np.arange(self.root + 2, dtype=np.int64) << 8)
        todo = [(self.root, b"")]
        while todo:
            state, prefix = todo.pop()
            if self.final[state]:
                yield prefix
            for i in range(first[state + 1] - 1, first[state] - 1, -1):
                todo.append((self.targets[i], prefix + bytes([self.edges[i] & 255])))


class Vocabulary:
    """The transducers of one language, each of a range of terms, with the ordinals' offsets."""

    def __init__(self, shards: list[tuple[bytes, int, bytes]]):
        """``shards``: least term, offset, stored transducer; in order of terms."""
        self.firsts = [s[0] for s in shards]
        self.shards = [(s[1], Transducer.from_bytes(s[2])) for s in shards]

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        if len(self.shards) == 1:
            base, shard = self.shards[0]
            found = shard.ordinals(terms)
            return np.where(found < 0, found, found + base)
        out = np.full(len(terms), -1, dtype=np.int64)
        where = np.array([bisect_right(self.firsts, t) - 1 for t in terms], dtype=np.int64)
        for i, (base, shard) in enumerate(self.shards):
            own = np.flatnonzero(where == i)
            if len(own):
                found = shard.ordinals([terms[k] for k in own])
                out[own] = np.where(found < 0, found, found + base)
        return out
