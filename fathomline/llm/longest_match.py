"""Longest-match tokenization in linear time: a trie with failure links and precomputed emissions.

Every node v of the trie over a vocabulary stands for a byte string. Where the input leaves the trie at v, greedy longest
match would emit some tokens of v's string and go on with what is left of it; both depend on v alone. They are worked out
once, in order of depth: ``emit[v]`` are the tokens, ``fail[v]`` is the node of the rest. So no byte is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence


class LongestMatch:
    def __init__(self, tokens: Sequence[bytes]) -> None:
        """tokens: the string of each id; empty strings are no tokens."""
        self.step: dict[int, int] = {}  # node << 8 | byte -> node
        self.fail: list[int] = [-1]
        self.emit: list[tuple[int, ...]] = [()]
        token_at: list[int] = [-1]
        for i, t in enumerate(tokens):
            v = 0
            for b in t:
                key = v << 8 | b
                u = self.step.get(key)
                if u is None:
                    u = self.step[key] = len(token_at)
                    token_at.append(-1)
                v = u
            if v and token_at[v] < 0:
                token_at[v] = i
        n = len(token_at)
        children: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, u in self.step.items():
            children[key >> 8].append((key & 255, u))
        self.fail, self.emit = [-1] * n, [()] * n
        layer = [0]
        while layer:
            below = []
            for v in layer:
                for b, u in children[v]:
                    below.append(u)
                    if token_at[u] >= 0:
                        self.fail[u], self.emit[u] = 0, (token_at[u],)
                        continue
                    z, out = self.fail[v], self.emit[v]
                    while z >= 0 and (z << 8 | b) not in self.step:
                        out, z = out + self.emit[z], self.fail[z]
                    if z >= 0:
                        self.fail[u], self.emit[u] = self.step[z << 8 | b], out
            layer = below
        self.emitted = [len(e) for e in self.emit]

    def ids(self, data: bytes) -> list[int] | None:
        """Tokens of a string, or None if the vocabulary can't cover it."""
        v, out, step = 0, [], self.step
        for b in data:
            while (u := step.get(v << 8 | b)) is None:
                if self.fail[v] < 0:
                    return None
                out += self.emit[v]
                v = self.fail[v]
            v = u
        while v:
            if self.fail[v] < 0:
                return None
            out += self.emit[v]
            v = self.fail[v]
        return out

    def count(self, data: bytes) -> int:
        """Number of tokens of a string; 1, an unknown token, if the vocabulary can't cover it."""
        v, n, step, fail, emitted = 0, 0, self.step, self.fail, self.emitted
        for b in data:
            while (u := step.get(v << 8 | b)) is None:
                if fail[v] < 0:
                    return 1
                n += emitted[v]
                v = fail[v]
            v = u
        while v:
            if fail[v] < 0:
                return 1
            n += emitted[v]
            v = fail[v]
        return n
