"""A generalised suffix automaton of word sequences, and what it says of a stream.

A state stands for the sequences that end at the same places of the items; walking
tokens through it gives, at each token, the longest sequence ending there that any
item holds. Windows of ``length`` words, and items of fewer words as a whole, are
looked up at the state where their length lies.
"""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """Of ``items``: (number of the item's id, list of words), none of them empty."""

    def __init__(self, items: list[tuple[int, list]], length: int):
        self.length, self.vocabulary = length, {}
        self.next, self.link, self.size = [{}], [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items]
        for _, tokens in coded:
            last = 0
            for t in tokens:
                last = self._extend(last, t)
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        # The ancestor whose sequences include the one of just ``length`` words.
        self.window = [-1] * len(self.size)
        for s in order:
            if self.size[s] >= length:
                up = self.link[s]
                self.window[s] = s if self.size[up] < length else self.window[up]
        self.items: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        for i, tokens in coded:
            at = 0
            for k, t in enumerate(tokens):
                at = self.next[at][t]
                if k + 1 >= length:
                    self.items.setdefault(self.window[at], set()).add(i)
            if len(tokens) < length:
                self.short.setdefault(self._holding(at, len(tokens)), {}).setdefault(len(tokens), set()).add(i)
        # The nearest ancestor at which a short item ends.
        self.short_above = [-1] * len(self.size)
        for s in order:
            up = self.link[s]
            self.short_above[s] = up if up in self.short else self.short_above[up]
        self.shortest = min((min(length, len(tokens)) for _, tokens in coded), default=length)
        pairs = {a * len(self.vocabulary) + b for _, tokens in coded for a, b in zip(tokens, tokens[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, t: int) -> int:
        old = self.next[last].get(t)
        if old is not None and self.size[old] == self.size[last] + 1:
            return old
        if old is not None:
            return self._split(last, old, t)
        new = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, t)
        return new

    def _split(self, p: int, q: int, t: int) -> int:
        """The state of q's sequences that are no longer than p's with t."""
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = copy
            p = self.link[p]
        return copy

    def _state(self, size: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _holding(self, state: int, length: int) -> int:
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of a stream of word numbers (negative: in no item) outside which no
        match can be as long as the shortest window: each two words of a match follow
        each other in some item too."""
        if len(ids) < self.shortest or not self.vocabulary:
            return []
        good = (ids[:-1] >= 0) & (ids[1:] >= 0)
        at = np.flatnonzero(good)
        if len(self.pairs):
            pair = ids[at].astype(np.int64) * len(self.vocabulary) + ids[at + 1]
            good[at[self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] != pair]] = False
        else:
            good[:] = False
        edge = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) + 1
        if self.shortest == 1:  # single known words are windows too
            lone = ids >= 0
            edge = np.diff(np.concatenate([[0], lone.view(np.int8), [0]]))
            first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        enough = last - first >= self.shortest
        return list(zip(first[enough].tolist(), last[enough].tolist()))

    def matches(self, ids, start: int):
        """(start, end, states) of each token at which windows end: of the longest one
        that ends there, and the states and lengths that tell the items."""
        state = size = 0
        for end, t in enumerate(ids, start + 1):
            while state and t not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if t not in self.next[state]:
                continue
            state, size = self.next[state][t], size + 1
            long = self.window[state] if size >= self.length else -1
            found, longest = [], self.length if long >= 0 else 0
            if long >= 0:
                found.append((long, 0))
            s = state if state in self.short else self.short_above[state]
            while s >= 0:
                for k in self.short[s]:
                    if k <= size:
                        found.append((s, k))
                        longest = max(longest, k)
                s = self.short_above[s]
            if found:
                yield end - longest, end, found

    def named(self, found: set) -> set:
        """Numbers of the items that the (state, length) of ``matches`` stand for."""
        return set().union(*(self.short[s][k] if k else self.items[s] for s, k in found))
