"""Generalised suffix automaton of word sequences.

One automaton holds every run of consecutive words of every test item.  A
stream of words is followed through it: after each word, the state and the
matched length tell the longest run of items that ends there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """States of all runs in ``items``; words are integers, state 0 is the empty run."""

    def __init__(self, items: Iterable[list[int]]) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.link) - 1

    def _extend(self, last: int, word: int) -> int:
        """The state of the run of ``last`` with ``word`` behind it."""
        known = self.step[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            known = self.step[p][word]
            self.link[new] = known if self.length[known] == self.length[p] + 1 else self._split(p, word, known)
        return new

    def _split(self, p: int, word: int, known: int) -> int:
        """A state of its own for the shorter runs of ``known``."""
        new = self._state(self.length[p] + 1, dict(self.step[known]), self.link[known])
        self.link[known] = new
        while p >= 0 and self.step[p].get(word) == known:
            self.step[p][word] = new
            p = self.link[p]
        return new

    def follow(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest known run that ends at each word."""
        step, link, length = self.step, self.link, self.length
        at = run = 0
        for word in words:
            to = step[at].get(word)
            while to is None and at:
                at = link[at]
                run = length[at]
                to = step[at].get(word)
            if to is None:
                run = 0
            else:
                at, run = to, run + 1
            yield at, run

    def by_length(self) -> list[int]:
        """States from the shortest on, so that a link comes before what links to it."""
        return sorted(range(len(self.link)), key=self.length.__getitem__)


class Windows:
    """Which items have a window that ends where a stream of words stands.

    A window is ``width`` consecutive words of an item; an item of fewer words is
    one window.
    """

    def __init__(self, items: list[list[int]], width: int) -> None:
        self.auto, self.width = SuffixAutomaton(items), width
        auto = self.auto
        #: Per state: the state of its last ``width`` words (-1: it has fewer), and the longest whole short item among its endings.
        self.window, self.short = [-1] * len(auto.link), [-1] * len(auto.link)
        self.of_window: dict[int, set[int]] = {}
        self.of_short: dict[int, set[int]] = {}
        for i, item in enumerate(items):
            if 0 < len(item) < width:
                *_, (state, _) = auto.follow(item)
                self.of_short.setdefault(state, set()).add(i)
        for s in auto.by_length()[1:]:
            up = auto.link[s]
            self.short[s] = s if s in self.of_short else self.short[up]
            if auto.length[s] >= width:
                self.window[s] = self.window[up] if auto.length[up] >= width else s
        for i, item in enumerate(items):
            for state, run in auto.follow(item):
                if run >= width:
                    self.of_window.setdefault(self.window[state], set()).add(i)

    def shorts(self, state: int, run: int) -> Iterator[int]:
        """States of the whole short items that end here, the longest first."""
        at = self.short[state]
        while at > 0:
            if self.auto.length[at] <= run:
                yield at
            at = self.short[self.auto.link[at]]

    def hits(self, words: Iterable[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words (end exclusive, in order, merged where they meet) and the items found."""
        spans: list[list[int]] = []
        windows, shorts = set(), set()
        for i, (state, run) in enumerate(self.auto.follow(words), 1):
            start = i
            if run >= self.width:
                windows.add(self.window[state])
                start = i - run
            for s in self.shorts(state, run):
                if s not in shorts:
                    shorts.add(s)
                start = min(start, i - self.auto.length[s])
            if start < i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i])
        found = set().union(*[self.of_window[w] for w in windows], *[self.of_short[s] for s in shorts])
        return [(a, b) for a, b in spans], found
