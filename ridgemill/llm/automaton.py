"""A suffix automaton over word codes, for matching statistics."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """Holds every run of the sequences added to it; size is linear in their length."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.depth = [0]

    def _state(self, depth: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.depth.append(depth)
        return len(self.depth) - 1

    def _split(self, before: int, code: int, old: int) -> int:
        """The state of `before` and `code`: `old`, or a copy of it with that depth."""
        if self.depth[old] == self.depth[before] + 1:
            return old
        copy = self._state(self.depth[before] + 1, dict(self.step[old]), self.link[old])
        self.link[old] = copy
        while before >= 0 and self.step[before].get(code) == old:
            self.step[before][code] = copy
            before = self.link[before]
        return copy

    def add(self, codes: Iterable[int]) -> None:
        """One more sequence."""
        last = 0
        for code in codes:
            if (old := self.step[last].get(code)) is not None:
                last = self._split(last, code, old)
                continue
            new = self._state(self.depth[last] + 1, {}, 0)
            at = last
            while at >= 0 and code not in self.step[at]:
                self.step[at][code] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, code, self.step[at][code])
            last = new

    def statistics(self, codes: Iterable[int]) -> list[int]:
        """For each place the length of the longest run ending there that some
        added sequence holds."""
        out, at, length = [], 0, 0
        step, link, depth = self.step, self.link, self.depth
        for code in codes:
            while (to := step[at].get(code)) is None and at:
                at = link[at]
                length = depth[at]
            if to is None:
                length = 0
            else:
                at, length = to, length + 1
            out.append(length)
        return out
