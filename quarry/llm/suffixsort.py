"""Hash-compared suffix sorting, vectorised.

Two suffixes' longest common extension is found by binary search on prefix polynomial
hashes, so a comparison takes logarithmic steps whatever the length of the match.  Many
short independent lists are sorted at once by bottom-up mergesort: at each level every
element finds its rank in the sibling run by binary search.
"""

from __future__ import annotations

import numpy as np

from .common import prefix_hash, span_hash


class SuffixOrder:
    """Compares suffixes of ``text`` on their first ``depth`` bytes."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth, self.prefix = text, depth, prefix_hash(text)
        self.steps = [1 << k for k in range(depth.bit_length() - 1, -1, -1)]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extensions of suffixes a and b, ``depth`` at most; none may end sooner."""
        out = np.zeros(len(a), np.int64)
        for step in self.steps:
            place = np.flatnonzero(out + step <= self.depth)
            x, y = a[place] + out[place], b[place] + out[place]
            same = span_hash(self.prefix, x, x + step) == span_hash(self.prefix, y, y + step)
            out[place[same]] += step
        return out

    def below(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix a comes before, with or after suffix b."""
        n = self.extension(a, b)
        at = np.minimum(n, self.depth - 1)
        return np.where(n == self.depth, 0, np.sign(self.text[a + at].astype(np.int16) - self.text[b + at]))

    def sort(self, starts: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """An order of ``starts`` that sorts each list's suffixes; ``lists`` is sorted, one number per start."""
        n = len(starts)
        order = np.arange(n)
        first = np.searchsorted(lists, lists)
        size = np.searchsorted(lists, lists, "right") - first
        width = 1
        while n and width < size.max():
            active = np.flatnonzero(size > width)
            within = active - first[active]
            block = within // (2 * width) * (2 * width)
            left = within - block < width
            begin = first[active] + block
            middle = begin + np.minimum(width, size[active] - block)
            end = begin + np.minimum(2 * width, size[active] - block)
            low = np.where(left, middle, begin)
            high = np.where(left, end, middle)
            base = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                c = self.below(starts[order[mid]], starts[order[active[open_]]])
                after = (c < 0) | ((c == 0) & ~left[open_])  # equal suffixes keep their order
                low[open_[after]] = mid[after] + 1
                high[open_[~after]] = mid[~after]
            own = np.where(left, active - begin, active - middle)
            merged = order.copy()
            merged[begin + own + (low - base)] = order[active]
            order = merged
            width *= 2
        return order

    def classes(self, starts: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, class number along the order): neighbours of one list whose first ``depth`` bytes
        are equal share a class.  Equal hashes are verified on the bytes."""
        order = self.sort(starts, lists)
        new = np.ones(len(order), bool)
        if len(order) > 1:
            a, b = starts[order[:-1]], starts[order[1:]]
            same = np.flatnonzero(lists[order[:-1]] == lists[order[1:]])
            same = same[self.extension(a[same], b[same]) == self.depth]
            rows = np.lib.stride_tricks.sliding_window_view(self.text, self.depth)
            for k in range(0, len(same), 65536):
                part = same[k : k + 65536]
                if not (rows[a[part]] == rows[b[part]]).all():
                    raise ArithmeticError("two different strings share their hashes")
            new[same + 1] = False
        return order, np.cumsum(new) - 1
