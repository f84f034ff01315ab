"""Readings by a dictionary of (surface, reading, cost): the cheapest way to lay words over a text.

Surfaces are held in a double array (one transition is two array reads) and are looked
for at all places of many texts at once, one character further a round.  Where words
overlap, the cheapest path over them is found for all such stretches together, place
after place in numpy; the rest of a text stands as it is.

A character under no word of the path costs ``unknown`` and is its own reading.  Of equally
cheap ways to reach a place the one with the longest last word is taken.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np

UNKNOWN = 10_000
#: Gaps of the array that are tried for a state's children before it grows.
TRIES = 24
LOW_BITS = 6
#: Characters whose words are looked for together.
CHARS = 1 << 17


class DoubleArray:
    """Sorted distinct surfaces as transitions base[state] + code, owned by state where check agrees."""

    def __init__(self, surfaces: Sequence[str]):
        letters = sorted({c for s in surfaces for c in s})
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.longest = max(map(len, surfaces), default=0)
        # a character is two steps of a small alphabet, which leaves few gaps
        steps = {c: chr(1 + (k >> LOW_BITS)) + chr(1 + (k & (1 << LOW_BITS) - 1)) for k, c in enumerate(letters)}
        spelt = ["".join(steps[c] for c in s) for s in surfaces]
        self._most = max((ord(x) for s in steps.values() for x in s), default=0)
        base, check, value = ([x] * (self._most + 1) for x in (0, -1, -1))  # no state is so low but the first
        after, ahead = ([0] * (self._most + 1) for _ in range(2))  # a ring of the places that nothing owns, through place 0
        check[0] = 0

        def grow(size: int) -> None:
            for k in range(len(check), size):
                last = ahead[0]
                after[last] = ahead[0] = k
                after.append(0)
                ahead.append(last)
            more = max(size - len(check), 0)
            base.extend([0] * more)
            check.extend([-1] * more)
            value.extend([-1] * more)

        todo = [(0, 0, len(spelt), 0)]  # state, its surfaces, their common length
        while todo:
            state, lo, hi, depth = todo.pop()
            if lo < hi and len(spelt[lo]) == depth:
                value[state] = lo
                lo += 1
            children = []
            while lo < hi:
                c = spelt[lo][depth]
                end = bisect_right(spelt, c, lo, hi, key=lambda x, d=depth: x[d])
                children.append((ord(c), lo, end))
                lo = end
            if not children:
                continue
            first = children[0][0]
            place, at = 0, 0
            for _ in range(TRIES):
                place = after[place]
                if place == 0:
                    break
                if all(place - first + c >= len(check) or check[place - first + c] < 0 for c, _, _ in children):
                    at = place - first
                    break
            at = at or len(check) - first
            grow(at + children[-1][0] + 1)
            base[state] = at
            for c, a, b in children:
                check[at + c] = state
                after[ahead[at + c]], ahead[after[at + c]] = after[at + c], ahead[at + c]
                todo.append((at + c, a, b, depth + 1))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))

    def _step(self, state: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after the step, whether there is one); step 0 leads nowhere."""
        to = self.base[state] + step
        held = np.minimum(to, len(self.check) - 1)
        return held, (step > 0) & (held == to) & (self.check[held] == state)

    def matches(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, number of the surface) of every occurrence; a character that no surface has ends all."""
        out = [(np.zeros(0, np.int64),) * 3]
        if self.longest:
            k = np.minimum(np.searchsorted(self.letters, chars), len(self.letters) - 1)
            known = np.append(self.letters[k] == chars, False)
            high, low = (np.where(known, np.append(1 + x, 0), 0) for x in (k >> LOW_BITS, k & (1 << LOW_BITS) - 1))
            at = np.flatnonzero(known)
            state = np.zeros(len(at), np.int64)
            for depth in range(self.longest):
                here = np.minimum(at + depth, len(chars))
                state, ok = self._step(state, high[here])
                at, state, here = at[ok], state[ok], here[ok]
                state, ok = self._step(state, low[here])
                at, state = at[ok], state[ok]
                found = self.value[state] >= 0
                out.append((at[found], at[found] + depth + 1, self.value[state[found]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def cheapest(n: int, start: np.ndarray, end: np.ndarray, cost: np.ndarray, unknown: int = UNKNOWN) -> np.ndarray:
    """Which words, numbered as given, lie on the cheapest path over places 0..n, in order."""
    if not len(start):
        return np.zeros(0, np.int64)
    # places inside some word; between stretches of them paths do not interact
    deep = np.zeros(n + 2, np.int64)
    np.add.at(deep, start + 1, 1)
    np.subtract.at(deep, end, 1)
    inside = np.cumsum(deep)[: n + 1] > 0  # a word spans this border
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, start, 1)
    np.subtract.at(covered, end, 1)
    covered = np.cumsum(covered)[:n] > 0
    place = np.flatnonzero(covered)  # characters that stand alone at a price
    first_of = np.flatnonzero(covered & ~inside[:n])  # where stretches begin
    s = np.concatenate((start, place))
    e = np.concatenate((end, place + 1))
    price = np.concatenate((cost.astype(np.int64), np.full(len(place), unknown, np.int64)))
    origin = first_of[np.searchsorted(first_of, s, "right") - 1]
    # one number to sort by: distance from the stretch's begin, then place, then the longest first
    longest = int((e - s).max())
    order = np.argsort(((e - origin) * (n + 1) + e) * (longest + 1) + longest - (e - s), kind="stable")
    s, e, price, origin = s[order], e[order], price[order], origin[order]
    far = e - origin
    best, by = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
    bounds = np.flatnonzero(np.concatenate(([True], far[1:] != far[:-1], [True])))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        reach = best[s[lo:hi]] * (s[lo:hi] > origin[lo:hi]) + price[lo:hi]
        head = np.flatnonzero(np.concatenate(([True], e[lo + 1 : hi] != e[lo : hi - 1])))
        least = np.minimum.reduceat(reach, head)
        ok = np.flatnonzero(reach == np.repeat(least, np.diff(np.append(head, hi - lo))))[::-1]
        to = e[lo:hi]
        best[to[head]] = least
        by[to[ok]] = ok + lo  # the last written is the one with the smallest begin, the longest
    ends = np.flatnonzero(covered & np.concatenate((~inside[1:n], [True]))) + 1
    chosen, at = [], ends
    begin = np.zeros(n + 1, bool)
    begin[first_of] = True
    while len(at):
        word = by[at]
        chosen.append(word)
        at = s[word]
        at = at[~begin[at]]
    chosen = order[np.concatenate(chosen)]
    chosen = chosen[chosen < len(start)]
    return chosen[np.argsort(start[chosen], kind="stable")]


class Reader:
    """Surfaces with readings and costs, for many texts at a time.

    Empty surfaces and those with a zero character are left out; of equal ones the cheapest counts, then the least reading.
    """

    def __init__(self, rows: Sequence[tuple[str, str, int]], unknown: int = UNKNOWN):
        kept: dict[str, tuple[int, str]] = {}
        for surface, reading, cost in rows:
            if surface and "\0" not in surface:
                kept[surface] = min(kept.get(surface, (cost, reading)), (cost, reading))
        surfaces = sorted(kept)
        self.words = DoubleArray(surfaces)
        self.readings = np.array([kept[s][1] for s in surfaces], object)
        self.costs = np.array([kept[s][0] for s in surfaces], np.int64)
        self.unknown = unknown
        self.letters = {c for s in surfaces for c in s}

    def find(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, cost, reading) of all occurrences in the texts laid end to end, one place between them."""
        chars = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        start, end, word = self.words.matches(chars)
        return start, end, self.costs[word], self.readings[word]

    def read(self, texts: Sequence[str]) -> list[str]:
        """The readings of texts, about CHARS characters at a time; a longer text is cut where no surface goes on."""
        parts = [(k, p) for k, text in enumerate(texts) for p in _parts(text, self.letters)]
        said: list[list[str]] = [[] for _ in texts]
        group, size = [], 0
        for n, (k, part) in enumerate(parts, 1):
            group.append((k, part))
            size += len(part)
            if size > CHARS or n == len(parts):
                own = [p for _, p in group]
                for (at, _), reading in zip(group, lay(own, *self.find(own), self.unknown), strict=True):
                    said[at].append(reading)
                group, size = [], 0
        return ["".join(x) for x in said]


def _parts(text: str, letters: set[str]) -> Iterator[str]:
    lo = 0
    while lo < len(text):
        hi = lo + CHARS
        while hi < len(text) and text[hi - 1] in letters:
            hi += 1
        yield text[lo:hi]
        lo = hi


def lay(texts: Sequence[str], start: np.ndarray, end: np.ndarray, cost: np.ndarray, reading: np.ndarray, unknown: int = UNKNOWN) -> list[str]:
    """The texts with the words of the cheapest path replaced by what they read."""
    line, bounds = "\0".join(texts), np.cumsum([len(t) + 1 for t in texts])
    path = cheapest(len(line), start, end, cost, unknown)
    starts, ends, said = start[path].tolist(), end[path].tolist(), reading[path].tolist()
    out, k, lo = [], 0, 0
    for text, hi in zip(texts, bounds.tolist(), strict=True):
        parts, at = [], lo
        while k < len(starts) and starts[k] < hi:
            parts += (line[at : starts[k]], said[k])
            at, k = ends[k], k + 1
        out.append("".join((*parts, line[at : hi - 1])) if parts else text)
        lo = hi
    return out
