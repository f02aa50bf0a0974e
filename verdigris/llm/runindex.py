"""Run-length indexes: run-compressed Burrows-Wheeler transforms with text positions sampled at run ends."""

from __future__ import annotations

import numpy as np

#: Ends each text of an index; UTF-8 has no such byte. It sorts after all others.
SEPARATOR = 0xFF
#: Match lengths are followed up to this many bytes; longer ones count as this long.
REACH = 64
#: Bits of a place in the text of an index.
PLACE_BITS = 21


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers from each start on, as many as its size."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number; separators follow the end."""
    padded = np.concatenate((text, np.full(8, SEPARATOR, np.uint8))).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i : i + len(text)]
    return out


def ordered(*keys: np.ndarray) -> np.ndarray:
    """Places in the order of ``keys``, then of the places. All keys and the place are one number, as numbers alone are
    sorted several times faster than places."""
    packed = keys[0]
    for key in keys[1:]:
        packed = packed << PLACE_BITS | key
    return np.sort(packed << PLACE_BITS | np.arange(len(packed))) & ((1 << PLACE_BITS) - 1)


def suffix_array(text: np.ndarray, group: np.ndarray, text_words: np.ndarray) -> np.ndarray:
    """Places of ``text`` by group, then by the suffix that ends with its own text; equal suffixes in text order.

    The first five bytes are sorted, then ranks are doubled, for the places only whose rank is not settled yet.
    """
    n = len(text)
    ends = np.flatnonzero(text == SEPARATOR)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    short = left < 5
    key = (text_words >> np.uint64(24)).astype(np.int64)
    key[short] |= (1 << (8 * (5 - left[short]))) - 1
    rank = np.empty(n, np.int64)

    def settle(places: np.ndarray, new: np.ndarray, base: np.ndarray | int) -> np.ndarray:
        """Rank ``places`` by where their class starts; return those in classes of two or more."""
        rank[places] = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0)) + base
        return places[~(new & np.append(new[1:], True))]

    places = ordered(key)
    settle(places, np.concatenate(([True], key[places][1:] != key[places][:-1])), 0)
    places = ordered(group, rank)
    r, g, s = rank[places], group[places], short[places]
    # what is left of a short one is all there is, and places already tell these apart
    open_, step = settle(places, np.concatenate(([True], (r[1:] != r[:-1]) | (g[1:] != g[:-1]) | s[1:])), 0), 5
    while len(open_):
        then = rank[np.minimum(open_ + step, n - 1)]
        order = ordered(rank[open_], then)
        open_, then = open_[order], then[order]
        own = rank[open_]
        first = np.concatenate(([True], own[1:] != own[:-1]))
        # a class keeps its place among all ranks
        base = own - np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))
        open_, step = settle(open_, first | np.concatenate(([True], then[1:] != then[:-1])), base), step * 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class RunIndex:
    """Indexes of many groups of texts at once: group by group, the runs of the Burrows-Wheeler transform with the
    symbol, first row, place of the row that its symbol leads to, and text position at either end of each run. The
    suffix array is dropped once the run ends are sampled; a match is followed by run ends alone."""

    def __init__(self, text: np.ndarray, group: np.ndarray):
        """``text``: bytes, each text ended by ``SEPARATOR``; ``group``: of each place, ascending."""
        if len(text) >= 1 << PLACE_BITS:
            raise ValueError(f"an index holds under {1 << PLACE_BITS} bytes, not {len(text)}")
        group = group.astype(np.int64)
        padded = np.concatenate((text, np.full(REACH + 8, SEPARATOR, np.uint8)))
        # the eight bytes from each place on, without a copy
        self.words = np.ndarray(len(text) + REACH + 1, "<u8", padded.data, strides=(1,))
        places = suffix_array(text, group, words(text))
        before = np.where(places > 0, text[places - 1], np.uint8(SEPARATOR))
        # places are sorted by group, so rows have the groups of the text
        new = np.concatenate(([True], (before[1:] != before[:-1]) | (group[1:] != group[:-1])))
        self.head = np.flatnonzero(new)
        self.size = np.diff(np.append(self.head, len(text)))
        self.symbol = before[self.head].astype(np.int64)
        self.first, self.last = places[self.head], places[self.head + self.size - 1]
        owner = group[self.head]
        self.order = ordered(owner * 256 + self.symbol)
        self.lead = np.empty(len(self.head), np.int64)
        self.lead[self.order] = np.cumsum(self.size[self.order]) - self.size[self.order]
        self.stride = len(self.head) + 1
        self.by_symbol = ((owner * 256 + self.symbol) * self.stride + np.arange(len(self.head)))[self.order]
        self.group_run = np.searchsorted(owner, np.arange(int(group[-1]) + 2))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the text has in common from places ``a`` and ``b`` on, up to ``REACH``."""
        apart = self.words[a] ^ self.words[b]
        out = np.zeros(len(a), np.int64)
        more = np.flatnonzero(apart == 0)
        if len(more):
            step = np.arange(8, REACH, 8)
            rest = self.words[a[more][:, None] + step] ^ self.words[b[more][:, None] + step]
            far = rest != 0
            k = far.argmax(axis=1)
            apart[more] = rest[np.arange(len(more)), k]
            out[more] = np.where(far.any(axis=1), 8 * (k + 1), REACH)
        # the lowest bit that differs is a power of two, so its logarithm is exact
        far = np.flatnonzero(apart)
        x = apart[far]
        out[far] += np.log2((x & (~x + np.uint64(1))).astype(np.float64)).astype(np.int64) >> 3
        return out

    def matching_statistics(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """For each place of the patterns (``sizes`` bytes of ``flat`` from ``starts`` on) how many bytes from there on
        the texts of the pattern's group hold somewhere, up to ``REACH``; in the order of ``flat``.

        All patterns are read at once from their last byte to their first. A byte that precedes the present row leads
        on from it. Otherwise the nearest runs of that byte above and below are tried: the end that has more in common
        with the text at the present position goes on.
        """
        found = np.zeros(len(flat), np.uint8)
        by_size = np.argsort(-sizes, kind="stable")
        starts, sizes, groups = starts[by_size], sizes[by_size], groups[by_size].astype(np.int64)
        row = self.head[self.group_run[groups]]
        pos = self.first[self.group_run[groups]]
        length = np.zeros(len(starts), np.int64)
        last = starts + sizes - 1
        for step in range(int(sizes[0]) if len(sizes) else 0):
            m = int(np.searchsorted(-sizes, -step))
            at = last[:m] - step
            byte = flat[at].astype(np.int64)
            run = np.searchsorted(self.head, row[:m], "right") - 1
            row[:m] += self.lead[run] - self.head[run]
            pos[:m] -= 1
            length[:m] += 1
            other = np.flatnonzero(self.symbol[run] != byte)
            if len(other):
                here, was = run[other], pos[other] + 1
                row_was = row[other] - self.lead[here] + self.head[here]
                base = (groups[other] * 256 + byte[other]) * self.stride
                p = np.searchsorted(self.by_symbol, base + here)
                above, below = np.maximum(p - 1, 0), np.minimum(p, len(self.order) - 1)
                has_above = (p > 0) & (self.by_symbol[above] >= base)
                has_below = (p < len(self.order)) & (self.by_symbol[below] < base + self.stride)
                up, down = self.order[above], self.order[below]
                near = self.common(np.concatenate((was, was)), np.concatenate((self.last[up], self.first[down]))).reshape(2, -1)
                near[0, ~has_above] = -1
                near[1, ~has_below] = -1
                use_up, none = near[0] > near[1], ~(has_above | has_below)
                best = np.maximum(near[0], near[1])
                row[other] = np.where(none, row_was, np.where(use_up, self.lead[up] + self.size[up] - 1, self.lead[down]))
                pos[other] = np.where(none, was, np.where(use_up, self.last[up], self.first[down]) - 1)
                length[other] = np.where(none, 0, np.minimum(length[other] - 1, best) + 1)
            np.minimum(length[:m], REACH, out=length[:m])
            found[at] = length[:m]
        return found
