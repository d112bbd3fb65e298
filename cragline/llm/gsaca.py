"""Suffix arrays by linear grouping, of many texts at once.

Phase 1 keeps suffixes in groups that share a prefix and handles the groups of each text in descending order. A handled
group's prefix is its suffixes' Lyndon prefix; each suffix points to the nearest earlier one in a smaller group (its
previous smaller suffix), whose own prefix it prolongs, so those move to new groups behind the rest of theirs, by how
often they were pointed to. Phase 2 walks the array upwards and puts the predecessor chain of each suffix into the next
free places of their groups. No text is renamed and nothing recurses.

All texts take a step at the same time: step k handles the k-th group from the end of every text, in flat arrays. The
last few texts, too few to fill an array, go on one by one.

Defined results: an empty text has an empty array; without texts the result is empty; a text of one repeated symbol
costs the square of its length.
"""

from __future__ import annotations

import numpy as np

#: With fewer texts than this under way, each goes on by itself.
FEW = 24


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))


class _State:
    """Positions and groups of all texts, numbered through; group ids are places of their first members."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray):
        n = len(text)
        self.hi = np.cumsum(lengths)
        self.lo = self.hi - lengths
        lane = np.repeat(np.arange(len(lengths)), lengths)
        self.sa = np.argsort(lane * (int(text.max()) + 1) + text, kind="stable") if n else np.zeros(0, np.int64)
        t, own = text[self.sa], lane[self.sa]
        new = np.ones(n, bool)
        new[1:] = (t[1:] != t[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        self.place, self.group, self.size = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
        self.place[self.sa] = np.arange(n)
        self.group[self.sa] = np.repeat(at, np.diff(np.r_[at, n]))
        self.size[at] = np.diff(np.r_[at, n])
        self.prev = np.full(n, -2)  # not known yet
        self.moves = np.zeros(n, bool)

    def step(self, first: np.ndarray, end: np.ndarray, lo: np.ndarray) -> None:
        """Handle one group of each of some texts: the places first to end, of texts that start at lo."""
        sa, place, group, size, prev = self.sa, self.place, self.group, self.size, self.prev
        many = end - first + 1
        s = sa[_ranges(first, many)]
        f, low = np.repeat(first, many), np.repeat(lo, many)
        p = s - 1
        go = np.flatnonzero((p >= low) & (group[p] >= f))
        while len(go):
            x = p[go]
            q = prev[x]
            x = np.where(q == -2, x - 1, q)
            p[go] = x
            go = go[(x >= low[go]) & (group[x] >= f[go])]
        prev[s] = np.maximum(p, low - 1)
        p = p[p >= low]
        if not len(p):
            return
        p.sort()
        new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        count = np.diff(np.r_[new, len(p)])
        p = p[new]
        g = group[p]
        o = np.lexsort((count, g))
        p, g, count = p[o], g[o], count[o]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        moved = np.diff(np.r_[start, len(g)])
        back = g[start] + size[g[start]] - moved  # the first place of what moves
        target = _ranges(back, moved)
        # whoever stays in a place at the back takes one that was left
        self.moves[p] = True
        there = sa[target]
        stay = there[~self.moves[there]]
        self.moves[p] = False
        left = place[p]
        left = np.sort(left[left < np.repeat(back, moved)])
        sa[left], place[stay] = stay, left
        sa[target], place[p] = p, target
        size[g[start]] -= moved
        run = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (count[1:] != count[:-1])])
        length = np.diff(np.r_[run, len(g)])
        size[target[run]] = length
        group[p] = np.repeat(target[run], length)

    def alone(self, end: int, lo: int, hi: int) -> None:
        """Go on with one text to its first group."""
        sa, place, group, prev = ((a[lo:hi] - lo).tolist() for a in (self.sa, self.place, self.group, self.prev))
        size = self.size[lo:hi].tolist()
        end -= lo
        unknown = -2 - lo
        while end >= 0:
            first = group[sa[end]]
            count: dict[int, int] = {}
            for s in sa[first : end + 1]:
                p = s - 1
                while p >= 0 and group[p] >= first:
                    q = prev[p]
                    p = q if q != unknown else p - 1
                prev[s] = p
                if p >= 0:
                    count[p] = count.get(p, 0) + 1
            end = first - 1
            by: dict[int, list[int]] = {}
            for p, c in count.items():
                by.setdefault(c, []).append(p)
            for c in sorted(by, reverse=True):
                moved: dict[int, int] = {}
                for p in by[c]:  # to the back of its group
                    g = group[p]
                    last = g + size[g] - 1 - moved.get(g, 0)
                    other, at = sa[last], place[p]
                    sa[at], sa[last] = other, p
                    place[other], place[p] = at, last
                    moved[g] = moved.get(g, 0) + 1
                for g, m in moved.items():
                    size[g] -= m
                    new = g + size[g]
                    if size[g]:
                        size[new] = m
                        for k in range(new, new + m):
                            group[sa[k]] = new
                    else:
                        size[g] = m
        self.group[lo:hi] = np.array(group) + lo
        self.prev[lo:hi] = np.array(prev) + lo

    def groups(self) -> None:
        lane = np.flatnonzero(self.hi > self.lo)
        end = self.hi[lane] - 1
        while len(lane) > FEW:
            lo = self.lo[lane]
            first = self.group[self.sa[end]]
            self.step(first, end, lo)
            end = first - 1
            live = end >= lo
            lane, end = lane[live], end[live]
        for x, e in zip(lane.tolist(), end.tolist(), strict=True):
            self.alone(e, int(self.lo[x]), int(self.hi[x]))

    def order(self, last: np.ndarray) -> np.ndarray:
        """The suffix arrays, from the groups; last: the place in the text of each text's smallest symbol, its end."""
        n = len(self.sa)
        out, done, free = np.zeros(n, np.int64), np.zeros(n, bool), np.arange(n)
        lane = np.flatnonzero(self.hi > self.lo)
        out[self.lo[lane]] = last[lane]
        done[last[lane]] = True
        k = 0
        while len(lane) > FEW:
            lo = self.lo[lane]
            e = out[lo + k] - 1
            go = np.flatnonzero((e >= lo) & ~done[e])
            e, low = e[go], lo[go]
            while len(e):
                g = self.group[e]
                out[free[g]] = e
                free[g] += 1
                done[e] = True
                e = self.prev[e]
                live = (e >= low) & ~done[e]
                e, low = e[live], low[live]
            k += 1
            lane = lane[lo + k < self.hi[lane]]
        for x in lane.tolist():
            lo, hi = int(self.lo[x]), int(self.hi[x])
            group, prev, place, at = ((a[lo:hi] - lo).tolist() for a in (self.group, self.prev, out, free))
            seen = done[lo:hi].tolist()
            for i in range(k, hi - lo):
                e = place[i] - 1
                while e >= 0 and not seen[e]:
                    g = group[e]
                    place[at[g]] = e
                    at[g] += 1
                    seen[e] = True
                    e = prev[e]
            out[lo:hi] = np.array(place) + lo
        return out


def suffix_arrays(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places in `text` (non-negative ints; texts of these lengths, one after another) of each text's suffixes in order."""
    lengths = np.asarray(lengths, np.int64)
    n = len(lengths)
    ends = np.cumsum(lengths)
    wide = np.zeros(len(text) + n, np.int64)  # each text gets a least symbol at its end
    at = np.arange(len(text)) + np.repeat(np.arange(n), lengths)
    wide[at] = np.asarray(text, np.int64) + 1
    state = _State(wide, lengths + 1)
    state.groups()
    last = ends + np.arange(n)
    got = state.order(last)
    keep = np.ones(len(got), bool)
    keep[state.lo] = False
    got = got[keep]
    return got - np.repeat(np.arange(n), lengths)


def suffix_array(text) -> list[int]:
    """Suffix array of one sequence of non-negative ints."""
    text = np.asarray(list(text), np.int64)
    return suffix_arrays(text, np.array([len(text)])).tolist()
