"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, then blind tries for long common prefixes."""

from __future__ import annotations

import numpy as np


def multikey_quicksort(rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their first ``depth`` bytes (a multiple of 8), and the numbers of their groups of equal ones.

    The characters are eight bytes wide, and all open groups are partitioned around their pivots at once: rows below, equal
    to and above the pivot part; equal ones go on to the next character.
    """
    n = len(rows)
    keys = np.ascontiguousarray(rows[:, :depth]).view(">u8").astype(np.uint64)
    order, group, at = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_ = np.arange(n)  # places in the order that are still unsorted; groups are runs of places
    last = keys.shape[1]
    while len(open_):
        g = group[open_]
        edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[edge, len(g)])
        char = keys[order[open_], at[open_]]
        pivot = np.sort(np.stack([char[edge], char[edge + size // 2], char[edge + size - 1]]), axis=0)[1]
        pivot = np.repeat(pivot, size)
        side = (char > pivot).astype(np.int64) - (char < pivot)
        by = np.argsort((np.repeat(np.arange(len(size)), size) * 3) + side + 1, kind="stable")
        order[open_], side = order[open_][by], side[by]
        at[open_] = at[open_][by] + (side == 0)
        # a group is named by its first place
        new = np.r_[True, (side[1:] != side[:-1]) | (g[1:] != g[:-1])]
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        alone = new & np.r_[new[1:], True]
        open_ = open_[~alone & (at[open_] < last)]
    return order, group


class BlindTrie:
    """A trie of equally long byte strings that keeps only the depths where they branch and the bytes there."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = [len(strings[0]), [], [0]]  # depth, branching bytes, children; at full depth: equal strings

    def insert(self, i: int) -> None:
        s, width, node, path = self.strings[i], len(self.strings[i]), self.root, []
        while node[0] < width:  # go down blindly, looking only at the bytes of branches
            path.append(node)
            c = s[node[0]]
            node = node[2][node[1].index(c)] if c in node[1] else node[2][0]
        path.append(node)
        other = self.strings[node[2][0]]
        common = _common(s, other)
        if common == width:
            node[2].append(i)
            return
        k = next(k for k, x in enumerate(path) if x[0] >= common)
        at = path[k]
        leaf = [width, [], [i]]
        if at[0] == common:
            c = s[common]
            where = sum(x < c for x in at[1])
            at[1].insert(where, c)
            at[2].insert(where, leaf)
            return
        below = at[:]
        pair = sorted([(s[common], 0, leaf), (other[common], 1, below)])
        at[:] = [common, [p[0] for p in pair], [p[2] for p in pair]]

    def walk(self) -> tuple[list[int], list[int]]:
        """The strings in order, and each one's common prefix with the one before."""
        order: list[int] = []
        lcp: list[int] = []
        stack = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if not node[1]:
                order += node[2]
                lcp += [before] + [node[0]] * (len(node[2]) - 1)
            else:
                for k in range(len(node[2]) - 1, -1, -1):
                    stack.append((node[2][k], node[0] if k else before))
        return order, lcp


def _common(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def deep_shallow(rows: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of equally many bytes (a multiple of 8), and each one's common prefix with the row before (0 for the first)."""
    n, width = rows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, group = multikey_quicksort(rows, min(shallow, width))
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[edge, n])
    if shallow < width:
        two = edge[size == 2]  # a trie of two is a comparison
        a, b = order[two], order[two + 1]
        differ = rows[a] != rows[b]
        at = np.argmax(differ, axis=1)
        swap = rows[a, at] > rows[b, at]
        order[two[swap]], order[two[swap] + 1] = b[swap], a[swap]
        for e, k in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            members = order[e : e + k]
            data = rows[members, shallow:].tobytes()
            trie = BlindTrie([data[j * (width - shallow) : (j + 1) * (width - shallow)] for j in range(k)])
            for j in range(1, k):
                trie.insert(j)
            order[e : e + k] = members[trie.walk()[0]]
    lcp = np.zeros(n, np.int64)
    for i in range(1, n, 1 << 16):
        a, b = rows[order[i - 1 : min(n, i + (1 << 16)) - 1]], rows[order[i : i + (1 << 16)]]
        differ = a != b
        lcp[i : i + (1 << 16)] = np.where(differ.any(axis=1), np.argmax(differ, axis=1), width)
    return order, lcp
