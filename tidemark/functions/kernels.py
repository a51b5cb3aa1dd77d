"""Sequence kernels without Spark: longest common subsequence and the diff built on it."""

from __future__ import annotations

import string
from collections.abc import Sequence
from itertools import groupby

import numpy as np


def lcs_table(a: Sequence, b: Sequence) -> np.ndarray:
    """Lengths for all prefixes; each row is one vector step over the longer side."""
    codes: dict = {}
    x = np.array([codes.setdefault(v, len(codes)) for v in a], np.int64)
    y = np.array([codes.setdefault(v, len(codes)) for v in b], np.int64)
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(1, len(x) + 1):
        up = table[i - 1]
        table[i, 1:] = np.maximum.accumulate(np.maximum(up[1:], np.where(y == x[i - 1], up[:-1] + 1, 0)))
    return table


#: Cells of a table that is held at once; longer sequences are parted in halves first.
MOST_CELLS = 1 << 26


def lcs(a: Sequence, b: Sequence) -> list:
    """One longest common subsequence. Equal ends are taken off first; within, equal heads are always
    taken together, else the step goes up unless left is strictly longer."""
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and hi < m - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    return [*b[:lo], *_inner_lcs(a[lo : n - hi], b[lo : m - hi]), *b[m - hi :]]


def _inner_lcs(a: Sequence, b: Sequence) -> list:
    if not a or not b:
        return []
    if (len(a) + 1) * (len(b) + 1) > MOST_CELLS and len(a) > 1:
        half = len(a) // 2
        at = int(np.argmax(_last_row(a[:half], b) + _last_row(a[half:][::-1], b[::-1])[::-1]))
        return _inner_lcs(a[:half], b[:at]) + _inner_lcs(a[half:], b[at:])
    table = lcs_table(a, b)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(b[j - 1])
            i, j = i - 1, j - 1
        elif table[i, j - 1] > table[i - 1, j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def _last_row(a: Sequence, b: Sequence) -> np.ndarray:
    """Lengths for all of ``a`` with each prefix of ``b``, one row in memory."""
    codes: dict = {}
    y = np.array([codes.setdefault(v, len(codes)) for v in b], np.int64)
    row = np.zeros(len(y) + 1, np.int64)
    for v in a:
        if (c := codes.get(v)) is not None:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == c, row[:-1] + 1, 0)))
    return row


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Its length, with the equal ends of both taken off first."""
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and hi < m - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    a, b = a[lo : n - hi], b[lo : m - hi]
    return lo + hi + (int(_last_row(a, b)[-1]) if a and b else 0)


class Compared:
    """Many sequences, made ready to be compared with one after another.

    Each sequence's places in the other are bits of one machine word, so that a step of the longest
    common subsequence is a few vector operations over all sequences; longer ones than a word has bits go one by one.
    """

    def __init__(self, many: Sequence[Sequence]):
        self.many = many
        self.codes: dict = {}
        rows = [[self.codes.setdefault(v, len(self.codes) + 1) for v in b] for b in many]
        self.n = np.array([len(r) for r in rows], np.int64)
        self.kinds = np.array([len(set(r)) for r in rows], np.int64)
        self.order = np.argsort(-self.n, kind="stable")
        longest = int(self.n.max()) if rows else 0
        self.at = np.zeros((longest, len(rows)), np.int64)
        for k, i in enumerate(self.order):
            self.at[: len(rows[i]), k] = rows[i]
        self.reach = [int((self.n > j).sum()) for j in range(longest)]
        each = [list(dict.fromkeys(r)) for r in rows]
        self.flat = np.array([c for r in each for c in r], np.int64)
        self.owner = np.repeat(np.arange(len(rows)), self.kinds)

    def shared(self, a: Sequence) -> np.ndarray:
        """How many distinct elements each has in common with ``a``."""
        has = np.zeros(len(self.codes) + 1, bool)
        has[[self.codes[v] for v in set(a) if v in self.codes]] = True
        return np.bincount(self.owner[has[self.flat]], minlength=len(self.many))

    def lcs_lengths(self, a: Sequence) -> np.ndarray:
        """:func:`lcs_length` of ``a`` and each."""
        if len(a) > 64:
            return np.array([lcs_length(a, b) for b in self.many], np.int64)
        places = [0] * (len(self.codes) + 1)
        for i, v in enumerate(a):
            if v in self.codes:
                places[self.codes[v]] |= 1 << i
        mask = np.array(places, np.uint64)
        v = np.full(len(self.many), 2**64 - 1, np.uint64)
        for j, k in enumerate(self.reach):
            u = v[:k] & mask[self.at[j, :k]]
            v[:k] = (v[:k] + u) | (v[:k] - u)
        out = np.empty(len(self.many), np.int64)
        out[self.order] = len(a) - np.bitwise_count(v & np.uint64((1 << len(a)) - 1)).astype(np.int64)
        return out


class Postings:
    """Many sequences, made ready to tell which distinct elements each has in common with each of others; for each element the sequences that have it."""

    def __init__(self, many: Sequence[Sequence]):
        self.codes: dict = {}
        rows = [[self.codes.setdefault(v, len(self.codes)) for v in dict.fromkeys(b)] for b in many]
        self.many = len(rows)
        self.kinds = np.array([len(r) for r in rows], np.int64)
        flat = np.array([c for r in rows for c in r], np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(rows)), self.kinds)[order]
        self.n = np.bincount(flat, minlength=len(self.codes))
        self.begin = np.cumsum(self.n) - self.n

    def shared(self, ones: Sequence[Sequence], weight=None) -> tuple[np.ndarray, np.ndarray | None]:
        """``(others, many)`` counts of the distinct elements in common; sums of their whole-numbered weights too, where ``weight(element)`` is given."""
        known = [[c for v in dict.fromkeys(a) if (c := self.codes.get(v)) is not None] for a in ones]
        code = np.array([c for r in known for c in r], np.int64)
        n = self.n[code]
        at = np.arange(n.sum()) + np.repeat(self.begin[code] - (np.cumsum(n) - n), n)
        cell = np.repeat(np.repeat(np.arange(len(known)), [len(r) for r in known]) * self.many, n) + self.owner[at]
        shape = (len(known), self.many)
        count = np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape)
        if weight is None:
            return count, None
        w = np.array([weight(v) for v in self.codes], float)[code]
        return count, np.bincount(cell, np.repeat(w, n), minlength=shape[0] * shape[1]).reshape(shape)


def fast_diff(a: Sequence, b: Sequence) -> list[tuple[int, object]]:
    """``(code, element)``: -1 only in a, 0 in both, 1 only in b. Removed precedes added."""
    out: list[tuple[int, object]] = []
    i = j = 0
    for c in [*lcs(a, b), None]:
        end = c is None
        while i < len(a) and (end or a[i] != c):
            out.append((-1, a[i]))
            i += 1
        while j < len(b) and (end or b[j] != c):
            out.append((1, b[j]))
            j += 1
        if not end:
            out.append((0, c))
            i, j = i + 1, j + 1
    return out


#: Weight of one common word against its characters, in a longest common subsequence of most characters.
_WORD = 1_000_000


def common_characters(a: Sequence[str], b: Sequence[str]) -> int:
    """Characters of the words in a longest common subsequence; of several longest ones, the most.

    One row of the table at a time: each is one vector step over the other side.
    """
    lo, n, m, kept = 0, len(a), len(b), 0
    while lo < n and lo < m and a[lo] == b[lo]:
        kept += len(a[lo])
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        kept += len(a[n - 1])
        n, m = n - 1, m - 1
    if lo == n or lo == m:
        return kept
    codes: dict = {}
    y = np.array([codes.setdefault(v, len(codes)) for v in b[lo:m]], np.int64)
    row = np.zeros(len(y) + 1, np.int64)
    for w in a[lo:n]:
        if (c := codes.get(w)) is not None:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == c, row[:-1] + _WORD + len(w), 0)))
    return kept + int(row[-1]) % _WORD


def change_sizes(a: Sequence[str], b: Sequence[str]) -> tuple[int, int]:
    """Characters of the removed and of the added words."""
    kept = common_characters(a, b)
    return sum(map(len, a)) - kept, sum(map(len, b)) - kept


def similar(a: Sequence[str], b: Sequence[str], one: str | None = None, two: str | None = None) -> bool:
    """Removed at most 0.2 and added at most 0.4 of the original's characters, or one text contains the other.

    ``a`` and ``b`` are the words of the preprocessed texts ``one`` and ``two``.
    """
    one, two = " ".join(a) if one is None else one, " ".join(b) if two is None else two
    if one in two or two in one:
        return True
    n, m = sum(map(len, a)), sum(map(len, b))
    if n == 0 or n - m > 0.2 * n or m - n > 0.4 * n:
        return False
    removed, added = change_sizes(a, b)
    return removed <= 0.2 * n and added <= 0.4 * n


def mark_changes(a: Sequence[str], b: Sequence[str], quote: str = "**") -> tuple[str, str]:
    """Both sentences with their changed runs in quotes and a full stop at the end."""
    diff = fast_diff(a, b)

    def side(own: int) -> str:
        out: list[str] = []
        for changed, run in groupby((x for x in diff if x[0] in (0, own)), key=lambda x: x[0] == own):
            text = " ".join(w for _, w in run)
            out.append(f"{quote}{text}{quote}" if changed else text)
        return " ".join(out) + "."

    return side(-1), side(1)


def copy_edit(a: str, b: str, tokens1: Sequence[str], tokens2: Sequence[str]) -> str | None:
    """'correction' or 'word usage' where a rewrite is a mere copy edit, else None. The first rule that fits holds.

    The tokens are those of the preprocessed sentences without full stops at their end.
    """
    chars = [(c, x) for c, x in fast_diff(a, b) if c]
    added, removed = [x for c, x in chars if c == 1], [x for c, x in chars if c == -1]
    mark = lambda x: x in string.punctuation or x in string.whitespace
    if len(added) <= 1 and len(removed) <= 1 and all(mark(x) or x in string.ascii_letters for x in added + removed):
        return "correction"
    if all(mark(x) for _, x in chars):
        return "correction"
    words = [(c, w) for c, w in fast_diff(tokens1, tokens2) if c]
    more, fewer = [w for c, w in words if c == 1], [w for c, w in words if c == -1]
    if not words:
        return "correction"
    if len(more) == 1 and more == fewer:
        return "word usage"
    if more in ([], ["the"]) and fewer in ([], ["the"]):
        return "word usage"
    return None


def diff_rows(old: Sequence[str], new: Sequence[str]) -> list[tuple[int, str, int, int, int, int]]:
    """``(code, line, p1, s1, p2, s2)``: the diff of two versions' lines with their places in either, -1 where a line is
    not in a version. Places count from 0; a blank line is the last of its paragraph."""
    out = []
    at = {-1: [0, 0], 1: [0, 0]}
    for code, line in fast_diff(old, new):
        place = [-1, -1, -1, -1]
        for k, side in enumerate((-1, 1)):
            if code in (side, 0):
                here = at[side]
                place[2 * k : 2 * k + 2] = here
                here[:] = [here[0] + 1, 0] if line == "" else [here[0], here[1] + 1]
        out.append((code, line, *place))
    return out
