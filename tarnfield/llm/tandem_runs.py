"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q, long and repeated enough, that
cannot be extended. Squares (two equal halves) are found in three steps. Blocks of
the Lempel-Ziv factorisation: the first occurrence of a square touches two blocks,
so common extensions to the left and right of the blocks' ends, one pair for each
possible period, give squares that cover, by rotation, the first occurrences of all.
The suffix tree: each is marked where it ends in the tree, and from there a
suffix link with a walk down, and one more character, leads to the next rotation
as long as that is a square of the sequence, which completes the vocabulary. The
leaves below a square's mark are its occurrences, and occurrences of one period
that begin at neighbouring words merge into a run. Squares whose half is itself a
repetition are left out: their runs have the smaller period.

Every window of least // 3 words in a run occurs twice or more in its text, so the
method runs on the stretches of a text all of whose windows do; whole runs, and
nothing that would extend them, lie within one stretch. Windows are found by
64-bit hashes, which may add a stretch but never lose one; within a stretch words
are told apart by their bytes.

Documents are spread over tasks as they lie; nothing is shuffled. A task holds
about 4 log2(n) bytes for each of the n words of a stretch, besides the tree.

Defined results: a null or empty text has no words, no runs, and an empty collapsed
text. Rows are independent, repeated rows get equal runs. Several runs may overlap.
Other columns are kept, but for those that have a result's name. An empty table
gives an empty result. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnfield.llm.shared import Words, mix, over_arrow, rolled, tidy, words

LEAST, TIMES = 24, 3
RESULTS = ("n_words", "runs", "collapsed")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Equal:
    """Common extensions in a sequence, from the ranks of all its substrings of 1, 2, 4.. elements."""

    def __init__(self, s: np.ndarray):
        self.n = n = len(s)
        self.ranks = []
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
        size = 1
        while True:
            # one place past the end, which equals nothing
            self.ranks.append(np.append(rank, -1).astype(np.int32))
            if size >= n or rank.max() == n - 1:
                break
            after = np.full(n, -1, np.int64)
            after[: n - size] = rank[size:]
            rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1]
            size *= 2
        self.rank = rank

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many elements from i on equal those from j on (i != j)."""
        i, j, start = i.copy(), j.copy(), i
        for k in reversed(range(len(self.ranks))):
            step = (self.ranks[k][i] == self.ranks[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many elements up to and with i equal those up to and with j (i != j); none before the beginning."""
        i, j, start = i.copy(), j.copy(), i
        for k in reversed(range(len(self.ranks))):
            size = 1 << k
            a, b = i - size + 1, j - size + 1
            inside = (a >= 0) & (b >= 0)
            step = (inside & (self.ranks[k][np.where(inside, a, 0)] == self.ranks[k][np.where(inside, b, 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return start - i


def blocks(order: np.ndarray, eq: Equal) -> np.ndarray:
    """Bounds of the Lempel-Ziv blocks: each the longest stretch that also begins earlier, or one new element."""
    n = eq.n
    # the nearest suffixes in order, on either side, that begin earlier
    before, after = np.full(n, -1), np.full(n, -1)
    stack: list[int] = []
    for i in order.tolist():
        while stack and stack[-1] > i:
            after[stack.pop()] = i
        if stack:
            before[i] = stack[-1]
        stack.append(i)
    longest = np.zeros(n, np.int64)
    for other in (before, after):
        at = np.flatnonzero(other >= 0)
        longest[at] = np.maximum(longest[at], eq.right(at, other[at]))
    step, out, h = np.maximum(longest, 1).tolist(), [0], 0
    while h < n:
        h += step[h]
        out.append(h)
    return np.array(out)


def covering(bounds: np.ndarray, eq: Equal) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that cover the first occurrences of all squares by rotation to the right."""
    first, last = bounds[:-1], bounds[1:]
    size = last - first
    n = eq.n

    def each(begin: np.ndarray, end: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        return np.repeat(begin, count), np.repeat(end, count), k

    # those that reach beyond the block in which their middle lies
    _, h1, k = each(first, last, np.where(last < n, size, 0))
    q = h1 - k
    right, left = eq.right(h1, q), eq.left(h1 - 1, q - 1)
    start = np.maximum(q - left, q - k + 1)
    ok = (left + right >= k) & (right > 0)
    found = [(start[ok], k[ok])]
    # those that begin before the block in which their middle lies
    h, h1, k = each(first, last, size + np.append(size[1:], 0))
    inside = h + k < n
    h, h1, k = h[inside], h1[inside], k[inside]
    q = h + k
    right, left = eq.right(h, q), eq.left(h - 1, q - 1)
    start = np.maximum(h - left, h - k + 1)
    ok = (left + right >= k) & (right > 0) & (start + k <= h1)
    found.append((start[ok], k[ok]))
    start, k = (np.concatenate(x) for x in zip(*found, strict=True))
    return start, k


def primitive(start: np.ndarray, k: np.ndarray, eq: Equal) -> np.ndarray:
    """Which squares have a half that is no repetition itself."""
    most = int(k.max(initial=1))
    factor = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, most + 1, p)] = p
    out, rest = np.ones(len(k), bool), k.copy()
    while True:
        at = np.flatnonzero(out & (rest > 1))
        if not len(at):
            return out
        p = factor[rest[at]]
        shorter = k[at] // p
        out[at[eq.right(start[at], start[at] + shorter) >= 2 * k[at] - shorter]] = False
        rest[at] //= p


class SuffixTree:
    """Leaves 0..n-1 in the order of suffixes, then inner nodes, the root first. `left` and `right` bound the leaves below a node."""

    def __init__(self, s: np.ndarray, order: np.ndarray, eq: Equal):
        n = len(s)
        self.s, self.order, self.root = s, order, n
        common = np.zeros(n, np.int64)
        common[1:] = eq.right(order[:-1], order[1:])
        depth, left, right, parent = [0], [0], [n], [-1]
        leaf_parent, stack = [0] * n, [0]
        for r, c in enumerate(common.tolist()):
            last = -1
            while depth[stack[-1]] > c:
                last = stack.pop()
                right[last] = r
                parent[last] = stack[-1]
            if depth[stack[-1]] < c:
                v = len(depth)
                depth.append(c)
                left.append(left[last] if last >= 0 else r - 1)
                right.append(n)
                parent.append(stack[-1])
                if last >= 0:
                    parent[last] = v
                else:
                    leaf_parent[r - 1] = v
                stack.append(v)
            leaf_parent[r] = stack[-1]
        # the stack is a path, whose parents are set
        self.depth = np.concatenate([n - order, depth])
        self.left, self.right = np.concatenate([np.arange(n), left]), np.concatenate([np.arange(1, n + 1), right])
        self.parent = np.concatenate([leaf_parent, parent]) + n
        self.parent[n] = n
        self.up = [self.parent.astype(np.int32)]
        while (self.up[-1] != n).any():
            self.up.append(self.up[-1][self.up[-1]])
        self.leaf = np.empty(n, np.int64)
        self.leaf[order] = np.arange(n)

    def locus(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The highest node whose path has s[start:start+size] as a prefix."""
        at = self.leaf[start]
        for up in reversed(self.up):
            higher = up[at]
            at = np.where(self.depth[higher] >= size, higher, at)
        return at

    def links(self) -> list[int]:
        """The suffix link of every inner node."""
        n, out = self.root, np.full(len(self.depth) - self.root, self.root)
        deep = np.flatnonzero(self.depth[n:] > 1)
        out[deep] = self.locus(self.order[self.left[n + deep]] + 1, self.depth[n + deep] - 1)
        return out.tolist()

    def children(self, width: int) -> dict[int, int]:
        """The child of a node by parent * width + first element of the edge."""
        node = np.concatenate([np.arange(self.root), np.arange(self.root + 1, len(self.depth))])
        up = self.parent[node]
        at = self.order[self.left[node]] + self.depth[up]
        ok = at < self.root
        return dict(zip((up[ok] * width + self.s[at[ok]]).tolist(), node[ok].tolist(), strict=True))


def vocabulary(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, period) of all squares that rotations of the marked ones lead to."""
    width, n = int(tree.s.max()) + 1, tree.root
    child, link = tree.children(width), tree.links()
    depth, parent, s = tree.depth.tolist(), tree.parent.tolist(), tree.s.tolist()
    first = tree.order[tree.left].tolist()
    marked: dict[int, int] = {}
    for node, size in zip(tree.locus(start, 2 * k).tolist(), (2 * k).tolist(), strict=True):
        while (key := node * (n + 1) + size) not in marked:
            marked[key] = node
            i = first[node]
            # without its first element: by the suffix link of the node above, then down
            at = link[parent[node] - n]
            while depth[at] < size - 1:
                at = child[at * width + s[i + 1 + depth[at]]]
            if depth[at] == size - 1:
                node = child.get(at * width + s[i], -1)
                if node < 0:
                    break
            elif s[first[at] + size - 1] == s[i]:
                node = at
            else:
                break
    keys = np.fromiter(marked, np.int64, len(marked))
    return keys // (n + 1), keys % (n + 1) // 2


def runs(s: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of small integers, of `least` elements and `times` periods or more."""
    none = np.zeros((0, 3), np.int64)
    if len(s) < max(least, 2):
        return none
    eq = Equal(s)
    order = np.argsort(eq.rank, kind="stable")
    start, k = covering(blocks(order, eq), eq)
    ok = primitive(start, k, eq)
    if not ok.any():
        return none
    tree = SuffixTree(s, order, eq)
    node, k = vocabulary(tree, start[ok], k[ok])
    below = tree.right[node] - tree.left[node]
    at = np.arange(below.sum()) + np.repeat(tree.left[node] - (np.cumsum(below) - below), below)
    place = np.sort(np.repeat(k, below) * (len(s) + 1) + order[at])
    edge = np.flatnonzero(np.diff(place) != 1) + 1
    head, tail = place[np.append(0, edge)], place[np.append(edge - 1, len(place) - 1)]
    period = head // (len(s) + 1)
    out = np.stack([head % (len(s) + 1), tail - head + 2 * period, period], 1)
    out = out[out[:, 1] >= np.maximum(least, times * period)]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _stretches(w: Words, width: int, least: int) -> list[tuple[int, int]]:
    """Ranges of words, within one text, all of whose windows occur twice in it, long enough for a run."""
    h, at = rolled(w.hash, w.doc, width)
    if not len(h):
        return []
    key = mix(h + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return []
    near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    start = at[twice[near] == key]
    edge = np.flatnonzero((np.diff(start) != 1) | (w.doc[start[1:]] != w.doc[start[:-1]])) + 1
    bounds = zip(np.append(0, edge).tolist(), np.append(edge, len(start)).tolist(), strict=True)
    return [(int(start[a]), int(start[b - 1]) + width) for a, b in bounds if b - a + width - 1 >= least]


def _of_pass(w: Words, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and (start, length, period) of each run, by text, start and period; and which words stay."""
    keep, doc, found = np.ones(len(w.start), bool), [], []
    first = np.concatenate([[0], np.cumsum(w.counts)])
    stretches = _stretches(w, least // 3, least)
    data = w.data.tobytes() if stretches else b""
    for a, b in stretches:
        number: dict[bytes, int] = {}
        ids = [number.setdefault(data[i:j], len(number)) for i, j in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
        got = runs(np.array(ids), least, times)
        for start, length, period in got.tolist():
            keep[a + start + period : a + start + length] = False
        got[:, 0] += a - first[w.doc[a]]
        doc.append(np.full(len(got), w.doc[a]))
        found.append(got)
    # stretches of a text come in order, and so do the runs of each
    return (np.column_stack([np.concatenate(doc), np.concatenate(found)]) if found else np.zeros((0, 4), np.int64)), keep


def _joined(w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    start, size, doc = w.start[keep], (w.end - w.start)[keep], w.doc[keep]
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    room = size + ~last
    to = np.cumsum(room) - room
    out = np.full(int(room.sum()), 0x20, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + inner] = w.data[np.repeat(start, size) + inner]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, room, w.n_docs))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(w.n_docs, pa.py_buffer(bounds), pa.py_buffer(out)).cast(pa.string())


def periodic_runs(documents: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """documents with n_words, `runs` (start, length, period in words, by start and period), and `collapsed`: the words that no run has after its first period, joined by spaces."""
    if times < 3 or least < 3:
        raise ValueError("runs of three periods and three words at least")
    fields = documents.schema.fields
    at, places = documents.columns.index(text), [i for i, f in enumerate(fields) if f.name.lower() not in RESULTS]
    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*(fields[i] for i in places), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(at), lower=False):
                part = batch.slice(w.first, w.n_docs)
                found, keep = _of_pass(w, least, times)
                bounds = np.searchsorted(found[:, 0], np.arange(w.n_docs + 1)).astype(np.int32)
                cells = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], fields=list(RUN))
                new = [pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), cells), _joined(w, keep)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *new], names=schema.names)

    return over_arrow(documents, run, schema)
