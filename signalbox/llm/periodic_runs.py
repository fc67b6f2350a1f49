"""Runs of words that repeat with a period, found by suffix trees and Lyndon roots.

A run is a longest stretch of words with a smallest period, at least ``EXPONENT`` periods and ``LEAST`` words long. Each run
has a rotation of its period that is a Lyndon word, for the order of words or for the reverse order, and
that is the longest Lyndon word where it starts. So every position gives two candidates: up to the next smaller and the next greater
suffix. Both come from the suffix order of an Ukkonen tree. A candidate is extended to the right by the longest
common extension of two suffixes, to the left by the same of the reversed words: depths of lowest common ancestors, which
are range minima over the Euler tours of the two trees, each in constant time.

Every word of a run occurs in it as often as the run has whole periods. Stretches between words that occur less often are hence
searched alone, with a separator of its own after each; most documents have none that is long enough, so no tree is built for them.

Edge cases: a null or empty text has no words and no runs; its ``collapsed`` is empty. Repeated rows are
searched one by one; an empty table gives an empty result. Columns other than the results are kept, those named like results
replaced. The memory of a task grows with the words of its longest document, not with the number of documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from signalbox.llm.common import row_batches, words_of

LEAST, EXPONENT = 24, 3
BLOCK = 16  # tour entries whose minima are looked up one by one
RESULTS = (
    "runs array<struct<start:bigint,length:bigint,period:bigint>>, n_runs bigint, start bigint, length bigint, period bigint,"
    " exponent_milli bigint, collapsed string"
)
NAMES = ["runs", "n_runs", "start", "length", "period", "exponent_milli", "collapsed"]
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
TYPES = [pa.list_(RUN), *[pa.int64()] * 5, pa.string()]


class RangeMinimum:
    """Minima of ranges in constant time: blocks of fixed size, a sparse table over blocks."""

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // BLOCK)
        self.values = np.full(n * BLOCK, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        blocks = self.values.reshape(n, BLOCK)
        self.before = np.minimum.accumulate(blocks, 1).ravel()
        self.after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [blocks.min(1)]
        while 2 << (len(self.levels) - 1) <= n:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of ``values[first..last]``, pair by pair."""
        a, b = first // BLOCK, last // BLOCK
        out = np.minimum(self.after[first], self.before[last])
        same = np.flatnonzero(a == b)
        if len(same):
            at = first[same, None] + np.arange(BLOCK)
            inside = at <= last[same, None]
            out[same] = np.where(inside, self.values[np.where(inside, at, 0)], np.iinfo(np.int32).max).min(1)
        wide = np.flatnonzero(b - a > 1)
        level = np.frexp((b - a - 1)[wide].astype(float))[1] - 1  # whole part of the logarithm
        for k in np.unique(level).tolist():
            at = wide[level == k]
            table = self.levels[k]
            out[at] = np.minimum(out[at], np.minimum(table[a[at] + 1], table[b[at] - (1 << k)]))
        return out


class SuffixTree:
    """Ukkonen's tree of a list of symbols whose last one occurs once, with its Euler tour."""

    def __init__(self, symbols: list[int]):
        self.n, self.width = len(symbols), max(symbols) + 1
        self._grow(symbols)
        self._walk()

    def _grow(self, s: list[int]) -> None:
        n, width, root = self.n, self.width, 0
        edges: dict[int, int] = {}  # node and first symbol of an edge, to the node below
        start, end, link, depth, suffix = [0], [0], [0], [0], [-1]
        node, edge, length, pending, leaves = root, 0, 0, 0, 0
        for i, c in enumerate(s):
            unlinked = root
            pending += 1
            while pending:
                if not length:
                    edge = i
                key = node * width + s[edge]
                below = edges.get(key)
                if below is None:
                    edges[key] = len(start)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = node
                else:
                    at = start[below]
                    span = (end[below] if end[below] <= i else i + 1) - at
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if s[at + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = edges[key] = len(start)
                    start.append(at)
                    end.append(at + length)
                    link.append(root)
                    depth.append(depth[node] + length)
                    suffix.append(-1)
                    start[below] = at + length
                    edges[middle * width + s[at + length]] = below
                    edges[middle * width + c] = len(start)
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                # the leaf of the next suffix
                start.append(i)
                end.append(n)
                link.append(root)
                depth.append(n - leaves)
                suffix.append(leaves)
                leaves += 1
                pending -= 1
                if node == root and length:
                    length -= 1
                    edge = i - pending + 1
                else:
                    node = link[node]
        self.edges, self.depth, self.suffix = edges, np.array(depth, np.int32), np.array(suffix, np.int64)

    def _walk(self) -> None:
        nodes = len(self.depth)
        keys = np.fromiter(self.edges.keys(), np.int64, len(self.edges))
        order = np.argsort(keys)
        below = np.fromiter(self.edges.values(), np.int64, len(self.edges))[order]
        bounds = np.searchsorted(keys[order] // self.width, np.arange(nodes + 1))
        del self.edges, keys, order
        children, turn, stop, leaf = below.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), (self.suffix >= 0).tolist()
        tour, above, node = [], [], 0
        while True:
            tour.append(node)
            if turn[node] < stop[node]:
                child = children[turn[node]]
                turn[node] += 1
                if leaf[child]:
                    tour.append(child)
                else:
                    above.append(node)
                    node = child
            elif above:
                node = above.pop()
            else:
                break
        visited = np.array(tour, np.int64)
        own = self.suffix[visited]
        places = np.flatnonzero(own >= 0)
        #: Places of the leaves in the tour, by suffix; their order is the order of the suffixes.
        self.place = np.empty(self.n, np.int64)
        self.place[own[places]] = places
        self.minimum = RangeMinimum(self.depth[visited])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of pairs of different suffixes."""
        a, b = self.place[i], self.place[j]
        return self.minimum(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def _next_smaller(ranks: list[int]) -> np.ndarray:
    """For each place the next one with a smaller rank; the end where there is none."""
    out, waiting = [len(ranks)] * len(ranks), []
    for i, rank in enumerate(ranks):
        while waiting and ranks[waiting[-1]] > rank:
            out[waiting.pop()] = i
        waiting.append(i)
    return np.array(out, np.int64)


def stretches(codes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Word numbers of the stretches in which each word occurs ``exponent`` times at least.

    Passes go on as long as one takes away a fifth of the words: any further pass would be right, but need not pay.
    """
    at = np.arange(len(codes))
    while len(at):
        piece = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
        long_enough = (np.bincount(piece) >= least)[piece]
        pair = piece * (int(codes.max()) + 1) + codes[at]
        _, which, counts = np.unique(pair, return_inverse=True, return_counts=True)
        kept = at[long_enough & (counts[which] >= exponent)]
        if 5 * len(kept) > 4 * len(at):
            return kept
        at = kept
    return at


def runs_of(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    counts = Counter(words)
    often = np.fromiter(map(counts.__getitem__, words), np.int64, len(words)) >= exponent
    if not often.any():
        return none
    numbers = {w: k for k, w in enumerate(counts)}
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    at = stretches(np.where(often, codes, len(numbers) + np.arange(len(codes))), least, exponent)
    if not len(at):
        return none
    # stretches one after the other, a separator of its own after each
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    _, dense = np.unique(codes[at], return_inverse=True)
    first = int(dense.max()) + 1
    ends = np.append(cuts, len(at))
    symbols = np.insert(dense, ends, first + np.arange(len(ends)))
    places = np.insert(at, ends, -1)
    n = len(symbols)
    ahead = SuffixTree(symbols.tolist())
    ranks = ahead.place.tolist()
    smaller, greater = _next_smaller(ranks), _next_smaller([-r for r in ranks])
    i = np.tile(np.arange(n), 2)
    period = np.concatenate([smaller, greater]) - i
    fits = (i + period < n) & (period * exponent <= n)
    i, period = i[fits], period[fits]
    right = ahead.common(i, i + period)
    del ahead
    back = SuffixTree([*symbols[::-1].tolist(), first + len(ends)])
    left = back.common(n - i, n - i - period)
    length = left + period + right
    found = length >= np.maximum(least, exponent * period)
    runs = np.stack([places[(i - left)[found]], length[found], period[found]], 1)
    runs = np.unique(runs, axis=0)  # both orders may find a run
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the most periods; of equal ones the first, then the one with the smallest period."""
    rows = [tuple(r) for r in runs.tolist()]
    return max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those after the first period of any run."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def described(text: str | None, least: int = LEAST, exponent: int = EXPONENT) -> tuple:
    """The result columns of one text."""
    words = words_of(text)
    runs = runs_of(words, least, exponent)
    best = strongest(runs)
    rows = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()]
    figures = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return rows, len(rows), *figures, collapsed(words, runs).decode("utf-8", "surrogatepass")


def with_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Rows of ``docs`` (which has ``text``) with their runs, the strongest one and the ``collapsed`` text."""
    docs = docs.drop(*NAMES)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            made = [described(t, least, exponent) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(TYPES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *NAMES])

    return docs.mapInArrow(search, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), RESULTS]))
