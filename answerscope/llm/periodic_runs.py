"""Periodic runs of words by internal pattern matching.

A run is a stretch of consecutive words with smallest period q, at least ``max(MIN_RUN, 2q)``
words long, that no neighbouring word extends keeping q. Texts of a slice are laid one after
another, each word a number of its own text, with separators that equal nothing.

1. Prefix doubling gives the suffix array and, for each level k, equal ranks to equal windows of
   2**k words; only windows that occur twice in their text are refined further.
2. A run of period q contains an aligned (dyadic) block of b words, b the greatest power of two
   with 2b - 1 <= q (2 for q up to 6), whose copy stands q words on. The occurrences of each
   block in the following window are asked of a wavelet tree over the suffix array: range
   successors in the block's interval, in parts of b starts. Three or more in a part are a
   progression with the block's own period, so first, second and last give them all; where the
   stretch of that period runs from the block to the last of them they bring no new period.
3. Each distance is a candidate period. It is extended both ways by the ranks, exactly; stretches
   that are long enough are runs, the least of the candidates for a stretch is its period.

A text is one task's work (about 300 bytes of memory a word); nothing is shuffled.

Nulls and empties: a null text has no words and no runs. A null doc_id is kept, and its text is
taken as it is. Repeated rows get equal results. Further columns are not looked at. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from answerscope.llm.common import byte_slices, table

MIN_RUN = 12
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class WaveletTree:
    """Counts and order statistics of slices of a sequence of numbers below 2**bits."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            one = ((values >> bit) & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append(zeros)
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values at low..high are less than ``bound``."""
        every, count = high - low, np.zeros(len(low), dtype=np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            a, b = zeros[low], zeros[high]
            one = ((bound >> bit) & 1).astype(bool)
            count += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return np.where(bound >> self.bits > 0, every, count)

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with ``n`` smaller ones at low..high."""
        low, high, n, out = low.copy(), high.copy(), n.copy(), np.zeros(len(low), dtype=np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            a, b = zeros[low], zeros[high]
            one = n >= b - a
            n -= np.where(one, b - a, 0)
            out |= np.where(one, 1 << bit, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return out


def _windows(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Suffix order, ranks of windows of 2**k words, and the starts of windows that occur again, by level."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    keys = symbols[order]
    first = np.ones(n, dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    ranks, repeated, width = [], [], 1
    while True:
        alone = first.copy()
        alone[:-1] &= first[1:]
        slots = np.flatnonzero(~alone)
        ranks.append(rank)
        repeated.append(order[slots])
        if not len(slots):
            return order, ranks, repeated
        members = order[slots]
        keys = rank[members].astype(np.int64) * (n + 1) + rank[np.minimum(members + width, n - 1)]
        move = np.argsort(keys, kind="stable")
        members, keys = members[move], keys[move]
        order[slots] = members
        head = np.ones(len(slots), dtype=bool)
        head[1:] = keys[1:] != keys[:-1]
        first[slots] = head
        rank = rank.copy()
        rank[members] = np.maximum.accumulate(np.where(head, slots, 0))
        width *= 2


def _ahead(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words from i and j on that are equal."""
    n, got = len(ranks[0]), np.zeros(len(i), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        got += np.where(ranks[k][np.minimum(i + got, n - 1)] == ranks[k][np.minimum(j + got, n - 1)], 1 << k, 0)
    return got


def _behind(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words before i and j that are equal, i < j."""
    got = np.zeros(len(i), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = i - got - (1 << k), j - got - (1 << k)
        got += np.where((a >= 0) & (ranks[k][np.maximum(a, 0)] == ranks[k][np.maximum(b, 0)]), 1 << k, 0)
    return got


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every text, by start, then period; words are numbers from 0."""
    sizes = np.array([len(t) for t in texts])
    offset = np.cumsum(sizes + 1) - sizes - 1
    n = int(sizes.sum()) + len(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    symbols = np.empty(n, dtype=np.int64)
    for t, o in zip(texts, offset.tolist(), strict=True):
        symbols[o:o + len(t)] = t + o  # numbers of a text lie below its size
        symbols[o + len(t)] = n + o
    order, ranks, repeated = _windows(symbols)
    if len(ranks) < 2 or not len(repeated[1]):
        return out
    again = np.zeros(n, dtype=bool)
    again[repeated[1]] = True
    held = again[order]
    slot = np.concatenate([[0], np.cumsum(held)])
    tree = WaveletTree(order[held])
    candidates = [np.zeros((2, 0), dtype=np.int64)]
    for k in range(1, len(ranks)):
        b, rank = 1 << k, ranks[k]
        size = np.bincount(rank[repeated[k]], minlength=n)
        block = repeated[k][repeated[k] % b == 0]
        if not len(block):
            continue
        low = rank[block].astype(np.int64)
        low, high = slot[low], slot[low + size[low]]
        for start in ((1, 3, 5) if b == 2 else (2 * b - 1, 3 * b - 1)):
            begin = block + start
            less, upto = tree.below(low, high, begin), tree.below(low, high, begin + b)
            some = upto > less
            at, lo, hi, less, count = block[some], low[some], high[some], less[some], (upto - less)[some]
            near = tree.nth(lo, hi, less)
            far = near.copy()
            two = count > 1
            far[two] = tree.nth(lo[two], hi[two], (less + count - 1)[two])
            step = np.maximum(far - near, 1)
            three = count > 2
            step[three] = tree.nth(lo[three], hi[three], (less + 1)[three]) - near[three]
            reach = at[three] + step[three] + _ahead(ranks, at[three], at[three] + step[three])
            fresh = np.ones(len(at), dtype=bool)
            fresh[three] = reach < far[three] + b
            at, near, step, count = at[fresh], near[fresh], step[fresh], count[fresh]
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            candidates.append(np.stack([np.repeat(at, count), np.repeat(near - at, count) + nth * np.repeat(step, count)]))
    at, period = np.concatenate(candidates, axis=1)
    back, ahead = _behind(ranks, at, at + period), _ahead(ranks, at, at + period)
    begin, length = at - back, back + ahead + period
    long = length >= np.maximum(MIN_RUN, 2 * period)
    found = np.unique(np.stack([begin[long], length[long], period[long]], axis=1), axis=0)
    if len(found):
        least = np.ones(len(found), dtype=bool)
        least[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found = found[least]
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        text = np.searchsorted(offset, found[:, 0], "right") - 1
        for k, (s, m, q) in zip(text.tolist(), found.tolist(), strict=True):
            out[k].append((s - int(offset[k]), m, q))
    return out


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run contains after its first period."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for s, m, q in runs:
        edge[s + q] += 1
        edge[s + m] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query's documents: one in ten gets a periodic tail, chosen by the CRC of its id."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
                     ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
_DDL = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _rows(prepare, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, values in byte_slices(batch.column("text")):
            ids = batch.column("doc_id").slice(first, end - first).to_pylist()
            words = [prepare(k, _WORD.findall(v)) for k, v in zip(ids, values, strict=True)]
            rows = []
            for k, mine, runs in zip(ids, words, find_runs([numbered(w) for w in words]), strict=True):
                s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
                kept = b" ".join(without_repeats(mine, runs))
                rows.append((k, len(runs), s, m, q, m and 1000 * m // q, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], schema=_SCHEMA)


def runs_of(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Digest of the runs of every text of ``docs`` (doc_id, text)."""
    prepare = planted if plant else (lambda _, words: words)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _rows(prepare, batches), _DDL)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs_of(table(spark, folder, "documents", "doc_id", "text"), plant=True)


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}
