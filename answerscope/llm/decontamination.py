"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of anything but blanks, punctuation, symbols and control characters,
of ASCII and of Unicode; a letter of a script without blanks (Chinese, Japanese, Thai, Lao,
Khmer, Burmese) is a word of its own, with the marks on it.
A document and a benchmark item that share a seed, ``MIN_MATCH`` words in a row (a shorter item
is one seed and matches where all its words stand in a row), are tiled:
their longest common run is marked on both sides, then the longest run of what is still
unmarked, and so on down to ``MIN_MATCH``; runs are found by Karp-Rabin hashes of windows of
falling width. The share of the item's words under tiles is its coverage, in whatever order
the document has them; at ``COVERAGE`` or more the document is contaminated. Pairs whose
seeds together cover less than that cannot reach it and are not tiled.

Items are taken in blocks of at most ``BLOCK_WORDS`` words (or one item), each broadcast and
met by all documents in one pass, so nothing is shuffled and no document meets another. A
benchmark of any size works; it costs one pass for each block.

Nulls and empties: a null text has no words, and an item without words never matches. A null doc_id or item_id is reported as null. Repeated documents or
items are reported each. Empty tables give an empty result, an empty benchmark keeps all rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.llm.common import Scratch, byte_slices, powers, shingle_hashes, table, word_hashes

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_WORDS = 1 << 20
FIRST_WINDOW = 20
_FILTER_BITS = 22

SEPARATOR = np.array([not (chr(k).isalnum() or k > 127) for k in range(256)])

# Thai, Lao, Burmese, Khmer, kana and ideographs: first and last character
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x30FF), (0x3105, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
            (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))


# ---- words

_KEPT, _APART, _ALONE, _MARK = range(4)


@cache
def _kinds() -> np.ndarray:
    """What each code point is: part of a word, a separator, a letter of a script without blanks, or a mark on one."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    unspaced = np.zeros(0x110000, dtype=bool)
    for a, b in UNSPACED:
        unspaced[a:b + 1] = True
    for k in range(0x80, 0x40000):
        category = unicodedata.category(chr(k))
        if k < 0x20000 and (category[0] in "PSZ" or category == "Cc" or k in (0x200B, 0xFEFF)):
            kinds[k] = _APART
        elif category[0] == "M" and (k < 0x370 or 0x1DC0 <= k < 0x3100 or 0xFE00 <= k < 0xFE30 or (unspaced[k] and k < 0x20000)):
            kinds[k] = _MARK
        elif unspaced[k] and (k >= 0x20000 or category[0] in "LN"):
            kinds[k] = _ALONE
    return kinds


def spaced(text: bytes) -> bytes:
    """The text with blanks for Unicode separators and around letters of scripts without blanks."""
    if text.isascii():
        return text
    codes = np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _kinds()[codes]
    codes = np.where(kinds == _APART, np.uint32(32), codes)
    if (kinds == _ALONE).any():
        at = np.arange(len(kinds))
        bearer = np.maximum.accumulate(np.where(kinds == _MARK, 0, at))  # a mark belongs to what stands before it
        alone = kinds[bearer] == _ALONE
        ends = alone & np.append(kinds[1:] != _MARK, True)
        codes = np.insert(codes, np.concatenate([np.flatnonzero(kinds == _ALONE), np.flatnonzero(ends) + 1]), 32)
    return codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


# ---- tiling of one pair

class _Windows:
    """Karp-Rabin hashes of word windows of any length."""

    def __init__(self, words: np.ndarray):
        up, self.down = powers(len(words) + 1)
        self.prefix = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[:-1], out=self.prefix[1:])

    def at(self, begin: np.ndarray, width: int) -> np.ndarray:
        return (self.prefix[begin + width] - self.prefix[begin]) * self.down[begin]


def tile(item: np.ndarray, doc: np.ndarray, places: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(item place, document place, words) of the tiles; ``places``: where the document has a seed of the item.

    The greatest width at which both sides still have a common unmarked window is found by
    halving, its windows are marked, and so on down to ``least``. A window that repeats is one
    hash with its places, so no pair of places is listed and repetitive texts cost no more.
    """
    item_windows, doc_windows = _Windows(item), _Windows(doc)
    item_free, doc_free = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    everywhere = np.arange(len(item))
    tiles: list[tuple[int, int, int]] = []

    def starts(free: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        at = at[at + width <= len(free)]
        used = np.concatenate([[0], np.cumsum(~free)])
        return at[used[at + width] == used[at]]

    def common(width: int) -> tuple[np.ndarray, ...]:
        """Item places and document places of the windows that both sides have, with their hashes; the latter sorted by hash."""
        here, there = starts(item_free, everywhere, width), starts(doc_free, places, width)
        a, b = item_windows.at(here, width), doc_windows.at(there, width)
        mine, theirs = np.isin(a, b), np.isin(b, a)
        order = np.argsort(b[theirs], kind="stable")
        return here[mine], a[mine], there[theirs][order], b[theirs][order]

    def first_free(at: np.ndarray, width: int) -> int:
        """The first place whose window is unmarked, -1 if there is none."""
        k = 0
        while k < len(at):
            taken = np.flatnonzero(~doc_free[at[k]:at[k] + width])
            if not len(taken):
                return int(at[k])
            k = int(np.searchsorted(at, at[k] + taken[-1], "right"))
        return -1

    most = min(len(item), len(doc))
    while most >= least:
        low, high, found = least, most, None
        width = min(most, max(least, FIRST_WINDOW))
        while low <= high:
            windows = common(width)
            if len(windows[0]):
                found, at_width, low = windows, width, width + 1
            else:
                high = width - 1
            width = (low + high + 1) // 2
        if found is None:
            break
        here, a, there, b = found
        for p, h in zip(here.tolist(), a, strict=True):
            if not item_free[p:p + at_width].all():
                continue
            t = first_free(there[np.searchsorted(b, h, "left"):np.searchsorted(b, h, "right")], at_width)
            if t >= 0 and np.array_equal(item[p:p + at_width], doc[t:t + at_width]):
                tiles.append((p, t, at_width))
                item_free[p:p + at_width] = False
                doc_free[t:t + at_width] = False
        most = at_width - 1
    return tiles


# ---- a block of items

class _Seeds:
    """Which items of a block hold each run of ``width`` words."""

    def __init__(self, width: int, numbers: list[int], words: list[np.ndarray]):
        self.width = width
        hashes = [shingle_hashes(w, width) for w in words]
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        self.seeds = every[order]
        self.owner = np.repeat(numbers, [len(h) for h in hashes])[order]
        self.place = np.concatenate([np.arange(len(h)) for h in hashes])[order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.seeds >> np.uint64(64 - _FILTER_BITS)] = True

    def in_document(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item number, place in the item, place in the document) of all shared seeds."""
        seeds = shingle_hashes(doc, self.width)
        at = np.flatnonzero(self.filter[seeds >> np.uint64(64 - _FILTER_BITS)])
        first, last = np.searchsorted(self.seeds, seeds[at], "left"), np.searchsorted(self.seeds, seeds[at], "right")
        count = last - first
        entry = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return self.owner[entry], self.place[entry], np.repeat(at, count)


class Block:
    """Items as word hashes, and which of them hold each seed; a short item is one seed."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.items = [(k, w) for k, w in items if len(w)]
        numbers: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            numbers.setdefault(min(MIN_MATCH, len(w)), []).append(k)
        self.seeds = [_Seeds(width, mine, [self.items[k][1] for k in mine]) for width, mine in sorted(numbers.items())]

    def matches(self, doc: np.ndarray, coverage: float = COVERAGE) -> list[tuple]:
        """(item id, its words, words under tiles, coverage, tiles) of the items that the document covers."""
        out = []
        for seeds in self.seeds:
            if len(doc) < seeds.width:
                continue
            owner, place, at = seeds.in_document(doc)
            order = np.argsort(owner, kind="stable")
            owner, place, at = owner[order], place[order], at[order]
            for k, mine in zip(owner[np.flatnonzero(np.diff(owner, prepend=-1))], np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1), strict=False):
                item_id, item = self.items[k]
                covered = np.zeros(len(item) + 1, dtype=np.int64)
                hit = np.unique(place[mine])
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + seeds.width, -1)
                if (np.cumsum(covered)[:-1] > 0).mean() < coverage:
                    continue
                tiles = tile(item, doc, np.unique(at[mine]), seeds.width)
                words = sum(n for _, _, n in tiles)
                if words >= coverage * len(item):
                    out.append((item_id, len(item), words, words / len(item), len(tiles)))
        return out


def doc_words(values: list[bytes]) -> Iterator[np.ndarray]:
    hashes, starts = word_hashes([spaced(v) for v in values], SEPARATOR)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield hashes[a:b]


# ---- Spark code

def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, values in byte_slices(batch.column("text")):
            packed = pa.array([w.tobytes() for w in doc_words(values)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(first, end - first), packed], names=["item_id", "words"])


def blocks_of(items: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Block]:
    held: list[tuple[int | None, np.ndarray]] = []
    size = 0
    for row in items.select("item_id", "text").mapInArrow(_item_rows, "item_id bigint, words binary").toLocalIterator():
        words = np.frombuffer(row.words, dtype=np.uint64)
        if held and size + len(words) > most:
            yield Block(held)
            held, size = [], 0
        held.append((row.item_id, words))
        size += len(words)
    if held:
        yield Block(held)


_MATCHES = "doc_id bigint, item_id bigint, item_words bigint, matched_words bigint, coverage double, tiles bigint"


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, item_words, matched_words, coverage, tiles) of every contaminated document and item it covers."""
    spark, scratch, out = docs.sparkSession, Scratch(docs.sparkSession, "tiles"), None
    for block in blocks_of(items, block_words):
        spread = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, end, values in byte_slices(batch.column("text")):
                    ids = batch.column("doc_id").slice(first, end - first).to_pylist()
                    rows = [(k, *m) for k, words in zip(ids, doc_words(values), strict=True) for m in spread.value.matches(words, coverage)]
                    if rows:
                        kinds = (pa.int64(),) * 4 + (pa.float64(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                         names=["doc_id", "item_id", "item_words", "matched_words", "coverage", "tiles"])

        found = scratch.keep(docs.select("doc_id", "text").mapInArrow(run, _MATCHES))
        spread.unpersist()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], _MATCHES) if out is None else out


def without_contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that cover no item; all their columns, whatever their names."""
    spark, scratch, spread = docs.sparkSession, Scratch(docs.sparkSession, "clean"), None
    for block in blocks_of(items, block_words):
        if spread is not None:  # one broadcast at a time: the rows that the block before left are written
            docs = scratch.keep(docs)
            spread.unpersist()
        spread = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not spread.value.matches(words, coverage) for _, _, values in byte_slices(batch.column("text")) for words in doc_words(values)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES: dict[str, str] = {}
