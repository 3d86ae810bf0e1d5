"""Suffix-array dedup: remove every byte covered by a long string that starts anywhere else too.

1. Each window of ``MIN_LENGTH`` bytes gets a key, the least hash of the ``GRAM``-byte strings
   inside it. Equal windows have equal keys, so windows can repeat only if their key occurs in
   several runs of windows, or if its string stands at several places of the one run (as it
   does in a stretch of short period). Runs of windows with one key are the unit ("region")
   that is shuffled: key, hash of the region's bytes and place, no text.
2. Equal regions are collapsed to one with a count. The texts of the distinct regions of a key
   that has several, or one that can repeat in itself, are fetched once and packed, whole keys at a time, into blocks of
   ``BLOCK_BYTES``. Over a block's Burrows-Wheeler transform, ``common_prefix_levels`` expands
   intervals breadth-first by backward extension: level l fixes the boundaries with common
   prefix l, and the search stops at ``MIN_LENGTH``; boundaries still open then separate
   suffixes that share at least ``MIN_LENGTH`` bytes.
3. A key with more than ``CROWDED`` different regions (a passage met in very many contexts)
   would outgrow a task: its windows are counted one by one by hash across the cluster.
4. Findings return to the places by (key, region hash) and are merged per text.

Nulls and empties: a null text has no bytes; a null doc_id is an id of its own. Repeated rows
are documents of their own, so their whole texts repeat when long enough. Texts shorter than
``MIN_LENGTH`` lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.llm.common import Scratch, byte_slices, free_name, prefix_hashes, range_hashes, table

MIN_LENGTH = 200
GRAM = 64
RUN = 256  # windows in a region at most
BLOCK_BYTES = 2 << 20
CROWDED = 2000


# ---- array code of a task

def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    out, have = a, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return out if have == width else np.minimum(out[:len(a) - width + 1], out[width - have:])


def regions(values: list[bytes], length: int = MIN_LENGTH, gram: int = GRAM):
    """Runs of windows with one key: (text number, first start, windows, key, hash of the bytes, whether the key's gram stands in it twice)."""
    values_long = [(k, v) for k, v in enumerate(values) if len(v) >= length]
    if not values_long:
        return [np.zeros(0, np.int64)] * 5 + [np.zeros(0, dtype=bool)]
    data = np.frombuffer(b"".join(v for _, v in values_long), dtype=np.uint8)
    sizes = np.array([len(v) for _, v in values_long])
    offset = np.cumsum(sizes) - sizes
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = range_hashes(prefix, at, at + gram)
    keys = sliding_min(grams, length - gram + 1)
    text = np.repeat(np.arange(len(sizes)), sizes)[:len(keys)]
    valid = np.arange(len(keys)) + length <= (offset + sizes)[text]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(valid & new)
    last = np.ones(len(keys), dtype=bool)
    last[:-1] = new[1:] | ~valid[1:]
    count = np.flatnonzero(valid & last) + 1 - begin
    pieces = -(-count // RUN)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(begin, pieces) + step * RUN
    count = np.minimum(np.repeat(count, pieces) - step * RUN, RUN)
    number = np.array([k for k, _ in values_long])
    whole = range_hashes(prefix, begin, begin + count + length - 1)
    # a gram is the least of some window if the greatest key of the windows around it is its own
    edge = np.zeros(length - gram, np.uint64)
    least = np.flatnonzero(~sliding_min(~np.concatenate([edge, keys, edge]), length - gram + 1) == grams)
    first, end = np.searchsorted(least, begin), np.searchsorted(least, begin + count + length - gram)
    region = np.repeat(np.arange(len(begin)), end - first)
    place = least[np.arange(len(region)) + np.repeat(first - np.cumsum(end - first) + (end - first), end - first)]
    twice = np.bincount(region[grams[place] == keys[begin][region]], minlength=len(begin)) > 1
    return number[text[begin]], begin - offset[text[begin]], count, keys[begin].view(np.int64), whole.view(np.int64), twice


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes (of symbols 0..511) in order of their first ``depth`` symbols, by prefix doubling of the groups still open."""
    n, wide = len(symbols), 7
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(wide, np.uint64)])
    packed = np.zeros(n, dtype=np.uint64)
    for j in range(wide):
        packed = (packed << np.uint64(9)) | padded[j:j + n]
    order = np.argsort(packed)
    rank = np.empty(n, dtype=np.int64)
    sorted_keys = packed[order]
    first = np.ones(n, dtype=bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while wide < depth:
        alone = first.copy()
        alone[:-1] &= first[1:]
        slots = np.flatnonzero(~alone)
        if len(slots) == 0:
            break
        members = order[slots]
        after = np.where(members + wide < n, rank[np.minimum(members + wide, n - 1)] + 1, 0)
        keys = rank[members] * np.int64(n + 1) + after
        move = np.argsort(keys)
        members, keys = members[move], keys[move]
        order[slots] = members
        head = np.ones(len(slots), dtype=bool)
        head[1:] = keys[1:] != keys[:-1]
        first[slots] = head
        rank[members] = np.maximum.accumulate(np.where(head, slots, 0))
        wide *= 2
    return order


def common_prefix_levels(symbols: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and the common prefix of each suffix with its predecessor (-1: ``limit`` or more).

    Symbol 0 separates texts; prefixes never run over it. Breadth-first over intervals of
    the Burrows-Wheeler transform: an interval of prefix length l is extended backward by
    every symbol in it, and the end of an extension that is still open gets the value l.
    """
    n = len(symbols)
    order = suffix_order(symbols, limit + 1)
    last = symbols[order - 1]  # the transform; the first suffix is preceded by the final separator
    back = np.argsort(last, kind="stable")
    to = np.empty(n, dtype=np.int64)
    to[back] = np.arange(n)
    following, preceding = np.full(n, n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    same = last[back[1:]] == last[back[:-1]]
    following[back[:-1][same]] = back[1:][same]
    preceding[back[1:][same]] = back[:-1][same]
    value = np.full(n + 1, -1, dtype=np.int16)
    counts = np.bincount(symbols)
    ends = np.cumsum(counts)
    value[0] = value[n] = 0
    value[ends] = 0
    real = np.flatnonzero(counts)  # the separator too: what runs into a text's end must be told from what goes on
    begin, end = (ends - counts)[real], ends[real]
    for level in range(1, limit):
        if len(begin) == 0:
            break
        size = end - begin
        interval = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(interval)) - np.repeat(np.cumsum(size) - size, size) + begin[interval]
        usable = last[place] != 0
        firsts = to[place[usable & (preceding[place] < begin[interval])]]
        lasts = to[place[usable & (following[place] >= end[interval])]]
        # extensions are disjoint, so the k-th begin belongs to the k-th end
        firsts.sort()
        lasts.sort()
        lasts += 1
        fresh = value[lasts] < 0
        begin, end = firsts[fresh], lasts[fresh]
        value[end] = level
    return order, value[:n]


def repeated_starts(texts: list[bytes], limit: int = MIN_LENGTH) -> list[np.ndarray]:
    """For each text, which places start a string of ``limit`` bytes that also starts at another place of the block."""
    size = np.array([len(t) for t in texts])
    symbols = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(size + 1) - 1
    symbols[ends] = 0
    order, value = common_prefix_levels(symbols, limit)
    open_ = value < 0
    repeated = open_.copy()
    repeated[:-1] |= open_[1:]
    flags = np.zeros(len(symbols), dtype=bool)
    flags[order[repeated]] = True
    return [flags[e - s:max(e - s, e - limit + 1)] for s, e in zip(size, ends, strict=True)]


def spans_of(flags: np.ndarray) -> list[int]:
    """Begin and end of each run of set flags, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge.tolist()


def merged_spans(places: list[int], size: int) -> list[tuple[int, int]]:
    """Flat begins and ends to maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(places[::2], places[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [(a, min(b, size)) for a, b in out]


# ---- Spark code

def _region_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, values in byte_slices(batch.column("s_text")):
            number, begin, count, key, whole, twice = regions(values)
            rows = pa.array(number + first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("s_id").take(rows), batch.column("s_hash").take(rows), pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key), pa.array(whole), pa.array(twice)],
                names=["s_id", "s_hash", "s_begin", "s_count", "s_key", "s_whole", "s_twice"])


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: whole keys are packed into blocks and transformed block by block."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def done():
        found = repeated_starts([t for _, _, t in held])
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in held], pa.int64()), pa.array([w for _, w, _ in held], pa.int64()), pa.array([spans_of(f) for f in found], pa.list_(pa.int32()))],
            names=["s_key", "s_whole", "s_spans"])

    for batch in batches:
        for key, whole, text in zip(*(batch.column(c).to_pylist() for c in ("s_key", "s_whole", "s_text")), strict=True):
            if held and size > BLOCK_BYTES and held[-1][0] != key:
                yield done()
                held, size = [], 0
            if not held or held[-1][:2] != (key, whole):  # repeated rows bring a region twice
                held.append((key, whole, text))
                size += len(text)
    if held:
        yield done()


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, whole, text in zip(*(batch.column(c).to_pylist() for c in ("s_key", "s_whole", "s_text")), strict=True):
            data = np.frombuffer(text, dtype=np.uint8)
            at = np.arange(len(data) - MIN_LENGTH + 1)
            hashes = range_hashes(prefix_hashes(data), at, at + MIN_LENGTH).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), key)), pa.array(np.full(len(at), whole)), pa.array(at.astype(np.int32)), pa.array(hashes)], names=["s_key", "s_whole", "s_at", "s_window"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("s_id"), F.xxhash64("text").alias("s_hash"), F.col("text").alias("s_text"))


def repeated_spans(docs: DataFrame, scratch: Scratch, crowded: int = CROWDED) -> DataFrame:
    """(s_id, s_hash, s_places): flat byte begins and ends of repeated strings, for the texts that have some."""
    kind = dict(docs.dtypes)["doc_id"]
    names = f"s_id {kind}, s_hash bigint, s_begin int, s_count int, s_key bigint, s_whole bigint, s_twice boolean"
    runs = scratch.keep(_keyed(docs).mapInArrow(_region_rows, names))
    shared = runs.groupBy("s_key").agg(F.count("*").alias("n"), F.max("s_twice").alias("twice")).where("n > 1 OR twice").select("s_key")
    found = scratch.keep(runs.join(shared, "s_key"))
    scratch.drop(runs)
    shapes = found.groupBy("s_key", "s_whole").agg(F.count("*").alias("s_times"), F.max("s_twice").alias("s_twice"), F.min(F.struct("s_id", "s_hash", "s_begin", "s_count")).alias("s_one"))
    shapes = scratch.keep(shapes)
    kinds = shapes.groupBy("s_key").agg(F.count("*").alias("s_kinds"))
    several = shapes.join(kinds, "s_key").where("s_kinds > 1 OR (s_times = 1 AND s_twice)").select("s_key", "s_whole", "s_times", "s_kinds", "s_one.*")
    texts = _keyed(docs)
    cut = F.substring(F.col("s_text").cast("binary"), F.col("s_begin") + 1, F.col("s_count") + (MIN_LENGTH - 1))
    texts = texts.join(several, [texts["s_id"].eqNullSafe(several["s_id"]), texts["s_hash"] == several["s_hash"]]).select("s_key", "s_whole", "s_times", "s_kinds", cut.alias("s_text"))
    texts = scratch.keep(texts)
    result = "s_key bigint, s_whole bigint, s_spans array<int>"
    blocks = texts.where(F.col("s_kinds") <= crowded).select("s_key", "s_whole", "s_text").repartition("s_key").sortWithinPartitions("s_key", "s_whole")
    blocks = blocks.mapInArrow(_block_rows, result)
    crowd = texts.where(F.col("s_kinds") > crowded).dropDuplicates(["s_key", "s_whole"])
    windows = crowd.select("s_key", "s_whole", "s_text").mapInArrow(_window_rows, "s_key bigint, s_whole bigint, s_at int, s_window bigint")
    again = windows.groupBy("s_key", "s_window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    counted = windows.join(again, ["s_key", "s_window"]).groupBy("s_key", "s_whole").agg(
        F.flatten(F.collect_list(F.array(F.col("s_at"), F.col("s_at") + 1))).alias("s_spans"))
    # a region met several times repeats from end to end
    whole = shapes.where("s_times > 1").select("s_key", "s_whole", F.array(F.lit(0), F.col("s_one.s_count")).alias("s_spans"))
    spans = blocks.unionByName(counted).unionByName(whole).where(F.size("s_spans") > 0)
    place = F.transform("s_spans", lambda x, i: x + F.col("s_begin") + F.when(i % 2 == 1, MIN_LENGTH - 1).otherwise(0))
    hits = found.join(spans, ["s_key", "s_whole"]).select("s_id", "s_hash", place.alias("s_places"))
    return scratch.keep(hits.groupBy("s_id", "s_hash").agg(F.flatten(F.collect_list("s_places")).alias("s_places")))


def with_places(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` and, in the last column, the places of their spans, null where nothing repeats."""
    text_hash, places = free_name("s_hash", docs.columns), free_name("s_places", docs.columns)
    left = docs.withColumn(text_hash, F.xxhash64("text"))
    same = [left["doc_id"].eqNullSafe(spans["s_id"]), left[text_hash] == spans["s_hash"]]
    return left.join(spans, same, "left").select(*(left[c] for c in docs.columns), spans["s_places"].alias(places))


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        out: list[tuple] = []
        for text, places in zip(texts, batch.column("s_places").to_pylist(), strict=True):
            text = text or b""
            spans, digest, at = merged_spans(places or [], len(text)), hashlib.sha256(), 0
            for a, b in spans:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            out.append((len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
        n_bytes, removed, n_spans, digests = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def cut_text(text: bytes, places: list[int]) -> str:
    """The text without its repeated runs; a run gives back bytes of characters it holds only in part."""
    out, at = [], 0
    for a, b in merged_spans(places, len(text)):
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]).decode()


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        places, names = batch.column(batch.num_columns - 1).to_pylist(), batch.schema.names[:-1]
        kept = [None if t is None else cut_text(t, p or []) for t, p in zip(texts, places, strict=True)]
        columns = [pa.array(kept, batch.schema.field("text").type) if n == "text" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all of them, with repeated strings cut out of ``text``; ``n_chars`` follows where it is a column, others stay whatever their names."""
    spans = repeated_spans(docs, Scratch(docs.sparkSession, "suffix"))
    out = with_places(docs, spans).mapInArrow(_cut_rows, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    spans = repeated_spans(docs, Scratch(spark, "op7"))
    kind = dict(docs.dtypes)["doc_id"]
    return with_places(docs, spans).mapInArrow(_digest_rows, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLES: dict[str, str] = {}
