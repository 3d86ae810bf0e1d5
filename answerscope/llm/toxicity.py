"""Toxicity scores from a convolutional text classifier trained in numpy.

A word, a run of anything but ASCII blanks and punctuation, is two hashed embeddings side by
side (two hash functions, so a chance collision fools one half only); filters of several
widths slide over a text, each keeps its largest response, and a logistic layer reads those.
The first number of an embedding starts at the bucket's leaning towards label 1 in the sample;
everything is then trained. Buckets that few texts of the sample hold are left at zero, so
words seen once are not memorised.

The fit uses a sample of labelled rows bounded by ``SAMPLE`` for each label, drawn by hash
of doc_id; whole texts are used, as everywhere. Its intercept is moved back to the shares
of the labels among all rows that may be learned from. A fifth of the sample is held back to
choose a threshold for each language (best F1; languages with fewer than ``LEAST`` positive
rows share one); ``toxic`` uses it, ``predicted`` is score >= 0.5. Labels, language, source
and id never enter a score. The weights are broadcast; their size is fixed by ``BUCKETS``.

Nulls and empties: a null or blank text has no words and gets the score of an empty text; a
null language uses the shared threshold; a null doc_id is scored, held_out false and never
learned from. Without usable labels every score is the share of toxic rows, or 0. Repeated
rows get equal scores. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.llm.common import SEPARATOR, byte_slices, free_name, mixed, table, without, word_hashes

BUCKETS = 1 << 17
DIM = 8  # of each of the two embeddings
WIDTHS = {1: 16, 2: 8, 3: 8}  # filter width: number of filters
SAMPLE = 4000
LEAST = 20
SEEN_IN = 3
EPOCHS = 4
RATE = 0.03
PAD = max(WIDTHS) - 1


def bucket_pairs(hashes: np.ndarray) -> np.ndarray:
    """Two buckets of every word; bucket 0 is the padding."""
    return np.stack([1 + (hashes % np.uint64(BUCKETS - 1)), 1 + (mixed(hashes) % np.uint64(BUCKETS - 1))], axis=1).astype(np.int32)


def padded(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket pairs of several texts behind one another, and where each begins; padding on both sides keeps windows in their text."""
    gap = np.zeros((PAD, 2), dtype=np.int32)
    starts = np.cumsum([0] + [len(v) + 2 * PAD for v in values])
    return np.concatenate([x for v in values for x in (gap, v, gap)] + [gap]), starts[:-1]


@dataclass
class Model:
    first: np.ndarray
    second: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width * 2 * DIM, number)
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)
    shared: float = 0.5

    def pooled(self, buckets: np.ndarray, starts: np.ndarray, places: bool = False):
        """Largest response of each filter in each text, and the place that gave it."""
        n = len(buckets) - PAD
        words = np.concatenate([self.first[buckets[:, 0]], self.second[buckets[:, 1]]], axis=1)
        parts, where = [], []
        for width, weights in self.filters.items():
            dim = words.shape[1]
            total = words[:n] @ weights[:dim]
            for j in range(1, width):
                total += words[j:n + j] @ weights[j * dim:(j + 1) * dim]
            top = np.maximum.reduceat(total, starts, axis=0)
            parts.append(top)
            if places:
                text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
                hit = total == top[text]
                row, column = np.nonzero(hit)
                at = np.zeros(top.shape, dtype=np.int64)
                at[text[row], column] = row
                where.append(at)
        raw = np.concatenate(parts, axis=1) + self.bias
        return np.maximum(raw, 0), raw > 0, where, words

    def scores(self, values: list[bytes]) -> np.ndarray:
        hashes, starts = word_hashes(values, SEPARATOR)
        pairs = bucket_pairs(hashes)
        buckets, begins = padded([pairs[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)])
        active = self.pooled(buckets, begins)[0]
        return 1 / (1 + np.exp(-np.clip(active @ self.out + self.base, -30, 30).astype(np.float64)))


def _new_model(rng: np.random.Generator, known: np.ndarray, leaning: np.ndarray) -> Model:
    """Random weights, but each embedding's first number starts at its bucket's leaning towards label 1."""
    tables = []
    for seen, lean in zip(known, leaning, strict=True):
        t = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
        t[:, 0] = lean
        t[~seen] = 0
        tables.append(t)
    filters = {}
    for w, n in WIDTHS.items():
        weights = (rng.standard_normal((w, 2 * DIM, n)) * 0.1).astype(np.float32)
        weights[:, 0] += 0.5 / w
        weights[:, DIM] += 0.5 / w
        filters[w] = weights.reshape(w * 2 * DIM, n)
    number = sum(WIDTHS.values())
    return Model(tables[0], tables[1], filters, np.full(number, -1.0, np.float32), np.full(number, 4.0 / number, np.float32), -2.0)


def _leaning(count: np.ndarray, rows: tuple[int, int]) -> np.ndarray:
    """Log odds of a bucket's document counts under label 1 against label 0, shrunk where label 1 has few."""
    odds = np.log((count[1] + 0.5) / (rows[1] + 1)) - np.log((count[0] + 0.5) / (rows[0] + 1))
    return np.clip(odds * count[1] / (count[1] + 10.0), 0, 6).astype(np.float32)


def fit(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], prior: tuple[float, float], seed: int = 7) -> Model:
    """A model from bucket pairs of whole texts; ``prior``: weights of a label 0 and a label 1 row."""
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < 0.2
    count = np.zeros((2, 2, BUCKETS), dtype=np.int32)  # side, label, bucket
    for k, t in enumerate(texts):
        if not held[k]:
            for side in (0, 1):
                count[side, labels[k]][np.unique(t[:, side])] += 1
    known = count.sum(axis=1) >= SEEN_IN
    known[:, 0] = False
    train = np.flatnonzero(~held)
    ones, zeros = train[labels[train] == 1], train[labels[train] == 0]
    model = _new_model(rng, known, np.stack([_leaning(c, (len(zeros), len(ones))) for c in count]))
    squares: dict[str, np.ndarray] = {}

    def move(name: str, array: np.ndarray, gradient: np.ndarray) -> None:
        total = squares.setdefault(name, np.full(array.shape, 1e-6, np.float32))
        total += gradient * gradient
        array -= RATE * gradient / np.sqrt(total)

    for _ in range(EPOCHS if len(ones) and len(zeros) else 0):
        # as many rows of either label in a batch; the rarer ones come several times
        rounds = max(1, max(len(ones), len(zeros)) // 16)
        picks = [rng.permutation(np.resize(rng.permutation(x), rounds * 16)).reshape(rounds, 16) for x in (ones, zeros)]
        for batch in np.concatenate(picks, axis=1):
            buckets, starts = padded([texts[k] for k in batch])
            buckets[rng.random(len(buckets)) < 0.1] = 0  # words left out at random
            active, on, where, words = model.pooled(buckets, starts, places=True)
            y = labels[batch]
            p = 1 / (1 + np.exp(-np.clip(active @ model.out + model.base, -30, 30)))
            error = ((p - y) / len(batch)).astype(np.float32)
            back = error[:, None] * model.out * on
            column = 0
            touched: list[tuple[np.ndarray, np.ndarray]] = []
            dim = 2 * DIM
            steps = []
            for (width, weights), at in zip(model.filters.items(), where, strict=True):
                part = back[:, column:column + weights.shape[1]]
                gradient = np.zeros_like(weights)
                for j in range(width):
                    rows = (at + j).ravel()
                    seen = words[rows].reshape(*at.shape, dim)
                    gradient[j * dim:(j + 1) * dim] = np.einsum("bfd,bf->df", seen, part)
                    touched.append((rows, (part[:, :, None] * weights[j * dim:(j + 1) * dim].T[None]).reshape(-1, dim)))
                steps.append((f"w{width}", weights, gradient))
                column += weights.shape[1]
            rows = np.concatenate([r for r, _ in touched])
            change = np.concatenate([c for _, c in touched])
            for side, (name, t, seen) in enumerate((("first", model.first, known[0]), ("second", model.second, known[1]))):
                ids, inverse = np.unique(buckets[rows, side], return_inverse=True)
                total = np.zeros((len(ids), DIM), np.float32)
                np.add.at(total, inverse, change[:, side * DIM:(side + 1) * DIM])
                total[~seen[ids]] = 0
                grown = squares.setdefault(name, np.full(t.shape, 1e-6, np.float32))
                grown[ids] += total * total
                t[ids] -= RATE * total / np.sqrt(grown[ids])
            for name, weights, gradient in steps:
                move(name, weights, gradient)
            move("bias", model.bias, back.sum(axis=0))
            move("out", model.out, active.T @ error)
            base = np.array([model.base], np.float32)
            move("base", base, error.sum(keepdims=True))
            model.base = float(base[0])
    if len(ones) and len(zeros):
        model.base += float(np.log(prior[1] / prior[0]))  # batches hold both labels equally
        _calibrate(model, [texts[k] for k in np.flatnonzero(held)], labels[held], [langs[k] for k in np.flatnonzero(held)], prior)
    else:
        model.out[:] = 0
        share = prior[1] / (prior[0] + prior[1]) if prior[0] + prior[1] else 0.0
        model.base = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    return model


def _calibrate(model: Model, texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], prior: tuple[float, float]) -> None:
    if not texts:
        return
    scores = np.concatenate([[_score_one(model, t)] for t in texts])
    weight = np.where(labels == 1, prior[1] / max((labels == 1).sum(), 1), prior[0] / max((labels == 0).sum(), 1))

    def best(mask: np.ndarray) -> float:
        s, y, w = scores[mask], labels[mask], weight[mask]
        cuts = np.unique(np.concatenate([[0.5], (np.sort(s)[1:] + np.sort(s)[:-1]) / 2]))
        hit = np.array([(w * (y == 1) * (s >= c)).sum() for c in cuts])
        false = np.array([(w * (y == 0) * (s >= c)).sum() for c in cuts])
        f1 = 2 * hit / np.maximum(hit + false + (w * (y == 1)).sum(), 1e-12)
        good = cuts[f1 >= f1.max() - 1e-9]
        return float(np.clip(good[np.argmin(abs(good - 0.5))], 0.05, 0.95))

    if (labels == 1).sum() >= LEAST:
        model.shared = best(np.ones(len(labels), dtype=bool))
    for lang in {x for x in langs if x is not None}:
        mask = np.array([x == lang for x in langs])
        if (labels[mask] == 1).sum() >= LEAST:
            model.thresholds[lang] = best(mask)


def _score_one(model: Model, pairs: np.ndarray) -> float:
    buckets, starts = padded([pairs])
    return float(1 / (1 + np.exp(-np.clip(model.pooled(buckets, starts)[0] @ model.out + model.base, -30, 30)[0])))


# ---- Spark code

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, values in byte_slices(batch.column("x_text")):
            hashes, starts = word_hashes(values, SEPARATOR)
            pairs = bucket_pairs(hashes)
            packed = [pairs[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(n).slice(first, end - first) for n in ("x_order", "x_lang", "x_label")] + [pa.array(packed, pa.binary())],
                                             names=["x_order", "x_lang", "x_label", "x_buckets"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` rows of each label, drawn by hash of doc_id among those that may be learned from; a doc_id with both labels is toxic."""
    usable = labels.select(F.col("doc_id").alias("x_id"), F.col("toxic").cast("int").alias("x_label")).where(
        "x_id IS NOT NULL AND x_label IN (0, 1)").where(~held_out(F.col("x_id"))).groupBy("x_id").agg(F.max("x_label").alias("x_label"))
    counts = {r.x_label: r.n for r in usable.groupBy("x_label").agg(F.count("*").alias("n")).collect()}
    order = F.md5(F.concat(F.lit("toxic-1|"), F.col("x_id").cast("string")))
    draw = F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = F.when(F.col("x_label") == 1, min(1.0, sample / max(counts.get(1, 0), 1))).otherwise(min(1.0, sample / max(counts.get(0, 0), 1)))
    chosen = usable.withColumn("x_order", order).where(draw < share)
    texts = docs.select("doc_id", F.col("text").alias("x_text"), F.col("lang").alias("x_lang"))
    # the sample's ids are bounded by its size, whatever the input
    joined = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["x_id"]).select("x_order", "x_lang", "x_label", "x_text")
    found = joined.mapInArrow(_bucket_rows, "x_order string, x_lang string, x_label int, x_buckets binary").toArrow()
    order_of, packed = found.column("x_order").to_pylist(), found.column("x_buckets")
    rows = sorted(range(found.num_rows), key=lambda k: (order_of[k], zlib.crc32(packed[k].as_buffer())))
    pairs = [np.frombuffer(packed[k].as_buffer(), np.int32).reshape(-1, 2) for k in rows]  # views, not copies
    labels_, langs = found.column("x_label").to_pylist(), found.column("x_lang").to_pylist()
    return fit(pairs, np.array([labels_[k] for k in rows], dtype=np.int64), [langs[k] for k in rows], (counts.get(0, 0), counts.get(1, 0)))


def with_scores(docs: DataFrame, model: Model, score: str = "score", flag: str = "toxic_flag") -> DataFrame:
    """All rows and columns of ``docs`` with the score and whether it reaches the threshold of the row's language, in place of columns of these names."""
    docs = without(docs, score, flag)
    spread = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        for batch in batches:
            scores = [m.scores(values) for _, _, values in byte_slices(batch.column("text"), 1 << 18)]
            got = np.concatenate(scores) if scores else np.zeros(0)
            langs = batch.column("lang").to_pylist()
            cut = np.array([m.thresholds.get(x, m.shared) for x in langs])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got), pa.array(got >= cut)], names=[*names, score, flag])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{score}` double, `{flag}` boolean")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold of their language; further columns stay whatever their names."""
    score, flag = free_name("x_score", docs.columns), free_name("x_toxic", docs.columns)
    scored = with_scores(docs, train(docs, labels), score, flag)
    return scored.where(~F.col(flag)).select(*docs.columns)


def op8_toxicity_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    model = train(docs, table(spark, folder, "labels", "doc_id", "toxic"))
    scored = with_scores(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("toxic_flag").alias("toxic"))


QUERIES = {"op8_toxicity_cnn": op8_toxicity_cnn}
ORACLES: dict[str, str] = {}
