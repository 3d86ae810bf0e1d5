"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are all 1- to 3-grams of a text's letters, lower-cased, where every run of other
characters counts as one blank; they are hashed into ``BUCKETS`` counters. A model is one
matrix of log probabilities, buckets by languages, which is broadcast: its size is
``BUCKETS`` x languages x 4 bytes whatever the input. Tasks add the rows of a text's
buckets with numpy; a language's prior is its share of the learned rows.

The fit counts n-grams over a sample of about ``SAMPLE`` rows of each language, drawn by
hash of doc_id, with whole texts. Only text and language of the learned rows are used.

The score is the posterior of the predicted language. A null text, or one without any letter,
is ``und`` with score 0, as is every text if nothing could be learned. A null doc_id is
predicted, counts as not held out, and is not learned from. Ties go to the language first
by code point. Repeated rows get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.llm.common import table, without

BUCKETS = 1 << 15
SAMPLE = 1500
PIECE = 1 << 17  # characters handled at once; longer texts go piece by piece
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)


@lru_cache
def _is_letter() -> np.ndarray:
    return np.array([chr(k).isalpha() for k in range(0x110000)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with one blank for every run of other characters and around the text."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
    letter = _is_letter()[codes]
    first = np.ones(len(codes), dtype=bool)
    first[1:] = letter[1:] | letter[:-1]
    return np.where(letter, codes, np.uint32(32))[first]


def buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a cleaned text, in pieces."""
    for k in range(0, max(len(codes) - 2, 1), PIECE):
        part = codes[k:k + PIECE + 2]
        a = part[:PIECE] if k + PIECE + 2 < len(codes) else part
        one = a * _A
        two = part[:-1] * _B + part[1:] * _A + np.uint32(1)
        three = part[:-2] * _C + part[1:-1] * _B + part[2:] * _A + np.uint32(2) if len(part) > 2 else part[:0]
        two = two[:len(a)] if len(a) < len(part) else two
        h = np.concatenate([one, two, three])
        h ^= h >> np.uint32(15)
        h *= _C
        yield h >> _SHIFT


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages), log probabilities
    prior: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        cleaned = letters(text or "")
        if not self.languages or len(cleaned) < 2:
            return "und", 0.0
        total = self.prior.copy()
        for part in buckets(cleaned):
            total += self.weights[part].sum(axis=0, dtype=np.float64)
        total -= total.max()
        share = np.exp(total)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best] / share.sum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts by language, summed over its rows."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            cleaned = letters(text or "")
            if len(cleaned) > 1:
                held = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in buckets(cleaned):
                    held += np.bincount(part, minlength=BUCKETS)
    for lang, held in totals.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])], names=["lang", "bucket", "n"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    usable = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    rows = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(rows, key=lambda s: s.encode())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    digest = F.md5(F.concat(F.lit("lang-1|"), F.col("doc_id").cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample / rows[k])))]), F.col("lang"))
    counted = usable.where(draw < share).select("lang", "text").mapInArrow(_count_rows, "lang string, bucket int, n bigint")
    cells = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((BUCKETS, len(languages)), 0.5)
    place = pc.index_in(cells.column("lang"), pa.array(languages)).to_numpy()
    counts[cells.column("bucket").to_numpy(), place] += cells.column("n").to_numpy()
    total = np.array([rows[k] for k in languages], dtype=np.float64)
    return Model(languages, (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32), np.log(total / total.sum()))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score, in place of columns of these names."""
    docs = without(docs, "lang_pred", "score")
    spread, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spread.value.predict(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    model = train(table(spark, folder, "documents", "doc_id", "text", "lang"))
    docs = table(spark, folder, "documents", "doc_id", "text")
    return with_language(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
