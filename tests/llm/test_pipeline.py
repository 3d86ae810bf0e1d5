"""Each stage of the pipeline against a plain version over the stage's own input."""

import random
from collections import Counter

import pytest
from test_decontamination import naive_tiles
from test_minhash_join import brute as near_duplicates
from test_suffix_dedup import brute as repeats

import corpus_pipeline as P
from answerscope.llm import mixing, toxicity
from answerscope.llm.common import Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(14) for _ in range(5)]
    passage, base = prose(60), prose(120)
    texts = [prose(rnd.randint(10, 60)) for _ in range(60)]
    texts = [t + (" vile" if k % 4 == 0 else "") for k, t in enumerate(texts)]
    texts += [prose(30) + " " + passage + " " + prose(30) for _ in range(3)]
    texts += [base, base, base.replace(base.split()[50], "zzz"), "", None, prose(10) + " " + items[2], items[4].split(" ", 7)[7] + " x " + " ".join(items[4].split()[:7])]
    rows = [(k, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), len(t or "")) for k, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    scratch = Scratch(spark, "test")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = scratch.keep(stage(spark, docs, path))
        after = docs.collect()
        seen[name] = (len(before), len(after))
        if name == "toxicity":
            frame = spark.createDataFrame(before, SCHEMA)
            scored = toxicity.with_scores(frame, toxicity.train(frame, spark.read.parquet(f"{path}/labels.parquet"))).collect()
            want = [r.doc_id for r in scored if not r.toxic_flag]
            assert len(want) < len(before)
        elif name == "near_duplicates":
            want = [d for d, _, _, kept in near_duplicates([(r.doc_id, r.text) for r in before]) if kept]
            assert len(want) < len(before)
        elif name == "repeated_strings":
            want = [r.doc_id for r in before]
            lengths = {r.doc_id: n - gone for r, (n, gone, _, _) in zip(before, repeats([(r.text or "").encode() for r in before]), strict=True)}
            assert {r.doc_id: len(r.text or "") for r in after} == lengths and sum(lengths.values()) < sum(len(r.text or "") for r in before)
            assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
        elif name == "decontamination":
            plain = lambda t: (t or "").split()
            want = [r.doc_id for r in before if not any(naive_tiles(plain(i), plain(r.text), 5) >= 0.5 * len(plain(i)) for i in items)]
            assert len(want) == len(before) - 2
        else:
            narrow = [(r.doc_id, r.source, len((r.text or "").split())) for r in before]
            counts = mixing.copy_counts(spark.createDataFrame(narrow, "m_id bigint, m_source string, m_size bigint")).collect()
            want = [r.m_id for r in counts for _ in range(r.m_copies)]
            assert docs.columns == [*columns, "mix_copy"]
        assert Counter(r.doc_id for r in after) == Counter(want), name
        if name != "mixture":
            assert docs.columns == columns
    assert Counter(map(tuple, P.run(spark, path).collect())) == Counter(map(tuple, after))


def test_no_rows(spark, folder, tmp_path):
    for t in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{folder[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
