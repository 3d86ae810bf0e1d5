import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerscope.operators import reshape
from answerscope.sources import npy as N
from answerscope.sources import tables as S
from answerscope.streaming.append import append_stream


def test_missing_jsonl_is_empty(spark, tmp_path):
    assert S.read_jsonl(spark, str(tmp_path / "none"), "a long").count() == 0


def test_jsonl_round_trip_keeps_text_and_nulls(spark, tmp_path):
    path = str(tmp_path / "out")
    S.write_jsonl(spark.createDataFrame([(1, "Zoë ✓"), (2, None)], "a long, t string"), path)
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text("utf-8").splitlines() if x]
    assert sorted(lines, key=lambda x: x["a"]) == [{"a": 1, "t": "Zoë ✓"}, {"a": 2, "t": None}]
    assert S.read_jsonl(spark, path, "a long, t string").count() == 2


def test_blank_lines_are_skipped(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert S.read_jsonl(spark, str(tmp_path), "a long").where("a is not null").count() == 2


def test_failed_replace_keeps_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    S.replace_table(spark.range(3), path)
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        S.replace_table(broken, path)
    assert S.read_current(spark, path).count() == 3
    S.replace_table(S.read_current(spark, path).where("id > 0"), path)
    assert S.read_current(spark, path).count() == 2


def test_two_writers_do_not_touch_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    S.replace_table(spark.range(3), path)
    with ThreadPoolExecutor(2) as pool:
        targets = list(pool.map(lambda n: S.replace_table(spark.range(n), path), [5, 7]))
    assert len(set(targets)) == 2 and {spark.read.parquet(t).count() for t in targets} == {5, 7}
    assert S.read_current(spark, path).count() in (5, 7)


def test_no_update_is_lost(spark, tmp_path):
    path = str(tmp_path / "t")
    S.replace_table(spark.createDataFrame([(0,)], "n long"), path)

    def add(_):
        S.update_table(spark, path, lambda t: t.select((F.col("n") + 1).alias("n")), attempts=50)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(8)))
    assert S.read_current(spark, path).first().n == 8
    assert len(list((tmp_path / "t").glob("_current_*"))) == 9 and not list((tmp_path / "t").glob("_next_*"))


def test_a_writer_on_an_old_version_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    S.replace_table(spark.range(3), path, expected=-1)
    with pytest.raises(S.Conflict):
        S.replace_table(spark.range(9), path, expected=-1)
    S.replace_table(spark.range(4), path, expected=0)
    assert S.read_current(spark, path).count() == 4
    with pytest.raises(S.Conflict, match="attempts"):
        S.update_table(spark, path, lambda t: (S.replace_table(spark.range(1), path), t)[1], attempts=2)
    with pytest.raises(FileNotFoundError):
        S.update_table(spark, str(tmp_path / "none"), lambda t: t)


@pytest.mark.parametrize("text", ['{"a": 1}\n{"a": \n', '{"a": "x"}\n'])
def test_malformed_lines_fail(spark, tmp_path, text):
    (tmp_path / "x.jsonl").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_jsonl(spark, str(tmp_path), "a long").collect()


def test_malformed_alias_list_fails(spark):
    rows = spark.createDataFrame([("[\"a\"]",), (None,)], "t string")
    assert [r[0] for r in rows.select(reshape.parse_aliases(F.col("t"))).collect()] == [["a"], []]
    with pytest.raises(Exception, match="(?i)malformed"):
        spark.createDataFrame([("[\"a",)], "t string").select(reshape.parse_aliases(F.col("t"))).collect()


def test_append_adds_each_key_once(spark, tmp_path):
    path = str(tmp_path / "a")
    S.append_new(spark.range(5).union(spark.range(2)), path, ["id"])
    S.append_new(spark.range(8), path, ["id"])
    S.append_new(spark.range(8), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(8))


def test_stream_append(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for _ in range(2):
        spark.range(6).write.mode("append").parquet(str(source))
        append_stream(spark.readStream.schema("id long").parquet(str(source)), target, ["id"], str(tmp_path / "check")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(6))


def test_npy_blocks(spark, tmp_path):
    block = np.arange(2 * 3 * 4, dtype=np.float16).reshape(2, 3, 4)
    np.save(tmp_path / "b0.npy", block)
    np.save(tmp_path / "b1.npy", block + 100)
    rows = N.read_npy(spark, str(tmp_path), ["row_id", "step"], range_bytes=32)  # four vectors of eight bytes
    assert rows.rdd.getNumPartitions() == 4
    got = rows.orderBy("row_id", "step").collect()
    assert [(r.row_id, r.step) for r in got] == [(i, s) for i in range(4) for s in range(3)]
    assert got[0].h == [0.0, 1.0, 2.0, 3.0] and got[-1].h == [120.0, 121.0, 122.0, 123.0]


def test_npy_round_trip(spark, tmp_path):
    df = spark.range(50).selectExpr("array(float(id), float(id) / 2, float(-id)) AS h").repartition(5).union(spark.sql("SELECT CAST(NULL AS array<float>)"))
    assert N.write_npy(df, f"{tmp_path}/t") == 50
    got = N.read_npy(spark, f"{tmp_path}/t", ["place"], range_bytes=24).collect()
    assert sorted(r.place for r in got) == list(range(50))
    assert sorted(r.h for r in got) == [[float(k), k / 2, float(-k)] for k in range(50)]


def test_npy_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert N.read_npy(spark, f"{tmp_path}/none", ["place"]).count() == 0
    for name, blocks in {"shapes": [np.zeros((2, 3)), np.zeros((2, 4))], "order": [np.asfortranarray(np.ones((2, 3)))], "axes": [np.zeros((2, 3, 4))]}.items():
        (tmp_path / name).mkdir()
        for k, block in enumerate(blocks):
            np.save(tmp_path / name / f"{k}.npy", block)
        with pytest.raises(Exception, match="wanted"):
            N.read_npy(spark, f"{tmp_path}/{name}", ["place"]).collect()


def test_name_cache(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({
        "names": {"Rome": ["Q220"], "Nowhere": []}, "ent": {"Q220": {"label": "Rome", "desc": "city", "sitelinks": 9, "claims": {"P31": ["Q515"]}}},
        "lab": {"Q515": ["city", "big town"]}}, indent=1))
    names, entities, labels = S.read_name_cache(spark, str(tmp_path))
    assert {r.name: r.qids for r in names.collect()} == {"Rome": ["Q220"], "Nowhere": []}
    assert entities.first().claims == {"P31": ["Q515"]} and labels.first().label == "city"


def test_aligned_stops_on_a_missing_row(spark):
    a, b = spark.range(4).withColumnRenamed("id", "row_id"), spark.range(3).withColumnRenamed("id", "row_id")
    assert S.aligned(b, b).count() == 3
    with pytest.raises(Exception, match="one side only"):
        S.aligned(a, b).collect()


def test_metrics_and_config(spark, tmp_path):
    S.write_metrics(spark, {"rows": 3, "test": {"raw|C1": {"auc": 0.5}}}, str(tmp_path / "m"))
    got = {(r.config, r.metric, r.value) for r in spark.read.json(str(tmp_path / "m")).collect()}
    assert got == {("", "rows", 3.0), ("test.raw|C1", "auc", 0.5)}
    assert S.config_record(spark, {"seed": 0}).first() == ("seed", "0")
