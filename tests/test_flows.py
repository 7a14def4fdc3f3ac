import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from platewise.operators import planes as A
from platewise.operators import results as R
from platewise.sources import files as S
from platewise.streaming import tasks as Q

FILE = {"image_file_url": "i", "label_file_url": "l", "results_path_stub": "s"}


def delivery(name, sent, **more):
    return {"task_id": name, "nav_root": "r", "dataset_name": "sim", "files": [FILE], "sent": f"2024-01-01T{sent}Z"} | more


def test_a_stream_that_fails_in_a_batch_goes_on_without_loss_or_repeats(spark, tmp_path, monkeypatch):
    inbox, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    inbox.mkdir()

    def turn(name=None, rows=()):
        if name:
            (inbox / name).write_text("\n".join(map(json.dumps, rows)))
        Q.serve(spark, str(inbox), out, ck, ("sim",), "1 day").awaitTermination()

    turn("1.json", [delivery("a", "00:00:00"), delivery("b", "01:00:00", dataset_name="no"), delivery("a", "00:00:00")])
    real = Q.status_counts
    monkeypatch.setattr(Q, "status_counts", lambda df: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(PySparkException):  # after files and rejected tasks of the batch are written
        turn("2.json", [delivery("c", "02:00:00"), delivery("a", "00:30:00"), delivery("d", "03:00:00", files=None)])
    monkeypatch.setattr(Q, "status_counts", real)
    turn()
    turn("3.json", [delivery("c", "02:00:00"), delivery("e", "04:00:00", files=[FILE, FILE])])
    assert sorted(r["task_id"] for r in spark.read.parquet(f"{out}/files").collect()) == ["a", "c", "e", "e"]
    assert {r["task_id"]: r["error"] for r in spark.read.parquet(f"{out}/rejected").collect()} == {"b": "unknown_dataset", "d": "no_files"}
    assert {r["status"]: r["count"] for r in Q.status_totals(spark, out).collect()} == {"valid": 3, "unknown_dataset": 1, "no_files": 1}


def test_what_was_sent_too_long_ago_is_dropped(spark, tmp_path):
    inbox, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    inbox.mkdir()
    for k, rows in enumerate([[delivery("a", "10:00:00")], [delivery("late", "01:00:00"), delivery("b", "10:30:00")]]):
        (inbox / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        Q.serve(spark, str(inbox), out, ck, ("sim",), "1 hour").awaitTermination()
    assert sorted(r["task_id"] for r in spark.read.parquet(f"{out}/files").collect()) == ["a", "b"]


LABEL = """RECORD_BYTES = 22
OBJECT = INDEX_TABLE
  OBJECT = COLUMN
    NAME = FILE_NAME
    START_BYTE = 2
    BYTES = 8
  END_OBJECT = COLUMN
  OBJECT = COLUMN
    NAME = "COUNT"
    START_BYTE = 12
    BYTES = 4
  END_OBJECT = COLUMN
  OBJECT = COLUMN
    NAME = X
    START_BYTE = 17
    BYTES = 4
  END_OBJECT = COLUMN
END_OBJECT = INDEX_TABLE
"""


def test_labelled_index(spark, tmp_path):
    def volume(name, label, *lines):
        (tmp_path / name).mkdir()
        if label:
            (tmp_path / name / f"{name}_index.lbl").write_text(label)
        (tmp_path / name / f"{name}_index.tab").write_text("".join(f"{x}\r\n" for x in lines))

    volume("V1", LABEL, '"A1      ",  12,1.50', '"é      ",    ,    ', '"short",1', '"A2      ",  xx, 2.5', '"A3      ",   7, abc')
    volume("V2", LABEL.replace("START_BYTE = 12", "START_BYTE = 17").replace("START_BYTE = 17\n    BYTES = 4\n  END_OBJECT = COLUMN\nEND", "START_BYTE = 12\n    BYTES = 4\n  END_OBJECT = COLUMN\nEND"), '"B1      ",  12,   5')
    volume("V3", LABEL.replace('"COUNT"', "OTHER"), '"C1      ",  12,1.50')
    volume("V4", None, '"D1      ",  12,1.50')
    volume("V5", LABEL.replace("RECORD_BYTES = 22\n", ""), '"E1      ",  12,1.50')
    labels, lines = S.volume_texts(spark, str(tmp_path), "*.lbl", whole=True), S.volume_texts(spark, str(tmp_path), "*.tab")
    good, bad = S.labelled_index(labels, lines, {"FILE_NAME": "string", "COUNT": "long", "X": "double"})
    assert sorted(tuple(r) for r in good.collect()) == [("V1", "A1", 12, 1.5), ("V1", "é", None, None), ("V2", "B1", 5, 12.0)]
    assert sorted((r["volume"], r["reason"]) for r in bad.collect()) == [("V1", "not a number: COUNT"), ("V1", "not a number: X"), ("V1", "wrong length"), ("V3", "label without COUNT"), ("V4", "no label"), ("V5", "label without a length")]
    names, none = S.labelled_index(labels, lines, {"FILE_NAME": "string"})
    assert "COUNT" not in names._jdf.queryExecution().optimizedPlan().toString() and none.count() == 3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_documents_are_pruned_and_replaced(spark, tmp_path):
    at = str(tmp_path / "documents")
    docs = lambda rows: spark.createDataFrame(rows, "dataset string, volume string, results_path_stub string, document string")
    R.replace_documents(docs([("d", "v1", "v1/a", "{}"), ("d", "v1", "v1/b", "{}"), ("d", "v2", "v2/a", "{}"), ("e", "v1", "v1/a", "{}")]), at)
    one = R.read_documents(spark, at, "d", ["v1"])
    assert "PartitionFilters: [isnotnull(dataset" in plan(one) and "(dataset" in plan(one) and "volume" in plan(one).split("PartitionFilters")[1].split("]")[0]
    assert sorted(r["results_path_stub"] for r in one.collect()) == ["v1/a", "v1/b"]
    R.replace_documents(docs([("d", "v1", "v1/c", "{}")]), at)  # a repeat of v1: nothing of the first run stays
    assert sorted((r["dataset"], r["volume"], r["results_path_stub"]) for r in R.read_documents(spark, at).collect()) == [("d", "v1", "v1/c"), ("d", "v2", "v2/a"), ("e", "v1", "v1/a")]


def test_written_planes_are_pruned_and_replaced(spark, tmp_path):
    at = str(tmp_path / "planes")
    px = spark.createDataFrame([(1, p, v, 0, x) for p, x in (("radius", 1.5), ("phase", 2.5)) for v in range(3)], "image_ord long, plane string, v long, u long, value double")
    ids = px.filter("plane = 'phase'").select("image_ord", "v", "u", F.lit(601).alias("body_id"))
    A.write_planes(A.plane_table(px, ids, {"radius": "km"}), at)
    one = A.read_planes(spark, at, ["radius"])
    assert "PartitionFilters: [isnotnull(PLANE" in plan(one)
    assert [(r["units"], r["value"]) for r in one.collect()] == [("km", 1.5)] * 3 and {r["PLANE"] for r in A.read_planes(spark, at).collect()} == {"RADIUS", "PHASE", "BODY_ID_MAP"}
    broken = px.withColumn("value", F.expr("IF(v = 2, raise_error('lost'), value)"))
    with pytest.raises(PySparkException):
        A.write_planes(A.plane_table(broken, ids, {}), at)
    A.write_planes(A.plane_table(px.filter("plane = 'phase'"), ids.limit(0), {}), at)
    assert {r["PLANE"] for r in A.read_planes(spark, at).collect()} == {"PHASE"} and not (tmp_path / "planes" / "PLANE=RADIUS").exists()


def test_plugged_archives_stay_apart():
    from platewise.functions import names as N

    a = N.Archive(N.InstrumentProfile("new", "", ("", ""), ("", ""), "", (1, 1), ("", 0, "")), "(.*)")
    before = dict(N.ARCHIVES)
    assert set(N.plugged(a)) == {*before, "new"} and N.ARCHIVES == before  # another choice knows nothing of it
    for known in (N.ARCHIVES["coiss"], a):
        with pytest.raises(ValueError):
            N.plugged(known, known=N.plugged(a))
    with pytest.raises(ValueError):
        from platewise.operators.catalog import archive_camera

        archive_camera(None, "left", N.ARCHIVES)
