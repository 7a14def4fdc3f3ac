import json

import pytest
from pyspark.sql import functions as F

from platewise.sources import files as S
from platewise.streaming import tasks as T


def test_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,primaryfilespec\n1,data/a.IMG\n")
    (tmp_path / "b.csv").write_text("Primary File Spec,y\ndata/b.IMG,2\n")
    (tmp_path / "c.csv").write_text("z\n1\n")
    got = S.spec_list(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(r[0] for r in got.collect()) == ["data/a.IMG", "data/b.IMG"]
    with pytest.raises(ValueError):
        S.spec_list(spark, [str(tmp_path / "c.csv")])
    (tmp_path / "names.txt").write_text("# head\n\nN1294561143 note\n  W1294561144\nbad\n")
    good, bad = S.name_list(spark, str(tmp_path / "names.txt"), F.col("name").rlike("^[NW]"))
    assert sorted(r[0] for r in good.collect()) == ["N1294561143", "W1294561144"] and [r["line"] for r in bad.collect()] == ["bad"]


def test_documents_and_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.json").write_text(json.dumps({"status": "success", "offset": [1.5, 2]}, indent=1))
    (tmp_path / "d" / "e" / "b.json").write_text("{broken")
    good, bad = S.documents(spark, str(tmp_path), "status string, offset array<double>")
    assert [tuple(r)[:2] for r in good.collect()] == [("success", [1.5, 2.0])] and bad.first()["file"].endswith("b.json")
    found = S.file_facts(spark, str(tmp_path), "*.json").collect()
    assert sorted(r["length"] for r in found) == [7, (tmp_path / "d" / "a.json").stat().st_size]


def test_sinks(spark):
    images = spark.createDataFrame([("W1294561144_1",), ("N1294561143_1",)], "img_name string")
    assert [tuple(r) for r in S.collection(images, "b", "data").collect()] == [("P", "urn:nasa:pds:b:data:1294561143n::1.0"), ("P", "urn:nasa:pds:b:data:1294561144w::1.0")]
    nav, back = spark.createDataFrame([("s", "success")], "results_path_stub string, status string"), spark.createDataFrame([("s", 1.0), ("t", 2.0)], "results_path_stub string, x double")
    assert json.loads(S.supplemental(nav, back).first()["document"]) == {"navigation": {"status": "success"}, "backplanes": {"x": 1.0}}


def test_task_stream(spark, tmp_path):
    f = {"image_file_url": "i", "label_file_url": "l", "results_path_stub": "s"}
    inbox, paths = tmp_path / "in", [str(tmp_path / x) for x in ("ok", "bad", "ck")]
    inbox.mkdir()

    def turn(name, rows):
        (inbox / name).write_text("\n".join(map(json.dumps, rows)))
        T.route(T.validated(T.read_tasks(spark, str(inbox)), ("sim",)), *paths).awaitTermination()

    turn("1.json", [{"task_id": "a", "nav_root": "r", "dataset_name": "sim", "files": [f, f]}, {"task_id": "b", "nav_root": "r", "dataset_name": "no", "files": [f]}])
    turn("2.json", [{"task_id": "c", "nav_root": None, "dataset_name": "sim", "files": [f]}])  # a restart goes on where the first ended
    assert [r["task_id"] for r in spark.read.parquet(paths[0]).collect()] == ["a", "a"]
    assert {r["task_id"]: r["error"] for r in spark.read.parquet(paths[1]).collect()} == {"b": "unknown_dataset", "c": "no_nav_root"}
    q = T.status_counts(T.validated(T.read_tasks(spark, str(inbox)), ("sim",))).writeStream.outputMode("update").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["status"]: r["count"] for r in spark.sql("SELECT * FROM counts").collect()} == {"valid": 1, "unknown_dataset": 1, "no_nav_root": 1}
