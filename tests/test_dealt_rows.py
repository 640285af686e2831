"""Rows of one row group do not stay one task where the work on them is long."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from murkwatch.operators import quality
from murkwatch.plans import receipts, sources, training
from murkwatch.plans.registry import Data
from murkwatch.session import cut_lineage
from murkwatch.sources import datasets


def test_training_rows_are_dealt_over_tasks(spark, tmp_path):
    spark.range(4000).selectExpr(
        "id AS l_orderkey", "id % 7 AS l_linenumber", "id % 50 AS l_partkey", "id % 20 AS l_suppkey", "id * 1.5D AS l_extendedprice",
        "CAST(id % 50 AS DOUBLE) AS l_quantity", "CASE id % 4 WHEN 0 THEN 'R' ELSE 'N' END AS l_returnflag").coalesce(1).write.parquet(
        str(tmp_path / "lineitem.parquet"))
    parts = training._parts(Data(spark, str(tmp_path)))
    assert len(parts[0].inputFiles()) >= 4
    assert sum(p.count() for p in parts) == 4000


def test_files_are_made_by_several_tasks_without_checksum_files(spark, tmp_path):
    spark.range(40).coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).selectExpr("CASE id % 2 WHEN 0 THEN 'clean' ELSE 'forged' END AS folder", "'file-' || id AS line")
    sources._one_file_each(rows, str(tmp_path / "out"), "txt")
    names = [n for folder in ("clean", "forged") for n in os.listdir(tmp_path / "out" / f"folder={folder}")]
    assert len(names) == 40 and all(n.endswith("txt") for n in names)
    assert len({n.split("-")[1] for n in names}) > 1
    assert sorted(p.read_text().strip() for p in Path(tmp_path, "out").rglob("*txt")) == sorted(f"file-{i}" for i in range(40))


def test_folders_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f, f"{f}-{i}") for f in ("clean", "a b:c", None) for i in range(30)] + [("clean", None), ("clean", " x \t")], "folder string, line string")
    rows = cut_lineage(rows)
    sources._one_file_each(rows, str(tmp_path / "top"), "txt")
    (tmp_path / "top" / ".hidden").write_text("x")
    (tmp_path / "top" / "_logs").mkdir()
    (tmp_path / "top" / "_logs" / "y.txt").write_text("y")
    tasks = datasets.list_files(spark, str(tmp_path / "top"))
    assert "binaryFile" not in tasks._jdf.queryExecution().optimizedPlan().toString()
    lines = datasets.file_lines(spark, str(tmp_path / "top")).collect()
    monkeypatch.setattr(datasets, "local_folder", lambda *a: None)
    index = datasets.list_files(spark, str(tmp_path / "top"))
    assert tasks.schema.names == index.schema.names
    assert sorted(map(tuple, tasks.collect())) == sorted(map(tuple, index.collect())) and tasks.count() == 91
    assert sorted(map(tuple, lines)) == sorted(map(tuple, datasets.file_lines(spark, str(tmp_path / "top")).collect()))
    sources._one_file_each(rows, str(tmp_path / "other"), "txt")  # by Spark's writer
    monkeypatch.undo()
    other = datasets.list_files(spark, str(tmp_path / "other"))
    assert sorted(map(tuple, other.select("parent", "size").collect())) == sorted(map(tuple, tasks.select("parent", "size").collect()))


def test_a_task_that_runs_again_leaves_no_second_file(spark, tmp_path):
    rows = cut_lineage(spark.createDataFrame([("clean", "x"), ("clean", "x"), ("forged", "x")], "folder string, line string").coalesce(1))
    sources._one_file_each(rows, str(tmp_path / "out"), "txt")
    first = sorted(p.name for p in Path(tmp_path, "out").rglob("*txt"))
    sources._one_file_each(rows, str(tmp_path / "out"), "txt")
    assert sorted(p.name for p in Path(tmp_path, "out").rglob("*txt")) == first and len(first) == 3


def test_json_strings_with_and_without_escapes_are_redacted_alike(spark):
    texts = ['{"a":"mail jo@corp.example.com","k":"","n":1}', '{"a":"say \\"x\\" to jo@corp.example.com\\n","b":["\\\\", "é/\\u0001", null, true]}', "jo@corp.example.com", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    tag = rows.limit(1).select(quality._redacted(F.lit("jo@corp.example.com"))).first()[0]
    out = [r.t for r in rows.select("i", quality.anonymize_json(F.col("t")).alias("t")).orderBy("i").collect()]
    assert out == [f'{{"a":"mail {tag}","k":"","n":1}}', f'{{"a":"say \\"x\\" to {tag}\\n","b":["\\\\","é/\\u0001",null,true]}}', tag, None]


def test_reference_lookup_scores_receipts_once(spark, tmp_path):
    spark.range(60).selectExpr("id AS o_orderkey", "id % 9 AS o_custkey", "DATE '2024-01-01' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    out = receipts.rcp12(Data(spark, str(tmp_path)))
    assert all("/cut-" in file for file in out.inputFiles())
