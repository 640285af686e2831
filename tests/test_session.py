"""Dealing out rows."""

from murkwatch import session


def test_rows_of_one_row_group_are_dealt_over_tasks_by_size(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(800_000).selectExpr("id", "sha2(CAST(id AS STRING), 256) AS t").coalesce(1).write.option("compression", "none").parquet(path)
    rows = spark.read.parquet(path)
    dealt = session.spread(rows, task_mb=4)
    sizes = dealt.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) >= 12 and sum(sizes) == 800_000 and max(sizes) < 2 * min(sizes)
    assert session.spread(spark.range(10).repartition(6), task_mb=4).rdd.getNumPartitions() == 4  # one task a core at least
