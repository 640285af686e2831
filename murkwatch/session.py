"""Session settings and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "murkwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    On a cluster ``master`` and memory come from spark-submit; only the
    settings that results depend on (UTC) and adaptive execution are pinned.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    tune(spark)
    return spark


def tune(spark: SparkSession) -> None:
    """Runtime settings for wide expression stages.

    HotSpot does not compile methods beyond 8000 bytes of bytecode; with this limit Spark
    splits such a stage into small compiled methods instead of one interpreted giant.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def spread(df: DataFrame, few: int = 32, task_mb: int | None = None) -> DataFrame:
    """Deal out an input of a few file splits for expensive row-wise work.

    Only inputs below ``few`` splits are dealt anew, a few gigabytes at most on any cluster; larger ones are read as they are.
    With ``task_mb`` rows are dealt at any size, over one task for every ``task_mb`` of input files: rows of short texts are small next
    to the work on them, and a row group is one task, however many splits there are beside it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if task_mb:
        tasks = -(-_file_bytes(df) // (task_mb << 20))
        return df.repartition(max(1, -(-tasks // cores)) * cores)  # whole rounds of tasks
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, few) else df


def _file_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` scans, each scan counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; where it is unset, a folder below the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The table outlives lost executors and is computed once (an eager ``checkpoint()`` runs its last
    stage twice). Files live as long as the checkpoint folder does, or until ``drop_table``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` gave and no later step reads."""
    jvm = df.sparkSession._jvm
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if "/cut-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_stream(df: DataFrame) -> DataFrame:
    """``df`` as a stream that ends: a stored table, read by a streaming file source (use an available-now trigger)."""
    stored = cut_lineage(df)
    folder = {file.rsplit("/", 1)[0] for file in stored.inputFiles()}.pop()
    return df.sparkSession.readStream.schema(stored.schema).parquet(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
