"""Readers and adapters that turn labelled files into dataset records.

Every adapter returns (records, rejected) or records with an explicit schema; counts and warnings
come from ``operators.quality.ingestion_summary`` over the same rows.
"""

from __future__ import annotations

import itertools
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as LB
from ..operators import quality
from ..session import cut_lineage

IMAGE_TYPES = ["png", "jpg", "jpeg", "webp"]
DOCUMENT_TYPES = ["pdf", "doc", "docx", "txt"]
FORENSIC_TYPES = ["pdf", "png", "jpg", "jpeg", "webp", "txt", "tiff"]


def record_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"rec_{prefix}_"), F.substring(F.sha2(value, 256), 1, 12))


def _first(df: DataFrame, names: list[str]) -> Column:
    """First non-empty of the columns that exist."""
    have = [F.when(F.trim(F.col(f"`{n}`").cast("string")) != "", F.col(f"`{n}`").cast("string")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def _metadata(df: DataFrame, used: set[str]) -> Column:
    rest = [c for c in df.columns if c not in used]
    if not rest:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.map_from_arrays(
        F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(f"`{c}`").cast("string") for c in rest])),
        lambda k, v: v.isNotNull())


def to_records(rows: DataFrame, dataset_type: str, value: str = "path_or_value", label: str = "label", split: str = "BENCHMARK",
               source: str = "file", anonymize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) from rows with a value and a label column; other columns become metadata."""
    for need in (value, label):
        if need not in rows.columns:
            raise ValueError(f"missing column {need}")
    used = {value, label, "id"}
    raw = rows.withColumn("_metadata", _metadata(rows, used)).withColumn("_label", LB.strict_label(F.col(label)))
    rejected = raw.where(F.col("_label").isNull() | F.col(value).isNull()).select(*rows.columns)
    v = F.col(value)
    out = raw.where(F.col("_label").isNotNull() & v.isNotNull()).select(
        F.coalesce(_first(rows, ["id"]), record_id(dataset_type.lower(), v)).alias("id"),
        F.lit(dataset_type).alias("dataset_type"), v.alias("path_or_value"), F.col("_label").alias("label"),
        F.lit(split).alias("split"), F.coalesce(_first(rows, ["source"]), F.lit(source)).alias("source"),
        F.col("_metadata").alias("metadata"))
    if anonymize:
        is_file = F.lower("path_or_value").rlike(r"\.(?:png|jpe?g|pdf|webp)$") & (F.col("dataset_type") != "URL")
        kept = out.withColumn("_file", F.when(is_file, F.col("path_or_value")))
        clean = quality.anonymize(kept, "path_or_value")
        out = quality.anonymize_map(clean.withColumn(
            "path_or_value", F.coalesce("_file", "path_or_value")).drop("_file"), "metadata")
    return out, rejected


def ingest_csv(spark: SparkSession, path: str, dataset_type: str, multi_line: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """CSV with a header; every column is read as text. ``multi_line`` allows line feeds in quotes, at one task a file."""
    rows = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return to_records(rows, dataset_type, **options)


def ingest_json(spark: SparkSession, path: str, dataset_type: str, columns: str, multi_line: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """JSON lines with an explicit column list (DDL); with ``multi_line`` a list or object, at one task a file."""
    return to_records(spark.read.schema(columns).option("multiLine", multi_line).json(path), dataset_type, **options)


def read_lines_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): UTF-8 where a whole file is valid UTF-8, Latin-1 otherwise.

    Bytes are read as Latin-1, which maps every byte to one character and keeps files splittable;
    validity is then one flag per file.
    """
    raw = spark.read.option("encoding", "ISO-8859-1").option("header", False).option("sep", "\u0001").option(
        "quote", "").schema("line string").csv(path).select("line", F.col("_metadata.file_path").alias("file"))
    raw = raw.withColumn("_bytes", F.encode("line", "ISO-8859-1"))
    bad = raw.where(~F.is_valid_utf8(F.col("_bytes"))).select("file").distinct().withColumn("_latin", F.lit(True))
    joined = raw.join(bad, "file", "left")
    return joined.select("file", F.when(F.col("_latin"), F.col("line")).otherwise(F.decode("_bytes", "UTF-8")).alias("line"))


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder on the file systems of driver and executors that ``path`` names; None for other stores, patterns and what is no folder."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    own = fs.makeQualified(target).toUri().getPath() if fs.getUri().getScheme() == "file" else None
    return own if own and os.path.isdir(own) else None


def _shown(entry: os.DirEntry) -> bool:
    """Whether Spark's readers take this file or folder: neither hidden nor an empty file."""
    hidden = (entry.name.startswith("_") and "=" not in entry.name) or entry.name.startswith(".") or entry.name.endswith("._COPYING_")
    return not hidden and (entry.is_dir() or entry.stat().st_size > 0)


def _scanned(batches):
    """(path, size, folder) of what stands in each folder, in batches of bounded size."""
    kind = pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
    for batch in batches:
        for top in batch.column(0).to_pylist():
            with os.scandir(top) as entries:
                shown = filter(_shown, entries)
                while rows := [(e.path, 0 if e.is_dir() else e.stat().st_size, e.is_dir()) for e in itertools.islice(shown, 10_000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)


def _listed(spark: SparkSession, top: str) -> DataFrame:
    """(path, size) of all files below a folder of the local file system: one table a level, no entry reaches the driver."""
    level, out = spark.range(1).select(F.lit(top.rstrip("/") or "/").alias("path")), None
    while True:
        seen = cut_lineage(level.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_scanned, "path string, size bigint, folder boolean"))
        files = seen.where("NOT folder").select("path", "size")
        out = files if out is None else out.unionByName(files)
        level = seen.where("folder").select("path")
        if level.isEmpty():
            return out


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, value): the lines of all text files below ``path``."""
    top = local_folder(spark, path)
    if top is None:
        return spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_name").alias("file_name"), "value")

    def read(batches):
        for batch in batches:
            for start in range(0, len(batch), 1000):
                names, lines = [], []
                for file in batch.column(0).slice(start, 1000).to_pylist():
                    with open(file, "rb") as f:
                        own = f.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n")
                    own = own.split("\n")
                    names += [os.path.basename(file)] * len(own)
                    lines += own
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], names=["file_name", "value"])

    return _dealt(_listed(spark, top).select("path")).mapInArrow(read, "file_name string, value string")


def _dealt(files: DataFrame) -> DataFrame:
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, parent, extension, size) of all files below ``path``; contents are not read.

    Of a folder written as key=value, as partitioned tables have, the parent is the value. On the local file system tasks list the
    folders; of other stores Spark's index is taken, which the driver holds.
    """
    top = local_folder(spark, path)
    if top is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    else:
        files = _listed(spark, top).select(F.concat(F.lit("file:"), "path").alias("path"), "size")
    name = F.substring_index("path", "/", -1)
    return files.select(
        "path", "size", name.alias("name"),
        F.substring_index(F.substring_index(F.substring_index("path", "/", -2), "/", 1), "=", -1).alias("parent"),
        F.lower(F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")).alias("extension"))


def _file_records(files: DataFrame, prefix: Column, dataset_type: Column, label: Column, source: str, extra: dict | None = None) -> DataFrame:
    meta = {"filename": F.col("name"), "parent_folder": F.col("parent"), "size_bytes": F.col("size").cast("string"), **(extra or {})}
    return files.select(
        F.concat(F.lit("rec_"), prefix, F.lit("_"), F.substring(F.sha2("path", 256), 1, 12)).alias("id"),
        dataset_type.alias("dataset_type"), F.col("path").alias("path_or_value"), label.alias("label"),
        F.lit("BENCHMARK").alias("split"), F.lit(source).alias("source"),
        F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v)]).alias("metadata"))


def ingest_directory(spark: SparkSession, path: str, default_type: str = "DOCUMENT") -> DataFrame:
    """Type by extension, label by parent folder; unknown folders become SUSPICIOUS."""
    files = list_files(spark, path)
    kind = F.when(F.col("extension").isin(IMAGE_TYPES), "UPI_SCREENSHOT").when(
        F.col("extension").isin(DOCUMENT_TYPES), "DOCUMENT").otherwise(default_type)
    known = LB.strict_label(F.col("parent"))
    out = _file_records(files, F.lower(kind), kind, F.coalesce(known, F.lit("SUSPICIOUS")), "directory_scan")
    return out.withColumn("label_inferred", LB.strict_label(F.element_at("metadata", "parent_folder")).isNotNull())


def receipt_directory(spark: SparkSession, path: str, labels: DataFrame | None = None) -> DataFrame:
    """Receipt images: label from the folder, overridden by a label table with file_name and any of label, ocr_text and others.

    The table's columns become metadata, redacted; a file without a row there has none of them. Of several rows for one
    file_name the least counts. Labels that are neither known as clean nor as forged leave the folder's label.
    """
    files = list_files(spark, path).where(F.col("extension").isin(IMAGE_TYPES))
    folder = F.when(F.col("parent") == "genuine", "CLEAN").when(
        F.col("parent").startswith("forged_") | (F.col("parent") == "tampered"), "HIGH").otherwise("SUSPICIOUS")
    kind = F.lit("UPI_SCREENSHOT")
    if labels is None:
        return _file_records(files, F.lit("upi"), kind, folder, "upi_receipts")
    told = [c for c in labels.columns if c != "file_name"]
    given = labels.groupBy(F.col("file_name").alias("name")).agg(F.min(F.struct(*[F.col(c).cast("string").alias(c) for c in told])).alias("_told"))
    raw = F.lower(F.trim(F.col("_told")["label"] if "label" in told else F.lit(None).cast("string")))
    held = given.select("name", raw.alias("_given"), *[F.col("_told")[c].alias(f"_raw_{c}") for c in told], *[F.col("_told")[c].alias(f"_told_{c}") for c in told])
    j = files.join(quality.anonymize(held, *[f"_told_{c}" for c in told]), "name", "left")
    raw = F.col("_given")
    label = F.when(raw.isin("genuine", "clean", "benign", "safe", "0"), "CLEAN").when(
        raw.isin("forged", "tampered", "fraud", "high", "1"), "HIGH").otherwise(folder)
    extra = {c: F.when(F.col(f"_raw_{c}").isNotNull(), F.col(f"_told_{c}")) for c in told}
    out = _file_records(j, F.lit("upi"), kind, label, "upi_receipts", extra)
    return out.withColumn("metadata", F.map_filter("metadata", lambda k, v: v.isNotNull()))


def forensic_directory(spark: SparkSession, path: str) -> DataFrame:
    files = list_files(spark, path).where(F.col("extension").isin(FORENSIC_TYPES))
    low = F.lower("parent")
    label = F.when(low == "clean", "CLEAN").when(low == "forged", "HIGH").otherwise("SUSPICIOUS")
    return _file_records(files, F.lit("doc"), F.lit("DOCUMENT"), label, "document_forensics")


def phish_export(rows: DataFrame) -> DataFrame:
    """Records from an exported list of reported phishing URLs; rows without a URL are skipped."""
    url, key = _first(rows, ["url", "URL"]), _first(rows, ["phish_id", "phish_detail_url"])
    verified = F.lower(_first(rows, ["verified", "verification_status"])).isin("yes", "true", "1", "verified")
    out = rows.select(url.alias("_u"), F.coalesce(key, url).alias("_k"), F.coalesce(verified, F.lit(False)).alias("_v"),
                      F.coalesce(_first(rows, ["online"]), F.lit("unknown")).alias("_o"),
                      F.coalesce(_first(rows, ["target"]), F.lit("unknown")).alias("_t")).where(F.col("_u").isNotNull())
    return out.select(
        record_id("pt", F.col("_k")).alias("id"), F.lit("URL").alias("dataset_type"), F.col("_u").alias("path_or_value"),
        F.when(F.col("_v"), "HIGH").otherwise("SUSPICIOUS").alias("label"), F.lit("BENCHMARK").alias("split"),
        F.lit("phishtank").alias("source"),
        F.create_map(F.lit("phish_id"), F.col("_k"), F.lit("online"), F.col("_o"), F.lit("target"), F.col("_t")).alias("metadata"))


def url_list(rows: DataFrame, url_column: str = "url", label_column: str = "label") -> DataFrame:
    """Records from any labelled URL list, with fallbacks for the column names."""
    url = _first(rows, [url_column, "url", "URL", "link"])
    raw = _first(rows, [label_column, "label", "status", "class"])
    out = rows.select(url.alias("_u"), raw.alias("_l")).where(F.col("_u").isNotNull() & F.col("_l").isNotNull())
    return out.select(
        record_id("md", F.col("_u")).alias("id"), F.lit("URL").alias("dataset_type"), F.col("_u").alias("path_or_value"),
        LB.url_list_label(F.col("_l")).alias("label"), F.lit("BENCHMARK").alias("split"), F.lit("mendeley").alias("source"))


def arff_names(spark: SparkSession, path: str) -> list[str]:
    """Attribute names of the first ARFF header among the files at ``path``; of each file only the head is read.

    Any file system that Spark reads will do. A file is left at its first line that is neither blank, comment nor header.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(target) or []
    files = sorted((f.getPath() for top in found for f in fs.listStatus(top.getPath())
                    if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=str)
    for file in files:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(file), "UTF-8"))
        try:
            names, line = [], reader.readLine()
            while line is not None and (not line.strip() or line.strip()[0] in "@%") and line.strip().lower() != "@data":
                words = line.split(None, 1)
                if words and words[0].lower() == "@attribute":
                    name = words[1].strip()
                    names.append(name[1:].split(name[0])[0] if name[0] in "'\"" else name.split()[0])
                line = reader.readLine()
        finally:
            reader.close()
        if names:
            return names
    raise ValueError(f"no ARFF header in {path}")


def parse_arff(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ARFF text: attributes by name plus label (result -1 becomes 1). The data is scanned once, without a job before.

    Data lines are the non-comment lines that start with neither '@' nor '%' and hold a comma.
    """
    names = arff_names(spark, path)
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    body = lines.where(~F.col("line").startswith("@") & ~F.col("line").startswith("%") & F.col("line").contains(","))
    cells = F.transform(F.split("line", ","), lambda c: F.btrim(F.trim(c), F.lit("'\"")))
    rows = body.select(cells.alias("_c"))
    out = rows.select(*[F.get("_c", i).alias(n.lower()) for i, n in enumerate(names)])
    last = "result" if "result" in out.columns else out.columns[-1]
    return out.withColumn("label", F.when(F.coalesce(F.col(last).try_cast("int"), F.lit(1)) == -1, 1).otherwise(0))


BENCHMARK_SCHEMA = (
    "id string, split string, label int, app string, forgery_type string, utr string, amount string, "
    "features struct<brand_palette_distance:double,text_height_variance:double,ela_hotspot_density:double,"
    "utr_valid:boolean,ocr_confidence:double,font_consistent:boolean>, image_path string, generation_method string, difficulty string"
)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Receipt benchmark JSON lines with flat, numeric features."""
    rows = spark.read.schema(BENCHMARK_SCHEMA).json(path)
    flat = rows.select(*[c for c in rows.columns if c != "features"], "features.*")
    return flat.withColumns({c: F.col(c).cast("double") for c in ("utr_valid", "font_consistent")})
