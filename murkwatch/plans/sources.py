"""Source and sink queries. Each writes files from the given tables first, then reads them back."""

import hashlib
import os
import uuid
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..session import cut_lineage, ensure_checkpoint_dir, spread
from ..sources import datasets, manifests, stores
from .evaluation import M, P, T, cells
from .quality import BINARY, STRICT, chain
from . import inputs  # noqa: F401
from .registry import Data, query


def _folder(d: Data) -> str:
    ensure_checkpoint_dir(d.spark)
    return f"{d.spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def _raw(d: Data):
    return d.records.select("path_or_value", F.col("raw_label").alias("label"), "source", "meta_note")


# Identifiers come from the raw value; value and note are redacted.
_RAW = f"""raw AS (SELECT DISTINCT 'rec_url_' || substr(sha256(path_or_value), 1, 12) AS id, path_or_value AS t, {STRICT} AS label, source, meta_note AS note FROM {{records}} WHERE {STRICT} IS NOT NULL)"""
_REC = f"""WITH {_RAW}, {chain('raw', 'id, label, source, note')}, {chain('(SELECT id, label, source, t AS path_or_value, note AS t FROM t6)', 'id, label, source, path_or_value', name='u')}
  SELECT DISTINCT id, path_or_value, label, source, t AS note FROM u6"""


@query("src1_ingest_csv", _REC)
def src1(d: Data):
    path = _folder(d)
    _raw(d).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    out, _ = datasets.ingest_csv(d.spark, path, "URL")
    return out.select("id", "path_or_value", "label", "source", F.element_at("metadata", "meta_note").alias("note")).distinct()


@query("src2_ingest_json", _REC)
def src2(d: Data):
    path = _folder(d)
    _raw(d).write.json(path)
    out, _ = datasets.ingest_json(
        d.spark, path, "URL", "path_or_value string, label string, source string, meta_note string", multi_line=False)
    return out.select("id", "path_or_value", "label", "source", F.element_at("metadata", "meta_note").alias("note")).distinct()


def _one_file_each(rows, path: str, extension: str) -> None:
    """A file of one line for each row (folder, line), in a folder of that name.

    Creating a file costs more than its row, so a row group is dealt over tasks. In a folder of the local file system tasks create the
    files themselves, without a process for each file's mode and without a rename by the driver; a task that runs again gives its files
    the same names. Elsewhere Spark's writer does.
    """
    dealt = spread(rows, task_mb=4).select("folder", "line")
    jvm = rows.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(rows.sparkSession._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(target)
    top = datasets.local_folder(rows.sparkSession, path)
    if top is None:
        dealt.write.mode("append").partitionBy("folder").option("maxRecordsPerFile", 1).option("extension", extension).option("quote", "").csv(path)
        return
    blank = "".join(map(chr, range(33)))

    def make(batches):
        task, met = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for folder, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                met[folder, line] += 1
                at = f"{top}/folder={_escaped(folder)}"
                os.makedirs(at, exist_ok=True)
                name = hashlib.md5(repr((top, folder, line, met[folder, line])).encode()).hexdigest()
                with open(f"{at}/part-{task:05d}-{name}.{extension}", "w", encoding="utf-8", newline="") as f:
                    f.write("" if line is None else f"{line.strip(blank)}\n")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    dealt.mapInArrow(make, "n bigint").agg(F.sum("n")).collect()


def _escaped(folder: str | None) -> str:
    """A partition's value in the name of its folder, as Spark writes it."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^\x7f" or 0 < ord(c) < 32 else c for c in folder) if folder else "__HIVE_DEFAULT_PARTITION__"


# One file for each document; the folder is the label. Names of files are Spark's own, so keys that contain them stay out.
_FOLDER = "CASE doc_id % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'forged' WHEN 2 THEN 'Fraud' WHEN 3 THEN lang ELSE 'genuine' END"


@query("src3_directory_scan", f"""WITH f AS (SELECT {_FOLDER} AS parent_folder, 'file-' || doc_id AS line FROM {{documents}}), l AS (
  SELECT *, CASE WHEN upper(parent_folder) IN ('CLEAN', 'SUSPICIOUS', 'HIGH') THEN upper(parent_folder) WHEN upper(parent_folder) = 'FRAUD' THEN 'HIGH' END AS known FROM f)
  SELECT 'DOCUMENT' AS dataset_type, coalesce(known, 'SUSPICIOUS') AS label, parent_folder, (strlen(line) + 1)::VARCHAR AS size_bytes, known IS NOT NULL AS label_inferred, count(*) AS n FROM l GROUP BY ALL""")
def src3(d: Data):
    path = _folder(d)
    _one_file_each(d.documents.selectExpr(f"{_FOLDER} AS folder", "'file-' || doc_id AS line"), path, "txt")
    out = datasets.ingest_directory(d.spark, path)
    meta = [F.element_at("metadata", k).alias(k) for k in ("parent_folder", "size_bytes")]
    return out.select("dataset_type", "label", *meta, "label_inferred").groupBy(
        "dataset_type", "label", "parent_folder", "size_bytes", "label_inferred").agg(F.count("*").alias("n"))


_RECEIPT = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'genuine' WHEN 1 THEN 'forged_font' WHEN 2 THEN 'tampered' ELSE 'unsorted' END AS folder,
  CASE page_id % 7 WHEN 0 THEN ' Clean ' WHEN 1 THEN 'FORGED' WHEN 2 THEN 'unclear' WHEN 3 THEN '1' ELSE NULL END AS label,
  'Paid Rs. ' || (page_id % 900) || ' to shop' || page_id || '@okaxis UTR ' || lpad(CAST(page_id AS STRING), 12, '4') || ' from ' || url AS ocr FROM {pages}"""


@query("src7_receipt_directory", f"""WITH r AS ({_RECEIPT}), {chain("(SELECT page_id, ocr AS t FROM r WHERE page_id % 3 <> 0)", "page_id")}
  SELECT r.page_id, CASE WHEN r.page_id % 3 <> 0 AND lower(trim(label)) = 'clean' THEN 'CLEAN' WHEN r.page_id % 3 <> 0 AND lower(trim(label)) IN ('forged', '1') THEN 'HIGH'
    WHEN folder = 'genuine' THEN 'CLEAN' WHEN folder = 'unsorted' THEN 'SUSPICIOUS' ELSE 'HIGH' END AS label, folder AS parent_folder, t6.t AS ocr_text
  FROM r LEFT JOIN t6 ON t6.page_id = r.page_id""")
def src7(d: Data):
    """Images by name; two of three have a row in the label table, which is built from what each file says it is."""
    path = _folder(d)
    rows = d.sql(_RECEIPT)
    for folder in ("genuine", "forged_font", "tampered", "unsorted"):  # a job each, so no two files have one name
        _one_file_each(rows.where(F.col("folder") == folder).selectExpr("folder", "CAST(page_id AS STRING) AS line"), f"{path}/{folder}", "png")
    files = cut_lineage(datasets.file_lines(d.spark, path).select("file_name", F.col("value").cast("long").alias("page_id")))
    named = files.join(rows.where("page_id % 3 <> 0").select("page_id", "label", F.col("ocr").alias("ocr_text")), "page_id")
    out = datasets.receipt_directory(d.spark, path, named.select("file_name", "label", "ocr_text"))
    return out.withColumn("file_name", F.element_at("metadata", "filename")).join(files.select("file_name", "page_id"), "file_name").select(
        "page_id", "label", F.element_at("metadata", "parent_folder").alias("parent_folder"), F.element_at("metadata", "ocr_text").alias("ocr_text"))


@query("src8_document_directory", f"""SELECT CASE lower(parent_folder) WHEN 'clean' THEN 'CLEAN' WHEN 'forged' THEN 'HIGH' ELSE 'SUSPICIOUS' END AS label, parent_folder, (strlen(line) + 1)::VARCHAR AS size_bytes, count(*) AS n
  FROM (SELECT {_FOLDER} AS parent_folder, doc_id || ' ' || source AS line FROM {{documents}} WHERE doc_id % 3 <> 0) GROUP BY ALL""")
def src8(d: Data):
    """Scans of two types; a third of the files has a type that is not taken."""
    path = _folder(d)
    rows = d.documents.selectExpr("doc_id", f"{_FOLDER} AS folder", "doc_id || ' ' || source AS line")
    for rest, extension in ((0, "log"), (1, "pdf"), (2, "jpg")):
        _one_file_each(rows.where(F.col("doc_id") % 3 == rest).drop("doc_id"), f"{path}/{extension}", extension)
    out = datasets.forensic_directory(d.spark, path)
    return out.select("label", *[F.element_at("metadata", k).alias(k) for k in ("parent_folder", "size_bytes")]).groupBy(
        "label", "parent_folder", "size_bytes").agg(F.count("*").alias("n"))


@query("src4_encodings", "SELECT 'Stra\u00dfe \u00e9 ' || source || ' ' || doc_id AS line, CASE doc_id % 2 WHEN 0 THEN 'utf' ELSE 'latin' END AS folder FROM {documents}")
def src4(d: Data):
    path = _folder(d)
    lines = d.documents.selectExpr("concat('Stra\u00dfe \u00e9 ', source, ' ', doc_id) AS line", "doc_id % 2 AS odd")
    lines.where("odd = 0").select("line").write.csv(f"{path}/utf")
    lines.where("odd = 1").select("line").write.option("encoding", "ISO-8859-1").csv(f"{path}/latin")
    read = datasets.read_lines_any_encoding(d.spark, f"{path}/*")
    return read.select("line", F.element_at(F.split("file", "/"), -2).alias("folder"))


@query("src5_phish_export", """SELECT 'rec_pt_' || substr(sha256(page_id::VARCHAR), 1, 12) AS id, url AS path_or_value, CASE page_id % 3 WHEN 0 THEN 'HIGH' ELSE 'SUSPICIOUS' END AS label FROM {pages} WHERE page_id % 11 <> 0""")
def src5(d: Data):
    path = _folder(d)
    d.pages.selectExpr("page_id AS phish_id", "CASE WHEN page_id % 11 = 0 THEN '' ELSE url END AS URL",
                       "CASE page_id % 3 WHEN 0 THEN 'yes' ELSE 'no' END AS verified").write.option("header", True).csv(path)
    rows = d.spark.read.option("header", True).csv(path)
    return datasets.phish_export(rows).select("id", "path_or_value", "label")


@query("src6_url_list", f"""SELECT DISTINCT 'rec_md_' || substr(sha256(path_or_value), 1, 12) AS id, path_or_value, CASE WHEN lower(trim(raw_label)) IN ('suspicious', 'warn', 'warning') THEN 'SUSPICIOUS' ELSE {BINARY} END AS label
  FROM {{records}}""")
def src6(d: Data):
    path = _folder(d)
    _raw(d).select(F.col("path_or_value").alias("link"), F.col("label").alias("status")).write.option("header", True).csv(path)
    return datasets.url_list(d.spark.read.option("header", True).csv(path)).select("id", "path_or_value", "label").distinct()


@query("src9_arff", """SELECT (o_custkey % 3 - 1)::VARCHAR AS having_ip_address, (o_orderkey % 3 - 1)::VARCHAR AS url_length, CASE o_orderkey % 2 WHEN 0 THEN 1 ELSE 0 END AS label, count(*) AS n FROM {orders} GROUP BY ALL""")
def src9(d: Data):
    path = _folder(d)
    rows = d.orders.selectExpr("concat(o_custkey % 3 - 1, ', ', o_orderkey % 3 - 1, ',', CASE o_orderkey % 2 WHEN 0 THEN -1 ELSE 1 END) AS value")
    # Header lines first: one small file next to the data files.
    head = d.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (
        "@relation sites", "@attribute having_IP_Address { -1,0,1 }", "@attribute 'URL_Length' numeric", "@attribute Result { -1,1 }",
        "@data", "% a comment, with a comma")])).alias("value"))
    head.coalesce(1).write.text(path)
    rows.write.mode("append").text(path)
    out = datasets.parse_arff(d.spark, path)
    return out.groupBy("having_ip_address", "url_length", "label").agg(F.count("*").alias("n"))


@query("src10_benchmark_jsonl", "SELECT split, app, label, count(*) AS n, round(sum(brand_palette_distance), 6) AS palette, sum(utr_valid) AS valid FROM {receipt_features} GROUP BY ALL")
def src10(d: Data):
    path = _folder(d)
    d.receipt_features.select("id", "split", "label", "app", "forgery_type", "difficulty", F.struct(
        "brand_palette_distance", "text_height_variance", "ela_hotspot_density", (F.col("utr_valid") == 1).alias("utr_valid"),
        "ocr_confidence", (F.col("font_consistent") == 1).alias("font_consistent")).alias("features")).write.json(path)
    rows = datasets.read_benchmark(d.spark, path)
    return rows.groupBy("split", "app", "label").agg(
        F.count("*").alias("n"), F.round(F.sum("brand_palette_distance"), 6).alias("palette"), F.sum("utr_valid").alias("valid"))


@query("src11_manifest_validation", """SELECT 'duplicate_id' AS problem, id, count(*) AS n FROM {records} GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'blank_value', id, 1 FROM {records} WHERE trim(path_or_value) = ''""")
def src11(d: Data):
    path = _folder(d)
    manifests.write_records(d.records.select("id", "path_or_value", "dataset_type", "split"), path)
    return manifests.validate_manifest(d.spark.read.parquet(path))


@query("src12_event_store", "SELECT event_id, doc_id, risk_score FROM {fraud_events} WHERE doc_id = 'doc_7'")
def src12(d: Data):
    path = _folder(d)
    ev_ = d.fraud_events
    stores.append_events(ev_.where(F.col("risk_score") > 50), path)
    stores.append_events(ev_.where(F.col("risk_score") <= 50), path)
    return stores.find_by_document(stores.read_events(d.spark, path), "doc_7").select("event_id", "doc_id", "risk_score")


@query("src13_training_table", "SELECT split, label, count(*) AS n, round(sum(ocr_confidence), 6) AS confidence FROM {receipt_features} GROUP BY ALL")
def src13(d: Data):
    path = _folder(d)
    stores.write_training_table(d.receipt_features.select("id", "label", "split", "ocr_confidence"), path, "csv")
    rows = d.spark.read.option("header", True).schema("id string, label int, split string, ocr_confidence double").csv(path)
    return rows.groupBy("split", "label").agg(F.count("*").alias("n"), F.round(F.sum("ocr_confidence"), 6).alias("confidence"))


@query("src14_experiments", "SELECT module, run_id, count(*) AS n, sum(score_a) AS total FROM {predictions}, (VALUES ('first'), ('second')) r(run_id) GROUP BY ALL")
def src14(d: Data):
    path = _folder(d)
    for run in ("first", "second"):
        stores.append_experiment(d.predictions.groupBy("module").agg(F.count("*").alias("n"), F.sum("score_a").alias("total")), path, run)
    return d.spark.read.schema("module string, run_id string, n long, total long").json(path)


_ML = ["accuracy", "precision", "recall", "f1", "fpr", "fnr"]


@query("src15_metric_table", f"WITH c AS (SELECT module, {cells(T, P)} FROM {{predictions}} GROUP BY 1) " + " UNION ALL ".join(
    f"SELECT module, '{m}' AS metric, round({M[m]}, 6) AS value FROM c" for m in _ML))
def src15(d: Data):
    path = _folder(d)
    m = ev.classification_metrics(d.predictions, "true_label", "label_a", ["module"])
    stores.write_metrics(ev.long_metrics(m, ["module"], _ML), path)
    return d.spark.read.option("header", True).schema("module string, metric string, value double").csv(path).withColumn("value", F.round("value", 6))
