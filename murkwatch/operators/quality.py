"""Dataset quality and privacy jobs."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as LB
from ..functions import privacy as P
from ..functions.exprs import lit_array, pin


def normalize_labels(df: DataFrame, raw: str = "raw_label") -> tuple[DataFrame, DataFrame]:
    """(accepted rows with column label, quarantined rows) under the strict label map."""
    tagged = df.withColumn("label", LB.strict_label(F.col(raw)))
    return tagged.where(F.col("label").isNotNull()), tagged.where(F.col("label").isNull()).drop("label")


def ingestion_summary(df: DataFrame, raw: str = "raw_label", value: str = "path_or_value") -> DataFrame:
    """One row: seen, written, skipped and the count per label, in one pass."""
    label = F.when(F.col(value).isNotNull(), LB.strict_label(F.col(raw)))
    per_label = [F.count_if(label == name).alias(f"{name.lower()}_count") for name in LB.LABELS]
    return df.agg(
        F.count("*").alias("records_seen"), F.count(label).alias("records_written"),
        (F.count("*") - F.count(label)).alias("skipped_records"), *per_label)


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Issues about missing or overwhelming classes; one row per finding."""
    dim = df.sparkSession.range(1).select(F.explode(lit_array(LB.LABELS)).alias("class"))
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    # At most one row per class on either side; the class list is a literal.
    full = F.broadcast(dim).join(counts, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    joined = full.crossJoin(F.broadcast(total))
    pct = 100.0 * F.col("n") / F.col("total")
    code = (
        F.when((F.col("n") == 0) & F.col("class").isin("CLEAN", "HIGH"), "MISSING_CLASS")
        .when(pct > 95.0, "EXTREME_IMBALANCE")
    )
    issues = joined.where(F.col("total") > 0).select(
        F.lit("warning").alias("severity"), code.alias("code"), "class", "n")
    empty = total.where(F.col("total") == 0).select(
        F.lit("error").alias("severity"), F.lit("EMPTY_MANIFEST").alias("code"), F.lit(None).cast("string").alias("class"),
        F.lit(0).cast("long").alias("n"))
    return issues.where(F.col("code").isNotNull()).unionByName(empty)


def class_shares(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    """(by, class, n, state) for each label of each group: missing, overwhelming (over 95 in 100) or present."""
    counts = df.groupBy(by).agg(F.count("*").alias("_all"), *[F.count_if(F.col(label) == name).alias(name) for name in LB.LABELS])
    long = counts.unpivot([by, "_all"], LB.LABELS, "class", "n")
    state = F.when(F.col("n") == 0, "missing").when(100.0 * F.col("n") / F.col("_all") > 95.0, "overwhelming").otherwise("present")
    return long.select(by, "class", "n", state.alias("state"))


def duplicate_issues(df: DataFrame, key: str, code: str, severity: str, order: str = "seq", record: str = "id") -> DataFrame:
    """Every row after the first with the same key, naming the first holder.

    Keys are aggregated first (map-side combined), only repeated keys are joined back. The join
    side built here has one row per repeated key, so adaptive execution can split a hot key.
    """
    firsts = df.groupBy(key).agg(
        F.count("*").alias("_n"), F.min(order).alias("_first"), F.min_by(record, order).alias("first_record"),
    ).where(F.col("_n") > 1).drop("_n")
    hit = df.join(firsts, key).where(F.col(order) > F.col("_first"))
    return hit.select(
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(record).alias("record_id"),
        F.col(order).alias("seq"), "first_record")


def missing_files(df: DataFrame, listing: DataFrame, path: str = "path_or_value", record: str = "id") -> DataFrame:
    """File-based records without an entry in a listing table (column path)."""
    files = df.where(F.col("dataset_type").isin("DOCUMENT", "UPI_SCREENSHOT"))
    gone = files.join(listing.select(F.col("path").alias(path)), path, "left_anti")
    return gone.select(
        F.lit("warning").alias("severity"), F.lit("MISSING_FILE").alias("code"), F.col(record).alias("record_id"))


def text_fields(df: DataFrame, record: str, value: str, metadata: str) -> DataFrame:
    """Rows (record_id, field, text): the value and every entry of a string map."""
    entries = F.transform(F.map_entries(metadata), lambda e: F.struct(
        F.concat(F.lit("metadata."), e["key"]).alias("field"), e["value"].alias("text")))
    own = F.array(F.struct(F.lit("path_or_value").alias("field"), F.col(value).alias("text")))
    return df.select(F.col(record).alias("record_id"), F.inline(F.concat(own, F.coalesce(entries, F.array())))).where(
        F.col("text").isNotNull() & (F.col("text") != ""))


def _strings(value) -> Iterator[tuple[str, str]]:
    """(field, text) of every string inside a JSON value, with its path."""
    left = [("metadata", value)]
    while left:
        field, v = left.pop()
        if isinstance(v, str):
            yield field, v
        elif isinstance(v, dict):
            left += [(f"{field}.{key}", own) for key, own in v.items()]
        elif isinstance(v, list):
            left += [(f"{field}[{i}]", own) for i, own in enumerate(v)]


def flatten_json(df: DataFrame, record: str, column: str) -> DataFrame:
    """Rows (record_id, field, text) for every string inside a JSON column, at any depth, with its path. One narrow pass.

    Texts are parsed and brought into canonical form by the JVM, so what is no JSON raises there.
    """
    def flat(batches):
        for batch in batches:
            # Numbers are of no interest, whatever their length.
            found = ((i, field, own) for i, text in enumerate(batch.column(1).to_pylist()) if text is not None
                     for field, own in _strings(json.loads(text, parse_int=float, parse_float=float)))
            while rows := list(itertools.islice(found, 20_000)):
                at, fields, texts = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(fields), pa.array(texts)], names=["record_id", "field", "text"])

    rows = df.select(F.col(record).alias("record_id"), F.to_json(F.parse_json(column)).alias("json"))
    kind = T.StructType([rows.schema["record_id"], T.StructField("field", T.StringType()), T.StructField("text", T.StringType())])
    return rows.mapInArrow(flat, kind)


def leak_issues(fields: DataFrame) -> DataFrame:
    """Issue rows (severity, code, record_id, field) from rows (record_id, field, text). Narrow."""
    found = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code")))
        for code, (sev, cond) in P.leak_flags(F.col("text")).items()
    ]))
    return fields.select("record_id", "field", F.inline(found)).select("severity", "code", "record_id", "field")


def issue_rollup(issues: DataFrame) -> DataFrame:
    """One row: counts by severity, sorted code list (bounded by the code vocabulary), valid flag."""
    return issues.agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.count_if(F.col("severity") == "info").alias("info_count"),
        F.array_join(F.array_sort(F.collect_set("code")), "|").alias("codes"),
    ).withColumn("valid", F.col("error_count") == 0)


def dataset_card(records: DataFrame, issues: DataFrame, name: str) -> DataFrame:
    """Card row: counts, types and the privacy and limitation notes."""
    leaks = F.filter(F.array_sort(F.collect_set("code")), lambda c: c.startswith("LEAK_"))
    found = issues.agg(leaks.alias("_leaks"))
    head = records.agg(
        F.count("*").alias("record_count"), F.array_join(F.array_sort(F.collect_set("dataset_type")), ", ").alias("dataset_type"),
        *[F.count_if(F.col("label") == n).alias(f"{n.lower()}_count") for n in LB.LABELS])
    privacy = F.when(F.size("_leaks") > 0, F.concat(
        F.lit("Scanned for identifiers; still present: "),
        F.array_join("_leaks", ", "), F.lit(". Redact these or check them by hand."),
    )).otherwise("Scanned for identifiers; none found.")
    limits = F.concat(F.lit("May hold generated rows or few of a kind. "), F.when(
        F.col("clean_count") == 0, "No CLEAN record to compare with.").when(
        F.col("high_count") == 0, "No HIGH record to compare with.").otherwise(""))
    return head.crossJoin(found).select(
        F.lit(name).alias("dataset_name"), "dataset_type", "record_count", "clean_count", "suspicious_count", "high_count",
        privacy.alias("privacy_notes"), limits.alias("known_limitations"))


def anonymize(df: DataFrame, *columns: str) -> DataFrame:
    """Apply all redactions, in order, to string columns (each layer pinned, so none is evaluated twice)."""
    for column in columns:
        df = df.withColumn(column, F.coalesce(F.col(column), F.lit("")))
        order = df.columns
        for layer in P.REDACTIONS:
            df = pin(df, {column: layer(F.col(column))})
        df = df.select(*order)
    return df


def anonymize_map(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.transform_values(column, lambda k, v: LB.anonymize(v)))


#: A string of a JSON text, with the colon if it is a key.
JSON_STRING = r'"(?:[^"\\]++|\\.)*+":?'


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _redacted(text: Column) -> Column:
    return reduce(lambda held, layer: _bound(held, lambda x: layer(x)), P.REDACTIONS, text)


def anonymize_json(column: Column) -> Column:
    """Apply all redactions to every string value inside a JSON text, at any depth; keys, numbers and structure stay.

    The text is brought into canonical form first, so a string is a key exactly if a colon follows it. One pass without
    levels, whatever the depth. Text that is not JSON is redacted as a plain string, null stays null.
    """
    def literal(m: Column) -> Column:
        # Without an escape the text stands between the quotes as it is, and redaction adds nothing to escape.
        escaped = m.contains("\\")
        own = F.when(escaped, F.try_variant_get(F.parse_json(m), "$", "string")).otherwise(F.substr(m, F.lit(2), F.length(m) - 2))

        def quoted(text: Column) -> Column:
            json = _bound(F.to_json(F.array(text)), lambda j: F.substr(j, F.lit(2), F.length(j) - 2))
            return F.when(escaped, json).otherwise(F.concat(F.lit('"'), text, F.lit('"')))

        return F.when(m.endswith(":"), m).otherwise(_bound(_redacted(own), quoted))

    def whole(canonical: Column) -> Column:
        return F.when(canonical.isNull(), _redacted(column)).otherwise(P.replace_matches(canonical, JSON_STRING, literal))

    return _bound(F.to_json(F.try_parse_json(column)), whole)


def pii_report(fields: DataFrame, source: str = "source") -> DataFrame:
    """Leak counts per source and code from rows (source, record_id, field, text)."""
    issues = leak_issues(fields.withColumn("record_id", F.struct(source, "record_id")))
    return issues.groupBy(F.col(f"record_id.{source}").alias(source), "code").agg(F.count("*").alias("n"))
