"""Dataset quality and privacy queries."""

from pyspark.sql import functions as F

from ..functions import labels as LB
from ..functions import privacy as P
from ..functions.exprs import pin
from ..operators import quality as ops
from . import inputs  # noqa: F401
from .registry import Data, query

STRICT = """CASE WHEN upper(trim(raw_label)) IN ('CLEAN', 'SUSPICIOUS', 'HIGH') THEN upper(trim(raw_label))
  WHEN upper(trim(raw_label)) IN ('BENIGN', 'SAFE', 'OK', '0') THEN 'CLEAN' WHEN upper(trim(raw_label)) IN ('MALICIOUS', 'FRAUD', 'BAD', '1', 'FRAUDULENT') THEN 'HIGH'
  WHEN upper(trim(raw_label)) IN ('WARN', 'WARNING', 'MEDIUM') THEN 'SUSPICIOUS' END"""
BINARY = """CASE WHEN lower(trim(raw_label)) IN ('legitimate', 'clean', 'benign', 'safe', 'ok', '0', 'false', 'no') THEN 'CLEAN'
  WHEN lower(trim(raw_label)) IN ('phishing', 'malicious', 'forged', 'fraud', 'bad', '1', 'true', 'yes', 'high') THEN 'HIGH' ELSE 'SUSPICIOUS' END"""
RISK = """CASE WHEN lower(trim(raw_label)) IN ('clean', 'benign', 'safe', 'ok', '0', 'low') THEN 'CLEAN'
  WHEN lower(trim(raw_label)) IN ('high', 'malicious', 'forged', 'fraud', 'bad', '1', 'critical') THEN 'HIGH' ELSE 'SUSPICIOUS' END"""
CONSENSUS = """CASE raw_label WHEN 'unknown' THEN 'UNKNOWN' WHEN 'phishing' THEN 'HIGH' WHEN 'suspicious' THEN 'SUSPICIOUS' ELSE 'CLEAN' END"""

E_, U_, PH_, V_ = P.EMAIL, P.UTR, P.PHONE, P.HANDLE


def flags(text: str) -> str:
    """SQL list of issue codes of one text expression."""
    q = lambda p: p.replace("'", "''")
    return f"""list_filter([
      CASE WHEN regexp_matches({text}, '{q(E_)}') THEN 'LEAK_EMAIL' END, CASE WHEN regexp_matches({text}, '{q(PH_)}') THEN 'LEAK_PHONE' END,
      CASE WHEN len(list_filter(regexp_extract_all({text}, '{q(V_)}'), lambda m: NOT regexp_matches(m, '{q(E_)}'))) > 0 THEN 'LEAK_UPI_ID' END,
      CASE WHEN regexp_matches({text}, '{q(U_)}') THEN 'LEAK_UTR' END,
      CASE WHEN regexp_extract({text}, '(?i)(?:c:\\\\Users\\\\|/home/|/Users/)([^/\\\\]+)', 1) <> '' AND lower(regexp_extract({text}, '(?i)(?:c:\\\\Users\\\\|/home/|/Users/)([^/\\\\]+)', 1)) NOT IN ('default', 'public', 'administrator', 'all users', 'system32') THEN 'LEAK_USERNAME' END,
      CASE WHEN (starts_with({text}, 'http://') OR starts_with({text}, 'https://')) AND contains({text}, '?') THEN 'URL_QUERY_PARAMS' END], lambda c: c IS NOT NULL)"""


FIELDS = """fields AS (SELECT id AS record_id, source, 'path_or_value' AS field, path_or_value AS text FROM {records}
  UNION ALL SELECT id, source, 'metadata.note', meta_note FROM {records} UNION ALL SELECT id, source, 'metadata.owner', meta_owner FROM {records}), leaks AS (
  SELECT record_id, source, field, unnest(""" + flags("text") + """) AS code FROM fields WHERE text <> '')"""


def chain(source: str, key: str, steps=("email", "utr", "phone", "handle", "amount", "url"), name: str = "t") -> str:
    """CTEs <name>0..n that redact column ``t`` of ``source`` step by step."""
    rules = {
        "email": (P.EMAIL, f"'<EMAIL_HASH:' || substr(sha256(lower(m) || '{P.SALT}'), 1, 16) || '>'"),
        "utr": (P.UTR, f"'<UTR_HASH:' || substr(sha256(m || '{P.SALT}'), 1, 16) || '>'"),
        "phone": (P.PHONE, rf"'<PHONE_HASH:' || substr(sha256(regexp_replace(m, '[-.\s()+]', '', 'g') || '{P.SALT}'), 1, 16) || '>'"),
        "handle": (P.HANDLE, f"'<UPI_ID_HASH:' || substr(sha256(lower(m) || '{P.SALT}'), 1, 16) || '>'"),
        "url": (P.URL, f"lower(split_part(m, '://', 1)) || '://' || regexp_extract(m, '^[^:]+://([^/?#]*)', 1) || CASE WHEN regexp_replace(regexp_extract(m, '^[^:]+://[^/?#]*(.*)$', 1), '^[?#]+$', '') = '' THEN '' ELSE '/<PATH_HASH:' || substr(sha256(m || '{P.SALT}'), 1, 16) || '>' END"),
    }
    out = [f"{name}0 AS (SELECT {key}, t FROM {source})"]
    for i, s in enumerate(steps):
        if s == "amount":
            expr = f"regexp_replace(t, '{P.AMOUNT}', '<AMOUNT>', 'g')"
        else:
            pat, rep = rules[s]
            expr = (f"array_to_string(list_transform(regexp_split_to_array(t, '{pat}'), lambda p, i: p || coalesce(list_transform("
                    f"regexp_extract_all(t, '{pat}'), lambda m: {rep})[i], '')), '')")
        out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT {key}, {expr} AS t FROM {name}{i})")
    return ", ".join(out)


def _labelled(d: Data):
    return ops.normalize_labels(d.records)[0]


def _fields(d: Data):
    recs = d.records.withColumn("metadata", F.create_map(F.lit("note"), F.col("meta_note"), F.lit("owner"), F.col("meta_owner")))
    return ops.text_fields(recs, "id", "path_or_value", "metadata")


@query("dq1_strict_labels", f"SELECT raw_label, {STRICT} AS label, count(*) AS n FROM {{records}} GROUP BY ALL")
def dq1(d: Data):
    ok, rejected = ops.normalize_labels(d.records)
    rows = ok.select("raw_label", "label").unionByName(rejected.select("raw_label", F.lit(None).cast("string").alias("label")))
    return rows.groupBy("raw_label", "label").agg(F.count("*").alias("n"))


@query("dq2_binary_risk_labels", f"SELECT raw_label, {BINARY} AS binary_label, {RISK} AS risk_label, count(*) AS n FROM {{records}} GROUP BY ALL")
def dq2(d: Data):
    raw = F.col("raw_label")
    return d.records.select("raw_label", LB.binary_label(raw).alias("binary_label"), LB.risk_label(raw).alias("risk_label")).groupBy(
        "raw_label", "binary_label", "risk_label").agg(F.count("*").alias("n"))


@query("dq3_consensus_labels", f"SELECT raw_label, {CONSENSUS} AS label, provider, count(*) AS n FROM {{consensus}} GROUP BY ALL")
def dq3(d: Data):
    return d.consensus.select("raw_label", LB.consensus_label(F.col("raw_label")).alias("label"), "provider").groupBy(
        "raw_label", "label", "provider").agg(F.count("*").alias("n"))


@query("dq4_ingestion_summary", f"""SELECT count(*) AS records_seen, count(label) AS records_written, count(*) - count(label) AS skipped_records,
  count(*) FILTER (label = 'CLEAN') AS clean_count, count(*) FILTER (label = 'SUSPICIOUS') AS suspicious_count, count(*) FILTER (label = 'HIGH') AS high_count
  FROM (SELECT {STRICT} AS label FROM {{records}})""")
def dq4(d: Data):
    return ops.ingestion_summary(d.records)


@query("dq5_label_distribution", f"""WITH l AS (SELECT dataset_type, {STRICT} AS label FROM {{records}}), t AS (SELECT dataset_type, count(*) AS total FROM l WHERE label IS NOT NULL GROUP BY 1), c AS (
  SELECT t.dataset_type, k.class, total, count(l.label) AS n FROM t CROSS JOIN (VALUES ('CLEAN'), ('SUSPICIOUS'), ('HIGH')) k(class) LEFT JOIN l ON l.label = k.class AND l.dataset_type = t.dataset_type GROUP BY ALL)
  SELECT dataset_type, CASE WHEN n = 0 THEN 'missing' WHEN 100.0 * n / total > 95 THEN 'overwhelming' ELSE 'present' END AS state, class, n FROM c""")
def dq5(d: Data):
    return ops.class_shares(_labelled(d), "dataset_type")


@query("dq6_duplicates", """WITH r AS (SELECT id, seq, path_or_value AS v FROM {records}), a AS (SELECT *, min(seq) OVER (PARTITION BY id) AS fi, first_value(id) OVER (PARTITION BY v ORDER BY seq) AS fv, min(seq) OVER (PARTITION BY v) AS sv FROM r)
  SELECT 'error' AS severity, 'DUPLICATE_ID' AS code, id AS record_id, seq, id AS first_record FROM a WHERE seq > fi
  UNION ALL SELECT 'warning', 'DUPLICATE_VALUE', id, seq, fv FROM a WHERE seq > sv""")
def dq6(d: Data):
    ids = ops.duplicate_issues(d.records, "id", "DUPLICATE_ID", "error")
    return ids.unionByName(ops.duplicate_issues(d.records, "path_or_value", "DUPLICATE_VALUE", "warning"))


@query("dq7_missing_files", """SELECT 'warning' AS severity, 'MISSING_FILE' AS code, id AS record_id FROM {records} r WHERE dataset_type IN ('DOCUMENT', 'UPI_SCREENSHOT')
  AND NOT EXISTS (SELECT 1 FROM {documents} x WHERE x.doc_id % 4 <> 0 AND '/data/files/' || x.source || '/' || x.doc_id || '.pdf' = r.path_or_value)""")
def dq7(d: Data):
    listing = d.sql("SELECT '/data/files/' || source || '/' || doc_id || '.pdf' AS path FROM {documents} WHERE doc_id % 4 <> 0")
    return ops.missing_files(d.records, listing)


@query("dq8_leak_scan", f"WITH {FIELDS} SELECT CASE code WHEN 'URL_QUERY_PARAMS' THEN 'info' ELSE 'warning' END AS severity, code, record_id, field FROM leaks")
def dq8(d: Data):
    return ops.leak_issues(_fields(d))


def _issues(d: Data):
    base = ops.leak_issues(_fields(d)).select("severity", "code", "record_id")
    return base.unionByName(dq6(d).select("severity", "code", "record_id"))


ISSUES = FIELDS + """, r AS (SELECT id, seq, path_or_value AS v FROM {records}), a AS (SELECT *, min(seq) OVER (PARTITION BY id) AS fi, min(seq) OVER (PARTITION BY v) AS sv FROM r), issues AS (
  SELECT CASE code WHEN 'URL_QUERY_PARAMS' THEN 'info' ELSE 'warning' END AS severity, code FROM leaks
  UNION ALL SELECT 'error', 'DUPLICATE_ID' FROM a WHERE seq > fi UNION ALL SELECT 'warning', 'DUPLICATE_VALUE' FROM a WHERE seq > sv)"""


@query("dq9_issue_rollup", f"""WITH {ISSUES} SELECT count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warning') AS warning_count,
  count(*) FILTER (severity = 'info') AS info_count, string_agg(DISTINCT code, '|' ORDER BY code) AS codes, count(*) FILTER (severity = 'error') = 0 AS valid FROM issues""")
def dq9(d: Data):
    return ops.issue_rollup(_issues(d))


@query("dq10_dataset_card", f"""WITH {ISSUES}, h AS (SELECT count(*) AS record_count, string_agg(DISTINCT dataset_type, ', ' ORDER BY dataset_type) AS dataset_type,
  count(*) FILTER (label = 'CLEAN') AS clean_count, count(*) FILTER (label = 'SUSPICIOUS') AS suspicious_count, count(*) FILTER (label = 'HIGH') AS high_count FROM (SELECT dataset_type, {STRICT} AS label FROM {{records}}) WHERE label IS NOT NULL)
  SELECT 'all_records' AS dataset_name, dataset_type, record_count, clean_count, suspicious_count, high_count,
  'Scanned for identifiers; still present: ' || (SELECT string_agg(DISTINCT code, ', ' ORDER BY code) FROM issues WHERE starts_with(code, 'LEAK_')) || '. Redact these or check them by hand.' AS privacy_notes,
  'May hold generated rows or few of a kind. ' AS known_limitations FROM h""")
def dq10(d: Data):
    return ops.dataset_card(_labelled(d), _issues(d), "all_records")


@query("red1_hash", f"SELECT id, substr(sha256(path_or_value || '{P.SALT}'), 1, 16) AS h FROM {{records}}")
def red1(d: Data):
    return d.records.select("id", P.hash_identifier(F.col("path_or_value")).alias("h"))


def _one(layer):
    def run(d: Data):
        text = d.records.select("seq", F.concat_ws(" ", "path_or_value", "meta_note").alias("t"))
        return pin(text, {"redacted": layer(F.col("t"))}).select("seq", "redacted")
    return run


_SRC = "(SELECT seq, path_or_value || ' ' || meta_note AS t FROM {records})"
for _name, _step, _layer in [
    ("red2_emails", "email", P.redact_emails), ("red3_utrs", "utr", P.redact_utrs), ("red4_phones", "phone", P.redact_phones),
    ("red5_handles", "handle", P.redact_handles), ("red6_amounts", "amount", P.redact_amounts), ("red6_urls", "url", P.redact_urls),
]:
    query(_name, f"WITH {chain(_SRC, 'seq', (_step,))} SELECT seq, t AS redacted FROM t1")(_one(_layer))


@query("red7_anonymize_records", f"WITH {chain(_SRC, 'seq')} SELECT seq, t FROM t6")
def red7(d: Data):
    text = d.records.select("seq", F.concat_ws(" ", "path_or_value", "meta_note").alias("t"))
    return ops.anonymize(text, "t")


@query("red7_anonymize_documents", f"WITH {chain('(SELECT doc_id, text AS t FROM {documents})', 'doc_id')} SELECT doc_id, sha256(t) AS digest, length(t) AS n FROM t6")
def red7_docs(d: Data):
    out = ops.anonymize(d.documents.select("doc_id", F.col("text").alias("t")), "t")
    return out.select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("bigint").alias("n"))


# Metadata as nested JSON; keys are in order, as the canonical form has them.
_NESTED = """nested AS (SELECT id AS record_id, source, seq, to_json({'contacts': [meta_note, path_or_value], 'note': meta_note,
  'owner': {'deep': {'deeper': [{'name': meta_owner, 'sources': [[source], [path_or_value]]}]}, 'seq': seq}}) AS js FROM {records}), leaves AS (
  SELECT record_id, source, 'metadata' || substr(fullkey, 2) AS field, atom ->> '$' AS t FROM nested, json_tree(nested.js) WHERE type = 'VARCHAR')"""


def _nested(d: Data):
    return d.records.select("id", F.to_json(F.struct(
        F.array("meta_note", "path_or_value").alias("contacts"), F.col("meta_note").alias("note"), F.struct(
            F.struct(F.array(F.struct(F.col("meta_owner").alias("name"), F.array(F.array("source"), F.array("path_or_value")).alias("sources"))).alias("deeper")).alias("deep"),
            F.col("seq").alias("seq")).alias("owner"))).alias("metadata"))


@query("red7_nested_metadata", f"WITH {_NESTED}, {chain('leaves', 'record_id, field')} SELECT record_id, field, t AS text FROM t6")
def red7_nested(d: Data):
    redacted = _nested(d).select("id", ops.anonymize_json(F.col("metadata")).alias("metadata"))
    return ops.flatten_json(redacted, "id", "metadata")


@query("dq8_nested_leak_scan", f"WITH {_NESTED}, leaks AS (SELECT record_id, field, unnest({flags('t')}) AS code FROM leaves WHERE t <> '') "
       "SELECT CASE code WHEN 'URL_QUERY_PARAMS' THEN 'info' ELSE 'warning' END AS severity, code, record_id, field FROM leaks")
def dq8_nested(d: Data):
    return ops.leak_issues(ops.flatten_json(_nested(d), "id", "metadata"))


@query("red8_pii_report", f"WITH {FIELDS} SELECT source, code, count(*) AS n FROM leaks GROUP BY ALL")
def red8(d: Data):
    recs = d.records.withColumn("metadata", F.create_map(F.lit("note"), F.col("meta_note"), F.lit("owner"), F.col("meta_owner")))
    fields = ops.text_fields(recs.withColumn("key", F.struct("source", "id")), "key", "path_or_value", "metadata")
    flat = fields.select(F.col("record_id.source").alias("source"), F.col("record_id.id").alias("record_id"), "field", "text")
    return ops.pii_report(flat)
