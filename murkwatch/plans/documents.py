"""Document queries."""

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions.exprs import hit_rules
from ..operators import documents as ops
from . import inputs  # noqa: F401
from .registry import Data, define_input, query, sql_array

_STOP = "(" + ", ".join(f"'{w}'" for w in D.STOPWORDS) + ")"
KEYWORDS = rf"""words AS (SELECT doc_id, trim(w, '.,;:!?"''()-/\') AS word FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[\s\x0B\p{{Z}}]+')) AS w FROM {{docs}})), kc AS (
  SELECT doc_id, word, count(*) AS n FROM words WHERE length(word) > 3 AND regexp_matches(word, '^\p{{L}}+$') AND word NOT IN {_STOP} GROUP BY ALL), kr AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word)::INT AS rank FROM kc), kw AS (
  SELECT doc_id, list(word ORDER BY rank) AS kws FROM kr WHERE rank <= 15 GROUP BY doc_id)"""
# RE2 treats accented letters as non-word characters; the guard class restores the wider word boundary.
PHR = r"""ph AS (SELECT *, list_transform(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '%s'), lambda m: m) AS ms FROM {docs}), pd AS (
  SELECT *, list_filter(ms, lambda m, i: list_position(list_transform(ms, lambda z: lower(z)), lower(m)) = i) AS phrases FROM ph)""" % (
    D.PHRASE_PATTERN)
_PSCORE = "CASE len(phrases) WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 45 WHEN 3 THEN 65 ELSE 80 END"
_TOOLS = "lower(coalesce(creator, '') || ' ' || coalesce(producer, ''))"
RULED = PHR + f""", ru AS (SELECT *, list_filter([
  CASE WHEN {' OR '.join(f"contains({_TOOLS}, '{e}')" for e in D.EDITORS)} THEN 'suspicious_editor' END,
  CASE WHEN creation_date <> modification_date THEN 'metadata_mismatch' END,
  CASE WHEN trim(coalesce(author, '')) = '' THEN 'blank_author' END, CASE WHEN is_encrypted THEN 'encrypted_pdf' END,
  CASE WHEN len(phrases) > 0 THEN 'suspicious_keywords' END], lambda r: r IS NOT NULL) AS rules FROM pd), sc AS (
  SELECT *, least(100, coalesce(list_sum(list_transform(rules, lambda r: CASE r WHEN 'suspicious_editor' THEN 25 WHEN 'metadata_mismatch' THEN 20 WHEN 'blank_author' THEN 5
    WHEN 'encrypted_pdf' THEN 15 ELSE {_PSCORE} END)), 0))::INT AS risk_score FROM ru)"""
_HINT = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(low, {chr(39)}{h}{chr(39)})' for h in hints)} THEN '{t}'" for t, hints in D.TYPE_HINTS.items()) + " ELSE 'unknown' END"


@query("doc1_top_keywords", f"WITH {KEYWORDS} SELECT doc_id, word, n, rank FROM kr WHERE rank <= 15")
def doc1(d: Data):
    return ops.top_keywords(d.docs)


@query("doc2_type_hint", f"SELECT document_type_hint, count(*) AS n FROM (SELECT {_HINT} AS document_type_hint FROM (SELECT lower(text) AS low FROM {{docs}})) GROUP BY ALL")
def doc2(d: Data):
    return d.docs.select(D.type_hint(F.col("text")).alias("document_type_hint")).groupBy("document_type_hint").agg(
        F.count("*").alias("n"))


FINGER = RULED + ", " + KEYWORDS + f""", fp AS (SELECT sc.*, coalesce(kws, []) AS kws,
  coalesce(nullif(trim(creator), ''), nullif(trim(producer), ''), 'unknown') AS tool, lower(text) AS low FROM sc LEFT JOIN kw USING (doc_id)), fh AS (
  SELECT *, {_HINT} AS hint FROM fp), fx AS (
  SELECT *, array_to_string(list_filter(list_concat(list_concat(kws, rules), [tool, hint]), lambda p: p <> '' AND p <> 'unknown'), ' ') AS fingerprint_text FROM fh)"""
_J = " || ', ' || ".join(f"""'"{c}": ' || coalesce('"' || {c} || '"', 'null')""" for c in sorted(
    ["author", "creator", "producer", "creation_date", "modification_date"]))


@query("doc3_fingerprint", f"WITH {FINGER} SELECT doc_id, tool AS editor_tool, hint AS document_type_hint, fingerprint_text, sha256('{{' || {_J} || '}}') AS metadata_hash FROM fx")
def doc3(d: Data):
    return fingerprints(d).select("doc_id", "editor_tool", "document_type_hint", "fingerprint_text", "metadata_hash")


def fingerprints(d: Data):
    return ops.fingerprint(ops.analyze(d.docs))


@query("doc4_content_hash", "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM {documents} GROUP BY 1 HAVING count(*) > 1")
def doc4(d: Data):
    return ops.exact_duplicates(d.documents)


@query("doc5_suspicious_phrases", f"WITH {PHR} SELECT doc_id, array_to_string(phrases, '|') AS phrases FROM pd WHERE len(phrases) > 0")
def doc5(d: Data):
    return ops.analyze(d.docs).where(F.size("phrases") > 0).select("doc_id", F.array_join("phrases", "|").alias("phrases"))


@query("doc6_phrase_score", f"WITH {PHR} SELECT {_PSCORE} AS score, count(*) AS n FROM pd GROUP BY 1")
def doc6(d: Data):
    return ops.analyze(d.docs).select(D.phrase_score(F.size("phrases")).alias("score")).groupBy("score").agg(
        F.count("*").alias("n"))


_PAGES = "SELECT conv_id AS doc_id, turn AS page, CASE (conv_id + turn) % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN 'short text' ELSE text END AS text FROM {conversations}"
define_input("doc_pages", _PAGES)


@query("doc7_page_statistics", r"""WITH s AS (SELECT doc_id, count(*) AS page_count, sum(length(text))::BIGINT AS total_text_length,
  sum(len(list_filter(regexp_split_to_array(text, '[\s\x0B\p{Z}]+'), lambda w: w <> '')))::BIGINT AS word_count, count(*) FILTER (trim(text) = '') AS empty_pages FROM {doc_pages} GROUP BY 1), t AS (
  SELECT *, total_text_length = 0 OR (page_count > 1 AND empty_pages >= page_count // 2) AS is_scanned FROM s)
  SELECT *, page_count > 1 AND NOT is_scanned AND total_text_length < 50 * page_count AS is_low_text FROM t""")
def doc7(d: Data):
    return ops.page_statistics(d.doc_pages)


@query("doc8_metadata_rules", f"WITH {RULED}, e AS (SELECT unnest(rules) AS rule FROM ru) SELECT rule, count(*) AS n FROM e WHERE rule <> 'suspicious_keywords' GROUP BY 1")
def doc8(d: Data):
    from ..functions.exprs import hits
    ind = hits(*D.metadata_rules(*[F.col(c) for c in (
        "creator", "producer", "creation_date", "modification_date", "author", "is_encrypted")]))
    return d.docs.select(F.explode(hit_rules(ind)).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


_SPANS = "SELECT l_orderkey AS doc_id, 'font' || (l_partkey % (2 + l_orderkey % 5)) AS font, 8 + (l_suppkey % 9) / 4e0 AS size FROM {lineitem}"
_LPAGES = "SELECT l_orderkey AS doc_id, l_linenumber AS page, CAST(l_partkey % 9 AS INT) AS blocks, CASE WHEN l_suppkey % 2 = 0 THEN 842 ELSE 300 END AS height FROM {lineitem}"
define_input("spans", _SPANS)
define_input("layout_pages", _LPAGES)


@query("doc9_layout_rules", """WITH f AS (SELECT doc_id, count(DISTINCT font) AS fc, count(DISTINCT round_even(size, 1)) AS sc FROM {spans} GROUP BY 1),
  p AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (blocks < 3) AS sparse, count(*) FILTER (blocks < 3 AND height > 400) AS gaps FROM {layout_pages} GROUP BY 1)
  SELECT doc_id, fc AS font_count, sc AS font_size_count, pages, sparse AS sparse_pages, gaps AS spacing_pages,
  CASE WHEN fc > 3 THEN 15 ELSE 0 END + CASE WHEN sc > 5 THEN 10 ELSE 0 END + CASE WHEN sparse > 0 AND pages > 1 THEN 15 ELSE 0 END + CASE WHEN gaps > 0 THEN 10 ELSE 0 END AS layout_score,
  array_to_string(list_filter([CASE WHEN fc > 3 THEN 'font_anomaly 15 Four or more typefaces share one document.' END, CASE WHEN sc > 5 THEN 'font_size_anomaly 8 Six or more letter sizes share one document.' END,
    CASE WHEN sparse > 0 AND pages > 1 THEN 'sparse_text_layout 10 Some pages hold next to no blocks of text.' END, CASE WHEN gaps > 0 THEN 'suspicious_spacing 5 Some pages are mostly blank.' END], lambda x: x IS NOT NULL), '|') AS indicators
  FROM f FULL JOIN p USING (doc_id)""")
def doc9(d: Data):
    told = F.transform("indicators", lambda i: F.concat_ws(" ", i["rule"], i["score"].cast("string"), i["detail"]))
    return ops.layout(d.spans, d.layout_pages).withColumn("indicators", F.array_join(told, "|"))


@query("doc10_risk_score", f"WITH {RULED} SELECT doc_id, array_to_string(rules, '|') AS rules, risk_score, CASE WHEN risk_score <= 30 THEN 'CLEAN' WHEN risk_score <= 60 THEN 'SUSPICIOUS' ELSE 'HIGH' END AS risk_level, len(rules)::INT AS explanations FROM sc")
def doc10(d: Data):
    return ops.analyze(d.docs).select(
        "doc_id", F.array_join(hit_rules("indicators"), "|").alias("rules"), "risk_score", "risk_level",
        F.size("explanation").alias("explanations"))


@query("doc11_rule_plus_model", f"""WITH {RULED}, m AS (SELECT doc_id, risk_score, round_even((doc_id * 37 % 101) / 101.0::DOUBLE * 100, 0)::INT AS ml_score FROM sc), c AS (
  SELECT *, least(100, risk_score + ml_score)::INT AS combined_score FROM m)
  SELECT doc_id, ml_score, combined_score, CASE WHEN combined_score <= 30 THEN 'CLEAN' WHEN combined_score <= 60 THEN 'SUSPICIOUS' ELSE 'HIGH' END AS combined_level FROM c""")
def doc11(d: Data):
    scored = ops.analyze(d.docs).withColumn("probability", F.expr("(doc_id * 37 % 101) / 101e0"))
    return ops.combine_with_model(scored).select("doc_id", "ml_score", "combined_score", "combined_level")


@query("doc12_feature_vector", """SELECT l_orderkey AS doc_id, l_linenumber AS part, l_discount AS ela_mean, l_tax AS ela_std, l_quantity AS ela_max, l_discount * 2 AS ela_high_pixel_ratio,
  least(l_linenumber, 5)::DOUBLE AS metadata_anomaly_score, l_extendedprice / 1024 AS file_size_kb, l_linenumber::DOUBLE AS page_count, (l_partkey % 6)::DOUBLE AS font_count,
  (l_suppkey % 4)::DOUBLE AS image_count, CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE l_partkey % 30 END::DOUBLE AS raw_delta, (l_returnflag = 'R')::INT::DOUBLE AS has_javascript,
  (l_linestatus = 'O')::INT::DOUBLE AS has_encryption, 0.0::DOUBLE AS text_extraction_failed FROM {lineitem}""".replace("AS raw_delta", "AS creation_to_mod_delta_days").replace(
    "CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE l_partkey % 30 END", "CASE WHEN l_partkey % 3 = 0 OR l_partkey % 30 = 0 THEN -1 ELSE l_partkey % 30 END"))
def doc12(d: Data):
    c = {
        "ela_mean": "l_discount", "ela_std": "l_tax", "ela_max": "l_quantity", "hotspot_ratio": "l_discount * 2",
        "metadata_flags": "l_linenumber", "file_size": "l_extendedprice", "page_count": "l_linenumber",
        "font_count": "l_partkey % 6", "image_count": "l_suppkey % 4",
        "delta_days": "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 30 END", "has_javascript": "l_returnflag = 'R'",
        "is_encrypted": "l_linestatus = 'O'", "text_failed": "CAST(NULL AS BOOLEAN)"}
    feats = D.feature_columns({k: F.expr(v) for k, v in c.items()})
    return d.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("part"), *[v.alias(k) for k, v in feats.items()])


_BE = " OR ".join(f"contains({c}, '{s}')" for c in ("c", "p") for s in D.BASELINE_EDITORS)


@query("doc13_metadata_baseline", f"""SELECT score, label, count(*) AS n FROM (SELECT CASE WHEN {_BE} THEN 80 WHEN c = '' AND p = '' THEN 40 ELSE 10 END AS score,
  CASE WHEN {_BE} THEN 'HIGH' WHEN c = '' AND p = '' THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS label
  FROM (SELECT lower(coalesce(creator, '')) AS c, lower(coalesce(producer, '')) AS p FROM {{docs}})) GROUP BY ALL""")
def doc13(d: Data):
    s, lab = D.metadata_baseline(F.col("creator"), F.col("producer"), F.lit(None).cast("string"))
    return d.docs.select(s.alias("score"), lab.alias("label")).groupBy("score", "label").agg(F.count("*").alias("n"))


@query("doc14_filename_screen", """SELECT doc_id, CASE WHEN odd THEN 90 ELSE 15 END AS risk_score, CASE WHEN odd THEN 'HIGH' ELSE 'CLEAN' END AS risk_level
  FROM (SELECT doc_id, contains(lower(filename), 'invoice') OR contains(lower(filename), 'tampered') OR contains(lower(filename), 'edit') AS odd FROM {docs})""")
def doc14(d: Data):
    s, lab = D.filename_screen(F.col("filename"))
    return d.docs.select("doc_id", s.alias("risk_score"), lab.alias("risk_level"))
