"""Redaction, leak scan, adapters and stores."""

import hashlib

import pytest
from pyspark.sql import functions as F

from murkwatch.functions import labels as LB
from murkwatch.functions import privacy as P
from murkwatch.operators import quality
from murkwatch.sources import datasets, stores


def h(v):
    return hashlib.sha256((v + P.SALT).encode()).hexdigest()[:16]


def test_redaction_tokens(spark):
    text = "Mail Jo.E@corp.com or a.jo.e@corp.com, UTR 312345678901, call 987-654-3210, pay shop@okaxis Rs. 500 https://pay.example.com/r?id=1"
    df = spark.createDataFrame([(1, text), (2, None)], "i int, t string")
    out = {r.i: r.t for r in quality.anonymize(df, "t").collect()}
    for part in (f"<EMAIL_HASH:{h('jo.e@corp.com')}>", f"<EMAIL_HASH:{h('a.jo.e@corp.com')}>", f"<UTR_HASH:{h('312345678901')}>",
                 f"<PHONE_HASH:{h('9876543210')}>", f"<UPI_ID_HASH:{h('shop@okaxis')}>", "<AMOUNT>",
                 f"https://pay.example.com/<PATH_HASH:{h('https://pay.example.com/r?id=1')}>"):
        assert part in out[1]
    assert out[2] == ""
    whole = spark.range(1).select(P.redact_urls(F.lit("see https://x.com"), True), P.redact_urls(F.lit("see https://x.com"), False)).first()
    assert whole[0] == "see https://x.com" and whole[1] == f"see <URL_HASH:{h('https://x.com')}>"


def test_nested_metadata_scan(spark):
    js = '{"a": {"b": ["x", "me@corp.com"]}, "deep": {"l": {"l": {"l": {"l": "shop@okaxis"}}}}, "n": 5}'
    df = spark.createDataFrame([("r1", js)], "id string, meta string")
    got = {(r.code, r.field) for r in quality.leak_issues(quality.flatten_json(df, "id", "meta")).collect()}
    assert ("LEAK_EMAIL", "metadata.a.b[1]") in got
    assert any(code == "LEAK_UPI_ID" and field.startswith("metadata.deep") for code, field in got)


def test_nested_metadata_redaction(spark):
    import json

    deep = {"k": "a@corp.com"}
    for _ in range(30):
        deep = {"in": [deep, "é \\ \"x\" a@corp.com: b"]}
    values = [{"mail@x.com": "a@corp.com", "n": 5, "t": True, "z": None, "list": ["987654321012", ["x"], {}]}, deep, "a@corp.com", [], 7]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(10, "not json a@corp.com"), (11, None), (12, ""), (13, "{ \"a\" : \"a@corp.com\" , \"b\":\"x:y\"}")]
    df = spark.createDataFrame(rows, "id int, j string")
    got = {r.id: r.j for r in df.select("id", quality.anonymize_json(F.col("j")).alias("j")).collect()}

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return v.replace("a@corp.com", tag).replace("987654321012", utr) if isinstance(v, str) else v

    tag, utr = spark.range(1).select(P.redact_emails(F.lit("a@corp.com")), P.redact_utrs(F.lit("987654321012"))).first()
    assert all(json.loads(got[k]) == plain(v) for k, v in enumerate(values))
    assert got[10] == f"not json {tag}" and got[11] is None and got[12] == "" and json.loads(got[13]) == {"a": tag, "b": "x:y"}


def test_json_is_flattened_in_one_narrow_pass(spark):
    deep = "[" * 60 + '"x"' + "]" * 60
    rows = [(1, '{"b":[1,"t\\u00e9 \\"q\\"",{"k.l":"","n":null}],"a":true}'), (2, '"alone"'), (3, None), (4, "null"), (5, deep), (6, '[%s,"%s"]' % ("9" * 30, "w" * 9))]
    out = quality.flatten_json(spark.createDataFrame(rows, "id int, meta string"), "id", "meta")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan" not in plan
    got = sorted(map(tuple, out.collect()))
    assert got == sorted([(1, "metadata.b[1]", 't\u00e9 "q"'), (1, "metadata.b[2].k.l", ""), (2, "metadata", "alone"), (5, "metadata" + "[0]" * 60, "x"), (6, "metadata[1]", "w" * 9)])
    with pytest.raises(Exception, match="MALFORMED"):
        quality.flatten_json(spark.createDataFrame([(1, "{")], "id int, meta string"), "id", "meta").collect()


def test_user_paths(spark):
    df = spark.createDataFrame([("1", "f", "/home/alice/x"), ("2", "f", "C:\\Users\\Public\\x"), ("3", "f", "c:\\users\\bob\\x")], "record_id string, field string, text string")
    assert {r.record_id for r in quality.leak_issues(df).where("code = 'LEAK_USERNAME'").collect()} == {"1", "3"}


def test_duplicates_under_skew(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), F.concat(F.lit("r"), F.col("id")).alias("id"), F.when(
        F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("v"))
    out = quality.duplicate_issues(df, "v", "DUPLICATE_VALUE", "warning")
    assert out.count() == 333 and {r.first_record for r in out.select("first_record").distinct().collect()} == {"r0"}


def test_csv_and_encoding(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("url,label,note\nhttps://a.com/x?u=1,phish?,n\nhttps://b.com,Safe,\"mail me@corp.com\"\n")
    ok, bad = datasets.ingest_csv(spark, str(p), "URL", value="url")
    r = ok.first()
    assert ok.count() == 1 and bad.count() == 1 and r.label == "CLEAN" and r.metadata["note"].startswith("mail <EMAIL_HASH")
    assert r.id == "rec_url_" + hashlib.sha256(b"https://b.com").hexdigest()[:12]
    d = tmp_path / "enc"
    d.mkdir()
    (d / "u.txt").write_bytes("née\nabc\n".encode())
    (d / "l.txt").write_bytes("née\n".encode("latin-1"))
    assert sorted(x.line for x in datasets.read_lines_any_encoding(spark, str(d)).collect()) == ["abc", "née", "née"]


def test_directories(spark, tmp_path):
    for f in ("clean/a.pdf", "odd/b.png", "genuine/c.png", "forged_x/d.jpg", "forged/e.tiff"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    name = lambda df: {r.metadata["filename"]: r for r in df.collect()}
    got = name(datasets.ingest_directory(spark, str(tmp_path)))
    assert got["a.pdf"].label == "CLEAN" and got["b.png"].label == "SUSPICIOUS" and not got["b.png"].label_inferred
    labels = spark.createDataFrame([("b.png", "forged", "pay a@ybl")], "file_name string, label string, ocr_text string")
    rec = name(datasets.receipt_directory(spark, str(tmp_path), labels))
    assert (rec["c.png"].label, rec["d.jpg"].label, rec["b.png"].label) == ("CLEAN", "HIGH", "HIGH")
    assert "<UPI_ID_HASH" in rec["b.png"].metadata["ocr_text"]
    doc = name(datasets.forensic_directory(spark, str(tmp_path)))
    assert doc["e.tiff"].label == "HIGH" and doc["a.pdf"].label == "CLEAN"


def test_receipt_labels_and_partitioned_folders(spark, tmp_path):
    (tmp_path / "folder=genuine").mkdir()
    for name in ("a.png", "b.png", "c.txt"):
        (tmp_path / "folder=genuine" / name).write_bytes(b"x")
    labels = spark.createDataFrame([("a.png", "odd", "call 987-654-3210"), ("a.png", "forged", "zz"), ("c.txt", "forged", "z")],
                                   "file_name string, label string, note string")
    got = {r.metadata["filename"]: r for r in datasets.receipt_directory(spark, str(tmp_path), labels).collect()}
    assert set(got) == {"a.png", "b.png"} and got["b.png"].label == "CLEAN" and "note" not in got["b.png"].metadata
    assert got["a.png"].label == "HIGH" and got["a.png"].metadata["note"] == "zz"  # the least of two rows


def test_arff_header_is_read_from_the_head(spark, tmp_path):
    (tmp_path / "a.arff").write_text("% c\n@relation r\n@ATTRIBUTE 'Two Words' {1,0}\n@attribute Result {-1,1}\n\n@data\n1,-1\n% x,y\n'0', 1\n")
    (tmp_path / "b.arff").write_text("1, 1\n")
    assert datasets.arff_names(spark, str(tmp_path)) == ["Two Words", "Result"]
    rows = datasets.parse_arff(spark, str(tmp_path)).collect()
    assert sorted((r["two words"], r.result, r.label) for r in rows) == [("0", "1", 0), ("1", "-1", 1), ("1", "1", 0)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.arff").write_text("1,2\n")
    with pytest.raises(ValueError):
        datasets.parse_arff(spark, str(tmp_path / "none"))


def test_event_store(spark, tmp_path):
    row = spark.sql("SELECT 'd1' AS doc_id, 45 AS risk_score, TIMESTAMP '2024-01-01 00:00:00' AS created_at")
    stores.append_events(row, str(tmp_path / "s"))
    stores.append_events(row, str(tmp_path / "s"))
    found = stores.find_by_document(stores.read_events(spark, str(tmp_path / "s")), "d1")
    assert found.count() == 2 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,d1)]" in found._jdf.queryExecution().toString()


def test_map_anonymize(spark):
    df = spark.range(1).select(F.create_map(F.lit("k"), F.lit("shop@okaxis")).alias("m"))
    assert quality.anonymize_map(df, "m").first().m["k"].startswith("<UPI_ID_HASH")
    assert spark.range(1).select(LB.anonymize(F.lit(None).cast("string"))).first()[0] == ""
