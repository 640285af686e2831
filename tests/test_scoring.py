"""Literal cases of URL, receipt, document and fusion scoring."""

import pytest
from pyspark.sql import functions as F

from murkwatch.functions import documents as D
from murkwatch.functions import labels as LB
from murkwatch.functions import receipts as R
from murkwatch.functions import urls as U
from murkwatch.functions.exprs import hit_rules
from murkwatch.operators import fusion
from murkwatch.operators import urls as ops


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_lexical_features(spark):
    rows = [(0, "http://192.168.1.1/login"), (1, "http://paypal-secure.tk/login"), (2, "http://scam.tk/phish"), (3, ""), (4, None)]
    out = {r["i"]: r for r in ops.lexical(spark.createDataFrame(rows, "i int, url string")).collect()}
    assert len(U.LEXICAL_FEATURES) == 25
    assert out[0]["has_ip_address"] == 1 and out[1]["contains_brand_keyword"] == 1 and out[2]["tld_suspicious"] == 1
    assert all(out[i][f] == 0 for i in (3, 4) for f in U.LEXICAL_FEATURES)


@pytest.mark.parametrize("age,expected", [(2000, 0), (15, 20), (60, 15), (89, 15), (90, 0), (29, 20), (30, 15)])
def test_registration_age(spark, age, expected):
    got = one(spark, s=U.network_score(F.lit(True), F.lit(age), F.lit(False), F.lit(False)))
    assert got.s == expected


def test_network_caps_and_unknown_rules(spark):
    net = U.network_score(F.lit(True), F.lit(2000), F.lit(True), F.lit(True))
    rules = F.array(*[F.lit(r) for r in ("http_only", "ip_as_domain", "bank_name_typosquat", "homoglyph_attack")])
    got = one(spark, net=net, missing=U.network_score(F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean")),
              capped=U.url_rule_score(rules), total=U.url_risk_score(rules, net), unknown=U.url_rule_score(F.array(F.lit("zzz"))))
    assert (got.net, got.missing, got.capped, got.total, got.unknown) == (30, 5, 70, 100, 0)


def test_rules_on_known_urls(spark):
    urls = ["https://www.hdfcbank.com/login", "http://hdfcb4nk-login.tk/verify", "", "https://pnb.tk/x", "https://а.example/%E0%A4%A"]
    rows = ops.analyze(spark.createDataFrame(list(enumerate(urls)), "i int, url string"))
    got = {r.i: r.rules for r in rows.select("i", hit_rules("triggered_rules").alias("rules")).collect()}
    assert got[0] == []
    assert {"http_only", "bank_name_typosquat", "suspicious_keywords", "suspicious_tld"} <= set(got[1])
    assert got[2] == ["empty_url"]
    assert "homoglyph_attack" in got[3]  # exact brand on a foreign domain
    assert isinstance(got[4], list)  # malformed escapes still score


def test_punycode(spark):
    df = spark.createDataFrame([(0, "https://аpple.com/x"), (1, "https://plain.com")], "i int, url string")
    out = {r.i: r for r in ops.analyze(ops.punycode_hosts(df), ascii_host="ascii_host").collect()}
    assert out[0].domain.startswith("xn--") and out[1].ascii_host is None
    assert "punycode_domain" in [h.rule for h in out[0].triggered_rules]


def test_fetch_guard(spark):
    urls = ["http://10.1.2.3/", "http://[::1]/", "http://8.8.8.8", "ftp://x", "http://a.b", "", "http://u@172.16.0.9:80/x", "http://[2001:db8::1]/", "http://[0:0:0:0:0:0:0:1]/", "http://[fe80:0::1%25eth0]/"]
    got = [r.fetch_class for r in ops.fetch_guard(spark.createDataFrame(list(enumerate(urls)), "i int, url string")).orderBy("i").collect()]
    assert got == ["blocked_address", "blocked_address", "allowed", "scheme_not_allowed", "needs_resolution", "empty", "blocked_address", "allowed", "blocked_address", "blocked_address"]


@pytest.mark.parametrize("ref,fmt,valid", [
    ("312345678901", "phonepe_numeric_12", True), ("ABC123XYZ", "invalid", False), ("T1234567890", "paytm_t_prefix", True),
    ("AB12345678", "gpay_alphanumeric", True), ("1234567890", "generic", True), ("", "invalid", False)])
def test_references(spark, ref, fmt, valid):
    got = one(spark, c=R.classify_utr(R.normalize_utr(F.lit(ref)))).c
    assert (got.format, got.valid) == (fmt, valid)


def test_receipt_text(spark):
    text = "From a@ybl\nPaid to shop@okaxis ₹1,200.50 UTR: 312345678901 T12345678901"
    t = F.lit(text)
    got = one(spark, c=R.utr_candidates(t), a=R.parse_amount(t), v=R.handles(t), p=R.select_payee(t, R.handles(t)), g=R.is_receipt(t),
              none=R.parse_amount(F.lit("no money here")))
    assert got.c == ["312345678901", "T12345678901"]
    assert (got.a, got.v, got.p, got.g, got.none) == (1200.5, ["a@ybl", "shop@okaxis"], "shop@okaxis", True, None)


def test_app_ties_and_palette(spark):
    app, conf = R.pick_app(R.app_points(F.lit("paytm gpay"), F.array(F.lit("#5f259f"))))
    unknown, low = R.pick_app(R.app_points(F.lit("hello")))
    any_d, first_d = R.palette_distance(F.array(F.struct(F.lit(95).alias("r"), F.lit(37).alias("g"), F.lit(159).alias("b"))), F.lit("PhonePe"))
    got = one(spark, app=app, conf=conf, unknown=unknown, low=low, d=any_d, f=first_d)
    assert (got.app, got.unknown, got.low, got.d, got.f) == ("PhonePe", "Unknown", 0.2, 0.0, 0.0)


def test_phrases(spark):
    t = F.lit("KYC update: Verify, verify and VERIFY your gift card. Urgently!")
    got = one(spark, p=D.distinct_phrases(D.phrase_matches(t)), h=D.type_hint(F.lit("Tax Invoice")))
    assert got.p == ["KYC", "Verify", "gift card", "Urgently"] and got.h == "invoice"


def test_fusion_partial_and_empty(spark):
    rows = [(1, 80.0, None, None), (2, None, None, None), (3, 100.0, 50.0, 0.0), (4, 40.0, 40.0, 0.0)]
    out = {r.case_id: r for r in fusion.fuse(spark.createDataFrame(rows, "case_id int, document double, phishing double, upi double")).collect()}
    assert (out[1].unified_score, out[1].document_weight, out[1].risk_level) == (80, 1.0, "HIGH")
    assert (out[2].unified_score, out[2].risk_level, out[2].dominant_signal) == (0, "CLEAN", None)
    assert out[3].unified_score == 52  # 52.5 rounds to even
    assert out[4].dominant_signal == "document"


def test_labels(spark):
    got = one(spark, a=LB.strict_label(F.lit(" Fraudulent ")), b=LB.strict_label(F.lit("?")), c=LB.consensus_label(F.lit("likely phish")),
              d=LB.consensus_label(F.lit(None).cast("string")), e=LB.binary_label(F.lit("no")), f=LB.url_list_label(F.lit("Warn")))
    assert tuple(got) == ("HIGH", None, "HIGH", "UNKNOWN", "CLEAN", "SUSPICIOUS")
