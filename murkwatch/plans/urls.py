"""URL queries."""

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.exprs import hit_rules, pin, strip
from ..operators import urls as ops
from . import inputs  # noqa: F401
from .registry import Data, query, sql_array

# ---- SQL twins: shared text ---------------------------------------------------

NORM = r"""norm AS (
  SELECT url_id, url, s, CASE WHEN s = '' THEN '' WHEN regexp_matches(s, '^https?://') THEN s ELSE 'https://' || s END AS n
  FROM (SELECT url_id, url, regexp_replace(coalesce(url, ''), '^\s+|\s+$', '', 'g') AS s FROM {urls}))"""

PARSED = NORM + r""", parsed AS (
  SELECT *, regexp_extract(n, '^https?://([^/?#]*)', 1) AS loc,
    regexp_replace(regexp_extract(n, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
    regexp_extract(n, '^https?://[^?#]*\?([^#]*)', 1) AS qry
  FROM norm), dom AS (
  SELECT *, CASE WHEN n = '' THEN '' ELSE regexp_replace(trim(lower(split_part(CASE WHEN loc <> '' THEN loc ELSE path END, ':', 1))), '^www\.', '') END AS domain
  FROM parsed), labels_ AS (
  SELECT *, string_split(domain, '.') AS parts,
    regexp_matches(domain, '^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$') AS is_ip,
    domain IN %(off)s OR len(list_filter(%(off_l)s, lambda d: ends_with(domain, '.' || d))) > 0 AS official
  FROM dom), roots AS (
  SELECT *, CASE WHEN is_ip THEN domain ELSE regexp_replace(CASE WHEN len(parts) <= 2 THEN parts[1] ELSE array_to_string(parts[1:len(parts) - 1], '') END, '[^a-z0-9]', '', 'g') END AS root
  FROM labels_), folded AS (SELECT *, translate(root, '0134568@', 'oleasbba') AS fold FROM roots)""" % {
    "off": "(" + ", ".join(f"'{d}'" for d in U.OFFICIAL_DOMAINS) + ")", "off_l": sql_array(U.OFFICIAL_DOMAINS)}

MATCHES = PARSED + r""", pairs AS (
  SELECT url_id, b.bank, b.pos, CASE
      WHEN root = '' OR official THEN NULL
      WHEN (contains(root, b.bank) AND root <> b.bank) OR (contains(fold, b.bank) AND fold <> b.bank) THEN 0.95::DOUBLE
      WHEN root <> b.bank THEN round_even(1 - levenshtein(root, b.bank)::DOUBLE / greatest(length(root), length(b.bank)), 4) END AS sim
  FROM folded, (SELECT unnest(%s) AS bank, generate_subscripts(%s, 1) AS pos) b), matches AS (
  SELECT url_id, array_agg(bank ORDER BY sim DESC, pos) AS banks, array_agg(sim ORDER BY sim DESC, pos) AS sims
  FROM pairs WHERE sim >= 0.55 GROUP BY url_id)""" % (sql_array(U.BRANDS), sql_array(U.BRANDS))

RULES = MATCHES + r""", facts AS (
  SELECT f.*, m.banks, m.sims, coalesce(len(m.banks), 0) > 0 AS typo,
    domain || '/' || lower(url_decode(path || CASE WHEN qry <> '' THEN '?' || qry ELSE '' END)) AS full_text,
    greatest(0, len(parts) - 2) AS subs, length(domain) - length(replace(domain, '-', '')) AS hyphens,
    list_filter(%(brands)s, lambda b: contains(fold, b)) AS fold_brands
  FROM folded f LEFT JOIN matches m USING (url_id)), kw AS (
  SELECT *, CASE WHEN n = '' THEN [] ELSE list_filter(%(kws)s, lambda k: contains(full_text, k)) END AS keywords FROM facts), ruled AS (
  SELECT *, CASE WHEN n = '' THEN ['empty_url'] ELSE list_filter([
    CASE WHEN starts_with(n, 'http://') THEN 'http_only' END, CASE WHEN is_ip THEN 'ip_as_domain' END,
    CASE WHEN typo THEN 'bank_name_typosquat' END, CASE WHEN len(keywords) > 0 AND NOT official THEN 'suspicious_keywords' END,
    CASE WHEN subs > 3 AND NOT official THEN 'excessive_subdomains' END, CASE WHEN contains(domain, 'xn--') THEN 'punycode_domain' END,
    CASE WHEN length(domain) > 45 AND NOT official THEN 'long_domain' END, CASE WHEN hyphens >= 3 AND NOT official THEN 'many_hyphens' END,
    CASE WHEN '.' || parts[-1] IN ('.zip', '.click', '.top', '.xyz', '.tk', '.ml', '.ga', '.cf') AND NOT official THEN 'suspicious_tld' END,
    CASE WHEN len(fold_brands) > 0 AND NOT official AND NOT typo THEN 'homoglyph_attack' END], lambda r: r IS NOT NULL) END AS rules
  FROM kw), scored AS (
  SELECT *, least(70, coalesce(list_sum(list_transform(rules, lambda r: CASE r WHEN 'http_only' THEN 20 WHEN 'ip_as_domain' THEN 30
    WHEN 'bank_name_typosquat' THEN 35 WHEN 'suspicious_keywords' THEN 20 WHEN 'excessive_subdomains' THEN 15 WHEN 'punycode_domain' THEN 20
    WHEN 'long_domain' THEN 10 WHEN 'many_hyphens' THEN 15 WHEN 'suspicious_tld' THEN 15 WHEN 'homoglyph_attack' THEN 30 ELSE 0 END)), 0))::INT AS rule_score
  FROM ruled)""" % {"brands": sql_array(U.BRANDS), "kws": sql_array(U.RULE_KEYWORDS)}

# Rule scores without a registration snapshot: every row carries the 5-point surcharge.
SCORED = RULES + r""", final AS (
  SELECT *, least(100, rule_score + 5)::INT AS risk_score,
    CASE WHEN rule_score + 5 <= 30 THEN 'CLEAN' WHEN rule_score + 5 <= 60 THEN 'SUSPICIOUS' ELSE 'HIGH' END AS risk_level FROM scored)"""

LEX = NORM + r""", lex AS (
  SELECT url_id, s, CASE WHEN regexp_matches(s, '^https?://') THEN s ELSE 'http://' || s END AS f FROM norm), cut AS (
  SELECT *, regexp_replace(regexp_extract(f, '^https?://([^/?#]*)', 1), '^.*@', '') AS hp,
    regexp_replace(regexp_extract(f, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
    regexp_extract(f, '^https?://[^?#]*\?([^#]*)', 1) AS qry FROM lex), host AS (
  SELECT *, lower(CASE WHEN hp LIKE '[%' THEN regexp_extract(hp, '^\[([^\]]*)\]', 1) ELSE split_part(hp, ':', 1) END) AS host FROM cut)"""


def _cnt(col: str, ch: str) -> str:
    return f"(length({col}) - length(replace({col}, '{ch}', '')))"


def _has(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_LEX_EXPR = {
    "url_length": "length(s)", "num_dots": _cnt("s", "."), "num_hyphens": _cnt("s", "-"),
    "num_underscores": _cnt("s", "_"), "num_slashes": _cnt("s", "/"), "num_at_signs": _cnt("s", "@"),
    "num_digits": r"length(regexp_replace(s, '\D', '', 'g'))",
    "digit_ratio": r"length(regexp_replace(s, '\D', '', 'g')) / greatest(length(s), 1)::DOUBLE",
    "has_ip_address": r"regexp_matches(host, '^(\d{1,3}\.){3}\d{1,3}$') OR (contains(host, ':') AND regexp_matches(host, '^[0-9a-fA-F:]*$'))",
    "subdomain_depth": _cnt("host", "."), "path_depth": f"greatest(0, {_cnt('path', '/')} - 1)",
    "tld_suspicious": "contains(host, '.') AND split_part(host, '.', -1) IN ('tk', 'ml', 'ga', 'cf', 'gq')",
    "has_https": "starts_with(lower(s), 'https')", "domain_length": "length(host)", "path_length": "length(path)",
    "query_length": "length(qry)", "num_params": _cnt("qry", "&"),
    "has_port": r"regexp_matches(hp, '^(\[[^\]]*\]|[^:\[]*):\d+$')",
    "url_entropy": "ent", "char_ratio_upper": r"length(regexp_replace(s, '\P{Lu}', '', 'g')) / greatest(length(s), 1)::DOUBLE",
    "num_special_chars": "length(regexp_replace(s, '[^%=&+@#]', '', 'g'))",
    "hostname_digit_ratio": r"length(regexp_replace(host, '\D', '', 'g')) / greatest(length(host), 1)::DOUBLE",
    "contains_brand_keyword": _has("lower(s)", U.LEXICAL_BRANDS), "contains_free_keyword": _has("lower(s)", U.LEXICAL_FREE),
    "longest_consecutive_consonants":
        "coalesce(list_max(list_transform(regexp_extract_all(lower(s), '[b-df-hj-np-tv-z]+'), lambda r: length(r))), 0)",
}
_ENTROPY = """, chars AS (SELECT url_id, length(s) AS n, unnest(string_split(s, '')) AS ch FROM norm WHERE s <> ''),
  freq AS (SELECT url_id, n, ch, count(*) AS c FROM chars GROUP BY ALL),
  ents AS (SELECT url_id, -sum(c / n::DOUBLE * log2(c / n::DOUBLE)) AS ent FROM freq GROUP BY url_id)"""


def lexical_select() -> str:
    cols = ", ".join(
        f"round(CASE WHEN s = '' THEN 0.0::DOUBLE ELSE ({e})::DOUBLE END, 9) AS {n}" for n, e in _LEX_EXPR.items())
    return f"WITH {LEX}{_ENTROPY} SELECT h.url_id, {cols} FROM host h LEFT JOIN ents USING (url_id)"


# ---- queries -----------------------------------------------------------------------

def _scored(d: Data):
    return ops.score(ops.analyze(d.urls))


@query("url1_lexical_features", lexical_select())
def url1(d: Data):
    return ops.lexical(d.urls).select("url_id", *[
        F.round(n, 9).alias(n) if "ratio" in n or "entropy" in n else n for n in U.LEXICAL_FEATURES])


@query("url2_entropy", f"WITH {NORM}{_ENTROPY} SELECT norm.url_id, round(coalesce(ent, 0.0), 9) AS entropy FROM norm LEFT JOIN ents USING (url_id)")
def url2(d: Data):
    text = pin(d.urls, {"s": strip(F.col("url"))})
    return text.select("url_id", F.round(U.entropy(F.col("s")), 9).alias("entropy"))


@query("url3_consonant_run", f"WITH {LEX} SELECT url_id, {_LEX_EXPR['longest_consecutive_consonants']} AS run FROM host")
def url3(d: Data):
    return d.urls.select("url_id", U.longest_consonant_run(strip(F.col("url"))).cast("bigint").alias("run"))


@query("url4_ip_tests", f"WITH {PARSED} SELECT url_id, domain, is_ip AS strict_ip, {_LEX_EXPR['has_ip_address'].replace('host', 'domain')} AS loose_ip FROM labels_")
def url4(d: Data):
    dom = ops.domains(d.urls).select("url_id", "domain")
    return dom.withColumns({"strict_ip": U.is_ipv4_strict(F.col("domain")), "loose_ip": U.is_ip_loose(F.col("domain"))})


@query("url5_normalize", f"WITH {NORM} SELECT url_id, n AS normalized_url FROM norm")
def url5(d: Data):
    return d.urls.select("url_id", U.normalize_url(F.col("url")).alias("normalized_url"))


@query("url6_punycode_hosts")
def url6(d: Data):
    # The crawl's hosts are ASCII; accented words of the page titles make the non-ASCII ones.
    word = F.regexp_extract("html", r"<title>\P{L}*(\p{L}+)", 1)
    urls = d.pages.select("page_id", F.concat(F.lit("https://"), F.lower(word), F.lit(".example.com/a")).alias("url"))
    return ops.punycode_hosts(urls)


@query("url7_domain", f"WITH {PARSED} SELECT url_id, domain FROM dom")
def url7(d: Data):
    return _domains(d)


def _domains(d: Data):
    return ops.domains(d.urls).select("url_id", "domain")


@query("url8_domain_root", f"WITH {PARSED} SELECT url_id, root FROM roots")
def url8(d: Data):
    return _domains(d).select("url_id", U.domain_root(F.col("domain")).alias("root"))


@query("url9_subdomains_tld", f"WITH {PARSED} SELECT url_id, greatest(0, len(parts) - 2) AS subdomains, '.' || parts[-1] AS tld FROM labels_")
def url9(d: Data):
    return _domains(d).select(
        "url_id", U.subdomain_count(F.col("domain")).cast("bigint").alias("subdomains"), U.tld(F.col("domain")).alias("tld"))


@query("url10_homoglyph_fold", f"WITH {PARSED} SELECT url_id, fold AS folded FROM folded")
def url10(d: Data):
    return _domains(d).select("url_id", U.fold_homoglyphs(U.domain_root(F.col("domain"))).alias("folded"))


@query("url11_official_domain", f"WITH {PARSED} SELECT official, count(*) AS n, count(DISTINCT domain) AS domains FROM labels_ GROUP BY official")
def url11(d: Data):
    return _domains(d).withColumn("official", U.is_official(F.col("domain"))).groupBy("official").agg(
        F.count("*").alias("n"), F.countDistinct("domain").alias("domains"))


@query("url12_brand_lookalikes", f"WITH {MATCHES} SELECT url_id, array_to_string(banks, '|') AS banks, sims[1] AS best_similarity FROM matches")
def url12(d: Data):
    out = ops.analyze(d.urls).where(F.size("domain_matches") > 0)
    return out.select(
        "url_id", F.array_join(F.transform("domain_matches", lambda m: m["bank"]), "|").alias("banks"),
        F.get("domain_matches", 0)["similarity"].alias("best_similarity"))


@query("url13_rule_hits", f"""WITH {RULES} SELECT url_id, domain, array_to_string(rules, '|') AS rules,
  array_to_string(keywords, '|') AS keywords, official AS is_official_bank_domain FROM ruled""")
def url13(d: Data):
    return ops.analyze(d.urls).select(
        "url_id", "domain", F.array_join(hit_rules("triggered_rules"), "|").alias("rules"),
        F.array_join("top_keywords", "|").alias("keywords"), "is_official_bank_domain")


@query("url14_risk_score", f"""WITH {SCORED} SELECT risk_level, count(*) AS n, sum(risk_score)::BIGINT AS total_score,
  max(risk_score) AS max_score FROM final GROUP BY risk_level""")
def url14(d: Data):
    return _scored(d).groupBy("risk_level").agg(
        F.count("*").alias("n"), F.sum("risk_score").alias("total_score"), F.max("risk_score").alias("max_score"))


@query("url15_registration_join", f"""WITH {RULES} SELECT url_id, r.domain IS NOT NULL AS registered,
  date_diff('day', r.created_on, DATE '2024-02-01')::INT AS age_days, date_diff('day', r.created_on, DATE '2024-02-01') < 90 AS is_recently_registered,
  r.cert_valid_to < DATE '2024-02-01' AS is_expired,
  least(100, rule_score + least(30, CASE WHEN r.domain IS NULL THEN 5 WHEN date_diff('day', r.created_on, DATE '2024-02-01') < 30 THEN 20
    WHEN date_diff('day', r.created_on, DATE '2024-02-01') < 90 THEN 15 ELSE 0 END
    + CASE WHEN r.self_signed THEN 25 ELSE 0 END + CASE WHEN r.cert_valid_to < DATE '2024-02-01' THEN 10 ELSE 0 END))::INT AS risk_score
  FROM scored s LEFT JOIN {{registrations}} r ON s.domain = r.domain""".replace("{{", "{").replace("}}", "}"))
def url15(d: Data):
    as_of = F.to_date(F.lit("2024-02-01"))
    rich = ops.enrich_registration(ops.analyze(d.urls), d.registrations, as_of)
    out = ops.score(rich, F.col("registered"), F.col("age_days"), F.col("self_signed"), F.col("is_expired"))
    return out.select("url_id", "registered", "age_days", "is_recently_registered", "is_expired", "risk_score")


@query("url16_batch_screening", f"""WITH {SCORED} SELECT url_id, n AS normalized_url, domain, risk_score, risk_level,
  CASE WHEN n = '' THEN 'Nothing to check.' END AS error FROM final""")
def url16(d: Data):
    return _scored(d).select(
        "url_id", "normalized_url", "domain", "risk_score", "risk_level",
        F.when(F.col("normalized_url") == "", "Nothing to check.").alias("error"))


@query("url17_keyword_baseline", f"""SELECT url_id, CASE WHEN k >= 2 THEN 85 WHEN k = 1 THEN 50 ELSE 10 END AS score,
  CASE WHEN k >= 2 THEN 'HIGH' WHEN k = 1 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS label
  FROM (SELECT url_id, len(list_filter({sql_array(U.BASELINE_KEYWORDS)}, lambda w: contains(lower(url), w))) AS k FROM {{urls}})""")
def url17(d: Data):
    s, lab = U.keyword_baseline(F.col("url"))
    return d.urls.select("url_id", s.alias("score"), lab.alias("label"))


@query("url18_length_baseline", """SELECT url_id, CASE WHEN k > 30 THEN 75 WHEN k > 20 THEN 45 ELSE 5 END AS score,
  CASE WHEN k > 30 THEN 'HIGH' WHEN k > 20 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS label
  FROM (SELECT url_id, length(split_part(regexp_replace(url, '^https?://', ''), '/', 1)) AS k FROM {urls})""")
def url18(d: Data):
    s, lab = U.length_baseline(F.col("url"))
    return d.urls.select("url_id", s.alias("score"), lab.alias("label"))


@query("url19_action", f"""WITH {SCORED} SELECT risk_score, CASE WHEN risk_score > 60 THEN 'Block' WHEN risk_score > 30 THEN 'Review' ELSE 'Allow' END AS action,
  CASE WHEN risk_score > 30 AND risk_score <= 60 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, count(*) AS n FROM final GROUP BY ALL""")
def url19(d: Data):
    return _scored(d).groupBy("risk_score", "action", "confidence").agg(F.count("*").alias("n"))


@query("url20_payment_uri", r"""SELECT id, pa, pn, am, cu, coalesce(contains(pa, 'scam') OR contains(pa, 'free') OR contains(pa, 'gift'), false) AS suspicious,
  CASE WHEN coalesce(contains(pa, 'scam') OR contains(pa, 'free') OR contains(pa, 'gift'), false) THEN 85 ELSE 10 END AS risk_score
  FROM (SELECT id, nullif(regexp_extract(u, 'pa=([^&]+)', 1), '') AS pa, nullif(regexp_extract(u, 'pn=([^&]+)', 1), '') AS pn,
    nullif(regexp_extract(u, 'am=([^&]+)', 1), '') AS am, nullif(regexp_extract(u, 'cu=([^&]+)', 1), '') AS cu
    FROM (SELECT id, CASE WHEN contains(uri, 'upi://pay') THEN uri ELSE '' END AS u FROM (
      SELECT id, CASE indicator_type WHEN 'upi_handle' THEN 'upi://pay?pa=' || value || '&pn=Shop&am=' || id || '.00' WHEN 'domain' THEN 'upi://pay?pn=X&cu=INR' ELSE value END AS uri FROM {alerts})))""")
def url20(d: Data):
    uris = d.alerts.select("id", F.expr(
        "CASE indicator_type WHEN 'upi_handle' THEN 'upi://pay?pa=' || value || '&pn=Shop&am=' || id || '.00' "
        "WHEN 'domain' THEN 'upi://pay?pn=X&cu=INR' ELSE value END").alias("uri"))
    out = uris.select("id", *[U.payment_uri_field(F.col("uri"), k).alias(k) for k in ("pa", "pn", "am", "cu")])
    out = out.withColumn("suspicious", U.payment_uri_suspicious(F.col("pa")))
    return out.withColumn("risk_score", F.when(F.col("suspicious"), 85).otherwise(10))


@query("url21_reconstruct_url", r"""SELECT id, CASE WHEN ssl = -1 THEN 'http' ELSE 'https' END || '://' || CASE WHEN at_ = 1 THEN 'support:admin@' ELSE '' END
  || CASE WHEN ip = 1 THEN '192.168.1.104' WHEN res = -1 THEN CASE WHEN ht = 1 THEN 'https-' ELSE '' END || CASE WHEN pre = 1 THEN 'secure-login-paypal' ELSE 'paypal-update-account' END || '.tk'
     ELSE CASE WHEN sub = 1 THEN 'accounts.google.com' ELSE 'microsoft.com' END END
  || CASE WHEN port = 1 THEN ':8080' ELSE '' END || '/' || CASE WHEN len = 1 THEN 'webapps/auth/login/verify/credentials/update/account/status/active' WHEN len = 0 THEN 'login/verify' ELSE 'auth' END AS url,
  CASE WHEN res = -1 THEN 1 ELSE 0 END AS label
  FROM (SELECT o_orderkey AS id, o_orderkey % 3 - 1 AS ssl, o_custkey % 3 - 1 AS at_, o_orderkey % 5 - 1 AS ip, CASE o_orderkey % 2 WHEN 0 THEN -1 ELSE 1 END AS res,
    o_custkey % 2 AS ht, o_orderkey % 7 % 3 - 1 AS pre, o_custkey % 4 - 1 AS sub, o_custkey % 5 - 1 AS port, o_orderkey % 11 % 3 - 1 AS len FROM {orders})""")
def url21(d: Data):
    coded = d.orders.selectExpr(
        "o_orderkey AS id", "o_orderkey % 3 - 1 AS sslfinal_state", "o_custkey % 3 - 1 AS having_at_symbol",
        "o_orderkey % 5 - 1 AS having_ip_address", "CASE o_orderkey % 2 WHEN 0 THEN -1 ELSE 1 END AS result",
        "o_custkey % 2 AS https_token", "o_orderkey % 7 % 3 - 1 AS prefix_suffix", "o_custkey % 4 - 1 AS having_sub_domain",
        "o_custkey % 5 - 1 AS port", "o_orderkey % 11 % 3 - 1 AS url_length")
    return ops.reconstruct(coded).select("id", "url", "label")


@query("fil6_store_gate", f"""WITH {SCORED} SELECT url_id, domain AS source_domain, risk_score,
  array_to_string(list_concat(list_concat([domain], keywords), rules), ' ') AS fingerprint_text FROM final WHERE risk_score >= 31""")
def fil6(d: Data):
    return ops.fingerprints(_scored(d)).select("url_id", "source_domain", "risk_score", "fingerprint_text")


@query("fil7_fetch_guard", NORM.replace("norm AS", "WITH norm AS") + r""", h AS (
  SELECT url_id, coalesce(url, '') AS u, regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', '') AS hp FROM norm), g AS (
  SELECT *, lower(split_part(hp, ':', 1)) AS host, regexp_matches(split_part(hp, ':', 1), '^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$') AS v4 FROM h), num AS (
  SELECT *, CASE WHEN v4 THEN split_part(host, '.', 1)::BIGINT * 16777216 + split_part(host, '.', 2)::BIGINT * 65536 + split_part(host, '.', 3)::BIGINT * 256 + split_part(host, '.', 4)::BIGINT END AS a FROM g)
  SELECT url_id, CASE WHEN u = '' THEN 'empty' WHEN lower(split_part(u, ':', 1)) NOT IN ('http', 'https') OR NOT contains(u, ':') THEN 'scheme_not_allowed'
    WHEN host = '' THEN 'no_host'
    WHEN v4 AND (a < 16777216 OR a // 16777216 IN (10, 127) OR a // 16777216 >= 224 OR a BETWEEN 1681915904 AND 1686110207 OR a // 65536 IN (43518, 49320)
      OR a // 1048576 = 2753 OR a // 256 IN (12582912, 12582914, 12989284, 13303921) OR a // 131072 = 25353) THEN 'blocked_address'
    WHEN v4 THEN 'allowed' ELSE 'needs_resolution' END AS fetch_class FROM num
  UNION ALL SELECT url_id, expected FROM {fetch_cases}""")
def fil7(d: Data):
    return ops.fetch_guard(d.urls.unionByName(d.fetch_cases.select("url_id", "url"))).select("url_id", "fetch_class")
