"""URL jobs. Everything except the registration join and IDN lookup is one narrow stage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions import urls as U
from ..functions.exprs import any_of, found_words, hit_rules, pin, strip

# Address blocks a fetcher must not reach (IPv4 part as first address and prefix length).
BLOCKED_IPV4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4), ("255.255.255.255", 32),
]
# Blocked IPv6 ranges as first group, low and high; the two single addresses are 0 and 1.
BLOCKED_IPV6 = [(0xFC00, 0xFDFF), (0xFE80, 0xFEBF), (0xFF00, 0xFFFF)]


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Append the 25 lexical feature columns."""
    u = F.col("_u")
    base = pin(df, {"_u": strip(F.coalesce(F.col(url), F.lit("")))})
    base = pin(base, {"_full": F.when(U.has_scheme(u), u).otherwise(F.concat(F.lit("http://"), u))})
    full = F.col("_full")
    base = pin(base, {"_host": U.hostname(full), "_path": U.path(full), "_query": U.query(full)})
    feats = U.lexical_features(u, full, F.col("_host"), F.col("_path"), F.col("_query"))
    return base.withColumns(feats).drop("_u", "_full", "_host", "_path", "_query")


def domains(df: DataFrame, url: str = "url") -> DataFrame:
    """Append normalized_url and domain."""
    norm = F.col("normalized_url")
    base = pin(df, {"normalized_url": U.normalize_url(F.col(url))})
    return pin(base, {"domain": F.when(norm == "", "").otherwise(U.domain(norm))})


def analyze(df: DataFrame, url: str = "url", ascii_host: str | None = None) -> DataFrame:
    """Append normalized_url, domain, brand matches, rule hits and keywords.

    ``ascii_host`` names an optional column with the punycode form of a
    non-ASCII network location (see :func:`punycode_hosts`).
    """
    norm, dom, official = F.col("normalized_url"), F.col("domain"), F.col("is_official_bank_domain")
    if ascii_host:
        fixed = U.normalize_url(F.col(url))
        swapped = F.concat(
            F.regexp_extract(fixed, r"^(https?://)", 1), F.col(ascii_host),
            F.regexp_extract(fixed, r"^https?://[^/?#]*(.*)$", 1))
        df = pin(df, {"_ascii": F.when(F.col(ascii_host).isNotNull(), swapped).otherwise(fixed)})
        base = domains(df, "_ascii").drop("_ascii")
    else:
        base = domains(df, url)
    qry = U.query(norm)
    base = pin(base, {
        "_decoded": F.lower(U.unquote(F.concat(
            U.path(norm), F.when(qry != "", F.concat(F.lit("?"), qry)).otherwise("")))),
        "is_official_bank_domain": U.is_official(dom),
        "_root": U.domain_root(dom),
    })
    base = pin(base, {"_folded": U.fold_homoglyphs(F.col("_root"))})
    base = pin(base, {"_sims": U.brand_similarities(F.col("_root"), F.col("_folded"), official)})
    base = pin(base, {
        "domain_matches": U.brand_matches(F.col("_sims")),
        "top_keywords": F.when(norm == "", F.array().cast("array<string>")).otherwise(
            found_words(F.concat(dom, F.lit("/"), F.col("_decoded")), U.RULE_KEYWORDS)),
    })
    rules = U.url_rules(
        norm, dom, F.col("_folded"), F.col("domain_matches"), F.col("top_keywords"), official)
    return pin(base, {"triggered_rules": rules}).drop("_decoded", "_root", "_folded", "_sims")


def score(df: DataFrame, registered=None, age_days=None, self_signed=None, expired=None) -> DataFrame:
    """Append risk_score, risk_level and the recommended action to analysed URLs.

    Without a registration snapshot the missing-registration surcharge applies to every row.
    """
    none = F.lit(None)
    net = U.network_score(
        F.lit(False) if registered is None else registered,
        none.cast("int") if age_days is None else age_days,
        none.cast("boolean") if self_signed is None else self_signed,
        none.cast("boolean") if expired is None else expired,
    )
    total = F.col("risk_score")
    return pin(df, {"risk_score": U.url_risk_score(hit_rules("triggered_rules"), net)}).withColumns({
        "risk_level": L.signal_level(total),
        "action": L.url_action(total),
        "confidence": L.url_action_confidence(total),
    })


def enrich_registration(df: DataFrame, snapshot: DataFrame, as_of) -> DataFrame:
    """Left join of a registration/certificate snapshot on domain.

    snapshot: domain, created_on, cert_valid_to, self_signed (one row per domain). The join
    strategy is left to adaptive execution: the snapshot may be small or as large as the web.
    """
    snap = snapshot.withColumnRenamed("domain", "_snap_domain")
    joined = df.join(snap, df["domain"] == snap["_snap_domain"], "left")
    return joined.withColumns({
        "registered": F.col("_snap_domain").isNotNull(),
        "age_days": F.datediff(as_of, F.col("created_on")),
        "is_expired": F.to_date(as_of) > F.col("cert_valid_to"),
    }).withColumn("is_recently_registered", F.col("age_days") < 90).drop("_snap_domain")


def punycode_hosts(df: DataFrame, url: str = "url") -> DataFrame:
    """Append ascii_host: punycode form of the non-ASCII network location, null otherwise.

    IDNA is not expressible in SQL. Only the distinct non-ASCII hosts, a small share of any
    crawl, go through one Arrow-batched function; the result is joined back.
    """
    @F.pandas_udf("string")
    def to_ascii(hosts: pd.Series) -> pd.Series:
        def one(host):
            try:
                return host.encode("idna").decode("ascii")
            except UnicodeError:
                return None
        return hosts.map(one)

    loc = U.netloc(U.normalize_url(F.col(url)))
    tagged = df.withColumn("_host", F.when(loc.rlike(r"[^\x00-\x7F]"), loc))
    hosts = (
        tagged.select("_host").where(F.col("_host").isNotNull()).distinct()
        .withColumn("ascii_host", to_ascii("_host"))
    )
    return tagged.join(hosts, "_host", "left").drop("_host")


def _ipv6_groups(host: Column) -> Column:
    """The eight groups of an IPv6 literal in any spelling, as numbers; null if it is none."""
    bare = F.regexp_replace(host, "%.*$", "")
    tail = F.split(F.regexp_extract(bare, r"(\d+\.\d+\.\d+\.\d+)$", 1), r"\.")
    byte = lambda k: F.get(tail, k).try_cast("int")
    pair = lambda k: F.lower(F.hex(byte(k) * 256 + byte(k + 1)))
    plain = F.when(bare.contains("."), F.concat(F.regexp_replace(bare, r"\d+\.\d+\.\d+\.\d+$", ""), pair(0), F.lit(":"), pair(2))).otherwise(bare)
    some = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    left, right = some(F.substring_index(plain, "::", 1)), some(F.substring_index(plain, "::", -1))
    filled = F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)
    groups = F.when(plain.contains("::"), filled).otherwise(some(plain))
    valid = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(valid, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int")))


def fetch_guard(df: DataFrame, url: str = "url") -> DataFrame:
    """Append fetch_class: why a literal-address URL may not be fetched, or ``allowed``.

    Host names need a resolver and are reported as ``needs_resolution``.
    """
    raw = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_replace(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), r"^.*@", "")
    bracket = F.regexp_extract(host, r"^\[([^\]]*)\]", 1)
    name = F.lower(F.when(host.startswith("["), bracket).otherwise(F.substring_index(host, ":", 1)))
    parts = F.split(F.col("_host"), r"\.")
    number = sum(
        (F.get(parts, i).cast("long") * F.lit(256 ** (3 - i)) for i in range(1, 4)),
        F.get(parts, 0).cast("long") * F.lit(256 ** 3),
    )

    def bounds(first: str, bits: int) -> tuple[int, int]:
        a, b, c, d = (int(x) for x in first.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        return low, low + 2 ** (32 - bits) - 1

    ranges = F.array(*[
        F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
        for lo, hi in (bounds(*net) for net in BLOCKED_IPV4)
    ])
    is_v4 = U.is_ipv4_strict(F.col("_host"))
    out = pin(pin(df, {"_host": name}), {"_num": F.when(is_v4, number), "_groups": F.when(F.col("_host").contains(":"), _ipv6_groups(F.col("_host")))})
    lead, end = F.get("_groups", 0), F.get("_groups", 7)
    near_zero = (end <= 1) & ~F.exists(F.slice("_groups", 1, 7), lambda g: g != 0)
    inner = any_of(lead.between(low, high) for low, high in BLOCKED_IPV6)
    cls = (
        F.when(raw == "", "empty")
        .when(raw.rlike(r"[\x00-\x1F\x7F]"), "control_characters")
        .when(~F.lower(F.substring_index(raw, ":", 1)).isin("http", "https") | ~raw.contains(":"), "scheme_not_allowed")
        .when(F.col("_host") == "", "no_host")
        .when(is_v4 & F.exists(ranges, lambda r: F.col("_num").between(r["lo"], r["hi"])), "blocked_address")
        .when(F.coalesce(near_zero | inner, F.lit(False)), "blocked_address")
        .when(is_v4 | F.col("_groups").isNotNull(), "allowed")
        .otherwise("needs_resolution")
    )
    return out.withColumn("fetch_class", cls).drop("_host", "_num", "_groups")


def fingerprints(scored: DataFrame, min_score: int = 31) -> DataFrame:
    """Event rows for URLs at or above the storing threshold."""
    rules = hit_rules("triggered_rules")
    return scored.where(F.col("risk_score") >= min_score).withColumns({
        "source_type": F.lit("URL"),
        "source_domain": F.col("domain"),
        "risk_indicators": rules,
        "document_type_hint": F.lit("phishing_url"),
        "fingerprint_text": F.array_join(F.concat(F.array("domain"), F.col("top_keywords"), rules), " "),
    })


def reconstruct(df: DataFrame) -> DataFrame:
    """Append url and label to rows of coded website attributes."""
    names = [
        "having_ip_address", "url_length", "having_at_symbol", "prefix_suffix", "having_sub_domain",
        "sslfinal_state", "port", "https_token", "result",
    ]
    attrs = {n: F.coalesce(F.col(n).try_cast("double").cast("int"), F.lit(0)) if n in df.columns else F.lit(0)
             for n in names}
    label = F.when(F.coalesce(F.col("result").try_cast("int"), F.lit(1)) == -1, 1).otherwise(0)
    return df.withColumn("_url", U.reconstruct_url(attrs)).withColumn("label", label).withColumnRenamed("_url", "url")
