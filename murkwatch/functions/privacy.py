"""Detection and redaction of personal identifiers.

Every match is replaced in place: the text is split at the pattern, the matches
are hashed, and both arrays are zipped together again. That is exact left-to-right
replacement without a Python function per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns.
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b|\b\d{10}\b"
HANDLE = r"\b[a-zA-Z0-9.\-_]+@[a-zA-Z0-9]+\b"
UTR = r"\b\d{12}\b"
AMOUNT = r"\b(?:Rs\.?|INR|USD|\$)\s*\d+(?:\.\d{2})?\b"
URL = r"(?i)https?://[^\s/$.?#].[^\s]*"
USER_PATH = r"(?i)(?:c:\\Users\\|/home/|/Users/)([^/\\]+)"
# Account names that are not personal.
SYSTEM_USERS = ["default", "public", "administrator", "all users", "system32"]
# Default only: a deployment passes its own secret, or that of the hashed datasets it has to match.
SALT = "neutral-salt"


def hash_identifier(value: Column, salt: str = SALT) -> Column:
    """First 16 hex digits of the salted SHA-256; '' for empty input."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v == "", "").otherwise(F.substring(F.sha2(F.concat(v, F.lit(salt)), 256), 1, 16))


def replace_matches(text: Column, pattern: str, render) -> Column:
    """Replace each match of ``pattern`` by ``render(match)``; untouched rows skip the work."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.array_join(
        F.zip_with(pieces, found, lambda p, m: F.concat(p, F.when(m.isNotNull(), render(m)).otherwise(""))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}:"), hash_identifier(value), F.lit(">"))


def redact_emails(text: Column) -> Column:
    return replace_matches(text, EMAIL, lambda m: _tag("EMAIL_HASH", F.lower(m)))


def redact_utrs(text: Column) -> Column:
    return replace_matches(text, UTR, lambda m: _tag("UTR_HASH", m))


def redact_phones(text: Column) -> Column:
    return replace_matches(text, PHONE, lambda m: _tag("PHONE_HASH", F.regexp_replace(m, r"[-.\s()+]", "")))


def redact_handles(text: Column) -> Column:
    return replace_matches(text, HANDLE, lambda m: _tag("UPI_ID_HASH", F.lower(m)))


def redact_amounts(text: Column) -> Column:
    return F.regexp_replace(text, AMOUNT, "<AMOUNT>")


def redact_urls(text: Column, keep_domain: bool = True) -> Column:
    """Keep scheme and host, hash the rest; or hash the whole URL."""

    def render(m: Column) -> Column:
        if not keep_domain:
            return _tag("URL_HASH", m)
        scheme = F.lower(F.substring_index(m, "://", 1))
        rest = F.substring(m, F.length(scheme) + 4, 1 << 30)
        host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
        tail = F.regexp_replace(F.substring(rest, F.length(host) + 1, 1 << 30), "^[?#]+$", "")
        base = F.concat(scheme, F.lit("://"), host)
        return F.when(tail == "", base).otherwise(F.concat(base, F.lit("/"), _tag("PATH_HASH", m)))

    return replace_matches(text, URL, render)


# The order matters: an e-mail address also looks like a handle, a reference like a phone number.
REDACTIONS = [redact_emails, redact_utrs, redact_phones, redact_handles, redact_amounts, redact_urls]


def leak_flags(text: Column) -> dict[str, tuple[str, Column]]:
    """code -> (severity, condition) for one text."""
    user = F.lower(F.regexp_extract(text, USER_PATH, 1))
    lone = F.filter(F.regexp_extract_all(text, F.lit(HANDLE), F.lit(0)), lambda m: ~m.rlike(EMAIL))
    has_at = text.contains("@")
    return {
        "LEAK_EMAIL": ("warning", has_at & text.rlike(EMAIL)),
        "LEAK_PHONE": ("warning", text.rlike(PHONE)),
        "LEAK_UPI_ID": ("warning", F.when(has_at, F.size(lone) > 0).otherwise(False)),
        "LEAK_UTR": ("warning", text.rlike(UTR)),
        "LEAK_USERNAME": ("warning", (user != "") & ~user.isin(SYSTEM_USERS)),
        "URL_QUERY_PARAMS": (
            "info", (text.startswith("http://") | text.startswith("https://")) & text.contains("?")),
    }
