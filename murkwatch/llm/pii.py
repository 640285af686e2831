"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in DataFrame expressions.

Candidates are found by one pattern and validated: check digits of cards and account numbers, octets, calendar days. Card
and account numbers are looked for at all borders within a run of digits or upper-case words. A valid one is permuted within its own format: digits stay digits and letters letters, separators stay where they are,
check digits are computed anew, a date becomes another day of the same 400-year calendar cycle. The permutation depends
on the kind, the value and the key only, so equal values stay equal in all documents, and ``restore`` inverts it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import pin

ROUNDS = 8

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
ASSIGNED = r"(?<=(?:password|passwd|secret|token|api_key)[ ]?[=:][ ]?[\"']?)[A-Za-z0-9_\-]{8,}"
DATE = r"(?<![\d.\-/])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\-/.]?\d)"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
PHONE = r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<!\d)(?:\(\d{3}\)[ ]?|\d{3}[\-.])\d{3}[\-.]\d{4}(?!\d)"
SOCIAL = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\-]?\d)"
#: A run ends before a separator after which one of these begins.
OTHERS = "|".join([EMAIL, ACCESS_KEY, DATE, ADDRESS, PHONE, SOCIAL])
#: Runs of upper-case words and digits that begin as an account number does, and runs of digits.
ACCOUNT_SHAPE = r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}"
ACCOUNT = (r"(?<![A-Za-z0-9])(?=[A-Z]{2}\d{2}(?:(?:[ ](?!" + OTHERS + r"))?[A-Z0-9]){11,30}(?![A-Za-z0-9]))[A-Z0-9]++"
           r"(?:[ ](?!\d{4,6}-\d{4,6}-\d|" + OTHERS + r")[A-Z0-9]++(?![a-z]))*+")
CARD_SHAPE = r"\d(?:[ \-]?\d){12,18}"
CARD = r"(?<!\d)(?=\d(?:(?:[ \-](?!" + OTHERS + r"))?\d){12})\d++(?:[ \-](?!" + OTHERS + r")\d++)*+"
KINDS = {"email": EMAIL, "access_key": ACCESS_KEY, "assigned": f"({ASSIGNED})", "date": DATE, "address": ADDRESS, "account": ACCOUNT,
         "phone": PHONE, "social": SOCIAL, "card": CARD}
#: Groups are numbered over the whole pattern; the assigned secret is the only one.
ANY = "|".join(KINDS.values())
#: Characters of an account number by country.
LENGTHS = """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27
GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22
MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22
VG24 XK20""".split()
OWN_LENGTH = "^(?:" + "|".join(f"{x[:2]}.{{{int(x[2:]) - 2}}}" for x in LENGTHS) + ")$"
LISTED = "^(?:" + "|".join(x[:2] for x in LENGTHS) + ")"
#: Usual lengths and first digits of cards.
USUAL = r"^(?:[2-6]\d{15}|3[47]\d{13}|3[0689]\d{12})$"
#: A text without any of these characters has no candidate.
HINT = r"[0-9@]|AKIA|password|passwd|secret|token|api_key"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` names it in a loop."""
    return F.get(F.transform(F.array(value), use), 0)


def _digest(key: str, kind: str, turn: Column, *other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), *other), 256)


def _rounds(start: Column, step: Callable[[Column, Column], Column], sign: int) -> Column:
    turns = F.sequence(F.lit(1), F.lit(ROUNDS)) if sign > 0 else F.sequence(F.lit(ROUNDS), F.lit(1))
    return F.aggregate(turns, start, step)


def permuted_text(value: Column, key: str, kind: str, sign: int = 1) -> Column:
    """Feistel rounds on the halves of a string: each shifts the letters and digits of one half, within their class, by a
    stream that the digest of the other half gives. Other characters stay."""

    def shifted(half: Column, other: Column, turn: Column) -> Column:
        def char(c: Column, i: Column, stream: Column) -> Column:
            by = F.conv(F.substr(stream, 2 * F.pmod(i, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int") * sign
            turned = lambda first, n: F.char(F.pmod(F.ascii(c) - ord(first) + by, F.lit(n)) + ord(first))
            return (F.when(c.between("0", "9"), turned("0", 10)).when(c.between("a", "z"), turned("a", 26))
                    .when(c.between("A", "Z"), turned("A", 26)).otherwise(c))

        whole = lambda stream: F.array_join(F.transform(F.split(half, ""), lambda c, i: char(c, i, stream)), "")
        return F.when(half == "", half).otherwise(_let(_digest(key, kind, turn, other), whole))

    def step(held: Column, turn: Column) -> Column:
        left, right = held["l"], held["r"]
        return (F.when(turn % 2 == 1, F.struct(shifted(left, right, turn).alias("l"), right.alias("r")))
                .otherwise(F.struct(left.alias("l"), shifted(right, left, turn).alias("r"))))

    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1).alias("r"))
    return _let(_rounds(start, step, sign), lambda out: F.concat(out["l"], out["r"]))


def permuted_number(value: Column, left: int, right: int, key: str, kind: str, sign: int = 1) -> Column:
    """The same on 0..left*right-1, halves added to modulo ``left`` and ``right``: a permutation for any two sizes."""

    def added(half: Column, other: Column, turn: Column, size: int) -> Column:
        by = F.conv(F.substr(_digest(key, kind, turn, other.cast("string")), F.lit(1), F.lit(12)), 16, 10).cast("long")
        return F.pmod(half + sign * F.pmod(by, F.lit(size)), F.lit(size)).cast("long")

    def step(held: Column, turn: Column) -> Column:
        a, b = held["l"], held["r"]
        return (F.when(turn % 2 == 1, F.struct(added(a, b, turn, left).alias("l"), b.alias("r")))
                .otherwise(F.struct(a.alias("l"), added(b, a, turn, right).alias("r"))))

    start = F.struct(F.floor(value / right).cast("long").alias("l"), F.pmod(value, F.lit(right)).cast("long").alias("r"))
    return _let(_rounds(start, step, sign), lambda out: out["l"] * right + out["r"])


def _chars(value: Column) -> Column:
    return F.sequence(F.lit(1), F.length(value))


def _luhn(digits: Column) -> Column:
    """Sum of the digits with every second one from the right doubled; the last is the check digit."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(_chars(digits), F.lit(0), add)


def _mod97(value: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        c = F.substr(value, i, F.lit(1))
        return F.when(c.between("0", "9"), (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(value), F.lit(0), add)


def _dressed(shape: Column, value: Column) -> Column:
    """The characters of ``value`` in the places of the letters and digits of ``shape``."""
    return _let(value, lambda bare: _placed(shape, bare))


def _placed(shape: Column, bare: Column) -> Column:
    def char(i: Column) -> Column:
        c = F.substr(shape, i, F.lit(1))
        held = F.length(F.regexp_replace(F.substr(shape, F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substr(bare, held, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_chars(shape), char), "")


def _valid_account(bare: Column) -> Column:
    return _let(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), _mod97) == 1


def _card(m: Column, key: str, sign: int) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = permuted_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", sign)

    def checked(value: Column) -> Column:
        return F.concat(value, F.pmod(10 - _luhn(F.concat(value, F.lit("0"))) % 10, F.lit(10)).cast("string"))

    return _dressed(m, _let(body, checked))


def _account(m: Column, key: str, sign: int) -> Column:
    bare = F.regexp_replace(m, " ", "")
    land, rest = F.substr(bare, F.lit(1), F.lit(2)), F.substr(bare, F.lit(5))

    def checked(value: Column) -> Column:
        check = F.lpad((98 - _let(F.concat(value, land, F.lit("00")), _mod97)).cast("string"), 2, "0")
        return F.concat(land, check, value)

    return _dressed(m, _let(permuted_text(rest, key, "account", sign), checked))


def _spans(m: Column) -> Column:
    """(rank, start, less, size) of the valid card and account numbers of a run that don't overlap, by place. Of
    overlapping ones an account of its country's length goes first, then a card of a usual kind, the whole run, and the
    earlier and longer one."""
    at = lambda text, i: F.substr(text, i, F.lit(1))

    def ranked(part: Column, start: Column, size: Column) -> Column:
        bare = F.regexp_replace(part, "[ \\-]", "")

        def rank(bare: Column) -> Column:
            whole = (start == 1) & (size == F.length(m))
            account = (F.when(~_valid_account(bare), 9).when(bare.rlike(OWN_LENGTH), 1).when(whole, 3).when(bare.rlike(LISTED), 9).otherwise(4))
            card = F.when(_let(bare, _luhn) % 10 != 0, 9).when(bare.rlike(USUAL), 2).when(whole, 3).otherwise(5)
            return F.when(part.rlike(f"^{CARD_SHAPE}$"), card).when(part.rlike(f"^{ACCOUNT_SHAPE}$"), account).otherwise(9)

        return F.struct(_let(bare, rank).alias("rank"), start.alias("start"), (-size).alias("less"), size.alias("size"))

    def from_start(start: Column) -> Column:
        def ends(window: Column) -> Column:
            border = lambda j: ~at(window, j).isin(" ", "-") & ~(
                at(window, j + 1).rlike("[0-9]") | (at(window, j + 1).rlike("[A-Z]") & at(window, F.lit(1)).rlike("[A-Z]")))
            sizes = F.filter(F.sequence(F.lit(1), F.least(F.length(window), F.lit(67))), lambda j: (j >= 13) & border(j))
            return F.transform(sizes, lambda j: ranked(F.substr(window, F.lit(1), j), start, j))

        return F.filter(_let(F.substr(m, start, F.lit(68)), ends), lambda x: x["rank"] < 9)

    begins = lambda i: F.when(at(m, i).rlike("[0-9]"), (i == 1) | ~at(m, i - 1).rlike("[0-9]")).otherwise(
        F.substr(m, i, F.lit(4)).rlike("^[A-Z]{2}[0-9]{2}$") & ((i == 1) | at(m, i - 1).isin(" ", "-")))
    found = F.flatten(F.transform(F.filter(_chars(m), begins), from_start))
    kind = "array<struct<rank:int,start:int,less:int,size:int>>"

    def free(chosen: Column, x: Column) -> Column:
        met = F.exists(chosen, lambda y: (y["start"] < x["start"] + x["size"]) & (x["start"] < y["start"] + y["size"]))
        return F.when(met, chosen).otherwise(F.concat(chosen, F.array(x)))

    chosen = F.aggregate(F.array_sort(found.cast(kind)), F.array().cast(kind), free)
    return F.array_sort(F.transform(chosen, lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"))))


def _run(m: Column, key: str, sign: int) -> Column:
    """(new, n): the run with its valid numbers replaced, each for itself."""

    def moved(spans: Column) -> Column:
        def part(held: Column, x: Column) -> Column:
            value = F.substr(m, x["start"], x["size"])
            new = _let(value, lambda v: F.when(v.rlike("^[A-Z]"), _account(v, key, sign)).otherwise(_card(v, key, sign)))
            return F.struct(F.concat(held["out"], F.substr(m, held["at"], x["start"] - held["at"]), new).alias("out"),
                            (x["start"] + x["size"]).alias("at"))

        done = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), part)
        return F.struct(_let(done, lambda d: F.concat(d["out"], F.substr(m, d["at"]))).alias("new"), F.size(spans).alias("n"))

    return _let(_spans(m), moved)


def _phone(m: Column, key: str, sign: int) -> Column:
    """The country code stays; the subscriber's digits are permuted."""
    code = F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .\-(]))", 1)
    rest = F.substr(m, F.length(code) + 1)
    return F.concat(code, _dressed(rest, permuted_text(F.regexp_replace(rest, "[^0-9]", ""), key, "phone", sign)))


def _address(m: Column, key: str, sign: int) -> Column:
    parts = F.split(m, r"\.")
    valid = ~F.exists(parts, lambda p: (p.cast("int") > 255) | p.rlike("^0."))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda held, p: held * 256 + p.cast("long"))
    shown = lambda x: F.concat_ws(".", *[F.pmod(F.floor(x / d), F.lit(256)).cast("string") for d in (16777216, 65536, 256, 1)])
    return F.when(valid, _let(permuted_number(number, 65536, 65536, key, "address", sign), shown)).otherwise(m)


def _late_days(offset: Column, first: Column) -> Column:
    """Rank of a day among those after the 12th of their month."""
    day = F.date_add(first, offset.cast("int"))
    months = (F.year(day) - 1800) * 12 + F.month(day)
    return (offset - 12 * months).cast("long")


def _late_day(rank: Column, first: Column) -> Column:
    """The day of this rank: months hold 16 to 19 such days, 88497 in 4800, so an estimate is off by a few months at most."""
    guess = F.floor(rank * 4800 / 88497).cast("int")
    months = F.sequence(F.greatest(guess - 3, F.lit(0)), guess + 3)
    before = lambda i: F.datediff(F.add_months(first, i), first) - 12 * i
    found = F.array_max(F.filter(months, lambda i: before(i) <= rank))
    return _let(found, lambda i: F.date_add(F.add_months(first, i), (rank - before(i) + 12).cast("int")))


def _date(m: Column, key: str, sign: int) -> Column:
    """Days of 1800 to 2199, one cycle of 146097 = 27 x 5411 days. What is no day as day/month/year is read as
    month/day/year and becomes another day after the 12th, of which there are 88497 = 9 x 9833, so that it can be read in one
    way only."""
    iso = m.rlike("^[0-9]{4}-")
    parts = F.split(m, r"[./\-]")
    us = ~iso & (parts[1].cast("int") > 12)
    year = F.when(iso, parts[0]).otherwise(parts[2])
    month, day = F.when(us, parts[0]).otherwise(parts[1]), F.when(iso, parts[2]).when(us, parts[1]).otherwise(parts[0])
    parsed = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    first = F.lit("1800-01-01").cast("date")
    offset = F.datediff(parsed, first).cast("long")
    two = lambda value, part: F.lpad(value.cast("string"), F.greatest(F.length(value.cast("string")), F.length(part)), "0")
    separator = F.regexp_extract(m, r"([./\-])", 1)

    def shown(turned: Column) -> Column:
        y, mo, d = F.date_format(turned, "yyyy"), two(F.month(turned), month), two(F.day(turned), day)
        return (F.when(iso, F.concat_ws("-", y, mo, d)).when(us, F.concat(mo, separator, d, separator, y))
                .otherwise(F.concat(d, separator, mo, separator, y)))

    any_day = _let(permuted_number(offset, 27, 5411, key, "date", sign), lambda x: F.date_add(first, x.cast("int")))
    late = _let(permuted_number(_late_days(offset, first), 9, 9833, key, "late date", sign), lambda x: _late_day(x, first))
    return F.when(offset.between(0, 146096), _let(F.when(us, late).otherwise(any_day), shown)).otherwise(m)


def _email(m: Column, key: str, sign: int) -> Column:
    """The part before the sign and the first label after it; the rest of the domain stays."""
    at = F.locate("@", m)
    dot = at + F.locate(".", F.substr(m, at + 1))
    return F.concat(permuted_text(F.substr(m, F.lit(1), dot - 1), key, "email", sign), F.substr(m, dot))


def pseudonym(m: Column, assigned: Column, key: str, sign: int = 1) -> Column:
    """(new, n): the replacement of one candidate and how many values it replaces, or the candidate itself where it isn't
    valid. ``assigned`` is true for what follows the name of a secret."""
    whole = lambda pattern: m.rlike(f"^(?:{pattern})$")
    prefix = F.substr(m, F.lit(1), F.lit(4))
    one = lambda new: _let(new, lambda x: F.struct(x.alias("new"), F.lit(1).alias("n")))
    run = whole(ACCOUNT_SHAPE) | whole(CARD_SHAPE)
    return (F.when(m.contains("@"), one(_email(m, key, sign)))
            .when(whole(ACCESS_KEY), one(F.concat(prefix, permuted_text(F.substr(m, F.lit(5)), key, "access_key", sign))))
            .when(whole(DATE), one(_date(m, key, sign))).when(whole(ADDRESS), one(_address(m, key, sign)))
            .when(whole(PHONE) & ~whole(ACCOUNT_SHAPE), one(_phone(m, key, sign)))
            .when(whole(SOCIAL), one(_dressed(m, permuted_text(F.regexp_replace(m, "-", ""), key, "social", sign))))
            .when(assigned & ~run, one(permuted_text(m, key, "assigned", sign)))
            .otherwise(_run(m, key, sign)))


def _replaced(docs: DataFrame, key: str, text_col: str, count_col: str | None, sign: int) -> DataFrame:
    # The documents' own columns travel in one struct, so no name of theirs meets a helper column.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("_")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    text, none = F.col("text"), F.array().cast("array<string>")
    found = pin(own, {"found": F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(none)})
    some = F.size("found") > 0
    marks = F.when(some, F.regexp_extract_all(text, F.lit(ANY), 1)).otherwise(none)
    turned = pin(found, {"turned": F.zip_with("found", marks, lambda m, mark: pseudonym(m, F.coalesce(mark, F.lit("")) != "", key, sign))})
    gaps = F.split(text, ANY, -1)
    spliced = F.array_join(F.zip_with(gaps, "turned", lambda gap, new: F.concat(gap, F.coalesce(new["new"], F.lit("")))), "")
    changed = F.aggregate(F.zip_with("found", "turned", lambda a, b: F.when(a != b["new"], b["n"]).otherwise(0)), F.lit(0), lambda n, x: n + x)
    made = {text_col: F.when(some, spliced).otherwise(text)} | ({count_col: changed.cast("long")} if count_col else {})
    order = docs.columns + ([count_col] if count_col and count_col not in docs.columns else [])
    return turned.select(*[made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in order])


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_replaced") -> DataFrame:
    """``docs`` with every valid e-mail address, access key, assigned secret, date, IP address, account, phone, social
    security and card number in ``text_col`` replaced, and ``count_col``: how many.

    One narrow stage without shuffle; the key reaches the executors in the plan. Null text stays null and counts 0, texts
    without candidates stay byte for byte. A column named ``count_col`` is replaced; columns of any other name go along. A
    value's pseudonym depends on its kind, the value and the key only. Which digits of a run of digit groups are a number is
    found by check digits: an account of its country's length first, then a card of a usual kind, then others.
    """
    return _replaced(docs, key, text_col, count_col, 1)


def restore(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The inverse of ``pseudonymise`` with the same key, for values that stand apart from other digits and upper-case words.
    A day or month of one digit may come back with a zero before it. In a run of digit groups a pseudonym can make other
    digits valid; such runs may not come back."""
    return _replaced(docs, key, text_col, None, -1)
