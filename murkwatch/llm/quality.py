"""Quality rules with thresholds that follow the corpus, in DataFrame expressions.

Each document gets counts; base rules refuse the hopeless ones. For the others, grid sketches (counts per integer grid
value, at most 1001 a measure) give quartiles per language and source. Sketches merge by addition, so the same rows give
the language's own quartiles. A document is refused when a measure lies outside the fences of both its source and its
language; the fences replace fixed cutoffs. The thresholds are then joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import pin
from ..session import cut_lineage
from .shared import SPACES

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Measure: (least spread, least possible value, whether it has a lower fence). Grid values: 0 to 1000. Shares are per mille,
#: word_length is in tenths of a character.
MEASURES = {"symbols": (20, 0, False), "dup_lines": (100, 0, False), "repeats": (45, 0, False), "word_length": (5, 10, True)}


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of COUNTS, base_failed and m_<measure> for MEASURES, replacing columns of these names.

    Null text has no words. Words are runs of characters other than the six spaces; a line is what line feeds part.
    """
    names = [*COUNTS, "base_failed", *(f"m_{name}" for name in MEASURES)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda line: F.btrim(line, F.lit(SPACES)) != "")
    held = pin(held, {"_words": words, "_full": full, "_lines": F.size(lines)})
    held = pin(held, {
        "_grams": F.when(F.size("_words") >= 5, F.transform(
            F.sequence(F.lit(0), F.size("_words") - 5), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(5)]))),
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long")})
    # Only documents with equal hashes can have equal windows; there the windows themselves are compared.
    may = F.size(F.array_distinct("_grams")) < F.size("_grams")
    windows = F.transform(F.sequence(F.lit(0), F.size("_words") - 5), lambda i: F.struct(
        F.array_join(F.slice("_words", i + 1, 5), " ").alias("gram"), i.alias("at")))
    held = pin(held, {"_sorted": F.when(may, F.array_sort(windows))})
    gram = lambda k: F.get("_sorted", k)["gram"]
    again = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda k: F.coalesce(gram(k) == gram(k - 1), F.lit(False)) | F.coalesce(gram(k) == gram(k + 1), F.lit(False)))
    starts = F.sort_array(F.transform(again, lambda k: F.get("_sorted", k)["at"]))
    held = pin(held, {"_starts": F.when(F.col("_sorted").isNotNull(), starts)})
    covered = F.aggregate("_starts", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda acc, at: F.struct(
        (at + 5).alias("end"), (acc["n"] + at + 5 - F.greatest(acc["end"], at)).alias("n")))["n"]
    held = pin(held.drop("_words", "_full", "_grams", "_sorted"), {"n_repeat_words": F.coalesce(covered, F.lit(0).cast("long"))})
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda part, whole: F.least(F.floor(1000 * part / whole), F.lit(1000)).cast("int")
    return held.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "m_symbols": share(F.col("n_symbols"), F.greatest(F.length(text), F.lit(1))),
        "m_dup_lines": share(F.col("n_dup_lines"), F.col("_lines")),
        "m_repeats": share(F.col("n_repeat_words"), n),
        "m_word_length": F.least(F.floor(10 * F.col("word_chars") / n), F.lit(1000)).cast("int")}).drop("_starts", "_lines")


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, low, high): quartiles of the merged sketch, three spreads out, but no further than half the way to the
    end of the scale, so that every fence can act. A value's rank is exact on the grid."""
    merged = sketch.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("value")), "all": F.sum("n").over(group)})
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("value")))
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for name, facts in MEASURES.items() for x in (name, facts[k])]), F.col("measure"))
    found = ranked.groupBy(*keys, "measure").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    out = 3 * F.greatest(F.col("q3") - F.col("q1"), of(0))
    low, high = F.ceil((F.col("q1") + of(1)) / 2).cast("int"), F.floor((F.col("q3") + 1000) / 2).cast("int")
    return found.select(*keys, "measure", F.greatest(F.col("q1") - out, low).alias("low"), F.least(F.col("q3") + out, high).alias("high"))


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, low_<measure>, high_<measure>): a row for each language and source with a document past the base rules."""
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(f"m_{name}").alias("value")) for name in MEASURES]))
    sketch = (measured.where("NOT base_failed").select("lang", "source", values.alias("v"))
              .groupBy("lang", "source", "v.measure", "v.value").agg(F.count("*").alias("n")))
    sketch = cut_lineage(sketch)
    own, wide = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"]).select(
        F.col("lang").alias("_lang"), F.col("measure").alias("_measure"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    both = own.join(wide, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_measure")))
    of = lambda col, name: F.max(F.when(F.col("measure") == name, col))
    return both.groupBy("lang", "source").agg(
        *[of(F.least("low", "_low"), name).alias(f"low_{name}") for name, (*_, lower) in MEASURES.items() if lower],
        *[of(F.greatest("high", "_high"), name).alias(f"high_{name}") for name in MEASURES])


def judged(measured: DataFrame) -> DataFrame:
    """``measured`` with kept: false for base_failed and for a measure outside its group's thresholds.

    ``measured`` should be a stored table: it is read for the sketches and again for the verdicts. Adaptive execution
    broadcasts the thresholds where they are small.
    """
    limits = cut_lineage(thresholds(measured).withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    met = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    outside: Column = F.lit(False)
    for name, (*_, lower) in MEASURES.items():
        outside = outside | (F.col(f"m_{name}") > F.col(f"high_{name}"))
        if lower:
            outside = outside | (F.col(f"m_{name}") < F.col(f"low_{name}"))
    return met.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).drop(*limits.columns)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept), one row for each input row. Null lang or source is a group of its own."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "lang", "source")
    stored = cut_lineage(measure(rows).drop("text"))
    return judged(stored).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the refused documents, columns as they are."""
    # Measured rows are stored with their texts: one write instead of a second measuring or a shuffle of texts.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text_col).alias("text"), "lang", "source")
    stored = cut_lineage(measure(own).drop("text"))
    return judged(stored).where("kept").select("_doc.*")
