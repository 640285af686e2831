"""Chat formatting in budgeted windows, in DataFrame expressions.

A conversation is cut at turns: prefix sums of the turns' tokens choose spans that fit the budget. Each window after the
first opens with the system turn and as many of the preceding turns as the history budget holds; both are repeats, and
only targets that are new in a window carry its loss mask, so every assistant text is learned once.

Template: ``<<SYS>>``text``<</SYS>>``, ``[INST]``text``[/INST]``, ``<s>``text``</s>`` for system, user and assistant,
``[ROLE]``role``[/ROLE]``text``</s>`` for any other role. A control string inside a role or text gets a backslash after
its first character; one with backslashes there gets one more. Taking one away inverts that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import pin

TAIL = r"(/?s>|</?SYS>>|/?INST\]|/?ROLE\])"
TURN = r"(?s)(<<SYS>>|\[INST\]|<s>|\[ROLE\])(.*?)(<</SYS>>|\[/INST\]|</s>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAIL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + TAIL, r"$1$2$3")


def _head(role: Column) -> Column:
    return (F.when(role == "system", "<<SYS>>").when(role == "user", "[INST]").when(role == "assistant", "<s>")
            .otherwise(F.concat(F.lit("[ROLE]"), escaped(role), F.lit("[/ROLE]"))))


def _end(role: Column) -> Column:
    return F.when(role == "system", "<</SYS>>").when(role == "user", "[/INST]").otherwise("</s>")


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, window, text, loss, n_repeated, n_tokens): the formatted windows of each conversation.

    ``loss`` lists (start, length) in code points of ``text``: the assistant texts, as escaped there, that are new in this
    window. The first ``n_repeated`` turns are the system turn and history. A turn's tokens are estimated as a quarter of its bytes plus four. A
    window holds at most ``budget`` tokens, unless its one new turn or the system turn is larger than their share: turns are
    never cut. Null role or text counts as empty; turns sort by number, role and text, null first, and equal rows stay
    twice. Rows with null conv_id form one conversation. A conversation is one row of the result, so it must fit a task.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    sized = rows.withColumn("tokens", F.ceil(F.octet_length("text") / 4).cast("long") + 4)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sums = sized.withColumns({
        "before": F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "place": F.row_number().over(order)})
    turn = F.struct("place", "before", "tokens", "role", F.concat(_head(F.col("role")), escaped(F.col("text")), _end(F.col("role"))).alias("text"),
                    F.length(_head(F.col("role"))).alias("skip"), F.length(escaped(F.col("text"))).alias("chars"))
    held = sums.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    first = F.element_at("turns", 1)
    led = F.when(first["role"] == "system", 1).otherwise(0)
    held = pin(held, {"_led": led, "_room": F.greatest(F.lit(1).cast("long"), F.lit(budget - history) - F.when(first["role"] == "system", first["tokens"]).otherwise(0))})

    # A span goes on while the tokens since its start fit the room; the first turn of the next span is kept.
    def span(acc: Column, t: Column) -> Column:
        opens = (t["before"] + t["tokens"] - acc["base"] > F.col("_room")) & (t["before"] > acc["base"])
        return (F.when(opens, F.struct(t["before"].alias("base"), F.concat(acc["starts"], F.array(t["place"])).alias("starts")))
                .otherwise(acc))

    # The system turn takes no room of the first span: its tokens are kept aside in every window.
    base = F.when(F.col("_led") == 1, first["tokens"]).otherwise(F.lit(0)).cast("long")
    begun = F.struct(base.alias("base"), F.array(F.lit(1)).alias("starts"))
    spans = pin(held, {"_starts": F.aggregate("turns", begun, span)["starts"]})
    def cut(start: Column, i: Column) -> Column:
        """The repeated and the new turns of window ``i``: only these go on, not the whole conversation."""
        until = F.coalesce(F.try_element_at("_starts", i + 2), F.size("turns") + 1)
        lowest = F.greatest(F.col("_led") + 1, start - F.lit(history))  # a turn has a token at least
        past = F.slice("turns", lowest, F.greatest(F.lit(0), start - lowest))
        reach = F.element_at("turns", start)["before"] - history
        repeated = F.concat(F.slice("turns", 1, F.col("_led")), F.filter(past, lambda t: t["before"] >= reach))
        return F.struct(F.when(i == 0, F.slice("turns", 1, 0)).otherwise(repeated).alias("_old"), F.slice("turns", start, until - start).alias("_new"))

    each = spans.select("conv_id", F.posexplode(F.transform("_starts", cut)).alias("window", "_cut")).select("conv_id", "window", "_cut.*")

    def mask(acc: Column, t: Column) -> Column:
        target = F.array(F.struct((acc["at"] + t["skip"]).alias("start"), t["chars"].alias("length")))
        return F.struct((acc["at"] + F.length(t["text"])).cast("int").alias("at"),
                        F.when(t["role"] == "assistant", F.concat(acc["spans"], target)).otherwise(acc["spans"]).alias("spans"))

    joined = lambda col: F.array_join(F.transform(col, lambda t: t["text"]), "")
    total = lambda col: F.aggregate(col, F.lit(0).cast("long"), lambda held, t: held + t["tokens"])
    opened = pin(each, {"_lead": joined(F.col("_old"))})
    start = F.struct((F.length("_lead") + 1).cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return opened.select(
        "conv_id", F.col("window").cast("long").alias("window"), F.concat("_lead", joined(F.col("_new"))).alias("text"),
        F.aggregate("_new", start, mask)["spans"].alias("loss"), F.size("_old").alias("n_repeated"),
        (total(F.col("_old")) + total(F.col("_new"))).alias("n_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) from ``windows`` alone: new turns as (role, text), unescaped, in order."""
    parts = F.transform(F.regexp_extract_all("text", F.lit(TURN), 0), _parsed)
    masked = F.array_join(F.transform("loss", lambda s: unescaped(F.substr("text", s["start"], s["length"]))), "")
    read = formatted.select("conv_id", "window", F.length("text").cast("long").alias("chars"), masked.alias("masked"),
                            F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(parts))).alias("parts"))
    each = F.array_sort(F.collect_list(F.struct("window", "parts", "masked")))
    whole = read.groupBy("conv_id").agg(each.alias("windows"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", F.flatten(F.transform("windows", lambda w: w["parts"])).alias("turns"),
                        F.array_join(F.transform("windows", lambda w: w["masked"]), "").alias("loss_text"), "formatted_chars")


def _parsed(turn: Column) -> Column:
    head = F.regexp_extract(turn, TURN, 1)
    other = head == "[ROLE]"
    inner = F.regexp_extract(turn, TURN, 2)
    cut = F.locate("[/ROLE]", inner)
    role = (F.when(head == "<<SYS>>", "system").when(head == "[INST]", "user").when(head == "<s>", "assistant")
            .otherwise(unescaped(F.substr(inner, F.lit(1), cut - 1))))
    return F.struct(role.alias("role"), unescaped(F.when(other, F.substr(inner, cut + 7)).otherwise(inner)).alias("text"))
