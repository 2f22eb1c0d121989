"""Chat formatting with a grammar round trip. DataFrame functions only.

    formatted := turn*          turn := "[INST] " role " [/INST]" text "</s>"

A control string is ``[INST]``, ``[/INST]`` or ``</s>``; one escaped has a backslash behind its first
character. The parser takes a turn apart at its control strings, and accepts just the grammar: any other
control string in a role or text makes the turn unreadable. In what it accepts it takes one backslash away
from each escaped control string, so every formatted text has exactly one reading.

Each turn is rendered as it is, reparsed, and compared with its source. As long as the two differ, more of it is
escaped (the text, then the role too; a backslash goes into each control string, and into each with backslashes there
already) and it is reparsed again. The whole conversation is parsed once more; what never reads back stops the job.

Cases: null role or text counts as empty; turns are in order of ``turn`` (nulls first), then role and
text; repeated rows are turns of their own; an empty text is a turn with nothing in it; an empty
table gives no rows. A conversation is one row, so its turns come together in one task. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SHUT, END = "[INST]", "[/INST]", "</s>"
_INSIDE = r"(?s)([<\[])(\\*)(/s>|INST\]|/INST\])"
_ESCAPED = r"(?s)([<\[])\\(\\*)(/s>|INST\]|/INST\])"
_TURN = r"(?s)^\[INST\] (.*?) \[/INST\](.*)$"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, _INSIDE, r"$1\\$2$3")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, _ESCAPED, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(f"{OPEN} "), role, F.lit(f" {SHUT}"), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: array of ``role`` and ``text``, null for a turn that isn't of the grammar."""
    parts = F.split(formatted, END, -1)

    def turn(x: Column) -> Column:
        plain = (F.size(F.regexp_extract_all(x, F.lit(r"\[/?INST\]"), F.lit(0))) == 2) & x.rlike(_TURN)
        return F.when(plain, F.struct(unescape(F.regexp_extract(x, _TURN, 1)).alias("role"), unescape(F.regexp_extract(x, _TURN, 2)).alias("text")))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def until_identical(role: Column, text: Column) -> Column:
    """``piece`` and ``shown`` (the text as it stands in it) of the least escaped rendering of a turn that reads back."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    ladder = [(role, text), (role, escape(text)), (escape(role), escape(text))]
    tried = [F.when(F.coalesce(parse(render(r, t)) == source, F.lit(False)), F.struct(render(r, t).alias("piece"), t.alias("shown"))) for r, t in ladder]
    return F.coalesce(*tried, F.raise_error(F.concat(F.lit("turn does not read back: "), text)))


def under_mask(formatted: Column, spans: Column) -> Column:
    """Texts that spans of a formatted text cover, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, ``turns`` (parsed from it) and ``loss_spans`` (of assistant texts in it).

    A span has ``start`` (code points before it) and ``length``, escapes included.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("_made", until_identical(F.col("role"), F.col("text"))).select("conv_id", "turn", "role", "text", "_made.piece", "_made.shown")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.length("piece") - F.length("shown") - len(END)
    upto = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("conv_id", "role", "text", "piece", F.row_number().over(order).alias("k"), (F.coalesce(upto, F.lit(0)) + head).alias("start"), (F.length("piece") - head - len(END)).alias("length"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "role", "text", "piece", "start", "length"))).alias("rows"))
    chats = chats.select("conv_id", F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"), F.array_join(F.transform("rows", lambda x: x["piece"]), "").alias("formatted"), F.transform(F.filter("rows", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"))
    chats = chats.withColumn("turns", parse(F.col("formatted")))
    sound = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("conversation does not read back: "), F.col("conv_id").cast("string"))))
    return chats.select("conv_id", "formatted", sound.alias("turns"), "loss_spans")
