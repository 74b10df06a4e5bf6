"""Chat formatting with Spark expressions only.

Turn structs are collected and sorted per conversation; adjacent turns of one role are merged into one block, an aggregate of
the array of their texts; the output string is concatenated, with a loss mask of code-point spans over assistant texts. Where a turn's text
begins is a running sum over the conversation's rows, so that work grows with the number of turns and not with its square.

Template: a user block is `[INST] texts [/INST]`, an assistant block `<s> texts </s>`, a system block `[SYS] texts [/SYS]`,
any other role `[ROLE=base64 of role] texts [/ROLE]`; texts of a block are joined by `[+]`. A control string inside a text
gets one backslash after its opening bracket (one more if it has some), so no text contains a marker and unescape()
takes exactly one away. Null text: empty. Null role: the role ''. Equal turn numbers: ordered by role, then text; repeated
rows stay. Empty table: no rows. A conversation is one string, so it has to fit in one row; the number of conversations
and equal conversations need no care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What follows the opening bracket of a control string.
CONTROL = r"/?s>|/?INST\]|/?SYS\]|ROLE=|/ROLE\]|\+\]"
JOINT = "[+]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])(\\*(?:{CONTROL}))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*(?:{CONTROL}))", "$1$2")


def _opener(role: Column) -> Column:
    other = F.concat(F.lit("[ROLE="), F.base64(role.cast("binary")), F.lit("] "))
    return F.when(role == "user", "[INST] ").when(role == "assistant", "<s> ").when(role == "system", "[SYS] ").otherwise(other)


def _closer(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "assistant", " </s>").when(role == "system", " [/SYS]").otherwise(" [/ROLE]")


def format_chat(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, n_turns, n_blocks, formatted, loss_mask array of (start, length) in code points."""
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    in_order = Window.partitionBy("id").orderBy("turn", "role", "raw")
    role = F.col("role")
    begins, ends = ~role.eqNullSafe(F.lag(role).over(in_order)), ~role.eqNullSafe(F.lead(role).over(in_order))
    rows = rows.withColumns({"pos": F.row_number().over(in_order), "text": escape(F.col("raw")), "begins": begins, "ends": ends})
    head = F.when(F.col("begins"), F.char_length(_opener(role))).otherwise(F.char_length(F.lit(JOINT)))
    tail = F.when(F.col("ends"), F.char_length(_closer(role))).otherwise(F.lit(0))
    rows = rows.withColumns({"head": head, "chars": F.char_length("text"), "size": head + F.char_length("text") + tail})
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int") + F.col("head"))
    turn = F.struct("pos", "role", "text", "begins", "start", "chars")
    sorted_ = rows.groupBy("id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    # a block is a stretch of turns: from one that begins it up to the next that does
    firsts = F.transform(F.filter("t", lambda x: x["begins"]), lambda x: x["pos"])
    merged = lambda first, i: F.slice("t", first, F.coalesce(F.get("firsts", i + 1), F.size("t") + 1) - first)
    blocks = F.transform("firsts", lambda first, i: F.struct(F.get("t", first - 1)["role"].alias("role"), F.array_join(F.transform(merged(first, i), lambda x: x["text"]), JOINT).alias("text")))
    out = sorted_.withColumn("firsts", firsts).withColumn("blocks", blocks)
    return out.select(
        F.col("id").alias(id_col),
        F.size("t").cast("long").alias("n_turns"),
        F.size("blocks").cast("long").alias("n_blocks"),
        F.array_join(F.transform("blocks", lambda b: F.concat(_opener(b["role"]), b["text"], _closer(b["role"]))), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["chars"].alias("length"))).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds."""
    blocks = F.filter(F.split(formatted, r"(?<= \[/INST\]| </s>| \[/SYS\]| \[/ROLE\])"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = (
            F.when(b.startswith("[INST] "), "user").when(b.startswith("<s> "), "assistant").when(b.startswith("[SYS] "), "system")
            .otherwise(F.unbase64(F.regexp_extract(b, r"^\[ROLE=([^\]]*)\]", 1)).cast("string"))
        )
        head, tail = F.char_length(_opener(role)), F.char_length(_closer(role))
        body = F.substring(b, head + 1, F.char_length(b) - head - tail)
        return F.transform(F.split(body, r"\[\+\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
