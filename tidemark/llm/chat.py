"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned spans: the turns that begin and end in one
stretch of budget less history and system turn, and each turn that runs over the end of one by itself. A
window is the leading system turn, the turns just before the span within `history` tokens and the budget, and
the span's own turns. Only assistant
texts of the span itself are under the loss mask, so every assistant text is a target exactly once.
Defined cases: null text or role is empty; rows order by turn, then role, then text (nulls first), and
repeated rows are turns of their own; a turn that does not fit the budget with its system turn is a window with
that turn alone, uncut; a null
conv_id is a conversation; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import read

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(c: Column) -> Column:
    """Puts a backslash behind each <, [ and backslash: no control string survives inside a text."""
    return F.regexp_replace(c, r"([<\[\\])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])\\", "$1")


def count_tokens(c: Column) -> Column:
    """Word runs and single marks, a stand-in that needs no vocabulary."""
    return F.regexp_count(c, F.lit(r"\w+|[^\w\s]"))


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 192) -> DataFrame:
    """(conv_id, window, formatted, loss, n_turns, n_repeated, n_tokens).

    loss: array of (start, chars) in code points of formatted, from 0. n_repeated: how many leading turns
    were seen in an earlier window. One shuffle, by conversation; all later windows and groups refine it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    t = t.select(
        "conv_id",
        F.row_number().over(in_order).alias("pos"),
        (F.col("role") == "assistant").alias("answers"),
        ((F.col("role") == "system") & (F.row_number().over(in_order) == 1)).alias("leads"),
        (count_tokens(F.col("text")) + 3).cast("long").alias("tokens"),
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    t = t.withColumn("only", F.count("*").over(whole) == 1)
    own = F.when(F.col("leads"), F.lit(0)).otherwise(F.col("tokens"))
    t = t.withColumn("stride", F.greatest(F.lit(1), budget - history - F.max(F.when(F.col("leads"), F.col("tokens")).otherwise(F.lit(0))).over(whole)))
    t = t.withColumn("start", F.coalesce(F.sum(own).over(Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bucket = F.floor(F.col("start") / F.col("stride")).cast("long")
    over = F.col("start") + F.col("tokens") > (bucket + 1) * F.col("stride")
    t = t.withColumn("span", F.when(~F.col("leads"), bucket * 2 + over.cast("long")))
    t = t.withColumn("first", F.coalesce(F.min("span").over(whole), F.lit(0))).withColumn("last", F.coalesce(F.max("span").over(whole), F.lit(0)))
    t = t.withColumn("span", F.coalesce("span", "first"))
    until = F.when(F.col("leads"), F.col("last")).otherwise(F.least(F.col("last"), F.floor((F.col("start") + history) / F.col("stride")).cast("long") * 2 + 1))
    t = t.withColumn("window", F.explode(F.sequence(F.col("span"), F.greatest(F.col("span"), until))))
    t = t.withColumn("fresh", F.col("window") == F.col("span"))
    each = Window.partitionBy("conv_id", "window")
    own_turn = F.col("fresh") & ~F.col("leads")
    t = t.withColumn("from", F.min(F.when(own_turn, F.col("start"))).over(each))
    t = t.withColumn("room", budget - F.coalesce(F.sum(F.when(own_turn | F.col("leads"), F.col("tokens"))).over(each), F.lit(0)))
    alone = F.col("leads") & F.col("fresh") & F.col("only")
    near = F.col("start") >= F.col("from") - F.least(F.lit(history), F.col("room"))
    t = t.filter(F.when(F.col("from").isNull(), alone).otherwise(F.col("fresh") | F.col("leads") | near))
    segment = F.concat("head", "body", F.lit(END))
    before = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.length(segment)).over(before), F.lit(0)) + F.length("head"))
    target = F.col("fresh") & F.col("answers")
    return t.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", segment.alias("s")))), lambda x: x["s"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(target, F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("chars"))))).alias("loss"),
        F.count("*").alias("n_turns"),
        F.count_if(~F.col("fresh")).alias("n_repeated"),
        F.sum("tokens").alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Undo chat_windows from its texts alone: per conversation the digests of turns and loss texts."""
    parts = F.slice(F.split("formatted", r"<\|end\|>"), F.col("n_repeated").cast("int") + 1, (F.col("n_turns") - F.col("n_repeated")).cast("int"))
    line = F.transform(parts, lambda p: F.concat(unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)), F.lit("\n"), unescape(F.substring_index(p, TEXT, -1)), F.lit("\n")))
    under = F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), (x["start"] + 1).cast("int"), x["chars"].cast("int"))))
    each = windows.select("conv_id", "window", F.size(parts).alias("n"), F.array_join(line, "").alias("turns"), F.array_join(under, "").alias("under"), F.length("formatted").alias("chars"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda x: x[c]), "")
    whole = each.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), joined("turns").alias("t"), joined("under").alias("u"), F.sum("chars").cast("long").alias("formatted_chars"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return whole.select("conv_id", "n_turns", digest("t").alias("turns_sha256"), F.length("u").cast("long").alias("loss_chars"), digest("u").alias("loss_sha256"), "formatted_chars")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(chat_windows(turns))
