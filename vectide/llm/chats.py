"""Chat formatting: collapse of cumulative snapshots, then rendering.

Loggers store a conversation again after every turn, so most logged conversations are a prefix of
a longer one. Each row gets rolling hashes of its conversation's turns so far: the running exclusive
or of position-keyed hashes of role and text, under two seeds (128 bits). A conversation whose hash
over all turns is the hash of a proper prefix of another falls by an anti-join; of equal
conversations that with the smallest id stays. Only what stays is gathered and rendered.

Turns are ordered by turn, then role and text, so repeated or missing turn numbers are no trouble.
A null role is "unknown", a null text is empty. A row without conversation id belongs to no other: it is a
conversation of one turn, and goes where another one begins with it; equal ones are counted before anything is shuffled.
Control strings inside a text are broken up, so that a text can't open or close a turn.
Missing turn numbers come first. Hot prefixes (a first turn that everyone shares) are made distinct before the join.
One conversation's turns meet in one task, as its rendering is one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import ident

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def maximal_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: conv_id (null where all its logs have none), n_turns, n_copies (equal logs, itself included), chat."""
    rows = turns.select(
        F.col(ident(conv_col)).alias("conv"),
        F.col(ident(turn_col)).alias("turn"),
        F.coalesce(F.col(ident(role_col)), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(ident(text_col)), F.lit("")).alias("text"),
    )
    hashes = lambda pos: [F.xxhash64(F.lit(seed), pos, "role", "text").alias(name) for name, seed in (("h1", 17), ("h2", 71))]
    shown = F.concat(F.lit(OPEN), "role", F.lit("\n"), F.replace(F.col("text"), F.lit("<|"), F.lit("< |")), F.lit(CLOSE + "\n"))
    single = rows.filter("conv is null").groupBy("role", "text").agg(F.count(F.lit(1)).alias("copies"))
    single = single.select(F.lit(1).alias("n"), *hashes(F.lit(1)), "copies", shown.alias("shown"))
    rows = rows.filter("conv is not null")

    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("conv")
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(whole).cast("int"))
    for name, h in zip(("h1", "h2"), hashes(F.col("pos")), strict=True):
        rows = rows.withColumn(name, F.bit_xor(h).over(so_far))
    prefixes = rows.filter("pos < n").select("pos", "h1", "h2").groupBy("pos", "h1", "h2").agg(F.lit(1).alias("any")).drop("any")
    nameless = single.select(F.lit(None).cast(rows.schema["conv"].dataType).alias("conv"), "n", "h1", "h2", "copies", "shown")
    ends = rows.filter("pos = n").select("conv", "n", "h1", "h2", F.lit(1).cast("long").alias("copies"), F.lit(None).cast("string").alias("shown")).unionByName(nameless)
    full = ends.groupBy("n", "h1", "h2").agg(F.min(F.struct(F.col("conv").isNull().alias("nameless"), "conv")).alias("least"), F.sum("copies").alias("n_copies"), F.max("shown").alias("shown"))
    kept = full.join(prefixes, (full["n"] == prefixes["pos"]) & (full["h1"] == prefixes["h1"]) & (full["h2"] == prefixes["h2"]), "left_anti").select(F.col("least.conv").alias("kept_conv"), "n_copies", "shown")
    turns = rows.select("conv", "n", "pos", shown.alias("shown")).join(kept.filter("kept_conv is not null").drop("shown"), F.col("conv") == F.col("kept_conv"))
    chat = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]))
    named = turns.groupBy("conv").agg(F.first("n").cast("long").alias("n_turns"), F.first("n_copies").alias("n_copies"), chat.alias("chat"))
    alone = kept.filter("kept_conv is null").select(F.col("kept_conv").alias("conv"), F.lit(1).cast("long").alias("n_turns"), "n_copies", F.col("shown").alias("chat"))
    return named.unionByName(alone).withColumnRenamed("conv", conv_col)
