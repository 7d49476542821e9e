"""Chat formatting of reply trees, in DataFrame operations only.

Messages point at their parents. Pointer-doubling self-joins (jump tables of 1, 2, 4, ... replies) give
every leaf its depth and the score of its whole branch in log2(depth) rounds; branches are ranked within
their conversation and only the chosen leaves are expanded, by the same jump tables, to one row per
message of the path. Every row of these joins is keyed by conversation and message, so one very large
tree is spread over all tasks. At last each path is gathered into its one formatted string.

Template: <|im_start|>role LF text <|im_end|> LF. Inside texts a backslash is doubled and `<|` becomes
`<\\|`; inside roles a line feed is written \\n as well. Control strings therefore never occur in texts, and
reading a formatted string back gives the roles and texts exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_saved, save

START, END = "<|im_start|>", "<|im_end|>"
#: Role whose texts the loss counts.
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    pairs = F.split(F.replace(role, F.lit("<\\|"), F.lit("<|")), r"\\\\")
    return F.array_join(F.transform(pairs, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def as_chain(rows: DataFrame) -> DataFrame:
    """Conversations by turn as trees of one branch: conv_id, msg_id, parent_id, score, role, text.

    Messages are numbered by turn, null turns first; equal turns by role, then text. Null roles and
    texts become empty. A null conv_id is a conversation of its own.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    msg = F.row_number().over(order).cast("long")
    return rows.select("conv_id", msg.alias("msg_id"), "role", "text").select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """conv_id, leaf_id, depth, back (replies between the message and the leaf), branch_score, rank and msg_id: one row
    per message of each chosen root-to-leaf path.

    messages: conv_id, msg_id (ascending with time within a conversation), parent_id, score. Rows that repeat a
    msg_id are one message, with the smallest parent and its score (in format_paths: the smallest role and its text).
    A parent that is null, missing or not earlier than its reply makes the reply a root, so there are no
    cycles. Null scores count 0. Of each conversation the `branches` best paths by summed score are
    chosen, all if None (rank is then null); ties go to the smaller leaf.
    """
    own = messages.select("conv_id", "msg_id", F.when(F.col("parent_id") < F.col("msg_id"), F.col("parent_id")).alias("_up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("_score"))
    own = own.groupBy("conv_id", "msg_id").agg(F.min(F.struct("_up", "_score")).alias("_r")).select("conv_id", "msg_id", "_r._up", "_r._score")
    ids = own.select(F.col("conv_id").alias("_c"), F.col("msg_id").alias("_m"))
    own = own.join(ids, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_up") == F.col("_m")), "left").drop("_c", "_up").withColumnRenamed("_m", "_up")
    # Jump table k: the message 2**k replies up, with how many messages and how much score the jump passes.
    # Messages whose jump leaves the tree are done and take no part in later rounds.
    jumps, done = [save(own.withColumn("_n", F.lit(1).cast("long")))], None
    while True:
        low, over = jumps[-1].filter("_up is not null"), jumps[-1].filter("_up is null")
        done = over if done is None else done.unionByName(over)
        if low.isEmpty():
            break
        high = done.unionByName(low).select(F.col("conv_id").alias("_c"), F.col("msg_id").alias("_m"), F.col("_up").alias("_up2"), F.col("_score").alias("_s2"), F.col("_n").alias("_n2"))
        both = low.join(high, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_up") == F.col("_m")))
        jumps.append(save(both.select("conv_id", "msg_id", F.col("_up2").alias("_up"), (F.col("_score") + F.col("_s2")).alias("_score"), (F.col("_n") + F.col("_n2")).alias("_n"))))
    parents = jumps[0].filter("_up is not null").select(F.col("conv_id").alias("_c"), F.col("_up").alias("_m"))
    total = done.select("conv_id", F.col("msg_id").alias("leaf_id"), F.col("_score").alias("branch_score"), F.col("_n").alias("depth"))
    leaves = total.join(parents, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("leaf_id") == F.col("_m")), "left_anti")
    if branches is None:
        leaves = leaves.withColumn("rank", F.lit(None).cast("int"))
    else:
        order = [F.col("branch_score").desc(), F.col("leaf_id").asc()]
        # First within shares of a conversation, then over the few that are left of each share.
        leaves = leaves.withColumn("_share", F.pmod(F.xxhash64("leaf_id"), F.lit(64)))
        leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "_share").orderBy(*order))).filter(F.col("rank") <= branches)
        leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).filter(F.col("rank") <= branches).drop("_share")
    found = leaves.withColumn("msg_id", F.col("leaf_id")).withColumn("back", F.lit(0).cast("long"))
    for k in range(len(jumps) - 2, -1, -1):
        # Longest jumps first: each message of a path gets the one 2**k above it, where there is one.
        jump = jumps[k].filter("_up is not null").select(F.col("conv_id").alias("_c"), F.col("msg_id").alias("_m"), "_up")
        up = found.join(jump, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("msg_id") == F.col("_m")))
        up = up.withColumn("msg_id", F.col("_up")).withColumn("back", F.col("back") + (1 << k)).select(*found.columns)
        before, found = found, save(found.unionByName(up))
        if hasattr(before, "_saved_at"):
            drop_saved(before)
    if hasattr(found, "_saved_at"):
        drop_saved(*jumps)
    return found


def format_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per chosen path: conv_id, leaf_id, rank, branch_score, formatted, and loss, the code-point
    ranges of formatted that the loss counts, the texts of LOSS_ROLE: start (from 0) and length, and the same start as
    a turn's number and how far (skip) into the turn it lies.

    An empty table gives an empty table; empty texts format as empty turns. A path ends up in one row,
    so its text must fit one string; work and memory grow in proportion to its length.
    """
    found = paths(messages, branches)
    turns = messages.select(F.col("conv_id").alias("_c"), F.col("msg_id").alias("_m"), escape_role(F.coalesce("role", F.lit(""))).alias("_role"), escape(F.coalesce("text", F.lit(""))).alias("_text"), (F.col("role") == LOSS_ROLE).alias("_loss"))
    turns = turns.groupBy("_c", "_m").agg(F.min(F.struct("_role", "_text", "_loss")).alias("_t")).select("_c", "_m", "_t.*")
    rows = found.join(turns, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("msg_id") == F.col("_m")))
    head = F.concat(F.lit(START), "_role", F.lit("\n"))
    rows = rows.select("conv_id", "leaf_id", "rank", "branch_score", "back", F.concat(head, "_text", F.lit(f"{END}\n")).alias("_turn"), F.length(head).alias("_skip"), F.length("_text").alias("_size"), F.coalesce("_loss", F.lit(False)).alias("_loss"))
    path = Window.partitionBy("conv_id", "leaf_id").orderBy(F.col("back").desc())
    rows = rows.withColumn("_at", F.sum(F.length("_turn")).over(path) - F.length("_turn")).withColumn("_no", F.row_number().over(path) - 1)
    span = F.struct(F.col("_no").alias("turn"), (F.col("_at") + F.col("_skip")).alias("start"), F.col("_skip").alias("skip"), F.col("_size").cast("long").alias("length"))
    turn = F.struct(F.col("_no").alias("no"), F.col("_turn").alias("turn"))
    whole = rows.groupBy("conv_id", "leaf_id", "rank", "branch_score").agg(F.array_sort(F.collect_list(turn)).alias("_turns"), F.array_sort(F.collect_list(F.when(F.col("_loss"), span))).alias("loss"))
    return whole.select("conv_id", "leaf_id", "rank", "branch_score", F.array_join(F.col("_turns.turn"), "").alias("formatted"), "loss")


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted string as they stand there, each without its START."""
    return F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array of role and text, as they were before escaping."""
    return F.transform(turns_of(formatted), lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)).alias("text"),
    ))


def digests(formatted: DataFrame) -> DataFrame:
    """Per path, read back from formatted and its loss ranges: counts and digests of turns and loss text."""
    # A range is cut from its own turn: cutting each from the start of the whole string would be quadratic.
    read = formatted.select("conv_id", "leaf_id", "formatted", "loss", parse(F.col("formatted")).alias("_turns"), turns_of(F.col("formatted")).alias("_parts"))
    under = lambda s: unescape(F.substring(F.get("_parts", s["turn"]), s["skip"] - len(START) + 1, s["length"].cast("int")))
    read = read.select("conv_id", "leaf_id", "formatted", "_turns", F.array_join(F.transform("loss", under), "").alias("_loss"))
    flat = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
