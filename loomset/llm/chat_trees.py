"""Chat formatting of reply trees, with DataFrame functions only.

A tree is rows (tree_id, node_id, parent_id, role, text, score). Iterative self-joins double each node's pointer to an
ancestor, adding up score and depth, so a path of n turns takes about log2(n) joins, and no step holds whole paths.
Leaves are branches; they are ranked in their tree by the score summed up from the root (then by depth, then by node).
The chosen leaves walk back over the same pointers, which names every turn of their path once, and each path is
formatted as one conversation.

Template: a turn of the assistant is ``<s>text</s>``; any other turn is ``[INST]role[ROLE]text[/INST]``. Inside texts and
roles a backslash is doubled and a backslash is put behind the first character of every control string, so no control
string of the template stands in a text, and dropping each escaping backslash gives the text back. The loss mask has the
assistant's texts, as (start, length) in code points of the formatted string.

Joins and counts run on (tree, node), so a tree that holds a third of all rows is spread over all tasks; what one task
must hold is a path, which is one output row.

Defined cases: rows without tree_id or node_id take no part; of rows with equal (tree_id, node_id) the smallest
(parent_id, role, text, score) is taken; a null or unknown parent makes a root; nodes on or under a cycle belong to no
path; null text is empty, null role is the empty role, null score is 0; a root without replies is a path of one turn;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomset.llm.common import materialise

ASSISTANT = "assistant"
_CONTROL_START = r"([<\[])(?=/?s>|/?INST\]|ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL_START, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _clean(nodes: DataFrame) -> DataFrame:
    body = F.struct("parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = nodes.where("tree_id is not null and node_id is not null").groupBy("tree_id", "node_id").agg(F.min(body).alias("body"))
    return rows.select("tree_id", "node_id", "body.*")


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``tree_id, branch`` (rank from 1), ``branch_score, place`` (from 0), ``role, text`` of the best branches of every tree."""
    clean = materialise(_clean(nodes))
    known = clean.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    linked = clean.select("tree_id", "node_id", "parent_id", "score").join(known, ["tree_id", "parent_id"], "left")
    linked = linked.withColumn("up", F.expr("if(known, parent_id, null)"))
    # up: the ancestor 2 ** k above; total and turns: what lies from the node to below that ancestor
    state = materialise(linked.select("tree_id", "node_id", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("turns")))
    parents = state.where("up is not null").select("tree_id", F.col("up").alias("node_id"))
    done, still = state.where("up is null"), state.where("up is not null")
    jumps: list[DataFrame] = []
    before = None
    while True:
        number = still.count()
        if not number or number == before:  # every path has met its root; what is left circles
            break
        before = number
        jumps.append(still.select("tree_id", "node_id", "up"))
        above = done.unionByName(still).select(
            "tree_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("turns").alias("further")
        )
        moved = still.join(above, ["tree_id", "up"]).select(
            "tree_id", "node_id", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("turns") + F.col("further")).alias("turns")
        )
        moved = materialise(moved)  # paths that have met their root take no further part
        done, still = done.unionByName(moved.where("up is null")), moved.where("up is not null")
    leaves = done.join(parents, ["tree_id", "node_id"], "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc("total"), F.desc("turns"), "node_id")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches)
    members = materialise(chosen.select("tree_id", "branch", F.col("total").alias("branch_score"), "node_id", (F.col("turns") - 1).alias("place")))
    for k in reversed(range(len(jumps))):  # each ancestor once: its distance in binary
        more = members.join(jumps[k], ["tree_id", "node_id"]).select("tree_id", "branch", "branch_score", F.col("up").alias("node_id"), (F.col("place") - (1 << k)).alias("place"))
        members = materialise(members.unionByName(more))
    return members.join(clean.select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"]).drop("node_id")


def format_paths(paths: DataFrame) -> DataFrame:
    """One row per (tree_id, branch): ``branch_score, n_turns, formatted`` and ``loss_mask`` (array of start, length)."""
    is_loss = F.col("role") == ASSISTANT
    marked = F.when(is_loss, F.concat(F.lit("<s>"), escape(F.col("text")), F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), escape(F.col("role")), F.lit("[ROLE]"), escape(F.col("text")), F.lit("[/INST]"))
    )
    rows = paths.select("tree_id", "branch", "branch_score", "place", is_loss.alias("is_loss"), marked.alias("marked"))
    before = Window.partitionBy("tree_id", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("marked")).over(before), F.lit(0)))
    turns = F.sort_array(F.collect_list(F.struct("place", "start", "is_loss", "marked")))
    grouped = rows.groupBy("tree_id", "branch").agg(F.first("branch_score").alias("branch_score"), turns.alias("turns"))
    opening, closing = len("<s>"), len("</s>")
    span = lambda t: F.struct((t["start"] + opening).alias("start"), (F.char_length(t["marked"]) - opening - closing).cast("long").alias("length"))
    return grouped.select(
        "tree_id",
        "branch",
        "branch_score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["marked"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["is_loss"]), span).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    marks = F.regexp_extract_all(formatted, F.lit(r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"), F.lit(0))

    def turn(mark: Column) -> Column:
        inner = F.substring(mark, F.lit(7), F.char_length(mark) - 13)  # between [INST] and [/INST]
        role = F.substring_index(inner, "[ROLE]", 1)
        text = F.substring(inner, F.char_length(role) + 7, F.char_length(inner))
        answer = F.substring(mark, F.lit(4), F.char_length(mark) - 7)
        loss = F.startswith(mark, F.lit("<s>"))
        return F.struct(
            F.when(loss, F.lit(ASSISTANT)).otherwise(unescape(role)).alias("role"), unescape(F.when(loss, answer).otherwise(text)).alias("text")
        )

    return F.transform(marks, turn)


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    pieces = F.transform(loss_mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(pieces, "")


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    return format_paths(best_paths(nodes, branches))


def chain(rows: DataFrame, tree: str, turn: str) -> DataFrame:
    """Rows of linear conversations as trees: every turn replies to the one before (ties by role and text), each scores 1."""
    order = Window.partitionBy(tree).orderBy(F.col(turn).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = rows.select(F.col(tree).alias("tree_id"), "role", "text", F.row_number().over(order).cast("long").alias("node_id"))
    return numbered.select("tree_id", "node_id", F.expr("nullif(node_id - 1, 0)").alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from ``formatted`` and ``loss_mask``."""
    parsed = formatted.select("tree_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: both turns say the template's own control strings."""
    return spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
