"""Chat formatting of reply trees, in DataFrame functions only.

Paths from root to leaf come from iterative self-joins that double their reach: after k rounds every
message knows its ancestor 2^k steps up and the score on the way, so a tree of depth d takes log d
rounds. Leaves are ranked by the score of their path; only the messages of the chosen paths are then
collected, by the same ancestors, and each path is written as one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.session import spool

# The template. A turn is HEAD, role, COLON, text, END; texts never hold END or HEAD.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Backslash before every backslash and ``#``, and inside ``</turn>``; undone by `unescape`."""
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#"))
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages ``tree, node, parent, score, role, text`` of linear conversations ``conv_id, turn,
    role, text``: every row answers the one before it, by turn, then role, then text."""
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    found = rows.select(F.col("conv_id").cast("long").alias("tree"), "turn",
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    found = found.withColumn("node", F.row_number().over(order).cast("long"))
    return found.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                        F.lit(0.0).alias("score"), "role", "text")


def chosen_paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """``key, leaf, rank, depth, node``: the messages of the ``top`` best paths of each tree (all if
    None), ``depth`` counting from the root. ``messages`` holds ``key, node, parent, score`` with
    unique ``(key, node)``; a parent that does not exist makes a root; messages whose parents run in
    a circle are on no path."""
    known = messages.select("key", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    nodes = messages.select("key", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    nodes = nodes.join(known, ["key", "parent"], "left").select(
        "key", "node", F.when(F.col("_there"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("steps"))
    nodes = spool(nodes)
    done, active = nodes.where("up IS NULL"), nodes.where("up IS NOT NULL")
    jumps = [active]
    most = messages.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    # a path longer than the tree has messages runs in a circle
    while (1 << (len(jumps) - 1)) <= most and not active.isEmpty():
        far = active.unionByName(done).select("key", F.col("node").alias("up"), F.col("up").alias("_up"),
                                              F.col("score").alias("_score"), F.col("steps").alias("_steps"))
        moved = spool(active.join(far, ["key", "up"]).select(
            "key", "node", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"),
            (F.col("steps") + F.col("_steps")).alias("steps")))
        # messages whose path is known take no further part
        done, active = done.unionByName(moved.where("up IS NULL")), moved.where("up IS NOT NULL")
        jumps.append(active)
    parents = jumps[0].select("key", F.col("up").alias("node"))
    leaves = done.join(parents, ["key", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "node"))
    leaves = leaves.select("key", F.col("node").alias("leaf"), "steps", rank.alias("rank"))
    rows = (leaves if top is None else leaves.where(F.col("rank") <= top)).select(
        "key", "leaf", "rank", F.col("steps").alias("depth"), F.col("leaf").alias("node"))
    for k, jump in enumerate(jumps[:-1]):
        step = jump.select("key", "node", "up")
        above = rows.join(step, ["key", "node"]).select(
            "key", "leaf", "rank", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("node"))
        # written every round: it is read twice by the next one, whose plan would double
        rows = spool(rows.unionByName(above))
    return rows


def format_trees(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """One row per chosen path of each tree: ``tree, leaf, rank, formatted, loss_mask``.

    ``messages`` holds ``tree, node, parent, score, role, text``. ``formatted`` is the conversation,
    ``loss_mask`` the spans ``start, end`` (code points of it, end exclusive, in order) of what
    assistants say, without marks of the template. Null roles and texts are empty, a null score is
    0, null trees are one tree; of rows with one ``(tree, node)`` the first by parent, role and text
    counts, a null node is a message of its own id space and is left out; ties of score go to the
    smaller leaf. Other columns are ignored. A tree is one conversation per path, so a path must fit
    into a string; trees are not split further.
    """
    rows = messages.where("node IS NOT NULL").select(
        F.col("tree").cast("long").alias("tree"), F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("key"),
        F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"),
        F.col("score").cast("double").alias("score"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    first = Window.partitionBy("key", "node").orderBy("parent", "role", "text")
    rows = spool(rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))
    head = F.concat(F.lit(HEAD), F.url_encode("role"), F.lit(COLON))
    body = escape(F.col("text"))
    path = Window.partitionBy("key", "leaf").orderBy("depth")
    turns = (chosen_paths(rows, top).join(rows.select("tree", "key", "node", "role", "text"), ["key", "node"])
             .withColumn("_piece", F.concat(head, body, F.lit(END)))
             .withColumn("_stop", F.sum(F.length("_piece").cast("long")).over(path) - len(END))
             .withColumn("_start", F.col("_stop") - F.length(body)))
    said = F.when(F.col("role") == LOSS_ROLE, F.struct(F.col("_start").alias("start"), F.col("_stop").alias("end")))
    parts = F.array_sort(F.collect_list(F.struct("depth", F.col("_piece").alias("piece"), said.alias("loss"))))
    found = turns.groupBy("key", "leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), parts.alias("_parts"))
    return found.select("tree", "leaf", "rank", F.array_join(F.col("_parts.piece"), "").alias("formatted"),
                        F.array_compact(F.col("_parts.loss")).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` rows with ``turns`` (array of ``role, text``) parsed from the string, and
    ``loss_text``: all text under the mask, unescaped."""
    pieces = F.split(F.col("formatted"), END)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        F.url_decode(F.regexp_extract(p, rf"^{HEAD}([^:]*){COLON}", 1)).alias("role"),
        unescape(F.regexp_replace(p, rf"^{HEAD}[^:]*{COLON}", "")).alias("text")))
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(
        F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", loss)
