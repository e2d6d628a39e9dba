"""Chat formatting of reply trees.

A message names its parent; a message whose parent is unknown starts a tree.
Root-to-leaf paths are found by iterative self-joins that double pointers:
after round k every message knows the ancestor 2**k steps up, and the number
and the score of the messages on the way.  The number of rounds is the
logarithm of the deepest path.  Branches (paths to leaves) are ranked by score
within their tree; only the chosen ones are written out, by cutting
a path in two at the largest kept pointer, round by round downwards, until
each piece is one message.  So space follows the messages and the chosen paths, not the lengths of
all paths.  Each chosen path is formatted as one conversation with the spans of its loss mask.

The template writes a turn as ``<s>[INST]role[/INST]text</s>``.  Inside roles
and texts ``\\``, ``<`` and ``[`` are escaped as ``\\\\``, ``\\l`` and ``\\b``, so no control
string can occur there and the original can be restored exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandcast.llm.common import prepare, written

HEAD, MIDDLE, END = "<s>[INST]", "[/INST]", "</s>"
_ESCAPES = str.maketrans({"\\": "\\\\", "<": "\\l", "[": "\\b"})
_BACK = {"\\": "\\", "l": "<", "b": "["}
_TURN = re.compile(r"<s>\[INST\]([^<\[]*)\[/INST\]([^<\[]*)</s>")


def escape(text: str) -> str:
    return text.translate(_ESCAPES)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the (start, end) code-point spans of assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = HEAD + escape(role or "") + MIDDLE, escape(text or "")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns that a formatted conversation holds."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def ranked_leaves(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((_tree, _leaf, _depth, _score, _rank), pointer tables) from (_tree, _msg, _parent, _score).

    Leaves are ranked within their tree by the total score of their path, then
    by id; ``_depth`` counts the path's messages.  Pointer table k has (_tree, _msg, _up): the
    ancestor 2**k steps up, for messages that have one.  Messages on a parent cycle or below one have no root and are left out."""
    m = written(messages.select("_tree", "_msg", "_parent", F.coalesce(F.col("_score").cast("double"), F.lit(0.0)).alias("_score")),
                "messages")
    ids = m.select(F.col("_tree").alias("_ti"), F.col("_msg").alias("_mi"))
    nodes = m.join(ids, F.col("_tree").eqNullSafe(F.col("_ti")) & (F.col("_parent") == F.col("_mi")), "left").select(
        "_tree", "_msg", F.col("_mi").alias("_up"), F.lit(1).cast("bigint").alias("_depth"), F.col("_score").alias("_sum"))
    nodes = written(nodes, "pointers")
    inner = nodes.filter("_up is not null").select(F.col("_tree").alias("_ti"), F.col("_up").alias("_mi")).distinct()
    leaves = written(nodes.join(inner, F.col("_tree").eqNullSafe(F.col("_ti")) & (F.col("_msg") == F.col("_mi")), "left_anti")
                     .select(F.col("_tree").alias("_ti"), F.col("_msg").alias("_mi")), "leaves")
    jumps = []
    open_ = nodes.filter("_up is not null").count()
    while open_:
        jumps.append(nodes.filter("_up is not null").select("_tree", "_msg", "_up"))
        above = nodes.select(F.col("_tree").alias("_ti"), F.col("_msg").alias("_mi"), F.col("_up").alias("_up2"),
                             F.col("_depth").alias("_depth2"), F.col("_sum").alias("_sum2"))
        done, todo = nodes.filter("_up is null"), nodes.filter("_up is not null")
        longer = todo.join(above, F.col("_tree").eqNullSafe(F.col("_ti")) & (F.col("_up") == F.col("_mi"))).select(
            "_tree", "_msg", F.col("_up2").alias("_up"), (F.col("_depth") + F.col("_depth2")).alias("_depth"),
            (F.col("_sum") + F.col("_sum2")).alias("_sum"))
        nodes = written(done.unionByName(longer), "pointers")
        left = nodes.filter("_up is not null").count()
        if left == open_:       # only messages without a root are left
            break
        open_ = left
    best = Window.partitionBy("_tree").orderBy(F.desc("_sum"), "_msg")
    ranked = (nodes.filter("_up is null")
              .join(leaves, F.col("_tree").eqNullSafe(F.col("_ti")) & (F.col("_msg") == F.col("_mi")), "left_semi")
              .select("_tree", F.col("_msg").alias("_leaf"), "_depth", F.col("_sum").alias("_score"), F.row_number().over(best).alias("_rank")))
    return ranked, jumps


def expanded(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(_tree, _rank, _pos, _msg): the messages of each leaf's path, from position 0 at the root.

    A piece is a message and how many messages of the path end in it; a piece of more than 2**k is
    cut at its pointer of table k, from the largest table down."""
    pieces = leaves.select("_tree", "_rank", F.col("_leaf").alias("_msg"), (F.col("_depth") - 1).alias("_pos"), F.col("_depth").alias("_n"))
    for k in range(len(jumps) - 1, -1, -1):
        step = 1 << k
        up = jumps[k].select(F.col("_tree").alias("_ti"), F.col("_msg").alias("_mi"), "_up")
        on = F.col("_tree").eqNullSafe(F.col("_ti")) & (F.col("_msg") == F.col("_mi"))
        long = pieces.filter(F.col("_n") > step).join(up, on).select("_tree", "_rank", F.explode(F.array(
            F.struct(F.col("_msg"), F.col("_pos"), F.lit(step).cast("bigint").alias("_n")),
            F.struct(F.col("_up").alias("_msg"), (F.col("_pos") - step).alias("_pos"), (F.col("_n") - step).alias("_n")))).alias("x"))
        pieces = written(pieces.filter(F.col("_n") <= step).unionByName(long.select("_tree", "_rank", "x.*")), "path-pieces")
    return pieces.drop("_n")


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """(_tree, _leaf, _path, _score, _rank) of all paths, ``_path`` listing the messages from root to leaf."""
    leaves, jumps = ranked_leaves(messages)
    leaves = written(leaves, "ranked-leaves")
    paths = expanded(leaves, jumps).groupBy("_tree", "_rank").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_msg"))), lambda x: x["_msg"]).alias("_path"))
    paths = paths.select(F.col("_tree").alias("_ti"), F.col("_rank").alias("_ri"), "_path")
    return leaves.join(paths, F.col("_tree").eqNullSafe(F.col("_ti")) & (F.col("_rank") == F.col("_ri"))) \
        .select("_tree", "_leaf", "_path", "_score", "_rank")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        made = [format_turns([(t["_role"], t["_text"]) for t in turns]) for turns in b.column("_turns").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("_tree"), b.column("_rank"), pa.array([x for x, _ in made], pa.string()),
             pa.array([[{"start": s, "end": e} for s, e in y] for _, y in made], span)],
            ["_tree", "_rank", "_formatted", "_loss"])


def format_reply_trees(messages: DataFrame, tree_col: str, msg_col: str, parent_col: str, role_col: str, text_col: str,
                       score: Column | None = None, branches: int | None = 1) -> DataFrame:
    """(tree, ``branch`` 1.., ``formatted``, ``loss_spans``): the best ``branches`` paths of every tree (None: all).

    Message ids are unique within their tree.  Null roles and texts count as
    empty; null scores as 0; a null parent, or one that does not exist, makes
    a root; several roots of a tree are branches of it; equal scores rank by
    leaf id.  Messages on or below a parent cycle are left out, as they have
    no root.  Null tree ids form one tree.  An empty table gives an empty
    result; other columns are not read.
    """
    prepare(messages.sparkSession)
    tree_type = messages.schema[tree_col].dataType.simpleString()
    m = messages.select(F.col(tree_col).alias("_tree"), F.col(msg_col).alias("_msg"), F.col(parent_col).alias("_parent"),
                        F.col(role_col).alias("_role"), F.col(text_col).alias("_text"),
                        (F.lit(0.0) if score is None else score).alias("_score"))
    leaves, jumps = ranked_leaves(m)
    if branches is not None:
        leaves = leaves.filter(F.col("_rank") <= branches)
    steps = expanded(written(leaves, "chosen-leaves"), jumps).select(F.col("_tree").alias("_t2"), "_rank", "_pos", F.col("_msg").alias("_m2"))
    turns = (steps.join(m.select("_tree", "_msg", "_role", "_text"),
                        F.col("_tree").eqNullSafe(F.col("_t2")) & (F.col("_msg") == F.col("_m2")))
             .groupBy("_tree", "_rank").agg(F.sort_array(F.collect_list(F.struct("_pos", "_role", "_text"))).alias("_turns")))
    out = f"_tree {tree_type}, _rank int, _formatted string, _loss array<struct<start:int,end:int>>"
    return turns.mapInArrow(_format, out).toDF(tree_col, "branch", "formatted", "loss_spans")


def conversation_messages(conversations: DataFrame, chunk: int = 1000) -> DataFrame:
    """A turn table as reply trees: each row answers the one before it.
    Rows that share a turn number follow each other by role and text.

    Rows are numbered within chunks of turn numbers and moved on by the counts of
    the chunks before, so a long conversation is not one task's."""
    part = F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 62))).alias("_part")       # null turns come first
    rows = conversations.select("conv_id", "turn", "role", "text", part)
    counts = rows.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("_ci"), F.col("_part").alias("_pi"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("conv_id", "_part").orderBy("turn", "role", "text")
    numbered = rows.withColumn("_at", F.row_number().over(order)).join(
        counts, F.col("conv_id").eqNullSafe(F.col("_ci")) & (F.col("_part") == F.col("_pi"))) \
        .select("conv_id", "role", "text", (F.col("_before") + F.col("_at")).alias("msg"))
    return numbered.withColumn("parent", F.when(F.col("msg") > 1, F.col("msg") - 1))
