"""Reply trees to conversations: paths by iterated self-joins, branches ranked by score, one text per path.

``ancestors`` doubles its reach in every round: joined with itself, a table of the parents 2^k levels
up gives that of 2^(k+1) levels, and each round adds the ancestors of the leaves at twice the distances
known so far. So a path of n turns takes about log2(n) joins, and no row holds more than one turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fencewatch.sources.scratch import written

# The template's control strings: [INST] [/INST] [ROLE] [/ROLE] [/TEXT] <s> </s>. One inside a text gets a
# backslash after its first character, also where it has some already; reading takes one away.
_ESCAPE = re.compile(r"(?<=\[)(?=\\*(?:/?INST|/?ROLE|/?TEXT)\])|(?<=<)(?=\\*/?s>)")
_UNESCAPE = re.compile(r"(?<=\[)\\(?=\\*(?:/?INST|/?ROLE|/?TEXT)\])|(?<=<)\\(?=\\*/?s>)")
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>|\[ROLE\](?P<role>.*?)\[/ROLE\] (?P<text>.*?) \[/TEXT\]",
    re.DOTALL,
)
FORMATTED = "text string, loss_mask array<struct<start:int,end:int>>"
_MASK = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"\\", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub("", text)


def formatted_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and where in it (code points, end exclusive) the assistant speaks."""
    parts, mask, size = ["<s>"], [], 3
    for role, text in turns:
        body = escaped(text)
        if role == "assistant":
            mask.append((size + 1, size + 1 + len(body)))
            part = f" {body} </s>"
        elif role == "user":
            part = f"[INST] {body} [/INST]"
        else:
            part = f"[ROLE]{quote(role, safe='')}[/ROLE] {body} [/TEXT]"
        parts.append(part)
        size += len(part)
    return "".join(parts), mask


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns that a formatted text was made from."""
    turns, at = [], 3
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        if found["user"] is not None:
            turns.append(("user", unescaped(found["user"])))
        elif found["assistant"] is not None:
            turns.append(("assistant", unescaped(found["assistant"])))
        else:
            turns.append((unquote(found["role"]), unescaped(found["text"])))
        at = found.end()
    return turns


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, node_id, distance): for every leaf itself and all its ancestors.

    ``nodes`` has tree_id, node_id, parent_id. A node whose parent is null or not in its tree is a
    root. Nodes that hang on a cycle of replies have no root, and so no path.
    """
    ids = written(nodes.select("tree_id", "node_id", "parent_id"), "reply-ids")
    parents = ids.where(F.col("parent_id").isNotNull()).alias("n").join(
        ids.select("tree_id", "node_id").alias("p"),
        _same("n.tree_id", "p.tree_id") & (F.col("n.parent_id") == F.col("p.node_id")),
        "left_semi",
    )
    up = written(parents.select("tree_id", "node_id", F.col("parent_id").alias("above")), "reply-up")
    leaves = ids.alias("n").join(
        up.alias("u"), _same("n.tree_id", "u.tree_id") & (F.col("n.node_id") == F.col("u.above")), "left_anti"
    )
    paths = leaves.select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("distance"))
    largest = ids.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= largest and not up.isEmpty():
        higher = paths.alias("a").join(
            up.alias("u"), _same("a.tree_id", "u.tree_id") & (F.col("a.node_id") == F.col("u.node_id"))
        )
        more = higher.select("a.tree_id", "leaf_id", F.col("above").alias("node_id"), (F.col("distance") + reach).alias("distance"))
        paths = written(paths.unionByName(more), "reply-paths")
        twice = up.alias("a").join(
            up.alias("b"), _same("a.tree_id", "b.tree_id") & (F.col("a.above") == F.col("b.node_id"))
        )
        up = written(twice.select("a.tree_id", "a.node_id", F.col("b.above").alias("above")), "reply-up")
        reach *= 2
    return paths


def conversations(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The best branches of every reply tree, each as one formatted conversation.

    ``nodes`` has tree_id, node_id, parent_id, role, text, score. Gives tree_id, leaf_id, rank (from 1,
    by the sum of scores along the path, then the smaller leaf), n_turns, text and loss_mask. Null role,
    text and score count as empty and 0. Of several rows with one tree and node id the smallest
    (parent, role, text, score) counts; rows without node id are no node. A null tree_id is a tree of
    its own. Other columns are not read.
    """
    once = (
        nodes.where(F.col("node_id").isNotNull())
        .groupBy("tree_id", "node_id")
        .agg(
            F.min(
                F.struct(
                    "parent_id",
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                    F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
                )
            ).alias("n")
        )
        .select("tree_id", "node_id", "n.*")
    )
    once = written(once, "reply-nodes")
    roots = once.alias("n").join(
        once.select("tree_id", "node_id").alias("p"),
        _same("n.tree_id", "p.tree_id") & (F.col("n.parent_id") == F.col("p.node_id")),
        "left_anti",
    )
    narrow = once.select("tree_id", "node_id", "score").join(
        roots.select(F.col("tree_id").alias("t"), F.col("node_id").alias("r"), F.lit(1).alias("root")),
        _same("tree_id", "t") & (F.col("node_id") == F.col("r")),
        "left",
    )
    paths = leaf_paths(once)
    valued = paths.alias("a").join(
        narrow.select("tree_id", "node_id", "score", "root").alias("n"),
        _same("a.tree_id", "n.tree_id") & (F.col("a.node_id") == F.col("n.node_id")),
    )
    ranked = (
        valued.groupBy("a.tree_id", "leaf_id")
        .agg(F.sum("score").alias("score"), F.max("root").alias("root"))
        .where(F.col("root") == 1)
        .withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")))
        .where(F.col("rank") <= branches)
    )
    chosen = paths.alias("a").join(
        ranked.select("tree_id", "leaf_id", "rank").alias("r"),
        _same("a.tree_id", "r.tree_id") & (F.col("a.leaf_id") == F.col("r.leaf_id")),
    )
    turns = (
        chosen.select("a.*", "rank")
        .alias("a")
        .join(
            once.select("tree_id", "node_id", "role", "text").alias("n"),
            _same("a.tree_id", "n.tree_id") & (F.col("a.node_id") == F.col("n.node_id")),
        )
        .groupBy("a.tree_id", "leaf_id", "rank")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("at"), "role", "text"))).alias("turns"))
    )
    return formatted(turns)


def formatted(frame: DataFrame, turns: str = "turns") -> DataFrame:
    """The frame with text and loss_mask in place of its array of turns (structs with role and text)."""
    kept = [f for f in frame.schema.fields if f.name not in (turns, "text", "loss_mask", "n_turns")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(turns)).to_pylist()
            made = [formatted_turns([(t["role"] or "", t["text"] or "") for t in row or []]) for row in lists]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            masks = [[{"start": a, "end": b} for a, b in mask] for _, mask in made]
            columns += [
                pa.array([len(row or []) for row in lists], pa.int64()),
                pa.array([text for text, _ in made], pa.string()),
                pa.array(masks, _MASK),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "n_turns", "text", "loss_mask"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return frame.mapInArrow(run, f"{schema}, n_turns long, {FORMATTED}")


def read_back(frame: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, ``turns`` (role and text) and ``loss_text`` (what the mask covers, unescaped) of formatted rows."""
    kept = [f for f in frame.schema.fields if f.name in keys]
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["text", "loss_mask"]).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in read_turns(row["text"])] for row in rows]
            loss = ["".join(unescaped(row["text"][m["start"] : m["end"]]) for m in row["loss_mask"]) for row in rows]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            columns += [pa.array(turns, kind), pa.array(loss, pa.string()), pa.array([len(r["text"]) for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "turns", "loss_text", "formatted_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return frame.mapInArrow(
        run, f"{schema}, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long"
    )


def chain(turns: DataFrame) -> DataFrame:
    """Reply-tree nodes of plain conversations: each turn answers the one before it.

    Turns are ordered by turn, then role and text, so repeated rows are turns of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node_id"))
    return numbered.select(
        F.col("conv_id").alias("tree_id"),
        "node_id",
        F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"),
        "role",
        "text",
        F.when(F.col("role") == "assistant", 1.0).otherwise(0.0).alias("score"),
    )
