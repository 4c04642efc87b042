"""Chat formatting of reply trees.

A node has a tree, an id, a parent id, a role, a text and a score. Paths from root to leaf
are found by self-joins that double: round k joins what is known of each leaf's ancestors
with a table of 2^k-step jumps, so a path of n turns takes log2 n rounds however deep it is.
Branches are ranked by their mean score (then by length, then by leaf), and each chosen path
becomes one conversation.

The template is ``<s>`` and one block per turn::

    [INST] text [/INST]     user
    [SYS] text [/SYS]       system
    [ASST] text </s>        assistant, the only text under the loss mask
    [ROLE name] text [/ROLE]  any other role, its name escaped too

A control string in a text gets a backslash after its first character, and one that has
backslashes there already gets one more, so unescaping takes one away and every text comes
back as it was.

Defined results: null texts and roles are empty ones; a null tree id is a tree of its own;
a node whose parent is missing is a root; a path that ends in a cycle reaches no root and is
left out; a null node id takes no part; of several rows of one (tree, id) the first by parent,
role, text and score counts, while ``linear`` gives every row an id of its own; a very long text is
escaped whole, by the task that has its conversation; an empty table gives an empty one.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellstrata.runtime import cut, ship

#: The openers and closers of the template.
_OPEN = {"user": "[INST] ", "system": "[SYS] ", "assistant": "[ASST] "}
_CLOSE = {"user": " [/INST]", "system": " [/SYS]", "assistant": " </s>"}
_TAIL = r"/?s>|/?INST|/?SYS|/?ASST|/?ROLE"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAIL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAIL})")
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|\[SYS\] (.*?) \[/SYS\]|\[ASST\] (.*?) </s>|\[ROLE (.*?)\] (.*?) \[/ROLE\]", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[int]]:
    """The formatted conversation, and start, end, ... of what is under the loss mask, in code points."""
    out, at, mask = ["<s>"], 3, []
    for role, text in turns:
        role, text = role or "", escape(text or "")
        # a bracket in a role's name would end it early
        head = _OPEN.get(role) or f"[ROLE {escape(role).replace('%', '%25').replace(']', '%5D')}] "
        tail = _CLOSE.get(role, " [/ROLE]")
        if role == "assistant":
            mask += [at + len(head), at + len(head) + len(text)]
        out += [head, text, tail]
        at += len(head) + len(text) + len(tail)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation, as they were."""
    turns, at = [], 3
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}: {formatted[at:at + 40]!r}")
        at = m.end()
        user, system, assistant, name, other = m.groups()
        for role, text in (("user", user), ("system", system), ("assistant", assistant)):
            if text is not None:
                turns.append((role, unescape(text)))
        if other is not None:
            turns.append((unescape(name.replace("%5D", "]").replace("%25", "%")), unescape(other)))
    return turns


def linear(turns: DataFrame) -> DataFrame:
    """Nodes of a table of turns (conv_id, turn, role, text): each row replies to the one before it.

    Rows of equal turn are ordered by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text").select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )


def paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, mean_score, depth, node) for every node of the chosen root-to-leaf paths.

    ``branches``: how many paths of each tree are kept, all by default.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    slim = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = slim.select(F.col("tree").alias("pt"), F.col("node").alias("pn"))
    step = slim.join(known, same("tree", "pt") & (F.col("parent") == F.col("pn")), "left").select("tree", "node", F.col("pn").alias("up"), "score")
    step = cut(step.withColumn("most", F.count("*").over(Window.partitionBy("tree"))), "chat-steps")
    inner = step.where("up is not null").select(F.col("tree").alias("it"), F.col("up").alias("iu")).distinct()
    leaves = step.join(inner, same("tree", "it") & (F.col("node") == F.col("iu")), "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"), "score", F.col("up").isNull().alias("root"), "most")
    jump = step.select(F.col("tree").alias("jt"), F.col("node").alias("jn"), F.col("up").alias("ju")).where("ju is not null")
    gain = step.select(F.col("tree").alias("st"), F.col("node").alias("sn"), F.col("score").alias("ss"), F.col("up").isNull().alias("sr"))
    size, total = 1, None
    while True:
        more = (
            found.join(jump, same("tree", "jt") & (F.col("node") == F.col("jn")))
            .select("tree", "leaf", F.col("ju").alias("node"), (F.col("back") + size).alias("back"), "most")
            .where("back < most")  # no path is longer than its tree, but one round a cycle is
            .join(gain, same("tree", "st") & (F.col("node") == F.col("sn")))
            .select("tree", "leaf", "node", "back", F.col("ss").alias("score"), F.col("sr").alias("root"), "most")
        )
        found = cut(found.unionByName(more), "chat-paths")
        now = found.count()
        if now == total:
            break
        total = now
        twice = jump.select(F.col("jt").alias("kt"), F.col("jn").alias("kn"), F.col("ju").alias("ku"))
        jump = cut(jump.join(twice, same("jt", "kt") & (F.col("ju") == F.col("kn"))).select("jt", "jn", F.col("ku").alias("ju")), "chat-jumps")
        size *= 2
    one = Window.partitionBy("tree", "leaf")
    ranked = found.withColumns({"mean_score": F.avg("score").over(one), "turns": F.count("*").over(one), "ends": F.max("root").over(one)}).where("ends")
    ranked = ranked.withColumn("depth", F.col("turns") - 1 - F.col("back"))
    heads = ranked.where("back = 0").select("tree", "leaf", "mean_score", "turns")
    order = Window.partitionBy("tree").orderBy(F.desc("mean_score"), F.desc("turns"), "leaf")
    heads = heads.select(F.col("tree").alias("ht"), F.col("leaf").alias("hl"), F.row_number().over(order).alias("rank"))
    if branches is not None:
        heads = heads.where(F.col("rank") <= branches)
    return ranked.join(heads, same("tree", "ht") & (F.col("leaf") == F.col("hl"))).select("tree", "leaf", "rank", "mean_score", "depth", "node")


_OUT = T.StructType(
    [
        T.StructField("formatted", T.StringType()),
        T.StructField("loss_mask", T.ArrayType(T.LongType())),
    ]
)


def format_conversations(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_mask): one row per chosen path."""
    ship(nodes.sparkSession)
    first = Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score")
    nodes = nodes.where("node is not null").withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    path = paths(nodes, branches).alias("p")
    said = nodes.select(F.col("tree").alias("nt"), F.col("node").alias("nn"), "role", "text")
    turns = path.join(said, F.col("tree").eqNullSafe(F.col("nt")) & (F.col("node") == F.col("nn")))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def run(batches):
        for b in batches:
            made = [render([(t["role"], t["text"]) for t in x]) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.int64()))], ["tree", "leaf", "rank", *_OUT.names])

    return whole.mapInArrow(run, T.StructType([whole.schema["tree"], whole.schema["leaf"], whole.schema["rank"], *_OUT]))


def read_back(formatted: DataFrame) -> DataFrame:
    """The columns of ``formatted`` but the text, with roles and texts read from it, and the text under the loss mask."""
    cols = [c for c in formatted.columns if c not in _OUT.names]
    df = formatted.select(*cols, *_OUT.names)
    kinds = [df.schema[c] for c in cols]

    def run(batches):
        for b in batches:
            texts, masks = b.column(len(cols)).to_pylist(), b.column(len(cols) + 1).to_pylist()
            turns = [parse(x) for x in texts]
            lost = ["".join(unescape(x[s:e]) for s, e in zip(m[::2], m[1::2], strict=True)) for x, m in zip(texts, masks, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(cols)], pa.array([[{"role": r, "text": t} for r, t in x] for x in turns], _TURNS), pa.array(lost, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                [*cols, "turns", "loss_text", "formatted_chars"],
            )

    return df.mapInArrow(run, T.StructType([*kinds, T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))), T.StructField("loss_text", T.StringType()), T.StructField("formatted_chars", T.LongType())]))


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
