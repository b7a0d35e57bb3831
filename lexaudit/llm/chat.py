"""Chat formatting of reply trees with DataFrame functions.

Method
------
A reply tree is a table of nodes with parents. Iterative self-joins enumerate its root-to-leaf paths. First every node finds
the head of its chain (a root, or a child of a node with several children) by pointer jumping: each self-join doubles
the distance, so a chain of n nodes takes log2(n) joins. Then paths grow from the root chains by one chain per self-join, as
often as the deepest path branches. Branches are ranked per conversation by the mean score of their nodes (null: 0),
then length, then leaf; each of the best ``branches`` becomes one conversation.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|`` (in roles a line end also becomes ``\\n``), so that no control string can occur there, and all of it can be read back.
The loss mask is an array of spans (code points) that cover the texts of assistant turns.

Defined results: null texts and roles are empty. A parent that is not in its conversation makes its node a root.
Nodes on a cycle have no path to a root and are left out. Of rows that repeat a node the first in order of role and
text stays. Rows with a null conv_id form one conversation. A conversation is formatted within one row, so its texts together must fit a row. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import running
from .storage import Workspace

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def linear_tree(turns: DataFrame) -> DataFrame:
    """The nodes of conversations without branches: each turn answers the one before it. Repeated turns follow each other."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    nodes = turns.select("conv_id", "turn", "role", "text").withColumn("node_id", at)
    return nodes.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(None).cast("double").alias("score"))


def _paths(nodes: DataFrame, ws: Workspace) -> DataFrame:
    """(conv, leaf, path): the node ids of every path from a root to a leaf."""
    parents = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("known"))
    fans = nodes.where("parent is not null").groupBy("conv", "parent").agg((F.count("*") > 1).alias("fans"))
    linked = nodes.select("conv", "node", "parent").join(parents, ["conv", "parent"], "left").join(fans, ["conv", "parent"], "left")
    head = F.col("known").isNull() | F.col("fans")
    # jump: the farthest known node up the chain; done: it is the head
    steps = linked.select("conv", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), F.when(head, F.col("node")).otherwise(F.col("parent")).alias("jump"), F.when(head, 0).otherwise(1).cast("long").alias("far"), head.alias("done"))
    first = ws.save(steps, "jump-0")
    # a round joins only the nodes that are still open; what they look up also holds the nodes that are done
    current, settled, open_before, at = first, first.where("done"), -1, 0
    while (left := current.where("not done").count()) and left != open_before:
        up = settled.union(current.where("not done")).select("conv", F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("far").alias("more"), F.col("done").alias("reached"))
        steps = current.where("not done").join(up, ["conv", "jump"]).select("conv", "node", "parent", F.col("next").alias("jump"), (F.col("far") + F.col("more")).alias("far"), F.col("reached").alias("done"))
        open_before, at = left, at + 1
        current = ws.save(steps, f"jump-{at}")
        settled = settled.union(current.where("done"))
    steps = settled
    chains = steps.where("done").groupBy("conv", F.col("jump").alias("head")).agg(F.sort_array(F.collect_list(F.struct("far", "node"))).alias("nodes"))
    chains = chains.select("conv", "head", F.transform("nodes", lambda n: n["node"]).alias("nodes"), F.element_at("nodes", -1)["node"].alias("tail"))
    starts = first.where("jump = node").select("conv", F.col("node").alias("head"), "parent")
    chains = ws.save(chains.join(starts, ["conv", "head"]).select("conv", "nodes", "tail", "parent"), "chains")
    below = chains.where("parent is not null").select("conv", F.col("parent").alias("tail"), F.col("nodes").alias("more"), F.col("tail").alias("end"))
    paths, done, depth = ws.save(chains.where("parent is null").select("conv", "tail", F.col("nodes").alias("path")), "paths-0"), None, 0
    while True:
        grown = paths.join(below, ["conv", "tail"], "left")
        grown = ws.save(grown.select("conv", F.coalesce("end", "tail").alias("tail"), F.concat("path", F.coalesce("more", F.array().cast("array<bigint>"))).alias("path"), F.col("end").isNotNull().alias("grew")), f"grown-{depth}")
        finished = grown.where("not grew").select("conv", F.col("tail").alias("leaf"), "path")
        done = finished if done is None else done.union(finished)
        paths, depth = grown.where("grew").drop("grew"), depth + 1
        if paths.isEmpty():
            return done


def format_conversations(tree: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, branch (from 1), score, n_turns, formatted, loss (array of start, end): the best root-to-leaf paths of every conversation.

    ``tree`` has conv_id, node_id, parent_id, role, text and score.
    """
    ws = Workspace(tree.sparkSession, "chat")
    key = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    rows = tree.select(key.alias("conv"), F.col("node_id").cast("long").alias("node"), F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("parent_id").cast("long").alias("parent"), "score", "conv_id").alias("r"))
    nodes = rows.groupBy("conv", "node").agg(F.min("r").alias("r")).select("conv", "node", "r.*")
    nodes = ws.save(nodes, "nodes")
    paths = _paths(nodes, ws)
    turns = paths.select("conv", "leaf", F.posexplode("path").alias("at", "node")).join(nodes.drop("parent"), ["conv", "node"])
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    opening = F.concat(F.lit(START), role, F.lit("\n"))
    body = escape(F.col("text"))
    piece = F.struct("at", opening.alias("opening"), body.alias("body"), (F.col("role") == LEARNED_ROLE).alias("learned"))
    whole = turns.groupBy("conv", "leaf").agg(F.first("conv_id", ignorenulls=True).alias("conv_id"), F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    best = Window.partitionBy("conv").orderBy(F.desc("score"), F.desc("n_turns"), "leaf")
    chosen = whole.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    formatted = F.expr(f"array_join(transform(pieces, p -> concat(p.opening, p.body, '{END}\n')), '')")
    chosen = chosen.withColumn("ends", F.expr(running(f"transform(pieces, p -> cast(length(p.opening) + length(p.body) + {len(END) + 1} as bigint))", "acc + x", "0L")))
    spans = f"zip_with(pieces, ends, (p, e) -> struct(p.learned, e - {len(END) + 1} - length(p.body) AS start, e - {len(END) + 1} AS end))"
    loss = F.expr(f"transform(filter({spans}, s -> s.learned), s -> struct(s.start, s.end))")
    return chosen.select("conv_id", "branch", "score", "n_turns", formatted.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, read from the formatted text and its loss mask."""
    plain = lambda sql: rf"regexp_replace({sql}, '\\\\([\\\\|])', '$1')"
    role = r"array_join(transform(split(substring_index(t, '\n', 1), '\\\\\\\\', -1), x -> replace(replace(x, '\\n', '\n'), '\\|', '|')), '\\')"
    text = plain(rf"substring(t, length(substring_index(t, '\n', 1)) + 2, length(t) - length(substring_index(t, '\n', 1)) - 1 - {len(END) + 1})")
    pieces = r"slice(split(formatted, '<\\|im_start\\|>', -1), 2, n_turns_int)"
    # spans are read from parts of the text that hold about the root of their number
    width = "cast(ceil(sqrt(size(loss))) as int)"
    blocks = f"filter(transform(sequence(0, {width} - 1), c -> slice(loss, c * {width} + 1, {width})), b -> size(b) > 0)"
    held = f"transform({blocks}, b -> struct(substring(formatted, cast(b[0].start as int) + 1, cast(element_at(b, -1).end - b[0].start as int)) AS held, b[0].start AS at, b AS spans))"
    parts = f"transform({held}, p -> transform(p.spans, s -> substring(p.held, cast(s.start - p.at as int) + 1, cast(s.end - s.start as int))))"
    out = formatted.withColumn("n_turns_int", F.col("n_turns").cast("int"))
    out = out.withColumn("turns", F.expr(f"transform({pieces}, t -> struct({role} AS role, {text} AS text))"))
    joined = f"array_join(transform(flatten({parts}), t -> {plain('t')}), '')"
    return out.withColumn("loss_text", F.expr(f"CASE WHEN size(loss) > 0 THEN {joined} ELSE '' END")).drop("n_turns_int")
