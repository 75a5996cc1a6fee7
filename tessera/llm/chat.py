"""Conversations from reply trees, in DataFrame operations throughout.

Each turn is written ``### role: text</turn>`` and a newline. Inside roles and texts a backslash is
doubled, ``</turn>`` becomes ``<\\/turn>`` and ``##`` becomes ``#\\#``; roles also have ``:`` escaped as
``\\:``. No escaped string holds a control string, and dropping the backslash of each pair restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    marked = F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(marked, F.lit("##"), F.lit("#\\#"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/#:])", "$1")


def jump_tables(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestors by self-joins that double the distance each time, and each node's whole path score.

    Jump table k has (tree, node, anc, score) of the nodes with an ancestor 2^k steps up; ``score`` sums the
    node and those below ``anc``. Nodes whose path is done leave: only what is still open is joined again, so
    a chain of n turns takes log2(n) joins, of which other trees pay for their own depth only.
    """
    start = materialize(nodes.select("tree", "node", F.col("parent").alias("anc"), "score"), "reply-0")
    tables, done, deepest = [], start.filter("anc IS NULL"), start.count().bit_length()
    level = start.filter("anc IS NOT NULL")
    while level.take(1):
        if len(tables) > deepest:  # 2^deepest exceeds the number of nodes
            raise ValueError("parent links form a cycle")
        tables.append(level)
        up = level.unionByName(done).select(
            F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("anc").alias("_anc"), F.col("score").alias("_score")
        )
        met = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("anc") == F.col("_node"))
        joined = level.join(up, met).select("tree", "node", F.col("_anc").alias("anc"), (F.col("score") + F.col("_score")).alias("score"))
        joined = materialize(joined, f"reply-{len(tables)}")
        done, level = done.unionByName(joined.filter("anc IS NULL")), joined.filter("anc IS NOT NULL")
    return tables, done


def reply_paths(nodes: DataFrame, top_k: int | None = 1) -> DataFrame:
    """The root-to-leaf paths of each tree with the best scores: (tree, rank, leaf, score, steps_up, node).

    ``nodes`` has tree, node, parent (null: root), score double. A parent that is not in the tree counts
    as null; rows that repeat (tree, node) must agree and count once; a null score counts 0. Paths rank
    by the sum of scores, then by leaf; ``top_k`` None keeps all. Nodes without a tree belong to no common
    one: each of their paths ranks first. Nodes on a cycle have no root: an error. An empty table gives no
    paths; other columns are not read.
    """
    nodes = nodes.dropDuplicates(["tree", "node"])
    keys = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    known = nodes.join(keys, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("parent") == F.col("_node")), "left")
    clean = known.select("tree", "node", F.col("_node").alias("parent"), F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    clean = materialize(clean, "reply-nodes")
    tables, done = jump_tables(clean)
    inner = clean.filter("parent IS NOT NULL").select(F.col("tree").alias("_tree"), F.col("parent").alias("_node")).distinct()
    leaves = done.join(inner, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node")), "left_anti")
    by_score = Window.partitionBy("tree", F.when(F.col("tree").isNull(), F.col("node"))).orderBy(F.col("score").desc(), "node")
    ranked = leaves.select("tree", "node", "score").withColumn("rank", F.row_number().over(by_score))
    if top_k is not None:
        ranked = ranked.filter(F.col("rank") <= top_k)
    # Down the tables again: the set of steps up grows from {0} to all numbers below 2^levels.
    path = ranked.select("tree", "rank", F.col("node").alias("leaf"), "score", F.lit(0).cast("long").alias("steps_up"), "node")
    before = None
    for k in range(len(tables) - 1, -1, -1):
        path = materialize(path, "reply-path")
        if before is not None:
            release(before)
        before = path
        up = tables[k].select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "anc")
        more = path.join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node")))
        more = more.select("tree", "rank", "leaf", "score", (F.col("steps_up") + F.lit(1 << k)).alias("steps_up"), F.col("anc").alias("node"))
        path = path.unionByName(more)
    return path


def format_paths(turns: DataFrame, paths: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """One conversation per path: (tree, rank, leaf, score, formatted string, loss_spans).

    ``turns`` has tree, node, role, text (null: empty). ``loss_spans`` array<struct<start, length>> gives,
    in code points of ``formatted``, each escaped text of the learned role: the loss mask. A conversation
    is one value, so its turns meet in one row; texts are attached only to chosen paths. Paths without turns
    give no rows, nor do empty tables; other columns of ``turns`` are not carried.
    """
    written = turns.dropDuplicates(["tree", "node"]).select(
        F.col("tree").alias("_tree"),
        F.col("node").alias("_node"),
        F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit(BETWEEN)).alias("_head"),
        escape(F.coalesce("text", F.lit(""))).alias("_body"),
        F.coalesce(F.col("role") == learned_role, F.lit(False)).alias("_learned"),
    )
    joined = paths.join(written, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node")))
    turn = F.struct((-F.col("steps_up")).alias("at"), F.col("_head").alias("head"), F.col("_body").alias("body"), F.col("_learned").alias("learned"))
    whole = joined.groupBy("tree", "rank", "leaf", "score").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    spans = f"""aggregate(_turns,
        named_struct('at', 0, 'spans', CAST(array() AS array<struct<start: int, length: int>>)),
        (s, t) -> named_struct(
            'at', s.at + length(t.head) + length(t.body) + {len(CLOSE)},
            'spans', IF(t.learned, concat(s.spans, array(named_struct('start', s.at + length(t.head), 'length', length(t.body)))), s.spans)),
        s -> s.spans)"""
    text = F.array_join(F.transform("_turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return whole.select("tree", "rank", "leaf", "score", text.alias("formatted"), F.expr(spans).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` array<struct<role, text>> and ``loss_text``, parsed from formatted and loss_spans alone.

    Columns of these names are replaced; a null ``formatted`` gives nulls, an empty table an empty result.
    """
    parts = F.split("formatted", CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    role = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): (.*)$"
    turns = F.transform(
        parts,
        lambda p: F.struct(unescape(F.regexp_extract(p, role, 1)).alias("role"), unescape(F.regexp_extract(p, role, 2)).alias("text")),
    )
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(masked, ""))


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply chains: tree, node, parent, role, text, score.

    The node is the row's place by turn, then role and text, nulls first; so repeated turns stay, each as
    a turn of its own. Each row without a conv_id is a conversation of its own, under a number that differs from
    run to run: write the result before it is read twice. An empty table gives no turns; other columns are not
    carried.
    """
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = conversations.select("conv_id", "turn", "role", "text", alone.alias("_alone"))
    order = Window.partitionBy("conv_id", "_alone").orderBy("turn", "role", "text")
    rows = rows.withColumn("node", F.coalesce("_alone", F.row_number().over(order).cast("long")))
    parent = F.when(F.col("_alone").isNull() & (F.col("node") > 1), F.col("node") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))
