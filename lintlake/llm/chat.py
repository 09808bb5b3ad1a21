"""Chat formatting from reply trees. DataFrame functions only.

paths()   enumerates root-to-leaf paths by self-joins that double their reach: the table of 2^k-th ancestors is joined with
            itself, and each leaf's set of ancestors with each such table, so a thread of depth d takes log2(d) rounds.
rank()    orders a tree's branches by their mean message score and keeps the best.
format()  renders every chosen path as one conversation, with the spans of assistant texts as loss mask.

A turn is `<turn>role`, a newline, the text and `</turn>` with a newline. Inside role and text a backslash becomes \\b and `<`
becomes \\l (in roles a newline becomes \\n), so no control string can appear in them, and reading back is exact.

Defined results: null texts and roles are empty strings; a parent that is null or not in the tree makes a root; messages that
repeat an id are siblings under the same id only once (the first by role and text is kept); messages in a ring of replies, and
those below one, have no root and are left out, whatever the ring's length; a null tree id is a tree of its own; empty tables give empty results; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.llm.common import cut

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column, line: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line else out


def unescape(text: Column, line: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if line else text
    return F.replace(F.replace(out, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, id, up): every message of every root-to-leaf path, `up` steps above the leaf.

    messages: tree, id, parent (ids unique within a tree). First the tables of 2^k-th ancestors are made; who still has one when 2^k
    exceeds the tree's replies hangs on a ring and goes before any path is begun.
    """
    nodes = messages.select("tree", "id", "parent")
    known = nodes.select("tree", F.col("id").alias("parent"))
    jumps = [cut(nodes.where(F.col("parent").isNotNull()).join(known, ["tree", "parent"], "left_semi").select("tree", "id", F.col("parent").alias("above")))]
    longest = jumps[0].groupBy("tree").count().agg(F.max("count").alias("n")).first()["n"] or 0
    while (1 << (len(jumps) - 1)) <= longest:
        on = jumps[-1].select("tree", F.col("id").alias("above"), F.col("above").alias("next"))
        further = cut(jumps[-1].join(on, ["tree", "above"]).select("tree", "id", F.col("next").alias("above")))
        if further.isEmpty():
            break
        jumps.append(further)
    if (1 << (len(jumps) - 1)) > longest > 0:
        rootless = jumps.pop().select("tree", "id")
        nodes = nodes.join(rootless, ["tree", "id"], "left_anti")
        jumps = [j.join(rootless, ["tree", "id"], "left_anti") for j in jumps]
    inner = jumps[0].select("tree", F.col("above").alias("id")).distinct()
    found = nodes.join(inner, ["tree", "id"], "left_anti").select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):
        higher = found.join(jump, ["tree", "id"]).select("tree", "leaf", F.col("above").alias("id"), (F.col("up") + (1 << k)).alias("up"))
        found = cut(found.unionByName(higher))
    return found


def rank(walks: DataFrame, messages: DataFrame, most: int) -> DataFrame:
    """walks of the `most` best leaves of each tree: highest mean score (null counts 0), then smallest leaf id."""
    scored = walks.join(messages.select("tree", "id", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "id"])
    branches = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"))
    order = W.partitionBy("tree").orderBy(F.col("branch_score").desc(), "leaf")
    best = branches.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= most)
    return walks.join(best, ["tree", "leaf"])


def conversations(messages: DataFrame, most: int = 1, tree_col: str = "tree", id_col: str = "id", parent_col: str = "parent", role_col: str = "role", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """(tree, leaf, branch, branch_score, formatted, loss_spans): one row for each of the `most` best paths of each tree.

    loss_spans: array of (start, length) in code points of formatted, one for every assistant text, in order.
    """
    key = F.coalesce(F.concat(F.lit("t"), F.col(tree_col).cast("string")), F.lit("null"))
    rows = messages.select(key.alias("tree"), F.col(tree_col).alias("tree_id"), F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.col(score_col).cast("double").alias("score"))
    once = W.partitionBy("tree", "id").orderBy("role", "text")
    rows = cut(rows.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth"))
    chosen = rank(paths(rows), rows, most).join(rows.select("tree", "tree_id", "id", "role", "text"), ["tree", "id"])
    head = F.concat(F.lit(OPEN), escape(F.col("role"), line=True), F.lit("\n"))
    body = escape(F.col("text"))
    down = W.partitionBy("tree", "leaf").orderBy(F.col("up").desc())
    turns = (
        chosen.select("tree", "tree_id", "leaf", "branch", "branch_score", "up", "role", head.alias("head"), body.alias("body"))
        .withColumn("shown", F.concat("head", "body", F.lit(CLOSE)))
        .withColumn("end", F.sum(F.length("shown")).over(down))
        .withColumn("start", F.col("end") - F.length("shown") + F.length("head"))
    )
    turn = F.struct((-F.col("up")).alias("at"), "shown", F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length"))).alias("span"))
    return (
        turns.groupBy("tree", "leaf", "branch", "branch_score")
        .agg(F.first("tree_id").alias("tree_id"), F.sort_array(F.collect_list(turn)).alias("turns"))
        .select(F.col("tree_id").alias(tree_col), "leaf", "branch", "branch_score", F.array_join(F.col("turns.shown"), "").alias("formatted"), F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"))
    )


def threads(rows: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by turn, role and text."""
    order = W.partitionBy(tree_col).orderBy(turn_col, role_col, text_col)
    placed = rows.select(tree_col, turn_col, role_col, text_col).withColumn("id", F.row_number().over(order).cast("long"))
    return placed.select(F.col(tree_col).alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.lit(0.0).alias("score"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    shown = F.filter(F.split(formatted, "</turn>\n"), lambda s: s != "")

    def turn(s: Column) -> Column:
        inside = F.substring(s, len(OPEN) + 1, 2147483647)
        role = F.substring_index(inside, "\n", 1)
        return F.struct(unescape(role, line=True).alias("role"), unescape(F.substr(inside, F.length(role) + 2)).alias("text"))

    return F.transform(shown, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


#: The digests straight from the rows, in DuckDB.
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, '<turn>' || replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n') || chr(10)
               || replace(replace(text, '\', '\b'), '<', '\l') || '</turn>' || chr(10) AS shown FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(shown)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
