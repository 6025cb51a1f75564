"""Chat formatting: reply trees to training conversations.

Messages name their parent. Iterative self-joins double the reach of every message's ancestor
pointer, so a path of any depth is enumerated in about log2(depth) joins: depth, root and the summed
score of each root-to-leaf path come with the pointers. Leaves are ranked by score within their
root; the pointers of the chosen leaves are then expanded, level by level, to all messages of their
paths. Every level is written to the shared folder. Texts join once, at the end, where one
conversation becomes one row.

Template: ``<|im_start|>role``, a newline, the text, ``<|im_end|>`` and a newline. Inside roles and
texts ``&``, ``<`` and ``[`` (and a role's newlines) become character references, so no control
string of any common template survives there; reading back undoes them in reverse order.

The loss mask is a list of (turn, start, end): code points within that turn's part of the output.

Defined results: null roles and texts are empty; a parent that is null or not in the table makes a
root; messages that hang in a cycle have no root and no path; equal scores rank the deeper leaf,
then the smaller message first; repeated rows of a conversation are turns of their own; texts of any
length stay whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonegrid.llm.common import table, written

START, END = "<|im_start|>", "<|im_end|>"
#: Characters that may begin a control string, and their references; the first is undone last.
REFERENCES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
NEWLINE = ("\n", "&#10;")
ASSISTANT = "assistant"


def escaped(text: Column, references: tuple = REFERENCES) -> Column:
    for char, reference in references:
        text = F.replace(text, F.lit(char), F.lit(reference))
    return text


def unescaped(text: Column, references: tuple = REFERENCES) -> Column:
    for char, reference in reversed(references):
        text = F.replace(text, F.lit(reference), F.lit(char))
    return text


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(root, leaf, rank, depth, node) for the ``branches`` best leaves of every root of ``messages`` (node, parent, score)."""
    nodes = written(messages.select("node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    parents = nodes.select(F.col("node").alias("of"))
    state = written(
        nodes.join(parents, F.col("parent") == F.col("of"), "left")
        .select("node", F.col("of").alias("up"), F.lit(1).cast("long").alias("dist"), "score", F.when(F.col("of").isNull(), F.col("node")).alias("root"))
    )
    levels, most = [], nodes.count()
    while levels == [] or state.where("root IS NULL").limit(1).count():
        levels.append(state.where("up IS NOT NULL").select(F.col("node").alias("at"), F.col("up").alias("above")))
        if 2 ** len(levels) > 2 * most:
            break  # no path has more messages than the table: what is still open hangs in cycles
        far = state.select(F.col("node").alias("of"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("score").alias("score2"), F.col("root").alias("root2"))
        open_ = state.where("root IS NULL").join(far, F.col("up") == F.col("of"))
        done = state.where("root IS NOT NULL").withColumn("up", F.lit(None).cast(state.schema["up"].dataType))
        state = written(
            done.unionByName(
                open_.select("node", F.col("up2").alias("up"), (F.col("dist") + F.col("dist2")).alias("dist"), (F.col("score") + F.col("score2")).alias("score"), F.col("root2").alias("root"))
            )
        )
    leaves = state.where("root IS NOT NULL").join(nodes.select(F.col("parent").alias("of")), F.col("node") == F.col("of"), "left_anti")
    order = Window.partitionBy("root").orderBy(F.col("score").desc(), F.col("dist").desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    path = chosen.select("root", F.col("node").alias("leaf"), "rank", "node", F.col("dist").alias("depth"))
    for k, level in enumerate(levels):
        above = path.join(level, F.col("node") == F.col("at")).select("root", "leaf", "rank", F.col("above").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        path = written(path.unionByName(above))
    return path


def formatted(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(root, leaf, rank, formatted, loss): one row per chosen path; ``messages`` has node, role and text."""
    said = messages.select(F.col("node").alias("of"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, F.col("node") == F.col("of")).select("root", "leaf", "rank", F.struct("depth", "role", "text").alias("turn"))
    whole = turns.groupBy("root", "leaf", "rank").agg(F.array_sort(F.collect_list("turn")).alias("turns"))

    def head(t: Column) -> Column:
        return F.concat(F.lit(START), escaped(t["role"], (*REFERENCES, NEWLINE)), F.lit("\n"))

    parts = F.transform("turns", lambda t: F.concat(head(t), escaped(t["text"]), F.lit(END + "\n")))
    spans = F.transform(
        "turns",
        lambda t, i: F.when(
            t["role"] == ASSISTANT,
            F.struct(i.alias("turn"), F.length(head(t)).alias("start"), (F.length(head(t)) + F.length(escaped(t["text"]))).alias("end")),
        ),
    )
    return whole.select("root", "leaf", "rank", F.array_join(parts, "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"))


def read_back(output: DataFrame) -> DataFrame:
    """``output`` of :func:`formatted` with turns (role, text) and loss_text, both taken from the output alone."""
    parts = F.split(F.col("formatted"), r"<\|im_start\|>")
    cut = output.withColumn("parts", F.slice(parts, F.lit(2), F.size(parts)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = p.substr(F.length(role) + 2, F.length(p) - F.length(role) - F.lit(2 + len(END)))
        return F.struct(unescaped(role, (*REFERENCES, NEWLINE)).alias("role"), unescaped(text).alias("text"))

    masked = F.transform("loss", lambda s: unescaped(F.element_at(F.col("parts"), s["turn"] + 1).substr(s["start"] + F.lit(1 - len(START)), s["end"] - s["start"])))
    return cut.withColumn("turns", F.transform("parts", turn)).withColumn("loss_text", F.array_join(masked, "")).drop("parts")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: every row answers the row before it, by turn (then role and text, nulls as empty).

    A message scores the code points that an assistant says. Rows of one conversation are one path, as each
    has to be in the result; a null conv_id is a conversation too.
    """
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = said.select("conv_id", "role", "text", F.row_number().over(in_order).alias("n"))

    def node(n: Column) -> Column:
        return F.struct(F.col("conv_id").isNull().alias("nameless"), F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv_id"), n.alias("n"))

    return numbered.select(
        node(F.col("n")).alias("node"), F.when(F.col("n") > 1, node(F.col("n") - 1)).alias("parent"),
        F.when(F.col("role") == ASSISTANT, F.length("text")).otherwise(0).cast("double").alias("score"), "role", "text",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    messages = written(conversation_messages(rows.union(extra)))
    out = read_back(formatted(reply_paths(messages), messages))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        F.when(~F.col("root.nameless"), F.col("root.conv_id")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS n,
         length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) AS m
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(m + n + 12 + 1 + 10 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
