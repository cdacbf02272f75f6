"""Chat formatting from reply trees.

Messages point to the message they answer. Root-to-leaf paths come from self-joins that double their reach: after k
joins each leaf knows 2**k of its ancestors, so the number of joins is the logarithm of the deepest thread. The branches
of a conversation are ranked by the mean score of their messages, and each chosen branch is formatted as one text:

    <turn:ROLE>
    TEXT</turn>

with ``&``, ``<`` and ``>`` of roles and texts written as entities, so that no control string can arise inside a text
and reading back is exact. The loss mask lists the character ranges of the texts of the trained roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import let, stored, table

#: Fixed values of the template.
OPEN, SHUT, END = "<turn:", ">\n", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def chain(messages: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) as trees of one branch: each message answers the one before it by turn, role, text."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = messages.withColumn("id", F.row_number().over(order).cast("long"))
    return rows.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1))


def branches(messages: DataFrame) -> DataFrame:
    """(conv, leaf, id, up) for messages (conv, id, parent): every message on the way from each leaf, ``up`` steps above it.

    A message whose parent is missing, itself or not of a smaller id is a root, so that there are no circles.
    """
    own = messages.select("conv", "id", "parent")
    there = messages.select(F.col("conv").alias("c"), F.col("id").alias("p"))
    ok = own["conv"].eqNullSafe(there["c"]) & (own["parent"] == there["p"]) & (own["parent"] < own["id"])
    jump = stored(own.join(there, ok, "inner").select("conv", "id", F.col("p").alias("above")), "jump")
    answered = jump.select(F.col("conv").alias("c"), F.col("above").alias("p")).distinct()
    leaves = own.join(answered, own["conv"].eqNullSafe(answered["c"]) & (own["id"] == answered["p"]), "left_anti")
    paths = leaves.select("conv", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    reach = 1
    while True:
        step = jump.select(F.col("conv").alias("c"), F.col("id").alias("i"), "above")
        on = paths["conv"].eqNullSafe(step["c"]) & (paths["id"] == step["i"])
        paths = stored(paths.unionByName(paths.join(step, on).select("conv", "leaf", F.col("above").alias("id"), (F.col("up") + reach).alias("up"))), "paths")
        after = jump.select(F.col("conv").alias("c"), F.col("id").alias("i"), F.col("above").alias("a"))
        jump = stored(jump.join(after, jump["conv"].eqNullSafe(after["c"]) & (jump["above"] == after["i"])).select("conv", "id", F.col("a").alias("above")), "jump")
        if jump.isEmpty():
            return paths
        reach *= 2


def format_conversations(messages: DataFrame, keep: int | None = 1, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv, leaf, rank, score, formatted, mask for the ``keep`` best branches of each conversation (None: all).

    ``messages`` has conv, id, parent, role, text and may have score (null: 0). Branches rank by mean score, then by
    their leaf's id, later first. Null roles and texts are empty. ``mask`` lists (start, length) in characters.
    """
    if "score" not in messages.columns:
        messages = messages.withColumn("score", F.lit(0.0))
    messages = stored(messages.select("conv", "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                                      F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "messages")
    paths = branches(messages)
    light = messages.select(F.col("conv").alias("c"), F.col("id").alias("i"), "score")
    means = paths.join(light, paths["conv"].eqNullSafe(light["c"]) & (paths["id"] == light["i"])).groupBy("conv", "leaf").agg(F.avg("score").alias("score"))
    ranked = means.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), F.desc("leaf"))))
    chosen = ranked if keep is None else ranked.where(F.col("rank") <= keep)
    b = chosen.select(F.col("conv").alias("c"), F.col("leaf").alias("l"), "rank", F.col("score").alias("branch_score"))
    m = messages.select(F.col("conv").alias("c2"), F.col("id").alias("i2"), "role", "text")
    rows = paths.join(b, paths["conv"].eqNullSafe(b["c"]) & (paths["leaf"] == b["l"])) \
        .join(m, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("id") == F.col("i2")))
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SHUT))
    rows = rows.select("conv", "leaf", "rank", "branch_score", "up", head.alias("head"), escaped(F.col("text")).alias("body"), F.col("role").isin(*trained).alias("loss"))
    before = Window.partitionBy("conv", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct((-F.col("up")).alias("n"), F.concat("head", "body", F.lit(END)).alias("piece"), "start", F.length("body").cast("long").alias("length"), "loss")
    return rows.groupBy("conv", "leaf", "rank", F.col("branch_score").alias("score")).agg(F.sort_array(F.collect_list(turn)).alias("t")).select(
        "conv", "leaf", "rank", "score", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("mask"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, SHUT, 1)
        return F.struct(unescaped(F.substring(head, F.lit(len(OPEN) + 1), F.length(head))).alias("role"),
                        unescaped(F.substring(piece, F.length(head) + len(SHUT) + 1, F.length(piece))).alias("text"))

    return F.transform(F.filter(F.split(formatted, END), lambda p: p != ""), turn)


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


SPECIAL = r"\### Assistant: </turn> ok"


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose two texts are control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SPECIAL).alias("text"))
    out = format_conversations(chain(given.unionByName(extra).withColumnRenamed("conv_id", "conv")))
    turns = F.array_join(F.transform(parsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("conv").alias("conv_id"), F.size(parsed(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        let(masked(F.col("formatted"), F.col("mask")), lambda x: F.struct(F.length(x).cast("long").alias("loss_chars"), F.sha2(x, 256).alias("loss_sha256"))).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars")).select("conv_id", "n_turns", "turns_sha256", "loss.*", "formatted_chars")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
    + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + 16) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
