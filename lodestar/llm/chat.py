"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Logging systems write a conversation again after every exchange, so one conversation appears as many
snapshots, each a prefix of the next. A snapshot adds nothing; only maximal conversations are kept,
and of identical ones that of the smallest id. Those are rendered.

A *turn* is the set of messages (role, text) that a conversation has under one turn number. The prefix
of a conversation up to a turn is identified by a rolling hash: the sum over its messages of three
36-bit hashes of (turn, role, text), 108 bits in all, so a prefix hash needs no scan by one task:
sums within runs of ``RUN`` turn numbers plus the sums of the runs before. A conversation is dropped
if its final hash is among the hashes that other conversations have before their last turn (an
anti-join of two tables with one row per hash, both combined before the shuffle).

Rendering groups by (conversation, part), a part being ``PART`` turn numbers, so even a conversation
with a third of all rows is rendered by many tasks; the parts joined in order are its text. Each
message becomes ``<|role|>\\ntext<|end|>\\n``. The unit of rendering is the messages of at most ``PART`` turn
numbers of one conversation. A log that numbers none of its turns has all messages of a conversation under
turn -1, so they are one unit and are held by one task: such a log should be numbered first. The join of
rows with the kept conversations is by conversation; one with a large share of all rows is split by
adaptive execution.

Edge cases: rows without a conversation id belong to none and are left out. A null turn number counts
as turn -1, a null role as ``unknown``, a null text as empty. Repeated rows are one message; several
messages under one turn number stand in the order of role and text. Turn numbers are part of the
identity: a log that numbers from 1 isn't a prefix of one that numbers from 0. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.blocks import persisted, table

RUN = 1024
PART = 256
LANES = ("p1", "p2", "p3")


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text) without nulls."""
    return conversations.filter("conv_id IS NOT NULL").select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("pos"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _lane(i: int) -> Column:
    return F.xxhash64(F.lit(i), "pos", "role", "text").bitwiseAND((1 << 36) - 1)


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, p1, p2, p3): the hash of each conversation up to each of its turns."""
    light = rows.select("conv_id", "pos", *[_lane(i).alias(p) for i, p in enumerate(LANES)]).distinct()
    turns = light.groupBy("conv_id", "pos").agg(*[F.sum(p).alias(p) for p in LANES]).withColumn("run", F.floor(F.col("pos") / RUN))
    runs = turns.groupBy("conv_id", "run").agg(*[F.sum(p).alias(p) for p in LANES])
    earlier = W.partitionBy("conv_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    before = runs.select("conv_id", "run", *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(f"before_{p}") for p in LANES])
    within = W.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = turns.select("conv_id", "run", "pos", *[F.sum(p).over(within).alias(p) for p in LANES])
    return summed.join(before, ["conv_id", "run"]).select("conv_id", "pos", *[(F.col(p) + F.col(f"before_{p}")).alias(p) for p in LANES])


def maximal_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that are kept; copies: identical ones, itself included."""
    prefixes = persisted(prefix_hashes(rows), "prefixes")
    finals = prefixes.groupBy("conv_id").agg(F.max("pos").alias("last"), F.count(F.lit(1)).alias("n_turns"), *[F.max_by(p, "pos").alias(p) for p in LANES])
    longer = prefixes.join(finals.select("conv_id", "last"), "conv_id").filter("pos < last").select(*LANES).distinct()
    alike = finals.groupBy(*LANES).agg(F.min("conv_id").alias("conv_id"), F.max("n_turns").alias("n_turns"), F.count(F.lit(1)).alias("copies"))
    return alike.join(longer, list(LANES), "left_anti").select("conv_id", "n_turns", "copies")


def render(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per kept conversation and part, with its text."""
    parts = rows.join(kept, "conv_id").withColumn("part", F.floor(F.col("pos") / PART))
    grouped = parts.groupBy("conv_id", "part").agg(F.sort_array(F.collect_set(F.struct("pos", "role", "text"))).alias("m"), F.max("n_turns").alias("n_turns"), F.max("copies").alias("copies"))
    text = F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("<|end|>\n"))), "")
    return grouped.select("conv_id", "part", "n_turns", "copies", F.size("m").cast("long").alias("n_messages"), text.alias("rendered"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, copies, n_messages, rendered) of maximal conversations."""
    rows = messages(conversations)
    return render(rows, maximal_conversations(rows))


def op4_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logged conversations that no longer one continues, rendered."""
    return collapse_and_render(table(spark, sf_dir, "conversations"))


OP4_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS pos, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(DISTINCT pos) AS n_turns, string_agg(pos || chr(1) || role || chr(1) || text || chr(2), '' ORDER BY pos, role, text) AS s FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, max(n_turns) AS n_turns, count(*) AS copies, s, string_split(s, chr(2))[1] AS opening FROM s GROUP BY s),
k AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.opening = a.opening AND length(b.s) > length(a.s) AND starts_with(b.s, a.s)))
SELECT conv_id, CAST(floor(pos / {PART}) AS BIGINT) AS part, max(n_turns)::BIGINT AS n_turns, max(copies)::BIGINT AS copies, count(*)::BIGINT AS n_messages,
  string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos, role, text) AS rendered
FROM t JOIN k USING (conv_id) GROUP BY conv_id, CAST(floor(pos / {PART}) AS BIGINT)
"""
