"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation again and again as it grows.  A rolling hash of
each conversation's turns (128 bits: two running xors of hashes of position,
role and text) names every prefix.  A conversation whose whole hash is a
proper prefix of a longer one, or equals that of one with a smaller id, is
dropped by an anti-join; those that stay are maximal and are rendered, one
text each: ``<|im_start|>role``, a line feed, the text and ``<|im_end|>``.  The
markers are kept out of roles and texts (``<|im_end|>`` there becomes
``<im_end>``), so that no text forges a turn.

Scale: hashes of equal conversations and of equal prefixes are aggregated
before they are joined, so a first turn or a conversation that a third of the
rows share is one row on each side.  Only the kept conversations' texts are
shuffled, to be put in order; a conversation must fit in a row.

Edge cases: rows without a conversation id are left out.  Null roles and texts
count as empty.  Turns go by number, null first; turns of one number by role,
then by the hash of their text; exact repeats stay.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def collapse(turns: DataFrame) -> DataFrame:
    """The ``conv_id`` of every maximal conversation, smallest id of equals."""
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    placed = turns.select("conv_id", "role", "digest", F.row_number().over(by).alias("pos"), "turn")
    item = lambda seed: F.xxhash64(F.lit(seed), "pos", "role", "digest")
    rolled = placed.select("conv_id", "pos", *(F.bit_xor(item(s)).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(f"h{s}") for s in (1, 2)), F.lead("pos").over(by).isNull().alias("last"))
    rolled = Scratch(turns.sparkSession, "chat").store(rolled, "rolled")
    whole = rolled.filter("last").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = rolled.filter("not last").select("pos", "h1", "h2").distinct()
    return whole.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id")


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``n_turns`` and rendered ``text`` of maximal conversations."""
    said = F.coalesce(F.col(text), F.lit(""))
    turns = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.sha2(said, 256).alias("digest"), said.alias("text"))
    kept = turns.join(collapse(turns.drop("text")), "conv_id", "left_semi")
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("<|im_start|>"), F.lit("<im_start>")), F.lit("<|im_end|>"), F.lit("<im_end>"))
    rendered = F.concat(F.lit("<|im_start|>"), safe("role"), F.lit("\n"), safe("text"), F.lit("<|im_end|>\n"))
    listed = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", rendered.alias("shown")))).alias("turns"))
    return listed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.shown", "").alias("text"))


ORACLE = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), listed AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, sha256(text)) AS turns FROM said GROUP BY conv_id
)
SELECT conv_id, n AS n_turns,
       list_aggregate(list_transform(turns, lambda x: '<|im_start|>' || replace(replace(x.r, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || chr(10) || replace(replace(x.t, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10)), 'string_agg', '') AS text
FROM listed a
WHERE NOT EXISTS (
  SELECT 1 FROM listed b
  WHERE b.turns[1] = a.turns[1] AND b.turns[1:a.n] = a.turns AND (b.n > a.n OR (b.n = a.n AND b.conv_id < a.conv_id)))
"""
