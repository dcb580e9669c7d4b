"""Multi-party perspective rotation of conversations, in DataFrame functions only.

For every participant the dialogue is rendered with that speaker as assistant
and all others as named users; masks mark what the assistant says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import stored
from tickloom.operators.ordered import number_rows

TURNS_PER_PART = 1024  # rendered in one row; longer dialogues go on in the next one
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", shared: str = "system",
    turns_per_part: int = TURNS_PER_PART, ranges: int | None = None,
) -> DataFrame:
    """``conv, part, participant, n_turns, n_trained, offset, context, rendered, mask, spans``.

    One rendering for each participant of a conversation. A dialogue of more than ``turns_per_part`` turns comes in several rows, cut by
    the rank of the turn: ``rendered`` in the order of ``part`` gives the whole dialogue, ``offset`` is where the part's
    characters begin in it, and ``context`` repeats the shared turns of the first part, for models that read a later one alone.
    No group grows beyond a part, whatever the turns' numbers. The ``shared``
    speaker is no participant: its turns stay system messages for everyone. ``mask`` has one
    digit a turn (1: trained on); ``spans`` has ``start:end`` in characters of the whole dialogue, comma-joined, for the
    trained text and its closing mark. Turns are ordered by number, speaker and text;
    null numbers come first. A null text is empty, a null or empty speaker is ``unknown``,
    repeated rows stay. Marks inside a text or a name are broken up with a
    blank. Rows without conversation id belong to no dialogue; a participant who is silent in a part still has its row there. A
    conversation of shared turns alone has no participant and gives no row; an empty table gives none.
    """
    clean = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    name = clean(F.col(speaker))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), F.when(name == "", "unknown").otherwise(name).alias("_speaker"), clean(F.col(text)).alias("_text")
    )
    turns_of = F.sort_array(F.collect_list(F.struct(F.col("_turn").alias("turn"), F.col("_speaker").alias("speaker"), F.col("_text").alias("text")))).alias("_turns")
    # Few dialogues are longer than a part; only those need ranks, and what goes before a part.
    several = rows.groupBy("_conv").count().where(F.col("count") > turns_per_part).select("_conv")
    several = stored(several, "long-dialogues")
    short = rows.join(several, "_conv", "left_anti").groupBy("_conv").agg(turns_of).withColumn("_part", F.lit(0).cast("long"))
    people = F.array_distinct(F.filter(F.transform("_turns", lambda t: t["speaker"]), lambda s: s != shared))
    views = short.select("_conv", "_part", "_turns", F.explode(people).alias("_who"), F.lit(0).cast("long").alias("_offset"), F.lit("").alias("_opening"))
    if not several.isEmpty():
        views = views.unionByName(_long_views(rows.join(several, "_conv", "left_semi"), turns_of, shared, turns_per_part, ranges))

    def head(t: Column) -> Column:
        role = F.when(t["speaker"] == shared, F.lit(shared)).when(t["speaker"] == F.col("_who"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t["speaker"]))
        return F.concat(F.lit(OPEN), role, F.lit("\n"))

    said = views.select(
        "_conv", "_part", "_who", "_offset", "_opening",
        F.transform("_turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["speaker"] == F.col("_who")).alias("own"))).alias("_said"),
    )
    start = F.struct(F.col("_offset").alias("at"), F.array().cast("array<string>").alias("spans"))

    def walk(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return said.select(
        F.col("_conv").alias(conv),
        F.col("_part").alias("part"),
        F.col("_who").alias("participant"),
        F.size("_said").cast("long").alias("n_turns"),
        F.size(F.filter("_said", lambda t: t["own"])).cast("long").alias("n_trained"),
        F.col("_offset").alias("offset"),
        F.col("_opening").alias("context"),
        F.array_join(F.transform("_said", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.transform("_said", lambda t: F.when(t["own"], "1").otherwise("0")), "").alias("mask"),
        F.array_join(F.aggregate("_said", start, walk)["spans"], ",").alias("spans"),
    )


def _long_views(rows: DataFrame, turns_of: Column, shared: str, turns_per_part: int, ranges: int | None) -> DataFrame:
    """``_conv, _part, _turns, _who, _offset, _opening`` of dialogues of several parts."""
    ranked = number_rows(rows, ["_conv"], ["_turn", "_speaker", "_text"], "_rank", ranges=ranges)
    ranked = ranked.withColumn("_part", F.floor((F.col("_rank") - 1) / turns_per_part))
    people = rows.where(F.col("_speaker") != shared).select("_conv", F.col("_speaker").alias("_who")).distinct()
    # Everyone sees the same characters but for the names of those who speak: a participant's own turns have another head.
    named = F.when(F.col("_speaker") == shared, F.length(F.lit(shared))).otherwise(F.length(F.lit("user name=")) + F.length("_speaker"))
    plain = F.length(F.lit(OPEN)) + named + F.length("_text") + F.length(F.lit(CLOSE)) + 2
    own = F.length(F.lit("assistant")) - F.length(F.lit("user name=")) - F.length("_speaker")
    sizes = ranked.groupBy("_conv", "_part", F.col("_speaker").alias("_who")).agg(F.sum(plain).alias("_size"), F.sum(own).alias("_change"))
    upto = Window.partitionBy("_conv", "_who").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.groupBy("_conv", "_part").agg(F.sum("_size").alias("_size")).join(people, "_conv").join(sizes.drop("_size"), ["_conv", "_part", "_who"], "left")
    offset = F.coalesce(F.sum(F.col("_size") + F.coalesce("_change", F.lit(0))).over(upto), F.lit(0)).cast("long")
    opening = ranked.where((F.col("_part") == 0) & (F.col("_speaker") == shared)).groupBy("_conv")
    opening = opening.agg(F.sort_array(F.collect_list(F.struct("_rank", F.concat(F.lit(f"{OPEN}{shared}\n"), "_text", F.lit(f"{CLOSE}\n")).alias("said")))).alias("_said"))
    opened = F.when(F.col("_part") > 0, F.coalesce(F.array_join("_said.said", ""), F.lit(""))).otherwise("")
    before = before.select("_conv", "_part", "_who", offset.alias("_offset")).join(opening, "_conv", "left").withColumn("_opening", opened).drop("_said")
    return ranked.groupBy("_conv", "_part").agg(turns_of).join(before, ["_conv", "_part"])


ROTATE_SQL = """
WITH turns AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE replace(role, '<|', '< |') END AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), people AS (
  SELECT DISTINCT conv_id, speaker AS participant FROM turns WHERE speaker <> 'system'
), said AS (
  SELECT t.conv_id, p.participant, t.turn, t.speaker, t.text, t.speaker = p.participant AS own,
         '<|im_start|>' || CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = p.participant THEN 'assistant'
                                ELSE 'user name=' || t.speaker END || chr(10) AS head,
         t.text || '<|im_end|>' AS body
  FROM turns t JOIN people p ON t.conv_id = p.conv_id
), placed AS (
  SELECT *, row_number() OVER w AS no,
         sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS begins
  FROM said
  WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), cut AS (SELECT *, CAST((no - 1) // 1024 AS BIGINT) AS part FROM placed
), opening AS (
  SELECT conv_id, participant, string_agg(head || body || chr(10), '' ORDER BY no) AS context FROM cut WHERE part = 0 AND speaker = 'system' GROUP BY ALL
)
SELECT conv_id, part, participant, count(*) AS n_turns, count(*) FILTER (own) AS n_trained,
       CAST(min(begins - length(head)) AS BIGINT) AS offset,
       CASE WHEN part > 0 THEN coalesce(any_value(context), '') ELSE '' END AS context,
       string_agg(head || body || chr(10), '' ORDER BY no) AS rendered,
       string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY no) AS mask,
       coalesce(string_agg(CASE WHEN own THEN CAST(CAST(begins AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(begins + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY no), '') AS spans
FROM cut LEFT JOIN opening USING (conv_id, participant) GROUP BY conv_id, part, participant
"""
