"""Chat formatting from every participant's perspective (operator 2).

For each participant of a conversation the whole dialogue is rendered with that speaker as the assistant
and all others as named users; system turns stay system turns. The mask says which characters the model is
to learn: the text and end mark of the assistant's turns, not the headers.

A rendering comes in parts of ``TURNS`` turns: part p holds turns p * TURNS to (p + 1) * TURNS - 1, and pieces of
``TURNS`` rows where turns repeat; so joining parts and pieces in order gives the whole, and a conversation of any length
makes many rows instead of a large one.

Scale: participants are collected per conversation from partial aggregates (distinct names, not turns);
turns are then grouped by (conversation, perspective, part, piece), of ``TURNS`` rows at most. Rows of parts that have
more are numbered by a sort over ranges, which no task does alone.

Defined cases: a null or empty role is the speaker "unknown"; a null text is empty; a null turn comes
first, in part -1; a null conv_id is a conversation like any other; equal turns are ordered by speaker, then
text, and repeated rows are repeated; a conversation of system turns alone has no perspective and gives no row;
bars after < and before > go from texts and roles, and a role's line ends become spaces, so that no text can end its turn
and no role can write a header; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import ranked

TURNS = 64
#: The marks around a turn.
START, END = "<|start|>", "<|end|>\n"


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "<[|]+", "<"), "[|]+>", ">")


def _pieces(said: DataFrame, turns: int) -> DataFrame:
    """``said`` with the piece of its part that each row belongs to."""
    many = said.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("_n")).where(f"_n > {turns}").select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"))
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))
    if many.isEmpty():
        return said.withColumn("piece", F.lit(0).cast("long"))
    keys = [F.col(c) for c in ("conv_id", "part", "turn", "speaker", "text")]
    long = ranked(said.join(many, on, "left_semi"), keys, "_rank")
    first = long.groupBy(F.col("conv_id").alias("_c"), F.col("part").alias("_p")).agg(F.min("_rank").alias("_first"))
    long = long.join(first, on).withColumn("piece", F.floor((F.col("_rank") - F.col("_first")) / turns)).select(*said.columns, "piece")
    return said.join(many, on, "left_anti").withColumn("piece", F.lit(0).cast("long")).unionByName(long)


def perspectives(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """conv_id, perspective, part, piece, n_turns, rendered, mask: (start, end) pairs of characters to learn from."""
    role = F.regexp_replace(_plain(F.col("role").cast("string")), "[\r\n]+", " ")
    said = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.nullif(role, F.lit("")), F.lit("unknown")).alias("speaker"),
        _plain(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / turns), F.lit(-1)).cast("long"))
    said = _pieces(said, turns)
    speakers = said.where("speaker <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    both = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    name = F.when(own, "assistant").when(F.col("speaker") == "system", "system").otherwise(F.concat(F.lit("user name="), "speaker"))
    one = F.struct(
        "turn", "speaker", "text", own.alias("own"),
        F.concat(F.lit(START), name, F.lit("\n")).alias("head"),
        F.concat("text", F.lit(END)).alias("body"),
    )
    grouped = both.groupBy("conv_id", "perspective", "part", "piece").agg(F.array_sort(F.collect_list(one)).alias("t"))
    spans = """aggregate(t, named_struct('at', 0, 'spans', cast(array() as array<array<int>>)),
        (a, x) -> named_struct('at', a.at + length(x.head) + length(x.body), 'spans', if(x.own,
            concat(a.spans, array(array(a.at + length(x.head), a.at + length(x.head) + length(x.body)))), a.spans)), a -> a.spans)"""
    return grouped.select(
        "conv_id", "perspective", "part", "piece",
        F.size("t").cast("long").alias("n_turns"),
        F.expr("array_join(transform(t, x -> concat(x.head, x.body)), '')").alias("rendered"),
        F.expr(spans).alias("mask"),
    )


def oracle(turns: int = TURNS) -> str:
    """The same in DuckDB, with the mask as text: a:b,c:d."""
    plain = lambda c: f"regexp_replace(regexp_replace({c}, '<[|]+', '<', 'g'), '[|]+>', '>', 'g')"
    return f"""
    WITH named AS (
      SELECT conv_id, turn, coalesce(nullif(regexp_replace({plain("role")}, '[\r\n]+', ' ', 'g'), ''), 'unknown') AS speaker, {plain("coalesce(text, '')")} AS text,
             coalesce(CAST(floor(turn / {turns}) AS BIGINT), -1) AS part
      FROM conversations),
    said AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, speaker, text) - 1) // {turns} AS piece FROM named),
    speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
    turns AS (
      SELECT s.conv_id, p.perspective, s.part, s.piece, s.turn, s.speaker, s.text, s.speaker = p.perspective AS own,
             '{START}' || CASE WHEN s.speaker = p.perspective THEN 'assistant' WHEN s.speaker = 'system' THEN 'system'
               ELSE 'user name=' || s.speaker END || chr(10) AS head,
             s.text || '{END.strip()}' || chr(10) AS body
      FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
    placed AS (
      SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part, piece
               ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
      FROM turns)
    SELECT conv_id, perspective, part, piece, count(*) AS n_turns,
           string_agg(head || body, '' ORDER BY turn NULLS FIRST, speaker, text) AS rendered,
           coalesce(string_agg(CASE WHEN own THEN (upto - length(body)) || ':' || upto END, ',' ORDER BY upto), '') AS mask
    FROM placed GROUP BY conv_id, perspective, part, piece"""
