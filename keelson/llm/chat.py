"""Preference formatting of chosen and rejected conversations (native).

The longest common turn prefix of the two conversations is rendered once, as
the prompt; what follows it is rendered as the two completions, each with a
mask that says which characters are trained on. A turn is rendered as

    <|role|>\\ntext<|end|>\\n

and a mask is a run-length list ``chars:trained`` joined by commas: an
assistant's text and its end mark are trained (1), the rest is not (0).

Defined results: a null role is ``unknown``, a null text is empty (a null and
an empty text are still different turns); turns are ordered by (turn, role,
text), nulls first, so ties and repeated rows have one order; a pair of which
a completion is empty (equal conversations leave two such) is returned with
usable = false; a missing conversation has no turns; rows of a null id are one
conversation, which is never next to another; no rows give no rows. Completions are as long as the
conversation is; nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

END = "<|end|>\n"


def turns(table: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: key, turns (array of role, text in order)."""
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    rows = table.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("_t"))
    return rows.select(key, F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"))


def _text(t: Column) -> Column:
    return F.coalesce(t["text"], F.lit(""))


def render(ts: Column) -> Column:
    return F.array_join(F.transform(ts, lambda t: F.concat(_head(t), _text(t), F.lit(END))), "")


def mask(ts: Column) -> Column:
    """``chars:trained`` runs of the rendered turns."""
    def runs(t: Column) -> Column:
        on = F.when(t["role"] == "assistant", F.lit(":1")).otherwise(F.lit(":0"))
        return F.concat(F.length(_head(t)).cast("string"), F.lit(":0,"),
                        (F.length(_text(t)) + len(END)).cast("string"), on)
    return F.array_join(F.transform(ts, runs), ",")


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    n = F.least(F.size(a), F.size(b))
    # the positions at which the two differ; their first is the prefix's length
    differs = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: ~p["a"].eqNullSafe(p["b"]))
    return F.coalesce(F.nullif(F.least(F.array_position(differs, True) - 1, n.cast("long")), F.lit(-1).cast("long")),
                      n.cast("long"))


def format_preferences(pairs: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs: key and two arrays of turns (role, text). One row per pair:
    n_prefix_turns, prompt, the completions, their masks, usable."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    p = pairs.select(key, F.coalesce(chosen, none).alias("_c"), F.coalesce(rejected, none).alias("_r"))
    p = p.withColumn("_n", common_turns(F.col("_c"), F.col("_r")))

    def rest(c: str) -> Column:
        return F.filter(F.col(c), lambda _, i: i >= F.col("_n"))
    p = p.select(key, F.col("_n").alias("n_prefix_turns"), F.filter("_c", lambda _, i: i < F.col("_n")).alias("_p"),
                 rest("_c").alias("_c"), rest("_r").alias("_r"))
    return p.select(key, "n_prefix_turns", render(F.col("_p")).alias("prompt"),
                    render(F.col("_c")).alias("chosen"), mask(F.col("_c")).alias("chosen_mask"),
                    render(F.col("_r")).alias("rejected"), mask(F.col("_r")).alias("rejected_mask"),
                    ((F.size("_c") > 0) & (F.size("_r") > 0)).alias("usable"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair per conversation of ``conversations``: chosen is the conversation,
    rejected is what precedes its last assistant turn, answered by the last
    assistant turn of the conversation with the next id (the table has no
    preferences of its own)."""
    table = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    convs = turns(table)
    said = F.filter("turns", lambda t: t["role"] == "assistant")
    last_at = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))), True)
    convs = convs.select("conv_id", "turns", said.alias("said"), F.when(F.size(said) > 0, last_at).otherwise(F.size("turns")).alias("cut"))
    answer = convs.select((F.col("conv_id") - 1).alias("before"), F.slice("said", -1, 1).alias("answer")).filter(F.size("answer") > 0)
    # an id may repeat only as one conversation, so the join adds no rows
    pairs = convs.join(answer, convs["conv_id"] == answer["before"], "left").select(
        "conv_id", F.col("turns").alias("chosen"),
        F.concat(F.filter("turns", lambda _, i: i < F.col("cut")),
                 F.coalesce("answer", F.array().cast("array<struct<role:string,text:string>>"))).alias("rejected"))
    return format_preferences(pairs, "conv_id")


ORACLE_SQL = r"""
WITH convs AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations GROUP BY conv_id),
last AS (
  SELECT conv_id, turns, len(turns) AS n,
         list_max([i FOR i IN range(1, len(turns) + 1) IF turns[i].role = 'assistant']) AS at FROM convs),
pairs AS (
  SELECT a.conv_id, a.turns AS c,
         list_concat(a.turns[1:coalesce(a.at - 1, a.n)], CASE WHEN b.at IS NULL THEN [] ELSE [b.turns[b.at]] END) AS r
  FROM last a LEFT JOIN last b ON b.conv_id = a.conv_id + 1),
cut AS (
  SELECT conv_id, c, r, coalesce(list_min([i FOR i IN range(1, least(len(c), len(r)) + 1) IF c[i] IS DISTINCT FROM r[i]]) - 1,
                                 least(len(c), len(r))) AS k FROM pairs),
parts AS (SELECT conv_id, k, c[1:k] AS p, c[k + 1:] AS c, r[k + 1:] AS r FROM cut)
SELECT conv_id, CAST(k AS BIGINT) AS n_prefix_turns,
  list_aggregate(list_concat([''], ['<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10) FOR t IN p]), 'string_agg', '') AS prompt,
  list_aggregate(list_concat([''], ['<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10) FOR t IN c]), 'string_agg', '') AS chosen,
  coalesce(list_aggregate([(length(coalesce(t.role, 'unknown')) + 5) || ':0,' || (length(coalesce(t.text, '')) + 8) || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END FOR t IN c], 'string_agg', ','), '') AS chosen_mask,
  list_aggregate(list_concat([''], ['<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10) FOR t IN r]), 'string_agg', '') AS rejected,
  coalesce(list_aggregate([(length(coalesce(t.role, 'unknown')) + 5) || ':0,' || (length(coalesce(t.text, '')) + 8) || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END FOR t IN r], 'string_agg', ','), '') AS rejected_mask,
  len(c) > 0 AND len(r) > 0 AS usable
FROM parts
"""
