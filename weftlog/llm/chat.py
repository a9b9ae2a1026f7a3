"""Preference formatting of conversations (operator 7).

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once
as the prompt; what follows it in either is rendered as a completion, with the spans of its
characters that are to be learned from (the assistant's turns; everything else is masked).
Everything is DataFrame functions on arrays of turns; a conversation is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) from (conv_id, turn, role, text): turns in order of turn, role and text.

    Rows without conv_id belong to no conversation and are left out. A null role is ``user``, a
    null text is empty. Repeated rows are turns of their own.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def learned_spans(turns: Column) -> Column:
    """``start-end`` of the assistant's texts with their end marks in the rendered turns, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(rendered(t))
        span = F.concat((acc["at"] + F.length(t["role"]) + 5).cast("string"), F.lit("-"), (end - 1).cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, add)["spans"], ",")


def common_prefix(a: Column, b: Column) -> Column:
    """Turns that two conversations have in common from the first on."""
    short = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), short - 1), lambda k: F.get(a, k) != F.get(b, k))
    return F.when(short == 0, F.lit(0)).otherwise(F.coalesce(F.get(differs, F.lit(0)), short))


def _from(turns: Column, k: Column) -> Column:
    return F.slice(turns, k + 1, F.greatest(F.size(turns) - k, F.lit(0)))


def preference_rows(pairs: DataFrame) -> DataFrame:
    """pairs (any columns, chosen and rejected as arrays of turns) as prompt, completions and spans.

    Gives n_prompt_turns, prompt, chosen, rejected, chosen_spans and rejected_spans beside the other
    columns of pairs. A side that is null or has no turns beyond the prompt has an empty completion.
    Repeated rows give repeated results, and an empty table none.
    """
    empty = F.array().cast(_TURNS)
    keep = [c for c in pairs.columns if c not in ("chosen", "rejected", "n_prompt_turns", "prompt", "chosen_spans", "rejected_spans")]
    both = pairs.select(*keep, F.coalesce("chosen", empty).alias("_c"), F.coalesce("rejected", empty).alias("_r"))
    both = both.withColumn("_n", common_prefix(F.col("_c"), F.col("_r")))
    c, r = _from(F.col("_c"), F.col("_n")), _from(F.col("_r"), F.col("_n"))
    return both.select(*keep, F.col("_n").cast("long").alias("n_prompt_turns"), render(F.slice("_c", F.lit(1), F.col("_n"))).alias("prompt"), render(c).alias("chosen"), render(r).alias("rejected"), learned_spans(c).alias("chosen_spans"), learned_spans(r).alias("rejected_spans"))


def next_answer_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, a number, with chosen, the conversation, and rejected: its last answer is that of conv_id + 1.

    Where there is no next conversation, or it has no answer, the rejected one ends before its
    last answer; a conversation without answers is its own rejected one. Nulls and repeated rows are
    taken as in conversations(); an empty table gives an empty result.
    """
    c = conversations(turns)
    last = F.array_max(F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda k: F.get("turns", k)["role"] == "assistant"))
    c = c.withColumn("last", last)
    answers = c.where("last is not null").select((F.col("conv_id") - 1).alias("next_of"), F.get("turns", F.col("last"))["text"].alias("answer"))
    both = c.join(answers, F.col("conv_id") == F.col("next_of"), "left")
    swapped = F.transform("turns", lambda t, k: F.struct(t["role"].alias("role"), F.when(k == F.col("last"), F.col("answer")).otherwise(t["text"]).alias("text")))
    cut = F.slice("turns", F.lit(1), F.col("last"))
    rejected = F.when(F.col("last").isNull(), F.col("turns")).when(F.col("next_of").isNull(), cut).otherwise(swapped)
    return both.select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
la AS (SELECT conv_id, max(k) AS k FROM t WHERE role = 'assistant' GROUP BY conv_id),
ans AS (SELECT t.conv_id, t.text FROM t JOIN la ON t.conv_id = la.conv_id AND t.k = la.k),
r AS (SELECT t.conv_id, t.k, t.role, CASE WHEN t.k = la.k THEN ans.text ELSE t.text END AS text
  FROM t LEFT JOIN la ON t.conv_id = la.conv_id LEFT JOIN ans ON ans.conv_id = t.conv_id + 1
  WHERE la.k IS NULL OR ans.text IS NOT NULL OR t.k < la.k),
n AS (SELECT t.conv_id, CAST(coalesce(min(t.k) FILTER (WHERE r.k IS NULL OR r.role <> t.role OR r.text <> t.text), count(*)) AS BIGINT) AS n
  FROM t LEFT JOIN r ON t.conv_id = r.conv_id AND t.k = r.k GROUP BY t.conv_id),
b AS (SELECT 'c' AS side, t.* FROM t UNION ALL SELECT 'r', r.* FROM r),
d AS (SELECT b.*, n.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS x FROM b JOIN n USING (conv_id)),
s AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY side, conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM d WHERE k >= n),
f AS (SELECT side, conv_id, string_agg(x, '' ORDER BY k) AS x,
  string_agg(CAST(CAST(place + length(role) + 5 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(place + length(x) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE role = 'assistant') AS spans FROM s GROUP BY side, conv_id),
p AS (SELECT conv_id, string_agg(x, '' ORDER BY k) AS prompt FROM d WHERE side = 'c' AND k < n GROUP BY conv_id)
SELECT n.conv_id, n.n AS n_prompt_turns, coalesce(p.prompt, '') AS prompt, coalesce(c.x, '') AS chosen, coalesce(j.x, '') AS rejected, coalesce(c.spans, '') AS chosen_spans, coalesce(j.spans, '') AS rejected_spans
FROM n LEFT JOIN p USING (conv_id) LEFT JOIN f AS c ON c.conv_id = n.conv_id AND c.side = 'c' LEFT JOIN f AS j ON j.conv_id = n.conv_id AND j.side = 'r'
"""
