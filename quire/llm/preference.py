"""Chat formatting of preference pairs with DataFrame functions only.

A pair of conversations (arrays of turns) is split at its longest common prefix of
turns. The prefix is rendered once, as the prompt; what follows in either is
rendered as a completion, with the character spans that count for the loss: the
text and end mark of each assistant turn. The prompt never takes the last turn of
either conversation, so both completions have a turn unless that conversation has none.

Null roles and texts are rendered as empty and equal each other; a conversation
that is null counts as empty. Extra columns pass through; a column named like an
output column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import docs_of, others, quoted, shared_dir, written

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
OUTPUTS = ("n_prompt_turns", "prompt", "chosen_text", "rejected_text", "chosen_spans", "rejected_spans")


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """The (start, end) of each assistant turn's text and end mark in the rendered turns."""
    none = F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["role"]) + (len(BEGIN) + 1)
        end = start + F.length(t["text"]) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with n_prompt_turns, prompt, chosen_text, rejected_text, chosen_spans, rejected_spans; chosen and rejected are arrays of struct(role, text)."""

    def clean(name: str) -> Column:
        empty = F.expr("CAST(array() AS array<struct<role: string, text: string>>)")
        turns = F.transform(quoted(name), lambda t: F.struct(F.coalesce(t["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(t["text"].cast("string"), F.lit("")).alias("text")))
        return F.coalesce(turns, empty)

    keep = others(pairs, chosen, rejected, *OUTPUTS)
    at = pairs.select(*(quoted(c) for c in keep), clean(chosen).alias("__quire_c"), clean(rejected).alias("__quire_r"))
    c, r = F.col("__quire_c"), F.col("__quire_r")
    most = F.least(F.size(c), F.size(r)) - 1
    same = F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: (F.get(c, i - 1)["role"] == F.get(r, i - 1)["role"]) & (F.get(c, i - 1)["text"] == F.get(r, i - 1)["text"]))
    differs = F.array_position(same, False)
    n = F.when(most < 1, 0).when(differs == 0, most).otherwise(differs - 1).cast("int")
    cut = at.withColumn("n_prompt_turns", n)
    p = F.col("n_prompt_turns")

    def tail(x: Column) -> Column:
        return F.slice(x, p + 1, F.greatest(F.size(x) - p, F.lit(0)))

    return cut.select(
        *(quoted(x) for x in keep),
        p,
        _rendered(F.slice(c, F.lit(1), p)).alias("prompt"),
        _rendered(tail(c)).alias("chosen_text"),
        _rendered(tail(r)).alias("rejected_text"),
        _spans(tail(c)).alias("chosen_spans"),
        _spans(tail(r)).alias("rejected_spans"),
    )


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """One preference pair for each conversation of (conv_id, turn, role, text): conv_id, chosen_id, chosen, rejected.

    Conversations with the same opening turn are answers to one prompt: the one of
    the smallest conv_id is chosen over each other (a star, so n pairs for n
    conversations). Any other conversation is chosen over itself with the last turn
    cut to the first half of its characters. Turns are ordered by turn, role and text;
    rows without a conv_id belong to no conversation.
    """
    spark = turns.sparkSession
    here = shared_dir(spark)
    turn = F.struct("turn", "role", "text")
    talks = (
        turns.where("conv_id IS NOT NULL")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("t"))
        .select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
        .withColumn("opening", F.sha2(F.concat_ws("\n", F.coalesce(F.col("turns")[0]["role"], F.lit("")), F.coalesce(F.col("turns")[0]["text"], F.lit(""))), 256))
    )
    talks = written(talks, f"{here}/talks")
    heads = written(talks.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("opening", "chosen_id"), f"{here}/heads")
    chosen = written(talks.join(heads, talks.conv_id == heads.chosen_id, "left_semi").select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), f"{here}/chosen")
    linked = talks.join(heads, "opening", "left").withColumn("chosen_id", F.when(F.col("chosen_id") != F.col("conv_id"), F.col("chosen_id")))
    pairs = linked.where("chosen_id IS NOT NULL").join(chosen, "chosen_id").select("conv_id", "chosen_id", "chosen", F.col("turns").alias("rejected"))
    last = F.element_at("turns", -1)
    cut = F.struct(last["role"].alias("role"), F.substring(last["text"], F.lit(1), F.floor(F.length(last["text"]) / 2).cast("int")).alias("text"))
    alone = linked.where("chosen_id IS NULL").select("conv_id", F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1), F.array(cut)).alias("rejected"))
    return pairs.unionByName(alone)


def op10_preference_format(spark, sf_dir: str) -> DataFrame:
    done = format_preferences(conversation_pairs(docs_of(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))

    def text(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")

    return done.select("conv_id", "chosen_id", "n_prompt_turns", "prompt", "chosen_text", "rejected_text", text("chosen_spans").alias("chosen_spans"), text("rejected_spans").alias("rejected_spans"))


OP10_SQL = r"""
WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT ts[1] AS o, min(conv_id) AS chosen_id FROM t GROUP BY ts[1] HAVING count(*) > 1),
l AS (SELECT t.*, CASE WHEN h.chosen_id <> t.conv_id THEN h.chosen_id END AS head FROM t LEFT JOIN h ON t.ts[1] = h.o),
p AS (SELECT l.conv_id, coalesce(l.head, l.conv_id) AS chosen_id, CASE WHEN l.head IS NULL THEN l.ts ELSE c.ts END AS c,
  CASE WHEN l.head IS NULL THEN list_append(l.ts[1:len(l.ts) - 1], {'role': l.ts[-1].role, 'text': substr(l.ts[-1].text, 1, length(l.ts[-1].text) // 2)}) ELSE l.ts END AS r
  FROM l LEFT JOIN t c ON c.conv_id = l.head),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r))), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r)) - 1) AS n FROM p),
x AS (SELECT conv_id, chosen_id, n, c[1:n] AS h, c[n + 1:len(c)] AS c, r[n + 1:len(r)] AS r FROM n),
s AS (SELECT *,
  list_transform(h, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS hs,
  list_transform(c, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS cs,
  list_transform(r, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS rs FROM x)
SELECT conv_id, chosen_id, CAST(n AS INTEGER) AS n_prompt_turns,
  coalesce(array_to_string(hs, ''), '') AS prompt, array_to_string(cs, '') AS chosen_text, array_to_string(rs, '') AS rejected_text,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i:
    CAST(coalesce(list_sum(list_transform(cs[1:i - 1], lambda z: length(z))), 0) + 22 AS BIGINT) || '-' || CAST(list_sum(list_transform(cs[1:i], lambda z: length(z))) AS BIGINT)), ','), '') AS chosen_spans,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i:
    CAST(coalesce(list_sum(list_transform(rs[1:i - 1], lambda z: length(z))), 0) + 22 AS BIGINT) || '-' || CAST(list_sum(list_transform(rs[1:i], lambda z: length(z))) AS BIGINT)), ','), '') AS rejected_spans
FROM s
"""
