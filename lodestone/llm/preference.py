"""Preference formatting of chat pairs.

The turns that a chosen and a rejected conversation begin with alike are rendered once, as the prompt; what follows
on each side is rendered as its completion. A completion's mask is the spans that a model learns: text and end mark of
the assistant's turns, not the turns' heads and not what others say.

The input has a row for each turn: pair_id, side ('chosen' or 'rejected'), turn, role, text. Turns are ordered by turn,
then role, then text; null roles and texts count as empty. A side without turns has an empty completion, and so have two
equal sides, whose turns are all prompt. Repeated rows are turns of their own. Rows of other sides are left out, other
columns are ignored, and an empty table gives an empty one. A pair's turns meet in one row, as its texts must; no other
grouping is done, so a first turn that many pairs share costs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, BREAK, END = "<|im_start|>", "\\n", "<|im_end|>"

_PIECE = f"concat('{HEAD}', t.role, '{BREAK}', t.text, '{END}{BREAK}')"


def _completion(side: str) -> str:
    return f"slice({side}, n_common + 1, greatest(size({side}) - n_common, 0))"


def _text(turns: str) -> str:
    return f"array_join(transform({turns}, t -> {_PIECE}), '')"


def _spans(turns: str) -> str:
    """SQL of an array of (start from 1, length) in characters of the rendered turns."""
    return (
        f"aggregate({turns}, named_struct('at', 1, 'spans', cast(array() as array<struct<start: int, length: int>>)), (s, t) -> named_struct("
        f"'at', s.at + length({_PIECE}), 'spans', if(t.role = 'assistant', concat(s.spans, array(named_struct('start', s.at + length(concat('{HEAD}', t.role, '{BREAK}')), 'length', length(t.text) + {len(END)}))), s.spans)), s -> s.spans)"
    )


def formatted(turns: DataFrame) -> DataFrame:
    """pair_id, n_common (turns of the prompt), prompt, chosen, rejected, chosen_spans, rejected_spans. Turns without a
    pair_id belong to no pair and are left out; repeated turns are turns of their own."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, turn))).alias(name)
    pairs = turns.filter(F.col("side").isin("chosen", "rejected") & F.col("pair_id").isNotNull()).groupBy("pair_id").agg(side("chosen"), side("rejected"))
    alike = """aggregate(arrays_zip(chosen, rejected), named_struct('n', 0, 'alike', true), (s, z) -> if(
        s.alike and z.chosen.role = z.rejected.role and z.chosen.text = z.rejected.text, named_struct('n', s.n + 1, 'alike', true), named_struct('n', s.n, 'alike', false)), s -> s.n)"""
    pairs = pairs.withColumn("n_common", F.expr(alike))
    return pairs.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_common"),
        F.expr(_text("slice(chosen, 1, n_common)")).alias("prompt"),
        F.expr(_text(_completion("chosen"))).alias("chosen"),
        F.expr(_text(_completion("rejected"))).alias("rejected"),
        F.expr(_spans(_completion("chosen"))).alias("chosen_spans"),
        F.expr(_spans(_completion("rejected"))).alias("rejected_spans"),
    )


def neighbour_pairs(conversations: DataFrame, fallback: str = "I cannot help with that.") -> DataFrame:
    """Pairs to format, out of plain conversations (conv_id, turn, role, text): a conversation is chosen against
    itself with its last assistant turn replaced by the last assistant turn of its neighbour, conversation 2k for 2k+1
    and the other way round, or by the fallback. Joins are by conv_id."""
    said = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = said.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max(F.struct("turn", "text")).getField("text").alias("last_text"))
    other = last.select((F.col("conv_id") + 1 - 2 * F.pmod("conv_id", F.lit(2))).alias("conv_id"), F.col("last_text").alias("other_text"))
    rows = said.join(last.select("conv_id", "last_turn"), "conv_id", "left").join(other, "conv_id", "left")
    replaced = F.when((F.col("turn") == F.col("last_turn")) & (F.col("role") == "assistant"), F.coalesce("other_text", F.lit(fallback))).otherwise(F.col("text"))
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("says")), F.struct(F.lit("rejected").alias("side"), replaced.alias("says"))))
    return rows.withColumn("one", sides).select(F.col("conv_id").alias("pair_id"), "one.side", "turn", "role", F.col("one.says").alias("text"))


def span_text(spans: str) -> str:
    """SQL: spans as start+length,start+length."""
    return f"array_join(transform({spans}, s -> concat(s.start, '+', s.length)), ',')"


#: DuckDB SQL of neighbour_pairs() and formatted(), with spans as text.
ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
last AS (SELECT conv_id, max(turn) AS last_turn, max({'turn': turn, 'text': text}).text AS last_text FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (
  SELECT t.conv_id, t.turn, t.role,
    CASE WHEN t.turn = l.last_turn AND t.role = 'assistant' THEN coalesce(p.last_text, 'I cannot help with that.') ELSE t.text END AS text
  FROM t LEFT JOIN last l ON l.conv_id = t.conv_id LEFT JOIN last p ON p.conv_id = t.conv_id + 1 - 2 * (t.conv_id % 2)),
both_sides AS (SELECT conv_id, 'chosen' AS side, turn, role, text FROM t UNION ALL SELECT conv_id, 'rejected', turn, role, text FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, role, text) AS k FROM both_sides),
common AS (
  SELECT a.conv_id, coalesce(min(a.k) FILTER (WHERE b.k IS NULL OR a.role <> b.role OR a.text <> b.text) - 1, max(a.k)) AS n_common
  FROM (SELECT * FROM n WHERE side = 'chosen') a LEFT JOIN (SELECT * FROM n WHERE side = 'rejected') b ON a.conv_id = b.conv_id AND a.k = b.k
  GROUP BY a.conv_id),
p AS (
  SELECT n.*, n_common, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece
  FROM n JOIN common USING (conv_id)),
o AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, side, k > n_common ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + length('<|im_start|>' || role || chr(10)) + 1 AS starts FROM p)
SELECT conv_id AS pair_id, CAST(any_value(n_common) AS BIGINT) AS n_common,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE side = 'chosen' AND k <= n_common), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE side = 'chosen' AND k > n_common), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE side = 'rejected' AND k > n_common), '') AS rejected,
  coalesce(string_agg(CAST(starts AS BIGINT) || '+' || (length(text) + 10), ',' ORDER BY k) FILTER (WHERE side = 'chosen' AND k > n_common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(starts AS BIGINT) || '+' || (length(text) + 10), ',' ORDER BY k) FILTER (WHERE side = 'rejected' AND k > n_common AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY conv_id
"""
