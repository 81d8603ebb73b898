"""Preference formatting: one prompt, two masked completions.

A pair is a chosen and a rejected conversation under one id.  The turns that
both begin with, the longest common prefix by role and text, are rendered once
as the prompt; what is left of each is a completion, with the spans of text
that a model is trained on (the assistant's turns, with the mark that ends
them).  Spans count code points of prompt and completion together.

Both sides are grouped by the id in one shuffle, and each pair is rendered in
one pass over its turns.

Defined results: turns are in the order of their number, then of role and text;
null roles and texts count as empty; a null turn number comes first; turns
without an id belong to no pair and take no part; a pair of which one side is
missing has an empty prompt and an empty completion on that side; equal
conversations have all turns in the prompt and empty completions; repeated rows
are turns of their own; an empty table gives an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, AFTER_ROLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"
_SPANS = "array<struct<start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

Turns = list[tuple[str, str]]


def render(turns: Turns, start: int = 0) -> tuple[str, list[dict[str, int]]]:
    """The text of turns, and the trained spans in it, counted from ``start``."""
    parts, spans = [], []
    for role, text in turns:
        shown = f"{BEGIN}{role}{AFTER_ROLE}{text}{END}"
        if role == TRAINED:
            spans.append({"start": start + len(BEGIN) + len(role) + len(AFTER_ROLE), "end": start + len(shown)})
        start += len(shown)
        parts.append(shown)
    return "".join(parts), spans


def common(chosen: Turns, rejected: Turns) -> int:
    """How many turns both begin with."""
    return next((i for i, (a, b) in enumerate(zip(chosen, rejected)) if a != b), min(len(chosen), len(rejected)))


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # a pair at a time bounds the memory
            c, r = ([(t["role"], t["text"]) for t in batch.column(k)[i].as_py()] for k in (1, 2))
            n = common(c, r)
            prompt, _ = render(c[:n])
            (chosen, c_spans), (rejected, r_spans) = (render(x[n:], len(prompt)) for x in (c, r))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), pa.array([n]), *(pa.array([x], pa.string()) for x in (prompt, chosen, rejected)), *(pa.array([x], _ARROW_SPANS) for x in (c_spans, r_spans))],
                ["pair_id", "n_common", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans"],
            )


def _turns(df: DataFrame, side: str, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    rows = df.select(F.col(id_col).alias("pair_id"), F.lit(side).alias("side"), F.struct(F.col(turn_col).cast("long").alias("turn"), *text).alias("t"))
    return rows.filter(F.col("pair_id").isNotNull())


def format_pairs(chosen: DataFrame, rejected: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans``."""
    both = _turns(chosen, "c", id_col, turn_col, role_col, text_col).unionByName(_turns(rejected, "r", id_col, turn_col, role_col, text_col))

    def of(side: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("t"))))

    pairs = both.groupBy("pair_id").agg(of("c").alias("c"), of("r").alias("r"))
    kind = pairs.schema["pair_id"].dataType.simpleString()
    return pairs.mapInArrow(_formatted, f"pair_id {kind}, n_common long, prompt string, chosen string, rejected string, chosen_spans {_SPANS}, rejected_spans {_SPANS}")


def _replied(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The turns of each conversation up to its last reply, with the number of that
    turn (``_last``) and the text of the reply before it (``_said``)."""
    named = turns.select(F.col(id_col).alias(id_col), F.col(turn_col).cast("long").alias(turn_col), F.col(role_col).alias(role_col), F.col(text_col).alias(text_col))
    replies = named.filter((F.col(role_col) == TRAINED) & F.col(id_col).isNotNull())
    at = Window.partitionBy(id_col).orderBy(F.desc_nulls_last(turn_col), F.desc(text_col))
    two = replies.withColumn("_nth", F.row_number().over(at)).filter("_nth <= 2")
    last = two.groupBy(id_col).agg(F.max(F.when(F.col("_nth") == 1, F.col(turn_col))).alias("_last"), F.max(F.when(F.col("_nth") == 2, F.col(text_col))).alias("_said"))
    return named.join(last, id_col).filter(F.col(turn_col).isNull() | (F.col(turn_col) <= F.col("_last")))


def to_last_reply(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The conversations that have an assistant's turn, each up to its last one."""
    return _replied(turns, id_col, turn_col, role_col, text_col).select(id_col, turn_col, role_col, text_col)


def stale_replies(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A rejected side for a table of plain conversations.

    As :func:`to_last_reply`, but the last reply says again what the assistant's
    turn before it said (or nothing, if it is the first): a reply that does not
    answer the last question.
    """
    rows = _replied(turns, id_col, turn_col, role_col, text_col)
    last = (F.col(role_col) == TRAINED) & F.col(turn_col).eqNullSafe(F.col("_last"))
    return rows.select(id_col, turn_col, role_col, F.when(last, F.coalesce("_said", F.lit(""))).otherwise(F.col(text_col)).alias(text_col))


def spans_text(col: str) -> Column:
    return F.array_join(F.transform(F.col(col), lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
