"""Preference formatting: the longest common turn prefix once as prompt, then two masked completions.

Two conversations, chosen and rejected, share a prefix of turns equal in role and text. The prefix is
rendered once; what follows in each is its completion, with a mask that trains on assistant turns
only, as character spans of the completion. Everything is DataFrame functions.

A null role or text is rendered as empty, and equals only null when prefixes are compared; turns are
ordered by number, then role and text where numbers repeat (repeated rows are repeated turns); rows
without a conv_id are left out; equal conversations give empty completions; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's (role, text) in order. A conversation is one record."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.where("conv_id is not null").groupBy("conv_id").agg(F.transform(rows, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("")), F.lit("|>\n"), F.coalesce(x["text"], F.lit("")), F.lit("\n"))), "")


def _spans(turns: str) -> str:
    """SQL for the (start, end) character spans of assistant turns' texts in a rendering."""
    length = "length(concat('<|', coalesce(x.role, ''), '|>\\n', coalesce(x.text, ''), '\\n'))"
    return f"""transform(filter(aggregate({turns},
        cast(array() AS array<struct<keep:boolean,start:bigint,end:bigint,next:bigint>>),
        (a, x) -> concat(a, array(struct(coalesce(x.role = 'assistant', false) AS keep,
            coalesce(try_element_at(a, -1).next, 0L) + length(coalesce(x.role, '')) + 5 AS start,
            coalesce(try_element_at(a, -1).next, 0L) + {length} - 1 AS end,
            coalesce(try_element_at(a, -1).next, 0L) + {length} AS next)))), s -> s.keep), s -> array(s.start, s.end))"""


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Format (chosen_id, rejected_id, chosen, rejected), the last two arrays of (role, text)."""
    same = F.expr("filter(sequence(0, least(size(chosen), size(rejected))), i -> NOT coalesce(get(chosen, i) <=> get(rejected, i) AND get(chosen, i) IS NOT NULL, false))[0]")
    cut = pairs.withColumn("prefix_turns", same.cast("long"))
    for side in ("chosen", "rejected"):
        cut = cut.withColumn(f"_{side}", F.slice(side, F.col("prefix_turns").cast("int") + 1, F.size(side)))
    return cut.select(
        "chosen_id", "rejected_id", "prefix_turns", _render(F.slice("chosen", F.lit(1), F.col("prefix_turns").cast("int"))).alias("prompt"),
        _render(F.col("_chosen")).alias("chosen_completion"), F.expr(_spans("_chosen")).alias("chosen_mask"),
        _render(F.col("_rejected")).alias("rejected_completion"), F.expr(_spans("_rejected")).alias("rejected_mask"),
    )


def reading_order(turns: DataFrame) -> DataFrame:
    """(conv_id, place, total): places from 0 in the order of the turns' digests, then of the id, so that
    conversations stand next to those that they share most first turns with.

    Only digests are sorted, in ranges that the id cuts too, so a common conversation spreads over
    them; a range's places follow from the sizes of the ranges before it."""
    mark = F.md5(F.concat_ws("\x01", F.coalesce(F.concat(F.lit("1"), "role"), F.lit("0")), F.coalesce(F.concat(F.lit("1"), "text"), F.lit("0"))))
    rows = turns.where("conv_id is not null").select("conv_id", F.struct("turn", mark.alias("mark")).alias("x"))
    keys = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x"))["mark"].alias("key"))
    spread = materialize(keys.repartitionByRange("key", "conv_id").withColumn("range", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in spread.groupBy("range").count().collect())  # a row a range
    before, total = [], 0
    for r, n in sizes:
        before.append((r, total))
        total += n
    offsets = turns.sparkSession.createDataFrame(before, "range int, before long")
    inside = F.row_number().over(Window.partitionBy("range").orderBy("key", "conv_id")) - 1
    placed = spread.withColumn("inside", inside).join(F.broadcast(offsets), "range")
    return placed.select("conv_id", (F.col("before") + F.col("inside")).alias("place"), F.lit(total).cast("long").alias("total"))


def pair_neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of neighbours in reading order (1st with 2nd, 3rd with 4th; an odd last one with the one
    before it, which then stands in two pairs; a single conversation has no pair). The one with more
    assistant text is chosen, on a tie the first. If the two share their first turn, both stand whole.
    If not, the rejected side is the chosen conversation branched at its last assistant turn, going on
    with the other's from its last assistant turn; it stays whole where either has none."""
    said = F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + F.when(x["role"] == "assistant", F.length(F.coalesce(x["text"], F.lit("")))).otherwise(0))
    own = F.array(F.floor(F.col("place") / 2))
    again = (F.col("total") % 2 == 1) & (F.col("place") == F.col("total") - 2)
    order = materialize(reading_order(turns)).select("conv_id", "place", F.explode(F.when(again, F.concat(own, F.array(F.floor(F.col("total") / 2)))).otherwise(own)).alias("pair"))
    conv = conversations(turns).join(order, "conv_id").select("pair", F.struct("place", "conv_id", said.alias("said"), "turns").alias("x"))
    both = conv.groupBy("pair").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n")).where("n = 2")
    win = F.col("a.said") >= F.col("b.said")
    side = lambda first: F.when(win if first else ~win, F.col("a")).otherwise(F.col("b"))
    picked = both.select(side(True).alias("c"), side(False).alias("r"))
    last = "size({0}.turns) - array_position(reverse(transform({0}.turns, x -> coalesce(x.role = 'assistant', false))), true) + 1"
    cut = picked.withColumns({"_c": F.expr(last.format("c")), "_r": F.expr(last.format("r"))}).withColumn("_whole", F.expr("c.turns[0] <=> r.turns[0] OR _c > size(c.turns) OR _r > size(r.turns)"))
    branch = F.expr("CASE WHEN _whole THEN r.turns ELSE concat(slice(c.turns, 1, int(_c) - 1), slice(r.turns, int(_r), size(r.turns))) END")
    return cut.select(F.col("c.conv_id").alias("chosen_id"), F.col("r.conv_id").alias("rejected_id"), F.col("c.turns").alias("chosen"), branch.alias("rejected"))
