"""Preference formatting of conversations (native: DataFrame functions only).

A pair has a chosen and a rejected conversation. Their longest common prefix of turns (same place, role and text)
is rendered once, as the prompt; what follows it in either is rendered as that side's completion, with a mask: the
spans (code points, end exclusive) of the completion that are trained on, which are the assistant's texts with
their closing marks.

A turn's place is its number and, among turns of one number, its order by role and text. Places of both sides are
laid side by side by (pair, number), the first place that differs is a minimum over the pair, and the pieces of a
pair are put together in two steps: by blocks of `BLOCK` turn numbers, which spreads the work on a long conversation
and shrinks it to a few strings, then by pair, one row each. Offsets of a mask count from the start of its completion.

Edge cases: a null text or role counts as empty; turns without a number come before all others, apart from them; rows
with a null conversation id are one conversation; a missing side is an empty conversation; if both sides are equal all
is prompt and both completions are empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BLOCK = 256
#: How a turn is rendered, and whose turns are trained on.
OPEN, AFTER_ROLE, CLOSE, TRAINED = "<|im_start|>", "\n", "<|im_end|>\n", "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(AFTER_ROLE), text, F.lit(CLOSE))


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: x["s"]), "")


def _spans(parts: Column) -> Column:
    """(length of the rendered parts, their trained spans as an array of (start, end))."""
    kind = "array<struct<a:bigint,z:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["s"])
        span = F.struct((acc["at"] + x["head"]).alias("a"), (end - 1).alias("z"))  # without the last line end
        return F.struct(end.alias("at"), F.when(x["head"] >= 0, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, step)


def _mask(blocks: Column, text: str, spans: str) -> Column:
    """start:end of the trained spans of blocks laid one after another, comma-joined."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        moved = F.transform(x[spans], lambda y: F.concat_ws(":", (acc["at"] + y["a"]).cast("string"), (acc["at"] + y["z"]).cast("string")))
        return F.struct((acc["at"] + F.length(x[text])).alias("at"), F.concat(acc["out"], moved).alias("out"))

    return F.array_join(F.aggregate(blocks, start, step, lambda acc: acc["out"]), ",")


def preference(turns: DataFrame) -> DataFrame:
    """turns: pair, side ('chosen' or 'rejected'), turn, role, text -> pair, prompt, chosen, rejected, chosen_mask, rejected_mask, prompt_turns."""
    empty = F.lit("")
    # A null pair is a key of its own, so keys compare by plain equality; turns without a number are a block of their own.
    kind = turns.schema["pair"].dataType
    none = F.lit(0 if "long" in kind.typeName() or "int" in kind.typeName() else "").cast(kind)
    pair, key = ["_pair", "_null"], ["_pair", "_null", "numbered", "block"]
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0))
    rows = turns.select(
        F.coalesce("pair", none).alias("_pair"), F.col("pair").isNull().alias("_null"), F.col("turn").isNotNull().alias("numbered"), F.floor(turn / BLOCK).cast("long").alias("block"),
        "side", turn.alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
    ).repartition(*key)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "side", "turn").orderBy("role", "text")))
    of = lambda side: F.max(F.when(F.col("side") == side, F.struct("role", "text"))).alias(side)
    places = rows.groupBy(*key, "turn", "nth").agg(of("chosen"), of("rejected"))
    place = F.struct("numbered", "turn", "nth")
    differs = F.col("chosen").isNull() | F.col("rejected").isNull() | (F.col("chosen") != F.col("rejected"))
    apart = places.groupBy(*key).agg(F.min(F.when(differs, place)).alias("first"))
    first = apart.groupBy(*pair).agg(F.min("first").alias("first"))
    placed = places.join(apart.select(*key).join(first, pair), key)
    common = F.col("first").isNull() | (place < F.col("first"))
    head = lambda x: F.when(x["role"] == TRAINED, F.length(x["role"]) + len(OPEN) + len(AFTER_ROLE)).otherwise(-1)

    def piece(x: Column) -> Column:
        return F.struct("turn", "nth", rendered(x["role"], x["text"]).alias("s"), head(x).cast("long").alias("head"))

    gather = lambda when, x: F.array_sort(F.collect_list(F.when(when & x.isNotNull(), piece(x))))
    blocks = placed.groupBy(*key).agg(gather(common, F.col("chosen")).alias("p"), gather(~common, F.col("chosen")).alias("c"), gather(~common, F.col("rejected")).alias("r"))
    blocks = blocks.select(
        *key, F.size("p").cast("long").alias("turns"), _joined(F.col("p")).alias("p"), _joined(F.col("c")).alias("c"), _joined(F.col("r")).alias("r"),
        _spans(F.col("c"))["out"].alias("cs"), _spans(F.col("r"))["out"].alias("rs"),
    )
    whole = blocks.groupBy(*pair).agg(F.sum("turns").alias("prompt_turns"), F.array_sort(F.collect_list(F.struct("numbered", "block", "p", "c", "r", "cs", "rs"))).alias("b"))
    b, text = F.col("b"), lambda c: F.array_join(F.transform("b", lambda x: x[c]), "")
    return whole.select(
        F.when(~F.col("_null"), F.col("_pair")).alias("pair"), text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"),
        _mask(b, "c", "cs").alias("chosen_mask"), _mask(b, "r", "rs").alias("rejected_mask"), "prompt_turns",
    )


def counterparts(conversations: DataFrame) -> DataFrame:
    """Pairs for a table of single conversations: each is chosen; rejected is the same one, but its last turn has the text of the last turn of its neighbour (the id with the lowest bit flipped), or none."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    last = rows.groupBy("conv_id").agg(F.max(F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    ends = last.select(F.col("conv_id").alias("of_id"), F.col("last.numbered").alias("end_numbered"), F.col("last.turn").alias("end_turn"), F.col("last.role").alias("end_role"), F.col("last.text").alias("end_text"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("for_id"), F.col("last.text").alias("other_text"))
    ends = ends.join(other, ends["of_id"] == other["for_id"], "left")
    joined = rows.join(ends, rows["conv_id"].eqNullSafe(ends["of_id"]))
    is_end = (F.col("turn").isNotNull() == F.col("end_numbered")) & (F.coalesce(F.col("turn").cast("long"), F.lit(0)) == F.col("end_turn")) & (F.coalesce("role", F.lit("")) == F.col("end_role")) & (F.coalesce("text", F.lit("")) == F.col("end_text"))
    rejected = F.when(is_end, F.coalesce("other_text", F.lit(""))).otherwise(F.col("text"))
    sides = F.inline(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), rejected.alias("text"))))
    return joined.select(F.col("conv_id").alias("pair"), "turn", "role", sides)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference(counterparts(table(spark, sf_dir, "conversations"))).withColumnRenamed("pair", "conv_id")
