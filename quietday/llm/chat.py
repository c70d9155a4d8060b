"""Chat formatting: collapse cumulative snapshots, then render the conversations that are left.

Logs often hold a conversation several times, each time one turn longer. A rolling hash of the turns (128
bits, each turn's hash tied to its place, joined by xor) names every prefix; a conversation is a
snapshot of a longer one when its own hash is met as a prefix more often than as a whole conversation.
Anti-joins take these and all but one of equal conversations away. Native DataFrame operations only.

A conversation may be very long: its turns are dealt to blocks of `BLOCK` turn numbers, ranks and rolling
hashes come from blocks first, and the text is rendered in parts of at most `BLOCK` turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietday.llm.common import cut

BLOCK = 256


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def _before(column: str, w) -> Column:
    """The xor of `column` over the rows before this one."""
    return F.coalesce(F.bit_xor(column).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def content(turns: DataFrame) -> DataFrame:
    """The turns with null role and text as empty, and a 128-bit hash of each text."""
    text = F.coalesce("text", F.lit(""))
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.unhex(F.md5(text)).alias("hash"))


def placed_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, hash, pos (from 1), turn hashes h1, h2 and the rolling ones p1, p2 up to and with each turn.

    Texts stay out of the sorts and joins. Repeated rows count once; turns are in order of turn (null first), role, hash.
    Null conv_ids are one conversation.
    """
    rows = rows.select("conv_id", "turn", "role", "hash").distinct()
    rows = rows.withColumn("block", F.floor(F.coalesce(F.col("turn").cast("double"), F.lit(-1.0)) / BLOCK).cast("long"))
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "hash")
    inner = rows.withColumn("inner", F.row_number().over(order))
    over = Window.partitionBy("conv_id").orderBy("block")
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    same = (F.col("a.block") == F.col("b.block")) & F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    placed = inner.alias("a").join(bases.alias("b"), same).select("a.*", (F.col("base") + F.col("inner")).alias("pos"))
    hashed = placed.withColumn("h1", F.xxhash64("pos", "role", "hash")).withColumn("h2", F.xxhash64("hash", F.lit("turn"), "pos", "role"))
    totals = hashed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    starts = totals.select("conv_id", "block", _before("t1", over).alias("s1"), _before("t2", over).alias("s2"))
    running = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumn("r1", F.bit_xor("h1").over(running)).withColumn("r2", F.bit_xor("h2").over(running))
    return (
        rolled.alias("a")
        .join(starts.alias("b"), same)
        .select("a.conv_id", "turn", "role", "hash", "pos", "h1", "h2", F.col("r1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("s2")).alias("p2"))
    )


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no longer one begins with; of equal ones, the least id."""
    wholes = cut(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2")))
    equal = wholes.groupBy("n_turns", "p1", "p2").agg(F.count(F.lit(1)).alias("whole"), F.min("conv_id").alias("keep"))
    prefixes = placed.groupBy(F.col("pos").alias("n_turns"), "p1", "p2").agg(F.count(F.lit(1)).alias("seen"))
    longer = equal.join(prefixes, ["n_turns", "p1", "p2"]).where(F.col("seen") > F.col("whole")).select("n_turns", "p1", "p2")
    return equal.join(longer, ["n_turns", "p1", "p2"], "left_anti").select(F.col("keep").alias("conv_id"), "n_turns")


def collapse_and_render(turns: DataFrame, part_turns: int = BLOCK) -> DataFrame:
    """One row per maximal conversation and part: conv_id, part (from 0), n_turns (of the whole), text.

    A part holds up to `part_turns` turns, so an ordinary conversation is part 0; with `part_turns` above the
    longest conversation's turns each is one row, which then must fit into a task. Null conv_ids are one
    conversation, null roles and texts are empty, repeated rows count once; a very long turn is rendered whole.
    An empty table gives no rows; columns other than conv_id, turn, role and text are ignored.
    """
    rows = content(turns)
    placed = cut(placed_turns(rows))
    kept = maximal(placed)
    mine = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    places = cut(placed.alias("a").join(kept.alias("b"), mine).select("a.conv_id", "n_turns", "turn", "role", "hash", "pos"))
    # repeated rows shrink to one before texts are joined to places and gathered
    rows = rows.groupBy("conv_id", "turn", "role", "hash", F.xxhash64("text")).agg(F.any_value("text").alias("text"))
    same = mine & F.col("a.turn").eqNullSafe(F.col("b.turn")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.hash") == F.col("b.hash"))
    pieces = rows.alias("a").join(places.alias("b"), same).select("a.conv_id", "n_turns", "pos", render_turn(F.col("a.role"), F.col("text")).alias("piece"))
    part = F.floor((F.col("pos") - 1) / part_turns).cast("int").alias("part")
    lists = pieces.groupBy("conv_id", part, "n_turns").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("pieces"))
    return lists.select("conv_id", "part", "n_turns", F.array_join("pieces.piece", "").alias("text"))
