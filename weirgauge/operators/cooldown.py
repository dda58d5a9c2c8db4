"""Per-(rule, target) suppression of repeated alerts.

The decision is sequential: an alert fires when none fired within the cooldown
before it, and suppressed ones do not count. To keep that parallel the timeline
is cut into blocks. What a block needs from the past is only the last firing
inside the cooldown right before it, and there are few such instants. So every
block is first evaluated for each possible entry, the blocks of a key are then
chained by looking the entries up, and each block finally fires from its own
true entry. No list grows beyond a block, or one number per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgauge.functions.clock import MICROS
from weirgauge.schema import FIRED_COLUMNS

BLOCK_SECS = 6 * 3600


def alert_key() -> Column:
    return F.concat_ws("|", F.col("rule"), F.coalesce(F.col("target_ip").cast("string"), F.lit("-")))


def apply_cooldown(candidates: DataFrame, cooldown_secs: int = 60, block_secs: int = BLOCK_SECS) -> DataFrame:
    """Candidates that fire. At exactly ``cooldown_secs`` after a firing the next one does."""
    quiet_us = cooldown_secs * MICROS
    block_us = max(block_secs, cooldown_secs) * MICROS
    long_ago = F.lit(-quiet_us).cast("bigint")

    at = F.unix_micros("triggered_at")
    hits = candidates.select(alert_key().alias("alert_key"), at.alias("at_us"), *FIRED_COLUMNS)
    block = F.call_function("div", F.col("at_us"), F.lit(block_us))
    # Bounded: a key has at most one candidate per tick.
    blocks = hits.groupBy("alert_key", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at_us", *FIRED_COLUMNS))).alias("hits"))

    past = Window.partitionBy("alert_key").orderBy("block")
    follows = F.lag("block").over(past) == F.col("block") - 1
    late_hits = F.filter(
        F.col("hits.at_us"), lambda t: t > (F.col("block") + 1) * block_us - quiet_us)
    linked = (
        blocks.withColumn("tail", late_hits)
        .withColumn("entries", F.concat(
            F.array(long_ago),
            F.when(follows, F.lag("tail").over(past)).otherwise(F.array().cast("array<bigint>"))))
        .withColumn("run", F.col("block") - F.row_number().over(past))
    )

    def last_firing(entry: Column) -> Column:
        return F.aggregate(
            F.col("hits.at_us"), entry, lambda last, t: F.when(t - last >= quiet_us, t).otherwise(last))

    steps = linked.select(
        "alert_key", "run", "block", "entries",
        F.transform("entries", last_firing).alias("exits"))
    # A firing too old to matter is the same as none, hence the fallback to entry 1.
    def follow(state: Column, step: Column) -> Column:
        place = F.array_position(step["entries"], state["now"]).cast("int")
        entry = F.when(place > 0, state["now"]).otherwise(long_ago)
        leave = F.element_at(step["exits"], F.when(place > 0, place).otherwise(F.lit(1)))
        return F.struct(
            leave.alias("now"),
            F.array_append(state["seen"], F.struct(step["block"].alias("block"), entry.alias("entry"))).alias("seen"))

    start = F.struct(
        long_ago.alias("now"), F.array().cast("array<struct<block:bigint,entry:bigint>>").alias("seen"))
    entered = (
        steps.groupBy("alert_key", "run")
        .agg(F.array_sort(F.collect_list(F.struct("block", "entries", "exits"))).alias("steps"))
        .select("alert_key", F.explode(F.aggregate("steps", start, follow, lambda s: s["seen"])).alias("seen"))
        .select("alert_key", "seen.block", "seen.entry")
    )

    hit_type = blocks.schema["hits"].dataType.simpleString()
    nothing = F.struct(F.col("entry").alias("last"), F.array().cast(hit_type).alias("fired"))

    def decide(state: Column, hit: Column) -> Column:
        return F.when(
            hit["at_us"] - state["last"] >= quiet_us,
            F.struct(hit["at_us"].alias("last"), F.array_append(state["fired"], hit).alias("fired")),
        ).otherwise(state)

    return (
        blocks.join(entered, ["alert_key", "block"])
        .select(F.explode(F.aggregate("hits", nothing, decide, lambda s: s["fired"])).alias("hit"))
        .select(*[F.col(f"hit.{c}") for c in FIRED_COLUMNS])
    )
