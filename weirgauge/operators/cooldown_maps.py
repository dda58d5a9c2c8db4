"""What a stretch of the timeline does to a cooldown, as a small map that composes.

All that a block of candidates needs from the past is the last firing inside the
cooldown right before it. So a block is a map: for each possible last firing (none, or a
candidate at the end of the block before) the last firing when the block is over, and how
many candidates fired in it. Maps of neighbouring blocks compose to the map of the
longer stretch, which is no larger than that of its first block. A map row is
``rule, target_ip, entries, exits, counts``; equal places of the three arrays belong
together, and place 1 is the entry without a firing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["rule", "target_ip"]
MAP_SCHEMA = T.StructType([
    T.StructField("rule", T.StringType()), T.StructField("target_ip", T.LongType()),
    *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("entries", "exits", "counts")]])


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _state(now: Column, fired: Column) -> Column:
    return F.struct(now.alias("now"), fired.alias("fired"))


def block_maps(candidates: DataFrame, quiet_us: int, block_us: int) -> DataFrame:
    """Maps of the blocks that have candidates, with the number of the block in
    ``block``. A block is at least as long as the cooldown, so a firing is forgotten
    over an empty block. ``candidates`` of the block before are needed, too."""
    at = F.unix_micros("triggered_at")
    block = F.floor(at / block_us).cast("bigint")
    own = F.struct(F.col("block"), F.lit(False).alias("before"))
    tail = F.struct((F.col("block") + 1).alias("block"), F.lit(True).alias("before"))
    late = F.col("at_us") > (F.col("block") + 1) * block_us - quiet_us
    placed = candidates.select(*KEY, at.alias("at_us"), block.alias("block")).select(
        *KEY, "at_us", F.explode(F.when(late, F.array(own, tail)).otherwise(F.array(own))).alias("p"))
    # Bounded: a key has one candidate per tick.
    blocks = placed.groupBy(*KEY, F.col("p.block").alias("block")).agg(
        F.array_sort(F.collect_list(F.when(~F.col("p.before"), F.col("at_us")))).alias("hits"),
        F.array_sort(F.collect_list(F.when(F.col("p.before"), F.col("at_us")))).alias("tail")).where(F.size("hits") > 0)

    def fire(state: Column, hit: Column) -> Column:
        return F.when(hit - state["now"] >= quiet_us, _state(hit, state["fired"] + 1)).otherwise(state)

    entries = F.concat(F.array(_long(-quiet_us)), F.col("tail"))
    through = F.transform("entries", lambda entry: F.aggregate("hits", _state(entry, _long(0)), fire))
    return _as_map(blocks.withColumn("entries", entries).withColumn("through", through), "block")


def _as_map(rows: DataFrame, *place: str) -> DataFrame:
    return rows.select(
        *KEY, *place, "entries", F.col("through.now").alias("exits"), F.col("through.fired").alias("counts"))


def _follow(state: Column, step: Column) -> Column:
    """One map further. A firing that the map does not know is too old to matter."""
    place = F.array_position(step["entries"], state["now"]).cast("int")
    place = F.when(place > 0, place).otherwise(F.lit(1))
    return _state(F.element_at(step["exits"], place), state["fired"] + F.element_at(step["counts"], place))


def _steps(order: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(order, "entries", "exits", "counts"))).alias("steps")


def compose_maps(maps: DataFrame, order: str, parent: Column, first: Column, quiet_us: int) -> DataFrame:
    """Compose the maps of each ``parent`` (as column ``parent``) along ``order``.
    ``first`` is the place in ``order`` that a parent begins with: without a map there,
    nothing before the parent matters."""
    nothing = F.array(_long(-quiet_us))
    joined = maps.groupBy(*KEY, parent.alias("parent"), first.alias("first")).agg(_steps(order))
    begin = F.element_at("steps", 1)
    entries = F.when(begin[order] == F.col("first"), begin["entries"]).otherwise(nothing)
    through = F.transform("entries", lambda entry: F.aggregate("steps", _state(entry, _long(0)), _follow))
    return _as_map(joined.withColumn("entries", entries).withColumn("through", through), "parent")


def last_firings(maps: DataFrame, order: str, quiet_us: int) -> DataFrame:
    """``rule, target_ip, at_us, fired``: the last firing of each key after all ``maps``
    along ``order``, and how many there were. The maps of a key follow on each other or
    have empty blocks between them."""
    start = _state(_long(-quiet_us), _long(0))
    return maps.groupBy(*KEY).agg(_steps(order)).select(
        *KEY, F.aggregate("steps", start, _follow).alias("s")).select(
        *KEY, F.col("s.now").alias("at_us"), F.col("s.fired").alias("fired"))


def as_candidates(firings: DataFrame, columns: Sequence[T.StructField]) -> DataFrame:
    """Last firings as rows that suppress what follows them in ``apply_cooldown``."""
    given = {"rule": F.col("rule"), "target_ip": F.col("target_ip"), "triggered_at": F.timestamp_micros("at_us")}
    return firings.select(*[
        given.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in columns])
