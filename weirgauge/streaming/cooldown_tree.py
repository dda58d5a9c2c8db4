"""Cooldown of a stream as a tree of stored maps.

The timeline is cut into blocks, and every ``FANOUT`` nodes of a level make up one of the
next. A node holds what its stretch does to the cooldown of each key
(``operators/cooldown_maps.py``). A batch computes the blocks of its ticks anew, and the
nodes above them that have passed: a late candidate costs its block, the next one and one
node per level, however long the history. Nodes that have not passed are not kept, so
that the path above the newest block is not written by every batch.

A node's rows are a partition per batch that has computed it; the newest counts. One row
without a key is always there, so that a node that has lost all its candidates is known
from one that was never computed. Times are those of receipt, 1970 or later.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgauge.config import TICK_SECS, WINDOW_SECS
from weirgauge.functions.clock import MICROS
from weirgauge.operators.alerts import number_alerts
from weirgauge.operators.cooldown import apply_cooldown
from weirgauge.operators.cooldown_maps import MAP_SCHEMA, as_candidates, block_maps, compose_maps, last_firings
from weirgauge.schema import FIRED_COLUMNS
from weirgauge.streaming.metrics_stream import (
    FIRED_SCHEMA, Span, current_candidates, in_spans, joined_spans, last_tick_us, newest_moment,
)
from weirgauge.streaming.tables import BATCH, FANOUT, groups_of, read_parts, write_batch

BLOCK_SECS = 600
NODE = "node"  # level and number
LISTED = 500  # nodes that are named one by one; beyond it their level is listed
_STORED = T.StructType([*MAP_SCHEMA.fields, T.StructField("number", T.LongType()), T.StructField(NODE, T.StringType())])


def _path(root: str, cooldown_secs: int) -> str:
    return f"{root}/cooldown-{cooldown_secs}"


def _block_us(cooldown_secs: int) -> int:
    return max(BLOCK_SECS, cooldown_secs) * MICROS


def _name(level: int, number: int) -> str:
    return f"{level}-{number}"


def _nodes(spark: SparkSession, path: str, names: Sequence[str], batch_id: int | None) -> DataFrame:
    """Rows of the named nodes as computed last, by ``batch_id`` at the latest."""
    if not names:
        return spark.createDataFrame([], _STORED)
    wanted = spark.createDataFrame([(n,) for n in names], f"{NODE} string")
    folders = names if len(names) <= LISTED else sorted({f"{n.split('-')[0]}-*" for n in names})
    rows = read_parts(spark, path, _STORED, NODE, folders).join(F.broadcast(wanted), NODE, "left_semi")
    if batch_id is not None:
        rows = rows.where(F.col(BATCH) <= batch_id)
    newest = rows.where(F.col("rule").isNull()).groupBy(NODE).agg(F.max(BATCH).alias(BATCH))
    return rows.join(F.broadcast(newest), [NODE, BATCH], "left_semi").where(F.col("rule").isNotNull()).select(
        *_STORED.fieldNames())


def _write(maps: DataFrame, path: str, level: int, numbers: Iterable[int], batch_id: int) -> None:
    """Replace the nodes ``numbers`` of a level."""
    spark = maps.sparkSession
    marks = spark.createDataFrame([(n,) for n in numbers], "number bigint")
    rows = maps.join(F.broadcast(marks), "number", "left_semi").unionByName(marks, allowMissingColumns=True)
    named = rows.withColumn(NODE, F.concat(F.lit(f"{level}-"), F.col("number").cast("string")))
    write_batch(named.select(*_STORED.fieldNames()), path, batch_id, [NODE])


def update_cooldown(spark: SparkSession, root: str, batch_id: int, spans: Sequence[Span], cooldown_secs: int = 60,
                    tick_secs: int = TICK_SECS, windows: Sequence[int] = WINDOW_SECS) -> None:
    """Bring the tree up to date with a batch that has flows in ``spans``. A node above
    the blocks is computed when it has passed, and again when a batch touches it."""
    path, size, quiet = _path(root, cooldown_secs), _block_us(cooldown_secs), cooldown_secs * MICROS
    reach = max(windows) * MICROS
    newest, former = newest_moment(spark, root, batch_id), newest_moment(spark, root, batch_id - 1)

    # The block after a touched one may be entered in another state.
    touched = {
        n for low, high in spans
        for n in range(last_tick_us(low, tick_secs) // size, (high + reach) // size + 2)}
    around = joined_spans([(n * size - quiet, (n + 1) * size - 1) for n in touched], 0)
    found = current_candidates(spark, root, batch_id, around).where(in_spans(F.unix_micros("triggered_at"), around))
    _write(block_maps(found, quiet, size).withColumnRenamed("block", "number"), path, 0, sorted(touched), batch_id)

    # Nodes that have passed since the batch before and are not above a block of this
    # batch have their last candidates where the flows ended then.
    ended = () if former is None else range(last_tick_us(former, tick_secs) // size, (former + reach) // size + 2)
    below, level = touched | set(ended), 1
    passed = last_tick_us(newest, tick_secs) // size  # whole blocks that have
    while FANOUT ** level <= passed:
        below = {n // FANOUT for n in below}
        due = sorted(n for n in below if (n + 1) * FANOUT ** level <= passed)
        if due:
            children = _nodes(spark, path, [_name(level - 1, n * FANOUT + k) for n in due for k in range(FANOUT)], batch_id)
            parent = F.floor(F.col("number") / FANOUT).cast("bigint")
            joined = compose_maps(children, "number", parent, parent * FANOUT, quiet)
            _write(joined.withColumnRenamed("parent", "number"), path, level, due, batch_id)
        level += 1


def alerts_between(spark: SparkSession, root: str, low_us: int, high_us: int, cooldown_secs: int = 60,
                   tick_secs: int = TICK_SECS) -> DataFrame:
    """Numbered alerts of the ticks from ``low_us`` to ``high_us``, both included, as in
    ``stored_alerts``, but from the candidates of this time alone: the state of the
    cooldown at its beginning and the ids given before come from O(log n) nodes.
    ``cooldown_secs`` must be what the stream runs with."""
    newest = newest_moment(spark, root)
    if newest is None:
        return number_alerts(spark.createDataFrame([], FIRED_SCHEMA))
    path, size, quiet = _path(root, cooldown_secs), _block_us(cooldown_secs), cooldown_secs * MICROS
    if read_parts(spark, path, _STORED, NODE, [_name(0, last_tick_us(newest, tick_secs) // size)]).isEmpty():
        raise ValueError(f"the stream under {root} keeps no cooldown of {cooldown_secs} s")

    limit = last_tick_us(newest, tick_secs)
    low, high = min(max(low_us, 0), limit), min(high_us, limit)
    blocks = low // size  # that lie before
    cover = {_name(level, (last + 1) // FANOUT ** level - 1): last for level, last in groups_of(blocks)}
    maps = _nodes(spark, path, list(cover), None)
    if cover:
        order = spark.createDataFrame([(name, last) for name, last in cover.items()], f"{NODE} string, place bigint")
        maps = maps.join(F.broadcast(order), NODE)
    else:
        maps = maps.withColumn("place", F.col("number"))
    firings = last_firings(maps, "place", quiet)
    given = firings.agg(F.coalesce(F.sum("fired"), F.lit(0))).first()[0]

    at = F.unix_micros("triggered_at")
    begin = blocks * size
    due = current_candidates(spark, root, spans=[(begin, max(begin, high))]).where(at.between(begin, high))
    # A firing before the last block is too old to matter, whatever the key.
    earlier = as_candidates(firings.where(F.col("at_us") > begin - quiet), FIRED_SCHEMA.fields)
    fired = apply_cooldown(earlier.unionByName(due).select(*FIRED_COLUMNS), cooldown_secs).where(at >= begin)
    return number_alerts(fired, given).where(at.between(low_us, high_us))
