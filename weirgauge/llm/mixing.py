"""Mixing sources to target weights by balanced sampling with the cube method.

A document of a source whose target is ``r`` times its size is taken ``floor(r)``
times for certain and once more with probability ``r - floor(r)``. The cube method
decides these extra copies: the vector of fractional probabilities moves in the
null space of the balancing constraints (documents taken, tokens taken) until
coordinates become 0 or 1. With two constraints any three open documents have such
a direction, so the flight never holds more than three.

The flight runs in blocks of a source, dealt by a hash of the document. A block
leaves two documents open at most and holds back ten of assorted sizes, the largest
among them; these form the blocks of the next level, until one block per source is
left. Its last twelve are landed by the rounding that comes closest to the tokens due.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgauge.llm.rows import one_row_each, text_key
from weirgauge.llm.words import word_count
from weirgauge.storage import settle

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK_ROWS = 2_000
HELD_BACK = 10
_EDGE = 1e-9
_PLACE_BITS = 33  # of monotonically_increasing_id within a partition

Unit = tuple[int, float, float]  # row number, probability, size


def _numbered(sources: DataFrame) -> DataFrame:
    """Add ``place``, 0 for the first source in code point order, null last. Sorted
    and counted by range, so no task sees all sources."""
    marked = settle(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_at", _PLACE_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return marked.withColumn("_part", part).join(starts, "_part").withColumn(
        "place", F.col("_before") + F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)).select(*sources.columns, "place")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Add ``place`` and ``target`` (double) to one row per source with its
    ``source_size``.

    Sources in code point order, null last, get ``weights`` in turn. The sum of all
    sizes is shared by weight; a target stops at ``most`` times its source's size and
    the excess is shared again among the others until none is above. Every round of
    sharing is one aggregate over the sources. A source of size 0 has target 0.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = settle(_numbered(sources).withColumn("_weight", weight.cast("double")), "weights")
    limit = F.col("source_size").cast("double") * most
    share, stopped = F.lit(0.0), -1
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while total:
        free = F.col("_weight") * share <= limit
        used, weight_left, n_stopped = table.agg(
            F.sum(F.when(~free, limit).otherwise(0.0)), F.sum(F.when(free, F.col("_weight"))),
            F.sum(F.when(~free, 1).otherwise(0))).first()
        if n_stopped == stopped or not weight_left:
            break
        share, stopped = F.lit((total - used) / weight_left), n_stopped
    return table.withColumn("target", F.least(F.col("_weight") * share, limit)).drop("_weight")


def flight(units: list[Unit], seed: int) -> tuple[dict[int, float], list[Unit]]:
    """Move probabilities along null-space directions, three units at a time. Returns
    the decided units and the two at most that stay open; the sums of ``p`` and of
    ``p * size`` do not change."""
    chance = random.Random(seed)
    decided: dict[int, float] = {}
    held: list[Unit] = []
    for unit in units:
        held.append(unit)
        while len(held) == 3:
            (_, pa, xa), (_, pb, xb), (_, pc, xc) = held
            move = (xb - xc, xc - xa, xa - xb)  # null space of the rows (1 1 1) and (xa xb xc)
            if not any(move):
                move = (1.0, -1.0, 0.0)
            pairs = [(p, m) for p, m in zip((pa, pb, pc), move) if m]
            ahead = min((1 - p) / m if m > 0 else p / -m for p, m in pairs)
            back = min(p / m if m > 0 else (1 - p) / -m for p, m in pairs)
            step = ahead if chance.random() * (ahead + back) < back else -back
            moved = [(key, p + step * m, x) for (key, p, x), m in zip(held, move)]
            edge = min(range(3), key=lambda i: min(moved[i][1], 1 - moved[i][1]))  # reached up to rounding
            held = []
            for i, (key, p, x) in enumerate(moved):
                if i == edge or p < _EDGE or p > 1 - _EDGE:
                    decided[key] = float(round(p))
                else:
                    held.append((key, p, x))
    return decided, held


def land(units: list[Unit]) -> dict[int, float]:
    """The 0/1 choice nearest to the tokens due, then to the documents due."""
    due, count = sum(p * x for _, p, x in units), sum(p for _, p, _ in units)
    best = min(product((0.0, 1.0), repeat=len(units)), key=lambda pick: (
        abs(sum(k * x for k, (_, _, x) in zip(pick, units)) - due), abs(sum(pick) - count), pick))
    return {key: k for (key, _, _), k in zip(units, best)}


def held_back(n: int) -> list[int]:
    """Ranks, by falling size, of the units kept for the landing: the largest, whose
    rounding must be made up for, and others down to the smallest, to do it finely."""
    top = HELD_BACK // 2
    spread = [top + (n - 1 - top) * i // (HELD_BACK - top) for i in range(1, HELD_BACK - top + 1)]
    return sorted({i for i in (*range(top), *spread) if 0 <= i < n})


def cube_sample(units: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Replace the probabilities in ``prob`` (double, 0 to 1) by 0.0 or 1.0.

    ``units`` also has ``stratum`` and ``key`` (long, seeds the draws),
    ``size`` (long) and ``n_stratum`` (long, its rows); other columns are kept.
    A level deals every stratum into blocks of about ``block_rows`` rows by a hash of
    the key. What the blocks leave open, twelve rows each, goes to the next level.
    Reruns agree. No rows give no rows.
    """
    def solve(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "key"], ascending=False, kind="stable").reset_index(drop=True)
        rows = list(zip(range(len(block)), block["prob"].astype(float), block["size"].astype(float)))
        sure = {i: float(round(p)) for i, p, _ in rows if p < _EDGE or p > 1 - _EDGE}
        moving = [r for r in rows if r[0] not in sure]
        held = held_back(len(moving))
        decided, open_rows = flight([r for i, r in enumerate(moving) if i not in held], int(block["key"].iloc[0]))
        open_rows = [moving[i] for i in held] + open_rows
        if int(block["_blocks"].iloc[0]) == 1:
            decided |= land(open_rows)
            open_rows = []
        final = sure | decided | {i: p for i, p, _ in open_rows}
        block["prob"] = [final[i] for i in range(len(block))]
        return block

    def in_blocks(rows: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(rows / block_rows)).cast("bigint")

    done: DataFrame | None = None
    left = units.withColumn("_blocks", in_blocks(F.col("n_stratum")))
    while True:
        dealt = left.withColumn("_block", F.pmod(F.xxhash64("key", "_blocks"), F.col("_blocks")))
        solved = settle(dealt.groupBy("stratum", "_block").applyInPandas(solve, dealt.schema), "cube")
        is_open = (F.col("prob") > 0) & (F.col("prob") < 1)
        closed = solved.where(~is_open).select(*units.columns)
        done = closed if done is None else done.unionByName(closed)
        if (solved.agg(F.max("_blocks")).first()[0] or 1) == 1:
            return done
        # Blocks of one block are landed, so only strata with several go on.
        left = solved.where(is_open).drop("_block").withColumn("_blocks", in_blocks((HELD_BACK + 2) * F.col("_blocks")))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``<id>, text_key, size, source_size, target, copies, taken`` per row of ``docs``.

    ``size`` counts the words of the whole text (null: 0), ``target`` is that of the
    row's source, ``copies`` says how often the mix takes the document (0 to
    ``most``) and ``taken`` the words this makes. ``text_key`` is a hash of the text;
    with the id it names the row. Rows that agree in both are decided one by one.
    A null source is a source of its own, the last in order. Empty documents are
    drawn like others and take no words. Other columns are not read, whatever their
    names. An empty table gives no rows.
    """
    sized = settle(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_key(F.col(text_col)).alias("text_key"),
        word_count(F.col(text_col)).alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_stratum"))
    targets = source_targets(sources, weights, most).withColumnRenamed("source", "_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source").withColumn(
        "sure", F.floor(ratio + _EDGE)).withColumn("prob", F.greatest(ratio - F.col("sure"), F.lit(0.0))).withColumn(
        "key", F.xxhash64("id", "text_key")).withColumnRenamed("place", "stratum")
    copies = (F.col("sure") + F.col("prob")).cast("bigint")
    return cube_sample(units, block_rows).withColumn("copies", copies).select(
        F.col("id").alias(id_col), "text_key", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options,
) -> DataFrame:
    """``docs`` with every document repeated as often as the mix takes it. Columns
    and their order stay, whatever their names. Rows that agree in id and text are one
    document here, with the copies of all of them; null ids and texts are taken like
    others. An empty table gives no rows."""
    picked = mix_sources(docs, id_col, text_col, source_col, **options).groupBy(
        F.col(id_col).alias("id"), F.col("text_key").alias("key")).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    return one_row_each(docs, settle(picked, "picked"), id_col, text_col, times="copies")
