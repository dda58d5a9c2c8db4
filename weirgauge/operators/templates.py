"""Templates: parsing, version history and the as-of lookup of data sets."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgauge.operators.sets import V5_SET, template_sets
from weirgauge.sources.datagrams import V5_RECORD
from weirgauge.storage import settle

TEMPLATE_KEY = ["exporter_ip", "domain", "template_id"]
# A packet holds at most 65535 / 4 sets, so (seq, set_idx) fits one long.
SETS_PER_PACKET = 1 << 14
HISTORY_BLOCK = 1 << 16  # packets
LOOKUP_LEVEL = 12  # payloads that are shuffled meet versions in blocks of 2**12 packets
LEVELS = 49  # a packet's number is below 2**49, as its position fits one long
# Levels of layout rows that are found without a block.
LATEST, FIXED, WITHIN = -1, -2, -3
# A layout row is below 200 bytes (fixed columns, addresses up to 45 characters),
# so a broadcast of this many stays below 40 MB.
BROADCAST_LAYOUTS = 200_000

# Fixed values: (column, information element, width, Spark type, mandatory).
ELEMENTS = [
    ("src_ip", 8, 4, "bigint", True), ("dst_ip", 12, 4, "bigint", True),
    ("src_port", 7, 2, "int", False), ("dst_port", 11, 2, "int", False),
    ("protocol", 4, 1, "int", True),
    ("packets", 2, 4, "bigint", True), ("bytes", 1, 4, "bigint", True),
    ("start_time", 22, 4, "bigint", False), ("end_time", 21, 4, "bigint", False),
    ("tcp_flags", 6, 1, "int", False),
]
OFFSET_COLUMNS = [f"at_{name}" for name, *_ in ELEMENTS]
# Byte offsets of the same columns in a version 5 record.
V5_OFFSETS = {
    "src_ip": 0, "dst_ip": 4, "packets": 16, "bytes": 20, "start_time": 24, "end_time": 28,
    "src_port": 32, "dst_port": 34, "tcp_flags": 37, "protocol": 38,
}

MAX_U16 = 65_535
ENTERPRISE_BIT = 0x8000
FIELD_LIST = T.ArrayType(T.StructType([
    T.StructField("type", T.IntegerType()), T.StructField("len", T.IntegerType()),
    T.StructField("enterprise", T.LongType())]))
TEMPLATE_LIST = T.ArrayType(T.StructType([
    T.StructField("tmpl_idx", T.IntegerType()), T.StructField("template_id", T.IntegerType()),
    T.StructField("fields", FIELD_LIST), T.StructField("total_length", T.IntegerType())]))
FIELD_ARROW = pa.struct([("type", pa.int32()), ("len", pa.int32()), ("enterprise", pa.int64())])
TEMPLATE_ARROW = pa.list_(pa.struct([
    ("tmpl_idx", pa.int32()), ("template_id", pa.int32()), ("fields", pa.list_(FIELD_ARROW)),
    ("total_length", pa.int32())]))


def read_templates(body: bytes, enterprise_fields: bool) -> list[dict]:
    """Templates of one template set; a truncated one ends the set."""
    found: list[dict] = []
    at = 0
    while at + 4 <= len(body):
        template_id, wanted = struct.unpack_from(">HH", body, at)
        at += 4
        fields = []
        while len(fields) < wanted and at + 4 <= len(body):
            kind, size = struct.unpack_from(">HH", body, at)
            at += 4
            vendor = None
            if enterprise_fields and kind & ENTERPRISE_BIT:
                if at + 4 > len(body):
                    break
                (vendor,) = struct.unpack_from(">I", body, at)
                kind, at = kind & ~ENTERPRISE_BIT, at + 4
            fields.append({"type": kind, "len": size, "enterprise": vendor})
        if len(fields) < wanted:
            break
        total = min(MAX_U16, sum(f["len"] for f in fields))
        found.append({"tmpl_idx": len(found), "template_id": template_id, "fields": fields, "total_length": total})
    return found


@F.arrow_udf(TEMPLATE_LIST)
def _templates_of(body: pa.Array, kind: pa.Array) -> pa.Array:
    lists = [read_templates(b, k == "ipfix") for b, k in zip(body.to_pylist(), kind.to_pylist())]
    return pa.array(lists, TEMPLATE_ARROW)


def parse_templates(sets: DataFrame) -> DataFrame:
    """Every template as received, with its place in the arrival order."""
    found = template_sets(sets).select(
        "exporter_ip", "domain", "seq", "set_idx", F.explode(_templates_of("body", "kind")).alias("t"))
    return found.select(
        "exporter_ip", "domain", "t.template_id", "seq", "set_idx", "t.tmpl_idx", "t.fields", "t.total_length")


def position() -> Column:
    return F.col("seq") * SETS_PER_PACKET + F.col("set_idx")


def template_history(templates: DataFrame) -> DataFrame:
    """Distinct consecutive versions per key with validity ``[from_pos, to_pos)``.

    Exporters repeat their templates all the time. A template is compared with the one
    before it inside its block of the arrival order; the first of a block with the last
    of the block before, which is known from one row per block. In the same way a
    version ends where the next begins, in its block or in the next block that has one.
    So no task sorts more than a block of a key, and the blocks of a key are all that is
    looked at together.
    """
    block = F.call_function("div", F.col("seq"), F.lit(HISTORY_BLOCK))
    placed = settle(templates.groupBy(*TEMPLATE_KEY, block.alias("block"), position().alias("from_pos")).agg(
        F.max_by(F.struct("fields", "total_length"), "tmpl_idx").alias("t")
    ).select(*TEMPLATE_KEY, "block", "from_pos", "t.fields", "t.total_length"), "templates")
    own = [*TEMPLATE_KEY, "block"]
    within = Window.partitionBy(*own).orderBy("from_pos")
    of_key = Window.partitionBy(*TEMPLATE_KEY).orderBy("block")  # a row per block

    carried = placed.groupBy(*own).agg(F.max_by("fields", "from_pos").alias("last")).select(
        *own, F.lag("last").over(of_key).alias("carried"))
    marked = placed.withColumn("previous", F.lag("fields").over(within)).join(carried, own)
    before = F.coalesce("previous", "carried")
    changed = settle(marked.where(before.isNull() | (before != F.col("fields"))).drop("previous", "carried"), "template-changes")

    heads = changed.groupBy(*own).agg(F.min("from_pos").alias("head")).select(
        *own, F.lead("head").over(of_key).alias("next_head"))
    ended = changed.withColumn("next", F.lead("from_pos").over(within)).join(heads, own)
    return ended.select(*TEMPLATE_KEY, "from_pos", "fields", "total_length", F.coalesce("next", "next_head").alias("to_pos"))


def template_layouts(history: DataFrame) -> DataFrame:
    """Replace the field list by the byte offset of each flow column.

    Only fields of the exact width count, the last one wins, vendor fields never
    do. ``usable`` is false when a mandatory column is missing or nothing is sent.
    """
    offsets = F.transform("fields", lambda f, i: F.struct(
        f["type"].alias("type"), f["len"].alias("len"), f["enterprise"].alias("enterprise"),
        F.aggregate(F.slice("fields", F.lit(1), i), F.lit(0), lambda a, g: a + g["len"]).alias("at")))
    placed = history.withColumn("offsets", offsets)

    def offset_of(element: int, width: int) -> Column:
        matching = F.filter("offsets", lambda f: (
            (f["type"] == element) & (f["len"] == width) & f["enterprise"].isNull()))
        return F.try_element_at(matching, F.lit(-1))["at"]

    columns = placed.select(
        *TEMPLATE_KEY, "from_pos", "to_pos", "total_length",
        *[offset_of(element, width).alias(f"at_{name}") for name, element, width, _, _ in ELEMENTS])
    usable = F.col("total_length") > 0
    for name, _, _, _, mandatory in ELEMENTS:
        if mandatory:
            usable = usable & F.col(f"at_{name}").isNotNull()
    return columns.withColumn("usable", usable)


def dyadic_blocks(first: Column, last: Column) -> Column:
    """The whole numbers from ``first`` (0 or more) to ``last`` as the fewest aligned
    blocks of powers of two: an array of ``level, block``, block ``b`` of level ``l``
    being the numbers from ``b * 2**l`` on. A level has two at most."""
    def at(level: Column) -> Column:
        low = F.call_function("shiftright", first - 1, level) + 1  # whole blocks of the level
        end = F.call_function("shiftright", last + 1, level)

        def block(number: Column, odd: Column) -> Column:
            there = (low < end) & (odd.bitwiseAND(F.lit(1).cast("bigint")) == 1)
            return F.when(there, F.struct(level.alias("level"), number.alias("block")))

        return F.array(block(low, low), block(end - 1, end))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at)))


def layout_cover(layouts: DataFrame) -> DataFrame:
    """Layouts once per ``level, block`` of packets that they are valid in. However long
    a version was valid, it has two rows per binary digit of that at most. The latest
    version of a key has one row, at the level ``LATEST``."""
    def packet(pos: Column) -> Column:
        return F.call_function("div", pos, F.lit(SETS_PER_PACKET))

    past = dyadic_blocks(packet(F.col("from_pos")), packet(F.col("to_pos") - 1))
    now = F.array(F.struct(F.lit(LATEST).alias("level"), F.lit(0).cast("bigint").alias("block")))
    cover = F.explode(F.when(F.col("to_pos").isNull(), now).otherwise(past)).alias("c")
    return layouts.select(*layouts.columns, cover).select(*layouts.columns, "c.level", "c.block")


def resolve_template(
    data: DataFrame, layouts: DataFrame, broadcast_layouts: int = BROADCAST_LAYOUTS
) -> DataFrame:
    """Give each data set the layout valid at its place; sets without one are
    dropped. Version 5 sets carry their fixed layout and need no lookup.

    Versions are kept by the power-of-two blocks of packets that they cover, and a data
    set looks into one block per level. The rows are written once and counted. Up to
    ``broadcast_layouts`` rows they are broadcast, and the payloads stay where they are:
    neither a version that is valid for long nor one that keeps changing makes a long
    list. Beyond that both sides meet on (key, block of the arrival order).
    """
    cover = settle(layout_cover(layouts), "template-layouts")
    sizes = {r["level"]: (r["count"], r["ends"]) for r in cover.groupBy("level").agg(  # a row per level
        F.count(F.lit(1)).alias("count"), F.max("to_pos").alias("ends")).collect()}
    placed = data.withColumn("pos", position())
    if sum(count for count, _ in sizes.values()) <= broadcast_layouts:
        joined = _broadcast_lookup(placed, cover, sizes)
    else:
        fixed = placed.where(F.col("template_id") == V5_SET)
        joined = _blocked_lookup(placed.where(F.col("template_id") != V5_SET), cover, sizes).unionByName(fixed, True)
    return with_fixed_layout(joined).where("usable").select(
        "exporter_ip", "received_at", "body", "total_length", *OFFSET_COLUMNS)


def with_fixed_layout(joined: DataFrame) -> DataFrame:
    """Fill in the layout of the version 5 sets."""
    is_v5 = F.col("template_id") == V5_SET
    kept = [c for c in joined.columns if c not in ("total_length", "usable", *OFFSET_COLUMNS)]
    return joined.select(
        *kept,
        F.when(is_v5, V5_RECORD).otherwise(F.col("total_length")).alias("total_length"),
        F.when(is_v5, True).otherwise(F.col("usable")).alias("usable"),
        *[F.when(is_v5, V5_OFFSETS[name]).otherwise(F.col(f"at_{name}")).alias(f"at_{name}") for name, *_ in ELEMENTS])


def _probe(level: int, block: Column | None = None) -> Column:
    return F.struct(F.lit(level).alias("level"), (F.lit(0) if block is None else block).cast("bigint").alias("block"))


def _valid() -> Column:
    return (F.col("pos") >= F.col("from_pos")) & (F.col("to_pos").isNull() | (F.col("pos") < F.col("to_pos")))


def _broadcast_lookup(placed: DataFrame, cover: DataFrame, sizes: dict[int, tuple[int, int | None]]) -> DataFrame:
    """A row's probes are made and looked up one by one inside its task; one at most hits."""
    past = sorted(level for level in sizes if level != LATEST)
    ended = max([ends for _, ends in sizes.values() if ends is not None], default=0)
    seq = F.col("seq")
    probes = [_probe(level, F.shiftright(seq, level)) for level in past]
    late = F.array(_probe(LATEST))
    wanted = (
        F.when(F.col("template_id") == V5_SET, F.array(_probe(FIXED)))
        .when(F.col("pos") < ended, F.array(*probes, _probe(LATEST))).otherwise(late))
    found = ["total_length", "usable", *OFFSET_COLUMNS]
    rows = placed.select(*placed.columns, F.explode(wanted).alias("probe")).alias("d")
    known = cover.select(*TEMPLATE_KEY, "level", "block", "from_pos", "to_pos", *found).alias("k")
    match = (F.col("d.probe.level") == F.col("k.level")) & (F.col("d.probe.block") == F.col("k.block")) & _valid()
    for name in TEMPLATE_KEY:
        match = match & (F.col(f"d.{name}") == F.col(f"k.{name}"))
    joined = rows.join(F.broadcast(known), match, "left").where(
        F.col("k.level").isNotNull() | (F.col("d.probe.level") == FIXED))
    return joined.select(*[F.col(f"d.{c}") for c in placed.columns], *[F.col(f"k.{c}") for c in found])


def _blocked_lookup(placed: DataFrame, cover: DataFrame, sizes: dict[int, tuple[int, int | None]]) -> DataFrame:
    """The blocks that have data are looked up first, as narrow rows, so that a version
    is listed for those only, and payloads are shuffled once."""
    here = F.shiftright(F.col("seq"), LOOKUP_LEVEL)
    blocked = placed.withColumn("here", here)
    above = sorted(level for level in sizes if level >= LOOKUP_LEVEL)
    probes = F.array(
        _probe(LATEST), _probe(WITHIN, F.col("here")),
        *[_probe(level, F.shiftright(F.col("here"), level - LOOKUP_LEVEL)) for level in above])
    asked = blocked.select(*TEMPLATE_KEY, "here").distinct().select(*TEMPLATE_KEY, "here", F.explode(probes).alias("p")).select(
        *TEMPLATE_KEY, "here", "p.level", "p.block")
    small = F.col("level").between(0, LOOKUP_LEVEL - 1)
    inside = cover.select(
        *[c for c in cover.columns if c not in ("level", "block")], F.when(small, WITHIN).otherwise(F.col("level")).alias("level"),
        F.when(small, F.call_function("shiftright", F.col("block"), F.greatest(F.lit(LOOKUP_LEVEL) - F.col("level"), F.lit(0))))
        .otherwise(F.col("block")).alias("block")).dropDuplicates([*TEMPLATE_KEY, "level", "block", "from_pos"])
    spread = asked.join(inside, [*TEMPLATE_KEY, "level", "block"]).drop("level", "block")
    return blocked.join(spread, [*TEMPLATE_KEY, "here"]).where(_valid()).drop("here", "from_pos", "to_pos")
