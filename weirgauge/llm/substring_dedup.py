"""Exact repeats of passages, found by fixed-block anchors.

A window of 20 words always holds one whole block of 10 words counted from the start
of its document. So the non-overlapping blocks of all documents are the index, and
every rolling window of 10 words probes it: positions whose 10 words are a block
somewhere, and occur more than once, are anchors. Every repeated 20-word window
contains one, in all of its occurrences. Anchors are then extended: only windows of
20 words around them are compared, and each but the first occurrence of its words, in
order of document and place, is marked. The union of the marked windows is what the
maximal repeats cover.

Index, probes and windows travel in binary rows: a task packs the hashes of a *unit*
of documents for every hash bucket. Equal hashes of a unit are settled in it and sent
once, so a passage that a third of all documents share reaches its bucket once per
unit, not once per document. A place is a number in its unit's concatenation of words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgauge.llm.words import WordHashes, covered, small_batches, split_words, window_hashes

WINDOW = 20
UNIT_WORDS = 2_000_000
BUCKET_WORDS = 4_000_000
LEAST_BUCKETS = 48
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)

# kind 0: hashes of a bucket; kind 1: what a unit has settled itself, with its documents.
PACKED = "bucket int, kind int, unit long, places binary, flags binary, hashes binary, docs binary"
MARKED = "unit long, places binary, docs binary"
PER_DOC = "id long, tie int, starts binary"
_DOC = np.dtype([("id", "<i8"), ("tie", "<i4"), ("first", "<u4")])
_WIDE = np.dtype([("a", "<u8"), ("b", "<u4")])  # 96 bits of a window's hash, besides its bucket


def pack_places(places: np.ndarray) -> bytes:
    """Ascending places as compressed differences."""
    return zlib.compress(np.diff(places.astype("<u4"), prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def unpack_places(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4"), dtype=np.int64)


@dataclass
class Unit:
    """Documents that are treated together; ``words`` are their words' hashes."""

    docs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    n_words: int = 0

    def add(self, doc_id: int, tie: int, words: np.ndarray) -> None:
        self.docs.append((doc_id, tie, words))
        self.n_words += len(words)

    def table(self) -> np.ndarray:
        """Identity and first place of each document."""
        lengths = np.array([len(w) for _, _, w in self.docs], np.int64)
        rows = np.zeros(len(self.docs), _DOC)
        rows["id"], rows["tie"] = [d for d, _, _ in self.docs], [t for _, t, _ in self.docs]
        rows["first"] = np.cumsum(lengths) - lengths
        return rows


def _packed_docs(table: np.ndarray) -> bytes:
    return zlib.compress(table.tobytes(), 1)


def _unpacked_docs(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), _DOC)


def _groups(order: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the runs of equal values."""
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return start, np.diff(np.append(start, len(ordered)))


def _row(bucket: int, kind: int, unit: int, places: np.ndarray, flags: bytes = b"", hashes: bytes = b"", docs: bytes = b"") -> tuple:
    return bucket, kind, unit, pack_places(places), flags, hashes, docs


def _home(unit: int, buckets: int) -> int:
    """The bucket that takes what a unit has settled. Numbers of units have their task in
    the high bits, so they are hashed."""
    return xxhash.xxh64_intdigest(int(unit).to_bytes(8, "little")) % buckets


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])


def _anchors_of(unit: Unit, number: int, buckets: int, block: int) -> pd.DataFrame:
    """Blocks and probes of a unit per bucket. Hashes that occur twice in the unit are
    anchors at once; of these one goes on, for the other units."""
    table = unit.table()
    hashes, places, is_block = [], [], []
    for first, (_, _, words) in zip(table["first"].tolist(), unit.docs):
        found = window_hashes(words, block)
        at = np.arange(len(found))
        hashes.append(found)
        places.append(at + first)
        is_block.append(at % block == 0)
    hashes, places, is_block = (np.concatenate(x) for x in (hashes, places, is_block))
    order = np.argsort(hashes, kind="stable")
    start, size = _groups(order, hashes[order])
    settled = np.sort(places[order[np.repeat(size > 1, size)]])
    rows = [_row(_home(number, buckets), 1, number, settled, docs=_packed_docs(table))]
    if len(start):
        one = order[start]
        blocks = np.logical_or.reduceat(is_block[order], start)
        bucket = (hashes[one] >> np.uint64(32)) % np.uint64(buckets)
        for b in np.unique(bucket):
            mine = np.flatnonzero(bucket == b)
            mine = mine[np.argsort(one[mine])]
            chosen = one[mine]
            rows.append(_row(int(b), 0, number, places[chosen], np.packbits(blocks[mine]).tobytes(),
                             hashes[chosen].astype("<u4").tobytes()))
    return _frame(rows)


def _marked_rows(sent: list[tuple[int, np.ndarray]], marked: np.ndarray) -> list[tuple]:
    """The marked ones of the places that units have sent, in the order sent."""
    rows, at = [], 0
    for unit, places in sent:
        mine = places[marked[at:at + len(places)]]
        at += len(places)
        if len(mine):
            rows.append((unit, pack_places(mine), None))
    return rows


def _passed_on(group: pd.DataFrame) -> list[tuple]:
    own = group[group["kind"] == 1]
    return list(zip(own["unit"], own["places"], own["docs"]))


def _find_anchors(group: pd.DataFrame) -> pd.DataFrame:
    """Places whose hash is a block and occurs more than once in the bucket."""
    asked = group[group["kind"] == 0]
    sent = [(unit, unpack_places(p)) for unit, p in zip(asked["unit"], asked["places"])]
    rows = _passed_on(group)
    if sent:
        hashes = np.concatenate([np.frombuffer(h, "<u4") for h in asked["hashes"]])
        is_block = np.concatenate([
            np.unpackbits(np.frombuffer(f, np.uint8), count=len(p)).astype(bool) for f, (_, p) in zip(asked["flags"], sent)])
        order = np.argsort(hashes, kind="stable")
        start, size = _groups(order, hashes[order])
        active = (size > 1) & np.logical_or.reduceat(is_block[order], start)
        marked = np.zeros(len(hashes), bool)
        marked[order[np.repeat(active, size)]] = True
        rows += _marked_rows(sent, marked)
    return pd.DataFrame(rows, columns=["unit", "places", "docs"])


def _windows_of(unit: Unit, anchors: list[np.ndarray], number: int, buckets: int, window: int, block: int) -> pd.DataFrame:
    """Windows around anchors, per bucket. Of equal windows the first goes on; the
    others are marked at once."""
    # In order of identity, so that places follow the order that decides; a repeated
    # row is the same document.
    by_identity = sorted({d[:2]: i for i, d in enumerate(unit.docs)}.values(), key=lambda i: unit.docs[i][:2])
    unit.docs, anchors = [unit.docs[i] for i in by_identity], [anchors[i] for i in by_identity]
    table = unit.table()
    first, second, places = [], [], []
    for begin, (_, _, words), at in zip(table["first"].tolist(), unit.docs, anchors):
        half = window_hashes(words, block)
        n = len(words) - window + 1
        if n < 1:
            continue
        reach = np.zeros(n + 1, np.int64)  # windows that contain an anchor's block
        np.add.at(reach, np.clip(at - (window - block), 0, n), 1)
        np.add.at(reach, np.clip(at + 1, 0, n), -1)
        chosen = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
        if len(chosen):
            a, b = half[chosen], half[chosen + window - block]
            full = (a ^ (b * _SECOND)) * np.uint64(0x9E3779B97F4A7C15)
            first.append(full ^ (full >> np.uint64(31)))
            mixed = (((a << np.uint64(23)) | (a >> np.uint64(41))) + b) * _SECOND
            second.append(mixed ^ (mixed >> np.uint64(29)))
            places.append(chosen + begin)
    if not first:
        return _frame([_row(_home(number, buckets), 1, number, np.empty(0, np.int64), docs=_packed_docs(table))])
    first, second, places = (np.concatenate(x) for x in (first, second, places))
    bucket = ((second >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    key = np.zeros(len(first), _WIDE)
    key["a"], key["b"] = first, second.astype("<u4")
    order = np.lexsort((places, key["b"], key["a"]))
    start, size = _groups(order, key[order])
    rest = np.ones(len(order), bool)
    rest[start] = False
    rows = [_row(_home(number, buckets), 1, number, np.sort(places[order[rest]]), docs=_packed_docs(table))]
    one = np.sort(order[start])
    for b in np.unique(bucket[one]):
        mine = one[bucket[one] == b]
        at = places[mine]
        here = np.unique(np.searchsorted(table["first"], at, "right") - 1)
        rows.append(_row(int(b), 0, number, at, hashes=key[mine].tobytes(), docs=_packed_docs(table[here])))
    return _frame(rows)


def _find_repeats(group: pd.DataFrame) -> pd.DataFrame:
    """Places of the windows of a bucket whose words begin earlier elsewhere."""
    asked = group[group["kind"] == 0]
    rows = _passed_on(group)
    sent, ids, ties, within = [], [], [], []
    for unit, packed, docs in zip(asked["unit"], asked["places"], asked["docs"]):
        places, table = unpack_places(packed), _unpacked_docs(docs)
        doc = np.searchsorted(table["first"], places, "right") - 1
        sent.append((unit, places))
        ids.append(table["id"][doc])
        ties.append(table["tie"][doc])
        within.append(places - table["first"][doc])
    if sent:
        key = np.concatenate([np.frombuffer(h, _WIDE) for h in asked["hashes"]])
        ids, ties, within = (np.concatenate(x) for x in (ids, ties, within))
        order = np.lexsort((within, ties, ids, key["b"], key["a"]))
        start, size = _groups(order, key[order])
        lead = np.repeat(order[start], size)
        # A repeated row has the identity and place of the first: it is no repeat of it.
        later = (ids[order] != ids[lead]) | (ties[order] != ties[lead]) | (within[order] != within[lead])
        marked = np.zeros(len(key), bool)
        marked[order[later]] = True
        rows += _marked_rows(sent, marked)
    return pd.DataFrame(rows, columns=["unit", "places", "docs"])


def _per_document(group: pd.DataFrame) -> pd.DataFrame:
    """Marked places of a unit, split among its documents."""
    table = next((_unpacked_docs(d) for d in group["docs"] if d is not None), np.empty(0, _DOC))
    places = np.unique(np.concatenate([unpack_places(p) for p in group["places"]]))
    doc = np.searchsorted(table["first"], places, "right") - 1
    rows = []
    for at in np.unique(doc):
        mine = places[doc == at] if len(table) < 64 else places[np.searchsorted(doc, at):np.searchsorted(doc, at, "right")]
        rows.append((int(table["id"][at]), int(table["tie"][at]), pack_places(mine - int(table["first"][at]))))
    return pd.DataFrame(rows, columns=["id", "tie", "starts"])


def _units(batches: Iterator[pd.DataFrame], unit_words: int, with_starts: bool) -> Iterator[tuple[Unit, list[np.ndarray], int]]:
    """Cut a task's documents into units, numbered by task and order."""
    from pyspark import TaskContext

    hashes, number = WordHashes(), TaskContext.get().partitionId() << 24
    unit, starts = Unit(), []
    for batch in batches:
        for row in batch.itertuples(index=False):
            unit.add(row.id, row.tie, hashes.of(row.text))
            if with_starts:
                starts.append(np.unique(np.concatenate([unpack_places(p) for p in row.starts])))
            if unit.n_words >= unit_words or len(unit.docs) >= unit_words // 20:
                yield unit, starts, number
                unit, starts, number = Unit(), [], number + 1
    if unit.docs:
        yield unit, starts, number


def repeated_starts(
    keyed: DataFrame, n_words: int, window: int = WINDOW, unit_words: int = UNIT_WORDS, bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """``id, tie, starts`` rows: packed starts of the windows that begin earlier
    elsewhere. ``keyed`` has ``id`` (long), ``tie`` (int) and ``text``; ``n_words`` sets
    the number of buckets."""
    block = window // 2
    buckets = max(LEAST_BUCKETS, -(-n_words // bucket_words))

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit, _, number in _units(batches, unit_words, False):
            yield _anchors_of(unit, number, buckets, block)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit, starts, number in _units(batches, unit_words, True):
            yield _windows_of(unit, starts, number, buckets, window, block)

    anchored = keyed.mapInPandas(anchors, PACKED).groupBy("bucket").applyInPandas(_find_anchors, MARKED).groupBy(
        "unit").applyInPandas(_per_document, PER_DOC).groupBy("id", "tie").agg(F.collect_list("starts").alias("starts"))
    around = keyed.join(anchored, ["id", "tie"]).mapInPandas(windows, PACKED)
    return around.groupBy("bucket").applyInPandas(_find_repeats, MARKED).groupBy("unit").applyInPandas(_per_document, PER_DOC)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """``<id>, n_words, n_removed, kept_text`` for every row of ``docs``.

    A word goes if a window of ``window`` words that covers it, an even number, occurs
    earlier: in a document with a smaller id, or before in the same one. Windows are
    judged on the input. ``kept_text`` joins the remaining words by one space. Null,
    empty and short texts have no windows. Rows with a null id come last in the order.
    Rows that agree in id and text are one document and get the same result; rows that
    share an id only are ordered by a hash of the text. Other columns are not read,
    whatever their names. An empty table gives no rows.
    """
    return _after_removal(docs, id_col, text_col, window, "kept_text string", lambda kept: kept.decode("utf-8"), **options)


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """Like ``remove_repeats``, with the SHA-256 of the kept text instead of the text."""
    return _after_removal(
        docs, id_col, text_col, window, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest(), **options)


def _after_removal(docs, id_col, text_col, window, last_column, finish, **options) -> DataFrame:
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(
        F.col(id_col).alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.hash(text_col).alias("tie"), F.col(text_col).alias("text"))
    # Sizes the buckets only: about six bytes a word.
    n_words = (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // 6
    starts = repeated_starts(keyed, n_words, window, **options).groupBy("id", "tie").agg(
        F.collect_list("starts").alias("starts"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = last_column.split()[0]
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                words = split_words(row.text)
                gone = np.zeros(len(words), bool)
                if row.starts is not None and len(row.starts):
                    at = np.unique(np.concatenate([unpack_places(p) for p in row.starts]))
                    gone = covered(at, len(words), window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if gone.any() else b" ".join(words)
                rows.append((row.doc, len(words), int(gone.sum()), finish(kept)))
            out = pd.DataFrame(rows, columns=["doc", "n_words", "n_removed", name])
            out["doc"] = pd.Series([r[0] for r in rows], dtype=object).where(out["doc"].notna(), None)
            yield out

    return keyed.join(starts, ["id", "tie"], "left").select("doc", "text", "starts").mapInPandas(
        cut, f"doc {id_type}, n_words long, n_removed long, {last_column}").withColumnRenamed("doc", id_col)


def sql(window: int = WINDOW) -> str:
    """The digests over ``documents`` in DuckDB's SQL, by grouping all windows."""
    return rf"""
with cut as (
  select doc_id, row_number() over () as rid,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
windows as (
  select rid, doc_id, pos, array_to_string(list_slice(words, pos + 1, pos + {window}), ' ') as passage
  from (select rid, doc_id, words, unnest(range(len(words) - {window - 1})) as pos from cut)),
repeats as (
  select rid, pos
  from (select rid, pos, row_number() over (partition by passage order by doc_id, pos) as place from windows) where place > 1),
gone as (
  select rid, list(distinct word) as places
  from (select rid, unnest(range(pos, pos + {window})) as word from repeats) group by rid),
kept as (
  select doc_id, words, coalesce(places, []) as places,
         list_filter(range(len(words)), lambda x: not list_contains(coalesce(places, []), x)) as left_places
  from cut left join gone using (rid))
select doc_id, cast(len(words) as bigint) as n_words, cast(len(places) as bigint) as n_removed,
       sha256(array_to_string(list_transform(left_places, lambda x: words[x + 1]), ' ')) as kept_sha256
from kept"""
