"""Token ids in binary shards with Elias-Fano coded document boundaries.

A store is a Parquet folder, so that any file system Spark knows can hold it and
the usual commit of a write makes it whole in spite of lost executors. Each row is a
chunk of consecutive documents:

``shard, chunk``   place in the order: range partition and number within it
``first_id``       ids of the shard before this chunk
``n_ids``          ids in this chunk
``doc_ids``        identifiers of the documents, ascending, null first
``boundaries``     Elias-Fano code of the start of each document and of the end
``ids``            all ids, little-endian, ``width`` bytes each

Documents follow one another in ascending order of identifier over chunks and
shards. A chunk closes at ``CHUNK_IDS`` ids; a longer document is a chunk alone.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirgauge.llm.elias_fano import EliasFano, encode
from weirgauge.llm.words import WORD, small_batches

CHUNK_IDS = 1 << 18
END_ID = 2
KEPT_WORDS = 300_000
KEPT_LETTERS = 64
WORDS_PER_CALL = 5_000
_WORD = re.compile(WORD)
# How the tokenizer cuts lower-case text, for the letters, digits and white space of Latin-1.
_LETTERS, _DIGITS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", " \t\n\v\f\r\x85\xa0"
_RUN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
_HOME = "weirgauge_worker_words"
SCHEMA = "shard int, chunk int, first_id long, n_ids long, doc_ids array<{id}>, boundaries binary, width int, ids binary"


class Recent:
    """What was used of late: two generations, of which the older goes as a whole when
    the newer is full. The bound only decides what is computed again."""

    def __init__(self, most: int):
        self.newer: dict = {}
        self._older: dict = {}
        self._most = most

    def missing(self, keys: set) -> list:
        """The ``keys`` that are not known; the others are in ``newer`` from now on."""
        if len(self.newer) > self._most:
            self._older, self.newer = self.newer, {}
        unknown = []
        for key in keys.difference(self.newer):
            value = self._older.get(key)
            if value is None:
                unknown.append(key)
            else:
                self.newer[key] = value
        return unknown


class WordIds:
    """Ids of texts by their words, little-endian in 32 bits.

    The tokenizer drops white space and looks at words one by one, so the ids of a
    text are those of its words. Within words it looks at runs of letters and of marks and
    at digits one by one, in lower case. Texts of Latin-1 are cut into these, so that
    words that differ in case or punctuation share their ids; other texts are cut at white
    space, and the tokenizer cuts on. What is new to a batch is encoded in a few calls.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        self._known = Recent(KEPT_WORDS)

    def of_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text of a batch."""
        cut = [_pieces(text) for text in texts]
        new = self._known.missing(set().union(*cut))
        for at in range(0, len(new), WORDS_PER_CALL):
            self._encode(new[at:at + WORDS_PER_CALL])
        found = [b"".join(map(self._known.newer.__getitem__, pieces)) for pieces in cut]
        for piece in new:
            if len(piece) > KEPT_LETTERS:
                del self._known.newer[piece]
        return found

    def _encode(self, pieces: list[str]) -> None:
        """Learn all pieces in one call: a token belongs to the piece it begins in."""
        found = self._tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        packed, owners = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids, np.float64)
        first = np.flatnonzero(np.diff(owners, prepend=-1))
        if len(first) != len(pieces):  # some are several units to this tokenizer, or none
            begins = np.fromiter((begin for begin, _ in found.offsets), np.int64, len(found.ids))
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
            first = np.searchsorted(begins, np.cumsum(lengths + 1) - lengths - 1)
        cuts = (4 * first).tolist()
        self._known.newer.update((piece, packed[a:b]) for piece, a, b in zip(pieces, cuts, [*cuts[1:], len(packed)]))


def _pieces(text: str | None) -> list[str]:
    """A text cut where its parts surely keep their ids."""
    if not text:
        return []
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:  # has letters that combine
        return _WORD.findall(text)
    return _WORD.findall(text) if "<|" in text else _RUN.findall(text.lower())


def _word_ids(tokenizer_file: str) -> WordIds:
    """The word table of this Python worker. Workers live on from task to task, while
    functions and their globals arrive anew with each, so it hangs on a module."""
    home = sys.modules.setdefault(_HOME, ModuleType(_HOME))
    table = getattr(home, "table", None)
    if table is None or table[0] != tokenizer_file:
        home.table = table = (tokenizer_file, WordIds(tokenizer_file))
    return table[1]


def _chunks(batches: Iterator[pd.DataFrame], tokenizer_file: str, end_id: int, width: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    word_ids, shard = _word_ids(tokenizer_file), TaskContext.get().partitionId()
    end, wide = np.array([end_id], "<u4").tobytes(), np.dtype(f"<u{width}")
    doc_ids: list = []
    parts: list[bytes] = []
    starts, first, chunk = [0], 0, 0

    def close() -> pd.DataFrame:
        ids = np.frombuffer(b"".join(parts), "<u4")
        if len(ids) and int(ids.max()) >> (8 * width):
            raise ValueError(f"an id does not fit into {width} bytes")
        return pd.DataFrame([{
            "shard": shard, "chunk": chunk, "first_id": first, "n_ids": len(ids), "doc_ids": doc_ids,
            "boundaries": encode(starts), "width": width, "ids": ids.astype(wide).tobytes()}])

    for batch in batches:
        given = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
        for doc_id, part in zip(given, word_ids.of_batch(batch["text"])):
            part += end
            if doc_ids and starts[-1] + len(part) // 4 > CHUNK_IDS:
                yield close()
                first, chunk = first + starts[-1], chunk + 1
                doc_ids, parts, starts = [], [], [0]
            doc_ids.append(doc_id)
            parts.append(part)
            starts.append(starts[-1] + len(part) // 4)
    if doc_ids:
        yield close()


def write_store(
    docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, width: int = 2,
) -> None:
    """Encode whole texts and write them in ascending order of ``id_col``.

    A null text is empty and has the end id only; null ids come first. Rows that share
    an id follow the order of a hash of their text. ``width`` is the bytes per stored
    id; an id that needs more is an error. Extra columns are ignored, whatever their
    names. An empty table gives a store without chunks.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_tie"))
    # The tie keeps repeated ids from sharing one range; texts are shuffled, not ids,
    # since these take more space.
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    ordered.mapInPandas(
        lambda batches: _chunks(batches, tokenizer_file, end_id, width), SCHEMA.format(id=id_type)
    ).write.parquet(path)


def shard_starts(store: DataFrame) -> DataFrame:
    """``shard, start``: ids of all shards before. A shard is a write task, so this is
    a row per task."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return store.groupBy("shard").agg(F.sum("n_ids").alias("_n")).select(
        "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("start"))


def _documents(batches: Iterator[pd.DataFrame], digest: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            bounds = EliasFano(row.boundaries).values().astype(np.int64)
            ids = np.frombuffer(row.ids, f"<u{row.width}").astype("<u4")
            pieces = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            frame = {"doc_id": list(row.doc_ids), "start": row.start + row.first_id + bounds[:-1], "n_tokens": np.diff(bounds)}
            if digest:
                frame["ids_crc32"] = [zlib.crc32(p.tobytes()) for p in pieces]
            else:
                frame["ids"] = [p.astype(np.int64) for p in pieces]
            yield pd.DataFrame(frame)


def _read(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    store = spark.read.parquet(path)
    id_type = store.schema["doc_ids"].dataType.elementType.simpleString()
    # A chunk holds many documents: few chunks per Arrow batch bound a worker's memory.
    small_batches(spark)
    last = "ids_crc32 long" if digest else "ids array<long>"
    # A row per write task, however many documents there are.
    return store.join(F.broadcast(shard_starts(store)), "shard").select(
        "start", "first_id", "doc_ids", "boundaries", "width", "ids"
    ).mapInPandas(lambda batches: _documents(batches, digest), f"doc_id {id_type}, start long, n_tokens long, {last}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of a store."""
    return _read(spark, path, digest=False)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the checksum of the ids, with the end
    id, as little-endian unsigned 32-bit integers."""
    return _read(spark, path, digest=True)


def read_document(chunk: dict | pd.Series, place: int) -> np.ndarray:
    """Ids of one document of a chunk, found by two selects."""
    bounds = EliasFano(chunk["boundaries"])
    first, end = bounds.select(place), bounds.select(place + 1)
    return np.frombuffer(chunk["ids"], f"<u{chunk['width']}")[first:end].astype(np.uint32)
