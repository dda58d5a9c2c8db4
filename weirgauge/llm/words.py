"""Words of a text, as all operators of this package see them: runs of characters
other than the six ASCII white-space characters."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def split_words(text: str | None) -> list[bytes]:
    """Words as UTF-8: ``bytes.split`` cuts at exactly the six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker."""
    if int(spark.conf.get(BATCH, "10000")) > rows:
        spark.conf.set(BATCH, str(rows))


class WordHashes(dict):
    """64-bit hashes of words; keeps those it has seen up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = split_words(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for at in range(width):
        total = (total ^ words[at:at + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def covered(starts: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words that begins at one of ``starts``."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n_words), -1)
    return np.cumsum(change[:-1]) > 0
