"""Benchmark passages in documents, found by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens: positions marked 1 are hashed, the
others are ignored, so a substituted token under a 0 does not disturb the match.
Seeds of documents that pass a fixed-size filter over the benchmark's seeds are
joined with these; every hit names an alignment (document, item, shift), and each
alignment is verified token by token: an ungapped stretch, which tolerates
substitutions, must be long and mostly equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgauge.llm.rows import same_row, text_key
from weirgauge.llm.words import small_batches
from weirgauge.storage import settle

# Masks of weight 8, 8 and 6.
MASKS = ("1101100110101", "11100101011001", "110100101001")
MIN_TOKENS = 8  # equal tokens of a stretch, or the whole of a shorter item
MIN_SHARE = 0.8  # of the stretch that must be equal, and of the item a short stretch must cover
LONG_TOKENS = 13  # equal tokens that suffice whatever share of the item they are
FILTER_BITS = 26  # the filter has 2**26 bits = 8 MiB, whatever the benchmark's size
_TOKEN = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class TokenHashes(dict):
    """64-bit hashes of tokens; keeps those it has seen up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return value

    def of(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the marked tokens at every position where the mask fits."""
    n = len(tokens) - len(mask) + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.full(n, int(mask, 2) * 2 + len(mask), np.uint64)
    for at, mark in enumerate(mask):
        if mark == "1":
            total = (total ^ tokens[at:at + n]) * _MIX
            total ^= total >> np.uint64(29)
    return total


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """``first, end`` of the stretch that maximises equal minus different positions
    counted twice, the first such."""
    if not len(equal):
        return 0, 0
    score = np.concatenate(([0], np.cumsum(np.where(equal, 1, -2))))
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    return int(np.argmax(score[:end + 1] == low[end])), end


def longest_share(equal: np.ndarray) -> tuple[int, int]:
    """``first, end`` of the stretch with the most equal positions among those of which
    at least ``MIN_SHARE`` are equal, without different positions at its ends; the
    shortest, then first such."""
    if not equal.any():
        return 0, 0
    share = Fraction(MIN_SHARE).limit_denominator(1000)
    total = np.concatenate(([0], np.cumsum(equal, dtype=np.int64)))
    above = share.denominator * total - share.numerator * np.arange(len(total))
    # A stretch has its share if it ends no lower than it starts: of all starts the first.
    starts = np.searchsorted(-np.minimum.accumulate(above), -above)
    count = total - total[starts]
    places = np.flatnonzero(equal)
    ends = np.flatnonzero(count == count.max())
    # The first and the last equal position of each; the ends differ in what is between.
    first, last = places[total[starts[ends]]], places[total[ends] - 1]
    at = int(np.argmin(last - first))
    return int(first[at]), int(last[at]) + 1


def _masks(lengths: Sequence[int], masks: Sequence[str]) -> list[str]:
    """The fixed masks, and for items too short for one of them the whole item."""
    widest = max(map(len, masks))
    return [*masks, *("1" * n for n in sorted(set(lengths)) if 0 < n < widest)]


def _seed_rows(batches: Iterator[pd.DataFrame], masks: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Seeds of items. Masks of a short item's length apply to items of that length."""
    hashes = TokenHashes()
    for batch in batches:
        for item, text in zip(batch["item"], batch["text"]):
            tokens = hashes.of(text)
            for mask in masks:
                if "0" not in mask and len(tokens) != len(mask):
                    continue
                found = seeds(tokens, mask)
                if len(found):
                    yield pd.DataFrame({"item": item, "item_at": np.arange(len(found)), "seed": found.view(np.int64)})


def _benchmark_filter(item_seeds: DataFrame, bits: int) -> np.ndarray:
    """Bit vector of the seeds' top bits: at most 2**bits / 64 longs come back."""
    place = F.shiftrightunsigned("seed", 64 - bits)
    words = item_seeds.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) & 63 as int))")).alias("set")).toPandas()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64).view(np.uint64)
    return table


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **options,
) -> DataFrame:
    """``<id>, <item>, n_equal, n_aligned, doc_at, item_at`` for every document and
    benchmark item that share a passage: its equal and aligned tokens and its first
    token in both, of the best stretch. That is the one of ``best_stretch`` if it is a
    passage, else the passage with the most equal tokens.

    Tokens are runs of letters and digits in lower case. A passage counts if at least
    ``MIN_SHARE`` of its tokens are equal and it has ``LONG_TOKENS`` equal ones, or
    ``MIN_TOKENS`` that make up ``MIN_SHARE`` of the item, or is all of an item with
    fewer tokens. Null and empty texts share nothing. Rows with a null id match like
    others and are told apart by text only; rows that repeat id and text give one
    result. Extra columns are not read. Empty tables give no rows.

    ``options`` are those of ``passages``.
    """
    found = passages(docs, benchmark, id_col, text_col, item_col, **options)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_equal", "n_aligned", "doc_at", "item_at").distinct()


def passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", masks: Sequence[str] = MASKS, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The rows of ``contaminated`` as ``id, key, item, ...``, where ``key`` is the hash of
    the document's text, so that rows with null or repeated ids can be named.

    The filter has a fixed size and only saves work. Documents reach the join as
    seeds that pass it, and their texts are read again only for documents with a hit.
    """
    spark = docs.sparkSession
    small_batches(spark)
    item_type, id_type = benchmark.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": [len(_TOKEN.findall((t or "").lower())) for t in batch["text"]]})
    widest = max(map(len, masks))
    short = items.select("text").mapInPandas(lengths, "n int").where(F.col("n") < widest).distinct().toPandas()["n"]
    every = _masks(short.tolist(), masks)  # at most as many more as the widest mask has tokens

    item_seeds = settle(items.mapInPandas(
        lambda batches: _seed_rows(batches, every), f"item {item_type}, item_at int, seed long"), "item-seeds")
    sieve = spark.sparkContext.broadcast(_benchmark_filter(item_seeds, filter_bits))

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, table = TokenHashes(), sieve.value
        for batch in batches:
            frames = []
            for key, text in zip(batch["key"], batch["text"]):
                tokens = hashes.of(text)
                for mask in every:
                    found = seeds(tokens, mask)
                    place = found >> np.uint64(64 - filter_bits)
                    at = np.flatnonzero(table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1))
                    if len(at):
                        frames.append(pd.DataFrame({"key": key, "doc_at": at, "seed": found[at].view(np.int64)}))
            if frames:
                yield pd.concat(frames)

    # The key names a row by id and text, also where ids are null or repeated.
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                        F.xxhash64(id_col, text_col).alias("key")).where("text is not null")
    hits = keyed.select("key", "text").mapInPandas(passing, "key long, doc_at int, seed long")
    aligned = hits.join(item_seeds, "seed").select(
        "key", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    pairs = settle(aligned.groupBy("key", "item").agg(F.collect_list("shift").alias("shifts")), "alignments")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = TokenHashes()
        for batch in batches:
            found, last, tokens = [], None, None
            for row in batch.itertuples(index=False):
                if row.text is not last:
                    last, tokens = row.text, hashes.of(row.text)
                wanted = hashes.of(row.item_text)
                enough = min(LONG_TOKENS, len(wanted), max(MIN_TOKENS, MIN_SHARE * len(wanted)))

                def best(stretch, row=row, tokens=tokens, wanted=wanted):
                    top = None
                    for shift in row.shifts:
                        first, end = max(0, -shift), min(len(wanted), len(tokens) - shift)
                        equal = wanted[first:end] == tokens[first + shift:end + shift]
                        a, b = stretch(equal)
                        got = (int(equal[a:b].sum()), a - b, -(first + a + shift), first + a)
                        top = max(top, got) if top else got
                    return top[0], -top[1], -top[2], top[3]

                got = best(best_stretch)
                if got[0] < enough or got[0] < MIN_SHARE * got[1]:
                    got = best(longest_share)  # its stretches all have the share
                if got[0] >= enough:
                    found.append((row.id, row.text_key, row.item, *got))
            yield pd.DataFrame(found, columns=["id", "key", "item", "n_equal", "n_aligned", "doc_at", "item_at"])

    texts = items.withColumnRenamed("text", "item_text").withColumnRenamed("item", "_item")
    found = pairs.join(keyed, "key").join(texts, F.col("item").eqNullSafe(F.col("_item"))).select(
        "id", text_key(F.col("text")).alias("text_key"), "item", "text", "item_text", "shifts").mapInPandas(
        verify, f"id {id_type}, key long, item {item_type}, n_equal int, n_aligned int, doc_at int, item_at int")
    return found


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options,
) -> DataFrame:
    """``docs`` without the rows that share a passage with a benchmark item. A row is
    judged by its own text, also where its id is null or that of other rows. Null and
    empty texts stay. Columns and their order remain, whatever their names; empty tables
    are returned as they are."""
    bad = passages(docs, benchmark, id_col, text_col, **options).select("id", "key").distinct()
    return docs.join(bad, same_row(docs, bad, id_col, text_col), "left_anti")
