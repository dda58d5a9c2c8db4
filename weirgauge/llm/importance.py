"""Importance resampling towards a target distribution.

Texts are bags of hashed word runs. A bucket's gain is the logarithm of how much more
of the target than of the corpus falls into it; a document's weight is the mean gain of
its runs. Adding Gumbel noise and taking the highest scores draws without replacement
with chances that follow the weights.

The gains are one array, which every row looks its buckets up in. The cutoff is found
without sorting the corpus: a mergeable quantile sketch proposes brackets around it, one
pass counts exactly what lies outside each, and of the narrowest that holds the cutoff
the rows are sorted. Only rows that are drawn are sorted for their ranks.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.llm.ranking import numbered
from weirgauge.storage import settle

FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST_RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
ACCURACY = 10_000  # of the sketch: its ranks err by one part in so many
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def feature_words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(FEATURE_WORD), F.lit(0))


def run_buckets(words: Column, longest: int, n_buckets: int) -> Column:
    """Buckets of all runs of 1 to ``longest`` words, repeats included."""
    def bucket(run: Column) -> Column:
        return (F.crc32(F.encode(run, "UTF-8")) % n_buckets).cast("int")

    def runs(width: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
        found = F.transform(starts, lambda at: bucket(F.array_join(F.slice(words, at, F.lit(width)), " ")))
        return F.when(F.size(words) >= width, found).otherwise(F.array().cast("array<int>"))

    single = F.transform(words, bucket)
    return single if longest == 1 else F.concat(single, *[runs(width) for width in range(2, longest + 1)])


def _hashed(texts: DataFrame, keep: list[Column], text_col: str, longest: int, n_buckets: int) -> DataFrame:
    words = texts.select(*keep, feature_words(F.col(text_col)).alias("_words"))
    return words.select(*[c for c in words.columns if c != "_words"], F.size("_words").cast("bigint").alias("n_words"),
                        run_buckets(F.col("_words"), longest, n_buckets).alias("buckets"))


def bucket_counts(hashed: DataFrame) -> DataFrame:
    """``bucket, n``: how many runs fall into each bucket that has any."""
    return hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, n_buckets: int) -> list[int]:
    """The gain of every bucket, from two tables of bucket counts. Their length is the
    parameter ``n_buckets``, whatever the size of the corpus."""
    spark = corpus.sparkSession
    table = settle(
        spark.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .na.fill(0, ["s", "t"]), "bucket-counts")
    all_s, all_t = (n or 0 for n in table.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t") + 1.0) * F.lit(float(all_s + n_buckets)) / ((F.col("s") + 1.0) * F.lit(float(all_t + n_buckets)))
    gains = table.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()
    return [gain for _, gain in sorted(gains)]


def mean_gain(buckets: Column, gains: list[int]) -> Column:
    """Floored mean of the gains of ``buckets``; 0 if there are none."""
    known = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded to one array
    total = F.aggregate(buckets, F.lit(0).cast("bigint"), lambda sum_, b: sum_ + F.get(known, b))
    n = F.size(buckets).cast("bigint")
    floored = (total - F.pmod(total, n)) / n  # exact: the remainder is gone
    return F.when(n > 0, floored.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def gumbel(id_: Column, seed: int) -> Column:
    """Floored thousandfold Gumbel noise from a hash of ``<seed>:<id>``; a null id is
    hashed as if it were empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


class Bracket(NamedTuple):
    low: int | None  # None: unbounded
    high: int | None
    above: int  # rows with a higher score than the bracket has


def find_bracket(scores: DataFrame, wanted: int, total: int) -> Bracket:
    """The narrowest of the sketch's brackets in ``score`` that surely holds the
    ``wanted`` th highest of ``total`` rows: exact counts of the rows outside tell. The
    last resort is the bracket without bounds, so none can fail."""
    at = 1 - wanted / total
    margins = [m / ACCURACY for m in (2, 10, 50, 250, 1250)]
    edges = [min(1.0, max(0.0, at + side * m)) for m in margins for side in (-1, 1)]
    found = scores.agg(F.percentile_approx("score", edges, ACCURACY).alias("q")).first().q
    pairs = list(zip(found[::2], found[1::2]))
    counts = scores.agg(*[F.count_if(F.col("score") > high) for _, high in pairs],
                        *[F.count_if(F.col("score") >= low) for low, _ in pairs]).first()
    for (low, high), above, reached in zip(pairs, counts[:len(pairs)], counts[len(pairs):]):
        if above < wanted <= reached:
            return Bracket(low, high, above)
    return Bracket(None, None, 0)


def _order(id_name: str) -> list[Column]:
    return [F.col("score").desc(), F.col(id_name).asc_nulls_last(), F.col("n_features").asc(), F.col("row").asc()]


def _key(id_value: Column, score: Column, n_features: Column, row: Column) -> Column:
    """Sorts like ``_order``."""
    return F.struct((-score).alias("a"), id_value.isNull().alias("b"), id_value.alias("c"), n_features.alias("d"), row.alias("e"))


def draw_highest(scored: DataFrame, eligible: Column, wanted: int, total: int, id_name: str) -> DataFrame:
    """Add ``rank``, 1 for the highest score, to the ``wanted`` highest of the ``total``
    rows that are ``eligible``; null for all others. Ties go to the smaller id, then to
    the shorter text. ``scored`` is a settled table with a ``row`` of its own per row."""
    if wanted <= 0:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    able = scored.where(eligible)
    bracket = find_bracket(able, wanted, total)
    inside = able
    if bracket.low is not None:
        inside = inside.where(F.col("score").between(bracket.low, bracket.high))
    last = numbered(inside, _order(id_name), "place").where(F.col("place") == wanted - bracket.above - 1).first()
    id_type = scored.schema[id_name].dataType

    def value(v: Any, kind: Any) -> Column:
        return F.lit(v).cast(kind)

    end = _key(value(last[id_name], id_type), value(last["score"], "bigint"), value(last["n_features"], "bigint"), value(last["row"], "bigint"))
    taken = eligible & (_key(F.col(id_name), F.col("score"), F.col("n_features"), F.col("row")) <= end)
    drawn = numbered(scored.where(taken), _order(id_name), "rank").withColumn("rank", F.col("rank") + 1)
    return drawn.unionByName(scored.where(~taken).withColumn("rank", F.lit(None).cast("bigint")))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    percent: int = PERCENT, longest: int = LONGEST_RUN, n_buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """``<id>, n_words, n_features, weight, score, rank`` (long) per row of ``docs``.

    Draws ``percent`` of a hundred of the documents with ``least_words`` words or more,
    those with the highest scores; ``rank`` counts them from 1 and is null for the rest.
    Null and empty texts have no features, the weight 0 and are never drawn. A null id
    gets the noise of an empty one and comes last among equal scores. Repeated rows are
    drawn one by one; which of two that agree in all but their text is drawn first is
    settled by the number of their runs. An empty target has no runs, so that rare
    buckets gain; an empty corpus gives no rows. Other columns are not read, whatever
    their names.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = settle(_hashed(read, [F.col("id")], "text", longest, n_buckets), "runs")
    wished = _hashed(target.select(F.col(target_text_col).alias("text")), [], "text", longest, n_buckets)
    gains = bucket_gains(bucket_counts(hashed), bucket_counts(wished), n_buckets)
    weighed = hashed.select(
        "id", "n_words", F.size("buckets").cast("bigint").alias("n_features"), mean_gain(F.col("buckets"), gains).alias("weight"))
    scored = settle(weighed.select("*", (F.col("weight") + gumbel(F.col("id"), seed)).cast("bigint").alias("score"),
                                   F.monotonically_increasing_id().alias("row")), "scores")
    eligible = F.col("n_words") >= least_words
    total = scored.where(eligible).count()
    drawn = draw_highest(scored, eligible, percent * total // 100, total, "id")
    return drawn.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def sql() -> str:
    """The same rows for the production parameters, in another engine's SQL: CRC-32 over
    a table made by shifts, ranks by one window."""
    return f"""
        with crc as (
            select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
        words as (
            select 'd' as side, doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{FEATURE_WORD}')) as w
            from documents
            union all
            select 't', item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{FEATURE_WORD}'))
            from benchmark),
        bucket as (
            select w, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(
                range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::int, 2))::bigint)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {BUCKETS} as b
            from (select distinct w from words), crc),
        counts as (
            select b, count(*) filter (side = 'd') as s, count(*) filter (side = 't') as t from words join bucket using (w) group by b),
        totals as (select sum(s) as s, sum(t) as t from counts),
        gains as (
            select b, floor(1000 * ln((c.t + 1)::double * (o.s + {BUCKETS})::double
                / ((c.s + 1)::double * (o.t + {BUCKETS})::double)))::bigint as gain
            from counts c, totals o),
        weights as (
            select doc_id, count(*) as n, sum(gain)::bigint as total from words join bucket using (w) join gains using (b)
            where side = 'd' group by doc_id),
        scored as (
            select d.doc_id, coalesce(n, 0)::bigint as n_features,
                coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight,
                floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::bigint + 0.5::double)
                    / 4294967296::double)))::bigint as noise
            from documents d left join weights using (doc_id)),
        ranked as (
            select *, weight + noise as score, n_features >= {LEAST_WORDS} as able,
                count(*) filter (n_features >= {LEAST_WORDS}) over () as n_able,
                row_number() over (partition by n_features >= {LEAST_WORDS} order by weight + noise desc, doc_id) as place
            from scored)
        select doc_id, n_features, weight, score,
            case when able and place <= ({PERCENT} * n_able) // 100 then place end as rank
        from ranked"""
