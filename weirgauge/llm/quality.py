"""Quality rules with adaptive thresholds per language and source.

Besides two fixed rules, a document is judged against the documents of its own language
and source by four features: the mean length of its words, and its shares of symbols, of
repeated lines and of words in repeated windows. A share is ``(k + 1) / (n + 2)``, what
``k`` of ``n`` make likely: a short document without symbols says less than a long one, so
that shares of nothing differ, too, and a group of short documents gets wider limits.

All thresholds come from mergeable quantile sketches, with no cutoff given. A sketch
keeps counts in logarithmic buckets (relative error ``ALPHA``), so merging is adding
counts: languages and the whole corpus get theirs from those of the sources, and the
result does not depend on order or partitioning. The spread of a sketch is the smaller
distance, in buckets, of its median from its quartiles; up to half of a group may be junk
to one side without moving it much. A limit is so many spreads from the median. It is drawn
towards the language's limit, and this towards the corpus's, the more the fewer documents
stand behind it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgauge.llm.words import WordHashes, covered, small_batches, window_hashes
from weirgauge.storage import settle

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
REPEAT_WORDS = 8
MIN_WORDS = 20
MOST_REPEATED = 0.3  # share of the words
ALPHA = 0.001
SHRINKAGE = 100  # documents that the limit of the next coarser group counts for

#: Feature → (has a lower limit, spreads between the median and the limit).
FEATURES = {
    "mean_word": (True, 8),
    "symbol_share": (False, 5),
    "dup_line_share": (False, 3),
    "repeat_share": (False, 5),
}
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def base_counts(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = hashes.of(text)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    windows = window_hashes(words, REPEAT_WORDS)
    _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    repeated = np.flatnonzero(times[place] > 1)
    return (
        len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS), len(lines),
        len(lines) - len(set(lines)), int(covered(repeated, len(words), REPEAT_WORDS).sum()))


def count_column(text: Column) -> Column:
    """Struct of the counts of whole texts; all 0 for null."""
    @F.pandas_udf(COUNTS)
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.DataFrame([base_counts(t, hashes) for t in texts], columns=[c.split()[0] for c in COUNTS.split(", ")])
    return counts(text)


def _bucket(value: Column) -> Column:
    """Bucket ``i`` holds values up to ``gamma ** i``."""
    log_gamma = math.log((1 + ALPHA) / (1 - ALPHA))
    return F.ceil(F.round(F.log(value) / log_gamma, 9)).cast("int")


def with_features(counts: DataFrame) -> DataFrame:
    """Add the buckets of the features; all are null for a document without words."""
    def share(part: str, whole: str) -> Column:
        return _bucket((F.col(part) + 1.0) / (F.col(whole) + 2.0))

    given = {
        "mean_word": _bucket(F.col("word_chars") / F.when(F.col("n_words") > 0, F.col("n_words"))),
        "symbol_share": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }
    return counts.withColumns({name: F.when(F.col("n_words") > 0, bucket) for name, bucket in given.items()})


def sketches(featured: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``<groups>, feature, bucket, n``: one mergeable sketch per group and feature."""
    value = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("bucket")) for f in FEATURES])).alias("v")
    return featured.select(*groups, value).select(*groups, "v.*").where("bucket is not null").groupBy(
        *groups, "feature", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketch.groupBy(*groups, "feature", "bucket").agg(F.sum("n").alias("n"))


def limits_of(sketch: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``<groups>, n_docs, <feature>_low, <feature>_high``, in buckets, from each sketch
    alone; null for a feature without spread. A window sees the buckets of one sketch:
    some thousands at most, since a bucket more is 0.2 % more in value."""
    of = Window.partitionBy(*groups, "feature")
    ranked = sketch.withColumn("total", F.sum("n").over(of)).withColumn(
        "upto", F.sum("n").over(of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    quartiles = ranked.groupBy(*groups, "feature").agg(
        F.max("total").alias("n_docs"),
        *[F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket"))).alias(f"q{k}") for k in (1, 2, 3)])
    spread = F.least(F.col("q2") - F.col("q1"), F.col("q3") - F.col("q2"))
    columns = [F.max("n_docs").alias("n_docs")]
    for name, (has_low, reach) in FEATURES.items():
        here = (F.col("feature") == name) & (spread > 0)
        low = F.when(here, F.col("q2") - reach * spread) if has_low else F.lit(None)
        columns += [F.max(low.cast("double")).alias(f"{name}_low"),
                    F.max(F.when(here, F.col("q2") + reach * spread).cast("double")).alias(f"{name}_high")]
    return quartiles.groupBy(*groups).agg(*columns)


def drawn_towards(own: Column, n_docs: Column, coarser: Column) -> Column:
    """A group's limit and that of the next coarser group, by their documents; where one
    has none it is the other's."""
    both = (n_docs * own + SHRINKAGE * coarser) / (n_docs + SHRINKAGE)
    return F.coalesce(both, own, coarser)


def thresholds(sketch: DataFrame, lang: str, source: str) -> DataFrame:
    """``<lang>, <source>, <feature>_low, <feature>_high``: the limits of every language
    and source, in buckets; null where there is none."""
    bounds = [f"{name}_{side}" for name in FEATURES for side in ("low", "high")]
    own = limits_of(sketch, [lang, source])
    by_lang = limits_of(merged(sketch, [lang]), [lang])
    whole = limits_of(merged(sketch, []).withColumn("_all", F.lit(1)), ["_all"]).first()  # one row, or none
    by_lang = by_lang.select(F.col(lang).alias("_lang"), *[
        drawn_towards(F.col(b), F.col("n_docs"), F.lit(whole[b] if whole else None).cast("double")).alias(f"_{b}") for b in bounds])
    joined = own.join(by_lang, F.col(lang).eqNullSafe(F.col("_lang")))
    return joined.select(lang, source, *[drawn_towards(F.col(b), F.col("n_docs"), F.col(f"_{b}")).alias(b) for b in bounds])


def judge_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """``<id>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept`` for every row of ``docs``.

    ``base_failed``: fewer than ``MIN_WORDS`` words, or over ``MOST_REPEATED`` of them
    in repeated windows. Others are kept if every feature lies within the limits of
    their language and source, bounds included; a null language or source is a group of
    its own. A feature whose sketches have no spread up to the whole corpus's judges no
    one. Null and word-less texts have counts of 0 and fail the base rules. Repeated rows
    and null ids are judged like others; other columns are not read, whatever their
    names. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    counted = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        count_column(F.col(text_col)).alias("c")).select("id", "lang", "source", "c.*")
    featured = with_features(settle(counted, "quality-counts"))
    limits = settle(thresholds(settle(sketches(featured, ["lang", "source"]), "quality-sketches"), "lang", "source"), "quality-limits")
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    within = F.lit(True)
    for name in FEATURES:
        for beyond in (F.col(name) < F.col(f"{name}_low"), F.col(name) > F.col(f"{name}_high")):
            within = within & ~F.coalesce(beyond, F.lit(False))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > round(100 * MOST_REPEATED) * F.col("n_words"))
    return featured.join(
        limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    ).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & within).alias("kept"))


def sql() -> str:
    """The same over ``documents`` in DuckDB's SQL: the limits of a feature are rows."""
    log_gamma = math.log((1 + ALPHA) / (1 - ALPHA))
    features = ", ".join(f"('{f}', {reach}, {str(low).lower()})" for f, (low, reach) in FEATURES.items())
    unpivot = " union all ".join(f"select rid, lang, source, '{f}' as feature, {f} as value from featured where n_words > 0" for f in FEATURES)
    repeated = round(100 * MOST_REPEATED)
    levels = " union all ".join(f"""
  select {lang} as lang, {source} as source, '{level}' as level, feature, bucket, sum(n) as n
  from sketch group by all""" for level, lang, source in (
        ("own", "lang", "source"), ("lang", "lang", "null"), ("all", "null", "null")))
    return rf"""
with cut as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
grams as (
  select rid, pos, array_to_string(list_slice(words, pos + 1, pos + {REPEAT_WORDS}), ' ') as gram
  from (select rid, words, unnest(range(len(words) - {REPEAT_WORDS - 1})) as pos from cut)),
repeats as (
  select rid, count(distinct word) as n_repeat_words
  from (select rid, unnest(range(pos, pos + {REPEAT_WORDS})) as word
        from (select rid, pos, count(*) over (partition by rid, gram) as times from grams) where times > 1)
  group by rid),
counted as (
  select rid, doc_id, lang, source, cast(len(words) as bigint) as n_words,
         cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) as bigint) as n_lines,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from cut left join repeats using (rid)),
featured as (
  select *, word_chars / nullif(n_words, 0) as mean_word, (n_symbols + 1.0::double) / (n_words + 2.0::double) as symbol_share,
         (n_dup_lines + 1.0::double) / (n_lines + 2.0::double) as dup_line_share,
         (n_repeat_words + 1.0::double) / (n_words + 2.0::double) as repeat_share
  from counted),
valued as (
  select rid, lang, source, feature, cast(ceil(round(ln(value) / {log_gamma!r}, 9)) as int) as bucket from ({unpivot})),
sketch as (select lang, source, feature, bucket, count(*) as n from valued group by all),
levels as ({levels}),
ranked as (
  select *, sum(n) over (partition by level, lang, source, feature) as total,
         sum(n) over (partition by level, lang, source, feature order by bucket
                      rows between unbounded preceding and current row) as upto
  from levels),
quartiles as (
  select level, lang, source, feature, max(total)::bigint as n_docs, min(bucket) filter (upto * 4 >= total) as q1,
         min(bucket) filter (upto * 4 >= total * 2) as q2, min(bucket) filter (upto * 4 >= total * 3) as q3
  from ranked group by all),
alone as (
  select level, lang, source, feature, n_docs,
         case when has_low and least(q2 - q1, q3 - q2) > 0 then (q2 - reach * least(q2 - q1, q3 - q2))::double end as low,
         case when least(q2 - q1, q3 - q2) > 0 then (q2 + reach * least(q2 - q1, q3 - q2))::double end as high
  from quartiles join (values {features}) as f(feature, reach, has_low) using (feature)),
by_lang as (
  select b.lang, b.feature,
         coalesce((b.n_docs * b.low + {SHRINKAGE} * a.low) / (b.n_docs + {SHRINKAGE}), b.low, a.low) as low,
         coalesce((b.n_docs * b.high + {SHRINKAGE} * a.high) / (b.n_docs + {SHRINKAGE}), b.high, a.high) as high
  from alone b join alone a using (feature) where b.level = 'lang' and a.level = 'all'),
limits as (
  select o.lang, o.source, o.feature,
         coalesce((o.n_docs * o.low + {SHRINKAGE} * b.low) / (o.n_docs + {SHRINKAGE}), o.low, b.low) as low,
         coalesce((o.n_docs * o.high + {SHRINKAGE} * b.high) / (o.n_docs + {SHRINKAGE}), o.high, b.high) as high
  from alone o join by_lang b on b.lang is not distinct from o.lang and b.feature = o.feature where o.level = 'own'),
judged as (
  select v.rid, not bool_or(coalesce(v.bucket < l.low, false) or coalesce(v.bucket > l.high, false)) as within
  from valued v join limits l on l.lang is not distinct from v.lang and l.source is not distinct from v.source and l.feature = v.feature
  group by v.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} or 100 * n_repeat_words > {repeated} * n_words as base_failed,
       not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {repeated} * n_words) and coalesce(within, true) as kept
from featured left join judged using (rid)"""
