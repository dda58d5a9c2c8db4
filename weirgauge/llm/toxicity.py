"""Toxicity from a weighted lexicon, matched by an Aho-Corasick automaton over text
whose homoglyphs and digit substitutions are folded away.

The lexicon is learned from labelled documents: word beginnings (and whole words)
that set toxic documents apart, weighted by their log odds. A term counts where it
begins a word and does not lie in an exception phrase, once per document. Largest
weight, total weight and weight per word, the length-normalised form, enter a
logistic score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.llm.words import small_batches, split_words
from weirgauge.storage import settle

# Look-alikes of Latin letters and usual substitutions. Letters that
# are taken for each other (l, i, 1) share one form.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ø": "o", "ł": "i", "đ": "d", "ß": "ss",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i",
    "l": "i",
    "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ɢ": "g", "ʜ": "h", "ɪ": "i", "ᴊ": "j", "ᴋ": "k", "ʟ": "i", "ᴍ": "m",
    "ɴ": "n", "ᴏ": "o", "ᴘ": "p", "ʀ": "r", "ꜱ": "s", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ʏ": "y", "ᴢ": "z", "ᴉ": "i",
}
INVISIBLE = "­​‌‍⁠﻿"
# Harmless phrases around words that also serve as insults.
EXCEPTIONS = (
    "clown fish", "class clown", "trash can", "trash bin", "trash bag", "trash collection", "pond scum", "soap scum",
    "stupid simple", "pathetic fallacy",
)
TRAIN_ROWS = 20_000
TERMS = 1_000
SHORTEST, LONGEST = 3, 12
COPY_WORDS = 3
CHANCE = 30.0  # likelihood ratio that none of some million terms reaches by chance
_WORD = re.compile(r"[^\W_]+")


def _fold_table() -> dict[int, str]:
    """Lower case, no accents, compatibility forms resolved, look-alikes folded, for
    the blocks of Latin, Greek, Cyrillic, phonetic, enclosed, full-width and mathematical
    letters."""
    table = {}
    blocks = (range(0x20, 0x530), range(0x1D00, 0x1D2C), range(0x1E00, 0x1F00), range(0x24B6, 0x24EA), range(0xA730, 0xA732),
              range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), range(0x1F130, 0x1F18A))
    for code in (c for block in blocks for c in block):
        plain = unicodedata.normalize("NFKD", chr(code).lower()).lower()
        bare = "".join(c for c in plain if not unicodedata.combining(c))
        folded = "".join(LOOKALIKES.get(c, c) for c in bare)
        if folded != chr(code) and (folded or unicodedata.combining(chr(code))):
            table[code] = folded
    return table | {ord(c): "" for c in INVISIBLE}


FOLDS = _fold_table()


def fold(text: str | None) -> str:
    """``text`` in the one form that all look-alike spellings share."""
    return text.translate(FOLDS) if text else ""


@dataclass(frozen=True)
class Lexicon:
    """Folded terms with weights, and the coefficients of the score: constant, largest
    weight, log of the total weight, log of the weight per 100 words."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = (-20.0, 0.0, 0.0, 0.0)


def automaton(lexicon: Lexicon):
    """Terms carry their weight; exception phrases carry None."""
    built = ahocorasick.Automaton()
    for term, weight in lexicon.terms:
        built.add_word(term, (term, weight))
    for phrase in map(fold, lexicon.exceptions):
        built.add_word(phrase, (phrase, None))
    if len(built):
        built.make_automaton()
    return built


def weights_in(folded: str, built) -> list[float]:
    """Weights of the different terms in a text. Of the terms that begin a word the
    longest counts; words inside exception phrases have none."""
    if not len(built):
        return []
    hits: dict[int, tuple[int, str, float]] = {}
    spared = []
    for end, (term, weight) in built.iter(folded):
        start = end - len(term) + 1
        if start and folded[start - 1].isalnum():
            continue
        if weight is None:
            spared.append((start, end))
        else:  # matches of one start come in order of their length
            hits[start] = (end, term, weight)
    return list({term: weight for start, (end, term, weight) in hits.items()
                 if not any(a <= start and end <= b for a, b in spared)}.values())


def _term_counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each label that hold a term, summed within the task."""
    def rows(counts: Counter) -> pd.DataFrame:
        flat = [(t, n if toxic else 0, 0 if toxic else n) for (t, toxic), n in counts.items()]
        return pd.DataFrame(flat, columns=["term", "toxic_docs", "clean_docs"])

    counts: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            words = set(_WORD.findall(fold(text)))
            terms = {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}
            counts.update((t, toxic) for t in terms)
            if len(counts) > 500_000:  # hand on what is there; sums continue after the shuffle
                yield rows(counts)
                counts = Counter()
    yield rows(counts)


def choose_terms(found: Sequence[tuple[str, int, int]], n_toxic: int, n_clean: int, most: int) -> list[tuple[str, float]]:
    """Weights of the terms in ``(term, toxic_docs, clean_docs)`` rows, best first. A
    term gives way to its continuation if that is found in as many toxic and no more
    clean documents."""
    counts = {t: (a, b) for t, a, b in found}
    covered = {t[:-1] for t, (a, b) in counts.items() if t[:-1] in counts
               and counts[t[:-1]][0] == a and b <= counts[t[:-1]][1]}
    return [(t, math.log((a + 0.5) / (n_toxic + 1) / ((b + 0.5) / (n_clean + 1))))
            for t, a, b in found if t not in covered][:most]


def features(texts: Iterable[str | None], built) -> np.ndarray:
    """A row per text: 1, largest weight, log of the total, log of the total per 100
    words."""
    rows = []
    for text in texts:
        weights = weights_in(fold(text), built)
        total = sum(weights)
        rows.append((1.0, max(weights, default=0.0), math.log1p(total),
                     math.log1p(100 * total / max(1, len(split_words(text))))))
    return np.array(rows, float).reshape(-1, 4)


def fit_logistic(x: np.ndarray, label: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method with a ridge penalty, which keeps separable labels finite."""
    coef = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        gradient = x.T @ (label - p) - ridge * coef
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(coef)), gradient)
        coef = coef + step
        if np.abs(step).max() < 1e-9:
            break
    return coef


def _one_of_copies(train: DataFrame) -> DataFrame:
    """One of the training documents that share label and smallest shingle hash. Else
    every word of a toxic document with many near copies would look toxic. The hash of
    the text decides which, so that reruns agree."""
    smallest = F.array_min(F.expr(f"""transform(sequence(0, greatest(0, size(w) - {COPY_WORDS})),
        i -> xxhash64(array_join(slice(w, i + 1, {COPY_WORDS}), ' ')))"""))
    hashed = train.withColumn("w", F.split("text", r"[\x20\x09-\x0D]+")).withColumn("_least", smallest).drop("w")
    one = hashed.groupBy("toxic", "_least").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return settle(one.select("text", "toxic"), "toxic-distinct")


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS, terms: int = TERMS, exceptions: Sequence[str] = EXCEPTIONS,
) -> Lexicon:
    """Learn terms and score from labelled rows, those whose id is held out apart.

    At most about ``train_rows`` labelled documents are used, drawn by a hash of the
    id; the ids of the draw are broadcast, which this parameter bounds. At most
    4 ``terms`` candidates reach the driver. Rows with a null id, label or text are
    not learned from. Without toxic or clean examples the lexicon is empty.
    """
    small_batches(docs.sparkSession)
    usable = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
    share = min(1.0, train_rows / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    train = settle(texts.join(F.broadcast(drawn), F.col("id") == F.col("_id")).select("text", "toxic"), "toxic-train")
    train = _one_of_copies(train)
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon((), tuple(exceptions))
    counts = train.mapInPandas(_term_counts, "term string, toxic_docs long, clean_docs long").groupBy("term").agg(
        F.sum("toxic_docs").alias("a"), F.sum("clean_docs").alias("b"))
    # Among millions of terms many are seen by chance in toxic documents only.
    seen = F.col("a") + F.col("b")
    prior = n_toxic / (n_toxic + n_clean)

    def part(n: Column, p: float) -> Column:
        return F.when(n > 0, n * F.log(n / (seen * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("a"), prior) + part(F.col("b"), 1 - prior))
    strong = counts.where((F.col("a") > 2) & (F.col("a") > 4 * F.col("b") * (n_toxic / n_clean))).withColumn("g", ratio)
    found = strong.where(F.col("g") > CHANCE).orderBy(F.desc("g"), "term").limit(4 * terms).collect()
    chosen = choose_terms([(r["term"], r["a"], r["b"]) for r in found], n_toxic, n_clean, terms)
    lexicon = Lexicon(tuple(chosen), tuple(exceptions))
    seen_rows = train.select("toxic", _feature_column(F.col("text"), lexicon).alias("x")).toPandas()
    coef = fit_logistic(np.array(seen_rows["x"].tolist(), float), seen_rows["toxic"].to_numpy(float))
    return replace(lexicon, coefficients=tuple(map(float, coef)))


def _feature_column(text: Column, lexicon: Lexicon) -> Column:
    @F.pandas_udf("array<double>")
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        built = automaton(lexicon)
        for texts in batches:
            yield pd.Series(list(features(texts, built)))
    return rows(text)


def toxicity(text: Column, lexicon: Lexicon) -> Column:
    """Score of whole texts, 0 to 1; null and empty texts have no weight."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        built = automaton(lexicon)
        for texts in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip(features(texts, built) @ np.array(lexicon.coefficients), -30, 30))))
    return score(text)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``<id>, held_out, score, predicted`` for every row of ``docs``.

    The lexicon comes from ``labels`` (id, ``toxic``) outside the held-out ids; the
    score reads the text alone. Null and empty texts get the score of a text without
    terms. Repeated rows and null ids are scored like others; other columns are not
    read. An empty table gives no rows; without labels every score is near 0.
    """
    lexicon = learn_lexicon(docs, labels, id_col, text_col, **options)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), toxicity(F.col(text_col), lexicon).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents predicted toxic. Null and empty texts are judged as
    texts without terms, rows with null or repeated ids by their own texts. Columns and
    their order remain, whatever their names; an empty table gives no rows, and without
    labels every row stays."""
    small_batches(docs.sparkSession)
    lexicon = learn_lexicon(docs, labels, id_col, text_col, **options)
    return docs.where(toxicity(F.col(text_col), lexicon) < 0.5)
