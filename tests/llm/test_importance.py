import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weirgauge.llm import importance as I

SMALL = dict(n_buckets=50, least_words=2, percent=30)


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(I.FEATURE_WORD, lowered)


def runs_of(words, longest):
    return [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, longest=1, n_buckets=I.BUCKETS, least_words=I.LEAST_WORDS, percent=I.PERCENT, seed=I.SEED):
    def buckets(text):
        return [zlib.crc32(r.encode()) % n_buckets for r in runs_of(words_of(text), longest)]

    s, t = Counter(), Counter()
    for d in docs:
        s.update(buckets(d[1]))
    for text in target:
        t.update(buckets(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + n_buckets) / ((s[b] + 1) * (all_t + n_buckets)))) for b in range(n_buckets)]
    rows = []
    for place, d in enumerate(docs):
        own = buckets(d[1])
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d[0], len(words_of(d[1])), len(own), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for rank, row in enumerate(able[:percent * len(able) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, rows), key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def target_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("longest", [1, 3])
def test_equals_brute_force(spark, make_docs, odd_rows, longest):
    docs = [*odd_rows, *[(20 + i, f"alpha w{i % 7} Beta, gamma{i % 3} x-y {i}", "en", "a") for i in range(60)]]
    target = ["alpha beta w3 w4", None, "", "gamma1 été \U0001f600"]
    got = rows_of(I.resample(make_docs(docs), target_of(spark, target), longest=longest, **SMALL))
    assert got == brute(docs, target, longest=longest, **SMALL)


def test_ties_go_to_the_smaller_id_and_copies_count_one_by_one(spark, make_docs):
    docs = [(7, "one two three", "en", "a")] * 5 + [(None, "one two three", "en", "a")] * 3 + [(1, "one two three", "en", "a")]
    got = rows_of(I.resample(make_docs(docs), target_of(spark, ["one"]), n_buckets=50, least_words=2, percent=60))
    assert got == brute(docs, ["one"], n_buckets=50, least_words=2, percent=60)


def test_empty_tables(spark, make_docs):
    docs, none = make_docs([(1, "one two three four", "en", "a")]), target_of(spark, [])
    assert I.resample(make_docs([]), none).count() == 0
    assert I.resample(docs, none, percent=100, least_words=1).first()["rank"] == 1
    assert I.resample(docs, none, percent=0).first()["rank"] is None
    assert I.resample(docs, none).first()["rank"] is None  # too few words


def test_words_follow_ascii_ranges(spark):
    text = "ABC-Éx_1~2 İ\U0001f600 \x7f z"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(I.feature_words(F.col("t")).alias("w")).collect()
    assert row[0].w == words_of(text) == ["abc", "Éx", "1", "2", "İ\U0001f600", "z"]
    assert row[1].w == []


@pytest.mark.parametrize("scores", [list(range(5000)), [7] * 5000, [0] * 2500 + [9] * 2500, [i * i % 97 for i in range(5000)]])
@pytest.mark.parametrize("wanted", [1, 500, 2500, 4999, 5000])
def test_bracket_holds_the_cutoff(spark, scores, wanted):
    frame = spark.createDataFrame(
        [(s,) for s in scores], "score long")
    found = I.find_bracket(frame, wanted, len(scores))
    cut = sorted(scores, reverse=True)[wanted - 1]
    assert (found.low is None or found.low <= cut) and (found.high is None or cut <= found.high)
    assert found.above == (0 if found.high is None else sum(s > found.high for s in scores))


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    frame = spark.range(10_000).select(F.col("id").alias("score"))
    monkeypatch.setattr(I, "ACCURACY", 3)  # a sketch too coarse for its own margins
    found = I.find_bracket(frame, 1_000, 10_000)
    assert found.low is None or found.low <= 9_000 <= found.high
