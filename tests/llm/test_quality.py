import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weirgauge.llm.quality import (
    ALPHA, FEATURES, SHRINKAGE, count_column, judge_quality, merged, sketches, thresholds, with_features,
)

SPACES = " \t\n\v\f\r"


def words_of(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute_counts(text):
    text = text or ""
    words = words_of(text)
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {i + j for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), len(lines)


def brute_buckets(count):
    words, chars, symbols, dup_lines, repeated, lines = count
    shares = (chars / words, (symbols + 1) / (words + 2), (dup_lines + 1) / (lines + 2), (repeated + 1) / (words + 2))
    return [math.ceil(round(math.log(v) / math.log((1 + ALPHA) / (1 - ALPHA)), 9)) for v in shares]


def brute_limits(peers, at, has_low, reach):
    values = sorted(p[at] for p in peers)
    q1, q2, q3 = (values[math.ceil(len(values) * k / 4) - 1] for k in (1, 2, 3))
    spread = min(q2 - q1, q3 - q2)
    return (q2 - reach * spread if has_low else None, q2 + reach * spread) if spread > 0 else (None, None)


def brute_verdicts(rows):
    """Quartiles of sorted lists in place of sketches."""
    counts = [brute_counts(r[1]) for r in rows]
    buckets = [brute_buckets(c) if c[0] else None for c in counts]
    out = []
    for row, count, own in zip(rows, counts, buckets):
        failed = count[0] < 20 or 100 * count[4] > 30 * count[0]
        within = True
        groups = [[f for f in buckets if f], [f for f, r in zip(buckets, rows) if f and r[2] == row[2]],
                  [f for f, r in zip(buckets, rows) if f and r[2:4] == row[2:4]]]
        for at, (has_low, reach) in enumerate(FEATURES.values()) if own else ():
            low = high = None
            for peers in groups:  # from the coarsest
                here = brute_limits(peers, at, has_low, reach)
                n = len(peers)
                low, high = (c if h is None else h if c is None else (n * h + SHRINKAGE * c) / (n + SHRINKAGE)
                             for h, c in zip(here, (low, high)))
            within = within and not (low is not None and own[at] < low or high is not None and own[at] > high)
        out.append((*count[:5], failed, not failed and within))
    return out


def corpus(odd_rows):
    rng = random.Random(6)
    rows = [tuple(r) for r in odd_rows]
    for i in range(500):
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), ("de", "a"), (None, None)])
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 200))]
        kind = rng.random()
        if kind < 0.1:
            words = [w + "###" for w in words]
        elif kind < 0.2:
            words = (words[:12] + ["\n"]) * 6
        elif kind < 0.25:
            words = ["".join(words[j:j + 9]) for j in range(0, len(words), 2)]
        rows.append((1000 + i, " ".join(words), lang, source))
    return rows


def test_counts_and_verdicts(make_docs, odd_rows):
    rows = corpus(odd_rows)
    want = defaultdict(list)
    for row, verdict in zip(rows, brute_verdicts(rows)):
        want[row[0]].append(verdict)
    got = judge_quality(make_docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] in want[r["doc_id"]]
    assert 100 < sum(r["kept"] for r in got) < 480


def plain(rng, n, letters=(3, 8)):
    return ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(*letters))) for _ in range(n)]


def test_every_feature_alone_can_reject(make_docs):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        words = plain(rng, rng.randrange(80, 200))
        rows.append((i, "\n".join(" ".join(words[k:k + 8]) for k in range(0, len(words), 8)), "en", "ab"[i % 2]))
    lines = [" ".join(plain(rng, 8)) for _ in range(12)]
    odd = {
        1000: " ".join(plain(rng, 120, (14, 18))), 1001: " ".join(plain(rng, 120, (1, 2))), 1002: " ".join(w + "#" for w in plain(rng, 120)),
        1003: "\n".join(line for _ in range(16) for line in ("short line here", " ".join(plain(rng, 9)))),
        1004: " ".join(plain(rng, 60) + lines[0].split() + plain(rng, 8) + lines[0].split() + plain(rng, 40)),
    }
    rows += [(i, text, "en", "a") for i, text in odd.items()]
    got = {r["doc_id"]: r for r in judge_quality(make_docs(rows)).collect()}
    assert not any(got[i]["base_failed"] for i in odd)
    assert not any(got[i]["kept"] for i in odd), [got[i] for i in odd]
    assert got[1003]["n_repeat_words"] == 0 and got[1004]["n_dup_lines"] == 0
    assert sum(got[i]["kept"] for i in range(400)) > 390


def test_groups_have_thresholds_of_their_own(make_docs):
    """Symbols that are usual in one source are odd in another."""
    rng = random.Random(2)
    rows = []
    for i in range(800):
        words = plain(rng, rng.randrange(50, 150))
        if i % 2:
            words = [w + "$" if rng.random() < 0.5 else w for w in words]
        rows.append((i, " ".join(words), "en", "ab"[i % 2]))
    rows.append((5000, " ".join(w + "$" for w in plain(rng, 100)[:50]) + " " + " ".join(plain(rng, 50)), "en", "a"))
    docs = make_docs(rows)
    counted = with_features(docs.select("lang", "source", count_column(F.col("text")).alias("c")).select("lang", "source", "c.*"))
    limits = {r["source"]: r for r in thresholds(sketches(counted, ["lang", "source"]), "lang", "source").collect()}
    assert all(limits["a"][f"{f}_high"] != limits["b"][f"{f}_high"] for f in ("mean_word", "symbol_share"))
    got = {r["doc_id"]: r["kept"] for r in judge_quality(docs).collect()}
    assert not got[5000] and sum(got[i] for i in range(1, 800, 2)) > 390


def test_sketches_merge(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice("xy"), *[rng.choice([None, rng.randrange(-50, 50)]) for _ in FEATURES]) for _ in range(800)]
    frame = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{f} int" for f in FEATURES))
    joined = merged(sketches(frame, ["lang", "source"]), ["lang"])
    direct = sketches(frame, ["lang"])
    assert sorted(joined.collect(), key=str) == sorted(direct.select(joined.columns).collect(), key=str)


def test_empty_table(make_docs):
    assert judge_quality(make_docs([(1, "a")]).limit(0)).count() == 0
