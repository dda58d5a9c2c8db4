import random
import re

import numpy as np
import pytest

from weirgauge.llm.decontaminate import (
    LONG_TOKENS, MIN_SHARE, MIN_TOKENS, best_stretch, contaminated, drop_contaminated, seeds)


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_force(rows, items):
    """Every alignment of every pair."""
    found = set()
    for doc_id, text in rows:
        for item, passage in items:
            have, want = tokens(text), tokens(passage)
            best = None
            for shift in range(-len(want) + 1, len(have)):
                first, end = max(0, -shift), min(len(want), len(have) - shift)
                equal = [want[i] == have[i + shift] for i in range(first, end)]
                top = (0, 0, 0)
                score = [0]
                for e in equal:
                    score.append(score[-1] + (1 if e else -2))
                for b in range(1, len(score)):
                    for a in range(b):
                        if score[b] - score[a] > top[0]:
                            top = (score[b] - score[a], a, b)
                got = sum(equal[top[1]:top[2]]), top[1] - top[2]
                best = max(best, got) if best else got
            if not best or not best[0]:
                continue
            n, length = best[0], -best[1]
            if (n >= LONG_TOKENS or n >= min(len(want), max(MIN_TOKENS, MIN_SHARE * len(want)))) and n >= MIN_SHARE * length:
                found.add((doc_id, item, n, length))
    return found


def corpus():
    rng = random.Random(8)
    words = [f"t{i}" for i in range(300)]

    def some(n):
        return [rng.choice(words) for _ in range(n)]
    items = [(i, some(rng.randrange(20, 40))) for i in range(12)] + [(50, some(4)), (51, some(9)), (52, [])]
    rows = []
    for d in range(60):
        text = some(rng.randrange(10, 80))
        if d % 3 == 0:
            passage = list(rng.choice(items)[1])
            if d % 2 and len(passage) >= 20:  # a substitution in ten tokens
                for at in range(rng.randrange(5, 10), len(passage), 10):
                    passage[at] = "substituted"
            at = rng.randrange(len(text))
            text = text[:at] + passage + text[at:]
        rows.append((d, " ".join(w.title() if rng.random() < 0.2 else w for w in text).replace(" t7 ", ", t7. ")))
    return rows, [(i, " ".join(t)) for i, t in items]


def test_same_as_brute_force(spark, make_docs, odd_rows):
    rows, items = corpus()
    odd = [(r[0] + 1000, r[1]) for r in odd_rows if r[0] is not None and len(r[1] or "") < 5000]
    bench = spark.createDataFrame([*items, (60, None), (61, "w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_equal"], r["n_aligned"]) for r in contaminated(make_docs(rows + odd), bench).collect()}
    want = brute_force(rows + odd, [*items, (61, "w1 w2 w3 w4 w5 w6 w7 w8 w9")])
    assert got == want and len(want) > 20


def test_small_filter_changes_nothing(spark, make_docs):
    rows, items = corpus()
    docs, bench = make_docs(rows), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(contaminated(docs, bench, filter_bits=8).collect()) == sorted(contaminated(docs, bench).collect())


def test_seeds_ignore_unmarked_tokens():
    a = np.arange(30, dtype=np.uint64)
    b = a.copy()
    b[2] = 99
    assert seeds(a, "1101")[0] == seeds(b, "1101")[0] and seeds(a, "1111")[0] != seeds(b, "1111")[0]
    assert len(seeds(a[:3], "1101")) == 0


@pytest.mark.parametrize("bits,want", [("", (0, 0)), ("111", (0, 3)), ("0111", (1, 4)), ("1110111", (0, 7)), ("110011", (0, 2))])
def test_best_stretch(bits, want):
    assert best_stretch(np.array([c == "1" for c in bits], bool)) == want


def test_drop_and_empty_tables(spark, make_docs):
    passage = " ".join(f"q{i}" for i in range(20))
    docs = make_docs([(1, passage), (2, "clean text"), (None, "other"), (3, None), (1, "again")])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "None"]
    assert contaminated(docs.limit(0), bench).count() == 0 and drop_contaminated(docs, bench.limit(0)).count() == 5
