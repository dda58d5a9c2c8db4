import random
import re

import numpy as np

from weirgauge.llm.decontaminate import MASKS, contaminated, longest_share


def tokens(text):
    return re.findall(r"[^\W_]+", text.lower())


def docstring_passage(have, want):
    """Any stretch of any alignment that the docstring calls a passage."""
    for shift in range(-len(want) + 1, len(have)):
        first, end = max(0, -shift), min(len(want), len(have) - shift)
        equal = [want[i] == have[i + shift] for i in range(first, end)]
        for a in range(len(equal)):
            for b in range(a + 1, len(equal) + 1):
                n = sum(equal[a:b])
                if 10 * n >= 8 * (b - a) and (
                        n >= 13 or n >= 8 and 10 * n >= 8 * len(want) or len(want) < 8 and n == len(want)):
                    return True
    return False


def test_every_passage_of_an_alignment_counts(spark, make_docs):
    """Substitutions near the ends of an item, and a good part of a stretch that is poor as a whole."""
    rng = random.Random(11)
    items, rows, pairs = [], [], []
    for i in range(120):
        n = (16, 18, 20, 64)[i % 4]
        item = [f"i{i}t{k}" for k in range(n)]
        copy = list(item)
        for at in rng.sample(range(n), (2, 3, 4, 15)[i % 4] + rng.randrange(2)):
            copy[at] = f"s{at}"
        items.append((i, " ".join(item)))
        pairs.append((i, copy, item))
        rows.append((i, " ".join(["before"] * 5 + copy + ["after"] * 5)))
    item = [f"e{k}" for k in range(16)]
    copy = ["x" if k in (2, 13) else f"e{k}" for k in range(16)]
    items.append((500, " ".join(item)))
    rows.append((500, " ".join(copy)))
    pairs.append((500, copy, item))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in contaminated(make_docs(rows), bench).collect()}

    def seeded(have, want):  # the README's limit: some mask is left intact
        return any(all(m == "0" or have[p + k] == want[p + k] for k, m in enumerate(mask))
                   for mask in MASKS for p in range(len(want) - len(mask) + 1))
    reached = [pair for pair in pairs if seeded(*pair[1:])]
    want = {d for d, copy, item in reached if docstring_passage(copy, item)}
    assert set(got) == want and 500 in want and 60 < len(want) < len(reached)
    texts = dict(rows)
    for d, _, item in reached:
        if d in got:
            r, have = got[d], tokens(texts[d])
            equal = [item[r["item_at"] + k] == have[r["doc_at"] + k] for k in range(r["n_aligned"])]
            assert sum(equal) == r["n_equal"] >= 0.8 * r["n_aligned"]


def test_longest_share():
    rng = random.Random(2)
    for _ in range(300):
        equal = [rng.random() < rng.choice([0.5, 0.8]) for _ in range(rng.randrange(0, 25))]
        fits = [(sum(equal[a:b]), a - b) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1)
                if 10 * sum(equal[a:b]) >= 8 * (b - a)]
        a, b = longest_share(np.array(equal, bool))
        assert (sum(equal[a:b]), a - b) == max(fits, default=(0, 0))
