import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirgauge.llm.substring_dedup import _home, pack_places, remove_repeats, repeat_digests, unpack_places


def brute_force(rows, window):
    """Rows that agree in id and text are one document."""
    parsed = [(r[0], r[1], (r[1] or "").encode().split()) for r in rows]
    order = sorted({(p[0] is None, p[0] or 0, p[1] or "") for p in parsed})
    words = {(p[0] is None, p[0] or 0, p[1] or ""): p[2] for p in parsed}
    seen, gone = set(), {}
    for doc in order:
        w = words[doc]
        gone[doc] = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if key in seen:
                gone[doc].update(range(i, i + window))
            seen.add(key)
    out = []
    for doc_id, text, w in parsed:
        lost = gone[doc_id is None, doc_id or 0, text or ""]
        kept = b" ".join(x for i, x in enumerate(w) if i not in lost)
        out.append((doc_id, len(w), len(lost), kept.decode()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(8, 70))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        if rng.random() < 0.2:
            words += ["again", "and"] * 25
        rows.append((rng.randrange(10**6), " ".join(words)))
    return rows


def same(got, want):
    def order(r):
        return str(r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("seed,window,options", [
    (1, 20, {}), (2, 20, {"unit_words": 300, "bucket_words": 200}), (3, 6, {"unit_words": 40}), (4, 2, {})])
def test_same_as_brute_force(make_docs, seed, window, options):
    rows = corpus(seed)
    same(remove_repeats(make_docs(rows).repartition(5), window=window, **options).collect(), brute_force(rows, window))


def test_odd_rows(make_docs, odd_rows):
    rows = [r[:2] for r in odd_rows]
    docs = make_docs(odd_rows)
    same(remove_repeats(docs.repartition(4)).collect(), brute_force(rows, 20))
    want = [(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in brute_force(rows, 20)]
    same(repeat_digests(docs).collect(), want)
    assert remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs, window=5)


def test_many_copies_of_one_passage(make_docs):
    """A passage in every document, shifted, and in one document many times."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(45)]
    rows = [(i, " ".join([f"d{i}x{j}" for j in range(rng.randrange(0, 25))] + passage + [f"e{i}"])) for i in range(300)]
    rows.append((500, " ".join(passage * 20)))
    same(remove_repeats(make_docs(rows), unit_words=2000, bucket_words=500).collect(), brute_force(rows, 20))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1 << 31), unique=True).map(sorted))
def test_places_round_trip(places):
    assert unpack_places(pack_places(np.array(places, np.int64))).tolist() == places


@pytest.mark.parametrize("buckets", [48, 64, 1000, 1024])
def test_units_are_dealt_to_all_buckets(buckets):
    """Units are numbered by task and order within it."""
    homes = np.bincount([_home((task << 24) + k, buckets) for task in range(10 * buckets) for k in range(2)], minlength=buckets)
    assert homes.min() > 0 and homes.max() < 4 * 20
