import pytest
import random
import zlib

from weirgauge.llm.toxicity import (
    Lexicon, automaton, drop_toxic, fold, held_out, learn_lexicon, score_toxicity, weights_in)

LEXICON = Lexicon((("idiot", 3.0), ("idiotic", 4.0), (fold("clown"), 2.0)), ("clown fish",))


def total(text):
    return sorted(weights_in(fold(text), automaton(LEXICON)))


def test_folding_and_boundaries():
    assert total("You IDIOT") == [3.0] and total("1d10t") == [3.0] and total("іdіоt") == [3.0] and total("ídíot!") == [3.0]
    assert total("ｉｄｉｏｔ") == [3.0] and total("i​diot") == [3.0]
    assert total("idiotic idiots idiot") == [3.0, 4.0]  # the longest term of a word, once each
    assert total("xidiot") == [] and total("") == [] and fold(None) == ""
    assert total("a clown fish swims") == [] and total("a cl0wn fish, a clown") == [2.0]


def test_terms_match_brute_force():
    rng = random.Random(4)
    terms = {t: float(i + 1) for i, t in enumerate(["ab", "abc", "bca", "c", "cab", "aaa"])}
    built = automaton(Lexicon(tuple(terms.items())))
    for _ in range(300):
        text = "".join(rng.choice("abc ") for _ in range(40))
        want = {}
        for word in text.split():
            best = max((t for t in terms if word.startswith(t)), key=len, default=None)
            if best:
                want[best] = terms[best]
        assert sorted(weights_in(text, built)) == sorted(want.values())


def corpus(n, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("mnoprstuvw") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["zorgat", "z0rgaten", "Krimbel"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learning(spark, make_docs, odd_rows):
    rows, labels = corpus(1500)
    odd = [(None if r[0] is None else 10_000 + r[0], *r[1:]) for r in odd_rows]
    docs = make_docs(rows + odd)
    marked = spark.createDataFrame(labels + [(None, 1), (10_001, None), (10_001, 1), (99_999, 1)], "doc_id long, toxic int")
    got = score_toxicity(docs, marked).collect()
    assert len(got) == len(rows) + len(odd)
    truth = dict(labels)
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(right) > 200 and sum(right) / len(right) > 0.97
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    kept = drop_toxic(docs, marked)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got)


def test_held_out_labels_are_not_learned_from(spark, make_docs):
    rows, labels = corpus(600)
    docs = make_docs(rows)
    out = {r["doc_id"] for r in docs.select("doc_id").where(held_out(docs["doc_id"])).collect()}
    flipped = [(i, 1 - t if i in out else t) for i, t in labels]
    first = learn_lexicon(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    second = learn_lexicon(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert first.terms == second.terms and first.terms


def test_without_examples(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in score_toxicity(docs, empty).collect()} == {0}
    assert score_toxicity(docs.limit(0), empty).count() == 0 and drop_toxic(docs, empty).count() == 2


@pytest.mark.parametrize("spelling", ["𝐢𝐝𝐢𝐨𝐭", "𝑰𝑫𝑰𝑶𝑻", "ⓘⓓⓘⓞⓣ", "ⒾⒹⒾⓄⓉ", "ᴉdiot", "ɪᴅɪᴏᴛ", "ｉｄｉｏｔ", "ìdïöt", "1d10t", "іdіоt", "🄸🄳🄸🄾🅃", "id\u200biot"])
def test_spellings_fold_into_one(spelling):
    assert total(spelling) == total("idiot") == [3.0]
