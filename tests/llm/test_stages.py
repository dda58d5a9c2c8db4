"""What every stage that filters or repeats documents leaves of odd rows."""

from collections import Counter

import pytest

from weirgauge.llm.decontaminate import drop_contaminated
from weirgauge.llm.mixing import mixed_documents
from weirgauge.llm.simhash import drop_near_duplicates
from weirgauge.llm.toxicity import drop_toxic

PASSAGE = " ".join(f"bench{i}" for i in range(40))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, "another item of the same id"), (None, None)], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (6, 1, 0), (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")


def rows_of(frame):
    return Counter((r["doc_id"], r["text"]) for r in frame.collect())


def test_clean_rows_stay_beside_contaminated_rows_of_their_id(make_docs, benchmark):
    clean = [(1, "a clean text"), (None, "clean and nameless"), (2, None), (2, ""), (1, "a clean text")]
    docs = make_docs([(*r, "en", "a") for r in [*clean, (1, "x " + PASSAGE), (None, PASSAGE + " y"), (3, PASSAGE.upper())]])
    assert rows_of(drop_contaminated(docs, benchmark)) == Counter(clean)


@pytest.mark.parametrize("stage", ["toxic", "near", "contaminated", "mixed"])
def test_odd_rows_and_clashing_columns(make_docs, odd_rows, benchmark, labels, stage):
    run = {"toxic": lambda d: drop_toxic(d, labels), "near": drop_near_duplicates,
           "contaminated": lambda d: drop_contaminated(d, benchmark), "mixed": mixed_documents}[stage]
    docs = make_docs(odd_rows)
    kept = run(docs)
    assert kept.schema.names == docs.schema.names
    given = {(r["doc_id"], r["text"]): r for r in docs.collect()}
    for row in kept.collect():
        assert row == given[row["doc_id"], row["text"]]  # also in the columns with names that stages might use
    if stage in ("toxic", "contaminated"):
        assert rows_of(kept) == rows_of(docs)
    assert run(docs.limit(0)).count() == 0


def test_stages_without_benchmark_or_labels(make_docs, odd_rows, benchmark, labels):
    docs = make_docs(odd_rows)
    assert rows_of(drop_contaminated(docs, benchmark.limit(0))) == rows_of(docs)
    assert rows_of(drop_toxic(docs, labels.limit(0))) == rows_of(docs)


def test_mix_takes_rows_of_one_id_by_their_texts(make_docs):
    """Each text as often as its rows are taken, in one source that is taken whole."""
    docs = make_docs([(1, "one two", "en", "a"), (1, "three four five", "en", "a"), (1, "one two", "en", "a"), (None, "six", "en", "a")])
    assert rows_of(mixed_documents(docs)) == rows_of(docs)
