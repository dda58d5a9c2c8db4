import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirgauge.llm import token_store
from weirgauge.llm.elias_fano import EliasFano, encode
from weirgauge.llm.token_store import WordIds, read_digests, read_document, read_documents, write_store

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 22), max_size=400).map(sorted))
def test_elias_fano_round_trip(values):
    code = EliasFano(encode(values))
    assert len(code) == len(values)
    assert code.values().tolist() == values
    assert [code.select(i) for i in range(len(values))] == values


def test_elias_fano_space_and_errors():
    values = sorted(random.Random(1).sample(range(1 << 20), 4000))
    assert len(encode(values)) * 8 < len(values) * (np.log2((1 << 20) / 4000) + 3) + 400
    with pytest.raises(ValueError):
        encode([3, 2])
    with pytest.raises(IndexError):
        EliasFano(encode([1])).select(1)
    assert EliasFano(encode([0] * 200 + [10**9])).select(200) == 10**9


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


@settings(max_examples=40, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=255), st.sampled_from("aeinrstäßéµªº.,!?'"), st.characters(exclude_categories=["Cs"]), st.sampled_from(
    " \t\n\v\f\r\x1c\x85  　'sΣσςİé́<|>endoftext")), max_size=60))
def test_words_give_the_ids_of_the_text(tokenizer, text):
    texts = [text, "", text.upper() + "."]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = WordIds(FILE).of_batch([*texts, None])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [*want, []]


def expected(rows, tokenizer):
    start, out = 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store(spark, make_docs, odd_rows, tokenizer, tmp_path, monkeypatch):
    rows = [r for r in odd_rows if r[0] is not None]
    docs = make_docs(rows).repartition(5)
    write_store(docs, str(tmp_path / "s"), FILE)
    got = sorted(tuple(r) for r in read_digests(spark, str(tmp_path / "s")).collect())
    assert got == sorted(expected(rows, tokenizer))
    for row in read_documents(spark, str(tmp_path / "s")).collect():
        assert zlib.crc32(np.array(row["ids"], "<u4").tobytes()) == {(g[0], g[1]): g[3] for g in got}[row["doc_id"], row["start"]]
    chunk = spark.read.parquet(str(tmp_path / "s")).where("size(doc_ids) > 1").first().asDict()
    assert len(read_document(chunk, 1)) == read_documents(spark, str(tmp_path / "s")).where(
        f"start = {chunk['first_id']} + {len(read_document(chunk, 0))}").first()["n_tokens"] or chunk["shard"]


def test_null_ids_come_first_and_empty_tables(spark, make_docs, tmp_path):
    docs = make_docs([(3, "c"), (None, "b b"), (1, None)])
    write_store(docs, str(tmp_path / "n"), FILE)
    rows = read_digests(spark, str(tmp_path / "n")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 3] and [r["n_tokens"] for r in rows] == [3, 1, 2]
    write_store(docs.limit(0), str(tmp_path / "e"), FILE)
    assert read_digests(spark, str(tmp_path / "e")).count() == 0


def test_chunks(spark, make_docs, tokenizer):
    import pandas as pd

    rows = [(i, " ".join(["word"] * (i % 7) * 40)) for i in range(50)]
    small = token_store.CHUNK_IDS
    try:
        token_store.CHUNK_IDS = 300
        import unittest.mock as mock
        with mock.patch("pyspark.TaskContext.get") as task:
            task.return_value.partitionId.return_value = 0
            chunks = pd.concat(token_store._chunks(iter([pd.DataFrame(rows, columns=["doc_id", "text"])]), FILE, 2, 2))
    finally:
        token_store.CHUNK_IDS = small
    assert len(chunks) > 5 and chunks["n_ids"].max() <= 300
    assert chunks["first_id"].tolist() == [0, *chunks["n_ids"].cumsum().tolist()[:-1]]
    chunks["start"] = 0
    back = pd.concat(token_store._documents(iter([chunks]), True))
    assert [tuple(r) for r in back.itertuples(index=False)] == expected(rows, tokenizer)
