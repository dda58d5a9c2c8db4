"""Rows of documents named by id and text, where ids may be null or repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_key(text: Column) -> Column:
    """Hash of a text, which tells apart the texts of one id; never null."""
    return F.xxhash64(text)


def same_row(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> Column:
    """Whether a row of ``docs`` is the one with the ``id`` and ``key`` of ``named``. The
    hash comes first: it is never null and spreads rows that share an id."""
    return (text_key(docs[text_col]) == named["key"]) & docs[id_col].eqNullSafe(named["id"])


def one_row_each(docs: DataFrame, named: DataFrame, id_col: str, text_col: str, times: str | None = None) -> DataFrame:
    """The rows of ``docs`` that ``named`` lists by ``id`` and ``key``, with ``n``, how
    many rows agree in both; of such rows one stays. With ``times`` every row is repeated
    as often as that column of ``named`` says.

    Texts are shuffled once, for the join. Only rows that have equals are compared.
    """
    def joined(chosen: DataFrame) -> DataFrame:
        if times is None:
            return docs.join(chosen, same_row(docs, chosen, id_col, text_col), "left_semi")
        found = docs.join(chosen, same_row(docs, chosen, id_col, text_col))
        again = found.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), chosen[times].cast("int"))).alias("again"))
        return again.select(*[docs[c] for c in docs.columns])

    single = joined(named.where("n = 1"))
    repeated = named.where("n > 1")
    if repeated.isEmpty():
        return single
    # One of the equal rows, then as often as wanted.
    own = docs.join(repeated, same_row(docs, repeated, id_col, text_col), "left_semi")
    parts = own.select(F.struct(*[own[c] for c in own.columns]).alias("row"), own[id_col].alias("id"), text_key(own[text_col]).alias("key"))
    kept = parts.dropDuplicates(["id", "key"])
    if times is not None:
        wanted = repeated.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col(times).cast("int").alias("_times"))
        kept = kept.join(wanted, (kept["key"] == wanted["_key"]) & kept["id"].eqNullSafe(wanted["_id"])).select(
            "row", F.explode(F.array_repeat(F.lit(0), F.col("_times"))))
    return single.unionByName(kept.select("row.*"))
