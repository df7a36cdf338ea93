"""Word grams of whole texts as Spark expressions: one pass, no Python, no shuffle of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

#: What lies between words: ASCII other than letters and digits, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    r"""The words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def grams_of(tokens: Column, k: int) -> Column:
    """The k-grams of an array of words, in order, words joined by a space."""
    at = F.sequence(F.lit(0), F.size(tokens) - F.lit(k))
    found = F.transform(at, lambda i: F.concat_ws(" ", *[F.get(tokens, i + F.lit(j)) for j in range(k)]))
    return F.when(F.size(tokens) >= k, found).otherwise(F.array().cast("array<string>"))


def exploded(docs: DataFrame, sizes: list[int], text: str, key: str) -> DataFrame:
    """(_row, _id, n_words, k, pos, gram): every gram of every row, and a row with null ``k`` for each row itself.

    ``_row`` tells repeated rows apart; it is made in the scan, in which it is only used.
    """
    def tagged(tokens: Column, k: int) -> Column:
        return F.transform(grams_of(tokens, k), lambda g, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), g.alias("gram")))

    itself = F.array(F.struct(F.lit(None).cast("int").alias("k"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("gram")))
    both = let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.concat(itself, *[tagged(w, k) for k in sizes]).alias("g")))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_id"), both.alias("_b"))
    return rows.select("_row", "_id", F.col("_b.n").alias("n_words"), F.explode("_b.g").alias("_g")).select("_row", "_id", "n_words", "_g.k", "_g.pos", "_g.gram")
