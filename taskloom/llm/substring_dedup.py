"""Substring dedup by hashing lines or paragraphs.

A unit's normal form is lower-cased with runs of white space as one space. Units
are grouped by two 64-bit digests of it over the whole corpus; the occurrence with
the least (rank, row, offset) stays and all others are removed. Offsets are code
points of the original text. Everything is DataFrame functions: texts are read
once for the digests, and only digests and places are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, with_row_id

SPACES = r"[\x09-\x0D\x20]+"


def normal_form(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), SPACES, " "))


def _pieces(text: Column, separator: str) -> Column:
    return F.split(text, separator if separator == "\n" else rf"\Q{separator}\E")


def repeated_units(docs: DataFrame, separator: str = "\n", min_words: int = 1, text: str = "text", rank: str = "doc_id") -> DataFrame:
    """(_rid, at, stop, first_rank): the units to remove, with their offsets and the rank of the one that stays.

    ``docs`` must be read from files. The rank is ``rank``, null last, then the
    row's number, so ties and repeated rows have an order; within a text the
    earlier offset comes first. Units of fewer than ``min_words`` words, and
    those without a word, stay. Null and empty texts have no units, an empty
    table gives no rows, and other columns play no part.
    """
    rows = with_row_id(docs.select(F.coalesce(F.col(rank).cast("long"), F.lit(2**63 - 1)).alias("rank"), F.col(text).alias("text")))
    units = rows.select("rank", "_rid", F.posexplode(_pieces(F.col("text"), separator)).alias("i", "unit"))
    units = units.select("rank", "_rid", "i", F.char_length("unit").alias("size"), normal_form(F.col("unit")).alias("form"))
    words = F.size(F.split("form", " ")) if min_words > 1 else F.lit(1)
    units = units.select("rank", "_rid", "i", "size", F.when((F.col("form") != "") & (words >= min_words), F.xxhash64("form")).alias("d1"), F.xxhash64(F.lit(7), "form").alias("d2"))
    before = Window.partitionBy("_rid").orderBy("i")
    stop = F.sum(F.col("size") + len(separator)).over(before) - len(separator)
    units = stored(units.select("rank", "_rid", "d1", "d2", stop.cast("int").alias("stop"), "size").where("d1 is not null").withColumn("at", F.col("stop") - F.col("size")).drop("size"))
    place = F.struct("rank", "_rid", "at")
    first = units.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return units.join(first, ["d1", "d2"]).where(place > F.col("first")).select("_rid", "at", "stop", F.col("first.rank").alias("first_rank"))


OUTPUTS = ["n_removed", "removed_chars", "removed", "kept_text"]


def substring_dedup(docs: DataFrame, separator: str = "\n", min_words: int = 1, text: str = "text", rank: str = "doc_id") -> DataFrame:
    """The rows of docs with the columns n_removed, removed_chars, removed and kept_text.

    ``removed`` lists (at, stop, first_rank) in text order. In kept_text a
    removed unit goes with the separator after it (at the end, the one before
    it). Null texts stay null; other columns are untouched, but columns of docs
    with the names of the four new ones are replaced.
    """
    rows = with_row_id(docs.select(F.col(text).alias("text"), F.struct("*").alias("row")))
    spans = repeated_units(docs, separator, min_words, text, rank).groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("at", "stop", "first_rank"))).alias("removed"))
    joined = rows.join(spans, "_rid", "left")
    none = F.array().cast("array<struct<at:int,stop:int,first_rank:bigint>>")
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("removed"), separator))
    return joined.select(
        *(F.col("row")[c].alias(c) for c in docs.columns if c not in OUTPUTS),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["at"]), F.lit(0).cast("long")).alias("removed_chars"),
        F.coalesce("removed", none).alias("removed"),
        kept.alias("kept_text"),
    )


def _without(text: Column, removed: Column, separator: str) -> Column:
    """The pieces between the removed spans, each with its own separators."""
    step = len(separator)
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda x: x["stop"] + step))
    ends = F.concat(F.transform(removed, lambda x: x["at"]), F.array(F.char_length(text) + step))
    # A piece carries the separator at its end; the last one is cut off again.
    pieces = F.zip_with(starts, ends, lambda a, b: F.when(b > a, F.substring(F.concat(text, F.lit(separator)), a + 1, b - a)).otherwise(F.lit("")))
    joined = F.array_join(pieces, "")
    return F.substring(joined, F.lit(1), F.greatest(F.char_length(joined) - F.lit(step), F.lit(0)))
