"""Chunks of long texts on sentence boundaries: a greedy fold, stated as SQL over arrays so that it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold(pieces: Column, size: int, state: Column) -> Column:
    """Append pieces with a blank while they fit; else push what is held."""

    def step(s: Column, p: Column) -> Column:
        fits = F.length(s["cur"]) + F.length(p) + 1 <= size
        held = F.trim(s["cur"])
        pushed = F.when(held != "", F.concat(s["out"], F.array(held))).otherwise(s["out"])
        return F.when(fits, F.struct(s["out"].alias("out"), F.concat(s["cur"], p, F.lit(" ")).alias("cur"))).otherwise(F.struct(pushed.alias("out"), F.concat(p, F.lit(" ")).alias("cur")))

    return F.aggregate(pieces, state, step)


def chunk_texts(text: Column, size: int = 512) -> Column:
    """The chunks of a text of more than ``size`` characters, by sentences and, within long ones, by words.

    Sentences end at runs of ``.!?`` and get one full stop; a single word beyond ``size`` is a chunk of its own.
    """
    ends = F.transform(F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != ""), lambda s: F.concat(s, F.lit(".")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def sentence(s: Column, p: Column) -> Column:
        fits = F.length(s["cur"]) + F.length(p) + 1 <= size
        held = F.trim(s["cur"])
        pushed = F.when(held != "", F.concat(s["out"], F.array(held))).otherwise(s["out"])
        words = F.filter(F.split(p, r"(?U)\s+"), lambda w: w != "")
        whole = F.struct(pushed.alias("out"), F.concat(p, F.lit(" ")).alias("cur"))
        cut = _fold(words, size, F.struct(pushed.alias("out"), F.lit("").alias("cur")))
        return F.when(fits, F.struct(s["out"].alias("out"), F.concat(s["cur"], p, F.lit(" ")).alias("cur"))).when(F.length(p) > size, cut).otherwise(whole)

    return F.aggregate(ends, start, sentence, lambda s: F.when(F.trim(s["cur"]) != "", F.concat(s["out"], F.array(F.trim(s["cur"])))).otherwise(s["out"]))


def chunked(blocks: DataFrame, size: int = 512, text_col: str = "text") -> DataFrame:
    """One row per chunk; texts up to ``size`` stay whole with null chunk numbers."""
    short = F.length(text_col) <= size
    pieces = F.when(short, F.array(text_col)).otherwise(chunk_texts(F.col(text_col), size))
    exploded = blocks.withColumn("_short", short).withColumn("_pieces", pieces).select("*", F.posexplode("_pieces").alias("_at", "_piece"))
    number = lambda c: F.when(~F.col("_short"), c).cast("int")
    kept = [c for c in blocks.columns if c not in (text_col, "chunk_index", "total_chunks")]
    return exploded.select(F.col("_piece").alias(text_col), *kept, number(F.col("_at")).alias("chunk_index"), number(F.size("_pieces")).alias("total_chunks"))
