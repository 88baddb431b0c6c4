"""Places of pattern matches inside a text, by column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BLOCK = 64


def located(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Add the leftmost non-overlapping matches as an array of (start, end, value), in code points, end exclusive.

    A match's start is the length of all matches before it and of all the gaps up to it; gaps and matches come from
    two passes of the same pattern, the second one only over texts with a match. Patterns must not match the empty text.

    Folds that append to an array copy it at every step, so matches are placed in blocks of ``BLOCK``: the blocks'
    lengths give each block's offset, and each block is folded from there.
    """
    hits, gaps = f"__{name}_hits", f"__{name}_gaps"
    out = df.withColumn(hits, F.regexp_extract_all(text, F.lit(pattern), 0))
    out = out.withColumn(gaps, F.when(F.size(hits) > 0, F.split(text, pattern, -1)))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def places(block: Column) -> Column:
        return F.sequence(block * BLOCK, F.least(block * BLOCK + BLOCK, F.size(hits)) - 1)

    def width(block: Column) -> Column:
        return F.aggregate(places(block), F.lit(0), lambda n, i: n + F.length(F.get(gaps, i)) + F.length(F.get(hits, i)))

    def offset(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen"))

    def step(acc: Column, i: Column) -> Column:
        value = F.get(hits, i)
        begin = acc["at"] + F.length(F.get(gaps, i))
        end = begin + F.length(value)
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), value.alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found"))

    def place(block: Column, at: Column) -> Column:
        return F.aggregate(places(block), F.struct(at.alias("at"), none.alias("found")), step, lambda acc: acc["found"])

    blocks = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen"))
    offsets = F.aggregate(F.transform(blocks, width), start, offset, lambda acc: acc["seen"])
    found = F.flatten(F.zip_with(blocks, offsets, place))
    return out.withColumn(name, F.when(F.size(hits) > 0, found).otherwise(none)).drop(hits, gaps)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Is this string of digits valid? Every second digit from the right counts twice, less nine if that is above nine."""
    places = F.sequence(F.lit(1), F.length(number))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.when(F.length(number) > 0, F.aggregate(places, F.lit(0), add) % 10 == 0).otherwise(F.lit(False))
