"""Header presence -- which keyword header names each file has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.operators.headers import keyword_headers
from sheetwise.session import stored


def header_presence(headers: DataFrame) -> DataFrame:
    """(column_name, source_file, present): the distinct header names containing
    a keyword, with every file that has them.  Rows grow with the headers."""
    return keyword_headers(headers).select(F.col("raw_name").alias("column_name"), "source_file").distinct().withColumn("present", F.lit(1))


def file_numbers(headers: DataFrame) -> DataFrame:
    """The file dimension: (source_file, file_no), numbered from 0 by name.  One
    row per file, so the numbering window is small."""
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source_file")) - 1
    return headers.select("source_file").distinct().withColumn("file_no", number)


def header_bits(headers: DataFrame, files: DataFrame) -> DataFrame:
    """(column_name, n_files, words): per name one bit per file of the dimension,
    64 to a word; word w holds files 64 w to 64 w + 63, the first in the lowest bit.
    Bits of a word are or-ed before the shuffle, so a name costs one row per 64
    files, not one per file."""
    found = header_presence(headers).join(files, "source_file")
    word = F.floor(F.col("file_no") / 64).cast("int")
    words = found.groupBy("column_name", word.alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(file_no % 64 AS INT))")).alias("bits"), F.count("*").alias("n"))
    return words.groupBy("column_name").agg(F.sum("n").alias("n_files"), F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("words"))


def has_file(number: int) -> Column:
    """1 or 0: whether a row of ``header_bits`` has the file's bit."""
    bits = F.coalesce(F.try_element_at("words", F.lit(number // 64)), F.lit(0).cast("long"))
    return F.getbit(bits, F.lit(number % 64)).cast("int")


def header_matrix(headers: DataFrame, files: list[str] | None = None) -> DataFrame:
    """The same as a matrix: one column per file, 1/0, one row per name that any
    file has (sorted, T3).  All files of the headers, or only the given ones."""
    headers = stored(headers, "headers")
    numbers = stored(file_numbers(headers), "files")
    number = {r.source_file: r.file_no for r in numbers.collect()}  # they become columns
    chosen = sorted(number) if files is None else files
    marks = [(has_file(number[f]) if f in number else F.lit(0)).alias(f) for f in chosen]
    return header_bits(headers, numbers).select("column_name", *marks).orderBy("column_name")
