"""Symbol-aware chunks: the code of each symbol, with symbols nested directly in it replaced by one line each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import ids
from treeloom.functions.text import indentation, line_range, split_lines


def direct_children(symbols: DataFrame) -> DataFrame:
    """(symbol_id, child_id, child_start, child_end, child_name): symbols inside another and inside no third one between.

    Inside means a later start and an end not after the other's. The symbols of one file meet in an equi-join on the file; a
    container is left out when one that starts later, and ends no later than it, also holds the child.
    """
    s = symbols.select("source_file_id", "id", "start_line", "end_line", "qualified_name")
    c = s.select(F.col("source_file_id").alias("_f"), F.col("id").alias("child_id"), F.col("start_line").alias("child_start"), F.col("end_line").alias("child_end"), F.col("qualified_name").alias("child_name"))
    inside = (F.col("child_id") != F.col("id")) & (F.col("child_start") > F.col("start_line")) & (F.col("child_end") <= F.col("end_line"))
    j = s.join(c, (F.col("source_file_id") == F.col("_f")) & inside)
    w = Window.partitionBy("child_id").orderBy(F.col("start_line").desc()).rangeBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("_closer", F.min("end_line").over(w)).where(F.col("_closer").isNull() | (F.col("_closer") > F.col("end_line")))
    return j.select(F.col("id").alias("symbol_id"), "child_id", "child_start", "child_end", "child_name")


def symbol_code(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """symbols with ``code``; texts: (source_file_id, text). Lines are numbered from 1; nested symbols become one marked line.

    Children are walked in the order of their first lines by a fold that holds the lines so far and the next line to copy.
    """
    symbols = symbols.select("id", "source_file_id", "qualified_name", "kind", "start_line", "end_line")
    kids = direct_children(symbols).groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct("child_start", "child_id", "child_end", "child_name"))).alias("_kids"))
    t = texts.select(F.col("source_file_id").alias("_f"), split_lines(F.col("text")).alias("_lines"))
    j = symbols.join(kids, F.col("id") == F.col("symbol_id"), "left").join(t, F.col("source_file_id") == F.col("_f"))
    empty = F.array().cast("array<string>")
    lines, start, stop = F.col("_lines"), F.col("start_line"), F.col("end_line")

    def step(acc, kid):
        between = F.when(acc["at"] < kid["child_start"], line_range(lines, acc["at"], kid["child_start"] - 1)).otherwise(empty)
        mark = F.concat(indentation(F.coalesce(F.try_element_at(lines, kid["child_start"]), F.lit(""))), F.lit("[nested symbol: "), kid["child_name"], F.lit("]"))
        return F.struct(F.concat(acc["out"], between, F.array(mark)).alias("out"), (kid["child_end"] + 1).alias("at"))

    def close(acc):
        return F.concat(acc["out"], F.when(acc["at"] <= stop, line_range(lines, acc["at"], stop)).otherwise(empty))

    kids_col = F.coalesce(F.col("_kids"), F.array().cast("array<struct<child_start:int,child_id:string,child_end:int,child_name:string>>"))
    code = F.aggregate(kids_col, F.struct(empty.alias("out"), start.alias("at")), step, close)
    return j.withColumn("code", F.array_join(code, "\n")).drop("symbol_id", "_kids", "_f", "_lines")


def embedding_text(language, path, name, kind, code):
    return F.concat(F.lit("Language: "), language, F.lit("\nFile: "), path, F.lit("\nSymbol: "), name, F.lit("\nKind: "), kind, F.lit("\n\nCode:\n"), code)


def chunk(symbols: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """One chunk per symbol whose code isn't blank, in the columns of the chunk table."""
    f = files.select(F.col("id").alias("_file"), "snapshot_id", "relative_path", "language")
    c = symbol_code(symbols, texts).join(f, F.col("source_file_id") == F.col("_file")).where(F.col("code").rlike(r"\S"))
    c = c.withColumns({"symbol_id": F.col("id"), "symbol_kind": F.col("kind"), "part_index": F.lit(0), "part_count": F.lit(1)})
    c = c.withColumn("id", ids.chunk_id()).withColumn("text", embedding_text(F.col("language"), F.col("relative_path"), F.col("qualified_name"), F.col("symbol_kind"), F.col("code")))
    return c.select("id", "snapshot_id", "source_file_id", "symbol_id", F.lit("SYMBOL").alias("kind"), "text", "code", "relative_path", "language", "qualified_name", "symbol_kind", "start_line", "end_line", "part_index", "part_count")
