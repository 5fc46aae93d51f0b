"""Readers of text, CSV and JSON inputs.

Empty files and folders without files give no rows; what a reader cannot read as its format is left out, as stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions.rules import addresses

#: Fixed values of the chat log format: what a user's and a model's turn begin with.
USER_MARK, MODEL_MARK = "You: ", "Ollama: "


def address_list(spark: SparkSession, path: str) -> DataFrame:
    """``(id)``: one address per line, trimmed; blank lines are skipped, repeated ones stay."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def dimension(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``(address)``: the first column of a CSV file (or the lines of a text file), trimmed, in lower case, once."""
    rows = spark.read.csv(path, header=header)
    return rows.select(F.lower(F.trim(F.col(rows.columns[0]))).alias("address")).filter("address <> ''").distinct()


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """``(path, row_id, value)``: lines with their 1-based numbers in each file.

    A line's number is its place in its split of the file and the lines of the splits before, so large files are
    read by many tasks; only one row per split is gathered by file.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("path"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("path", "split").orderBy("at")))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("path", "split").agg(F.count(F.lit(1)).alias("lines"))
    splits = splits.withColumn("base", F.coalesce(F.sum("lines").over(before), F.lit(0))).drop("lines")
    return lines.join(splits, ["path", "split"]).select("path", (F.col("base") + F.col("n")).alias("row_id"), "value")


def cluster_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id, members)``: comma-joined rows of unequal width; blank rows are skipped but keep their number.
    Empty members between commas stay, as empty text; files of a folder are numbered each from 1."""
    rows = _numbered(spark, path).filter("trim(value) <> ''")
    return rows.select("row_id", F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("members"))


def label_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``(address, name, position)`` from JSON objects ``address -> {name}``, one per file.

    The position is that in the file, after all entries of the files before it in order of their names.  A file is one
    row of one task, as JSON has no record ends to split at: at most 2 GB, and large dictionaries are several files.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.map_entries(F.from_json("value", "map<string, struct<name: string>>")).alias("entries"))
    rows = files.select("path", F.posexplode("entries").alias("at", "e"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    base = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "path").select(F.col("e.key").alias("address"), F.col("e.value.name").alias("name"), (F.col("base") + F.col("at")).alias("position"))


def entity_map(spark: SparkSession, path: str) -> DataFrame:
    """``(entity, name)`` from JSON objects ``entity -> [name]``, one per file of at most 2 GB."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("entity", "names")).select("entity", F.explode("names").alias("name"))


def result_lists(spark: SparkSession, path: str) -> DataFrame:
    """``(anchor, members)``: JSON lists, one per line, in files named after their anchor or in folders ``anchor=``.

    Lines that are no list are skipped.  Folders are named by a pattern, ``path/*``.
    """
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), F.from_json("value", "array<bigint>").alias("members"))
    return rows.filter("members IS NOT NULL").select(_named("path", "anchor").alias("anchor"), "members")


def _named(path: str, key: str) -> Column:
    """The value of a folder ``key=value`` in a path, or where there is none the file's name without its ending."""
    folder = F.regexp_extract(path, f"/{key}=([^/]*)/[^/]*$", 1)
    return F.when(folder != "", F.try_url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).otherwise(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(log, line_no, line)`` for ``chat_turns``: the lines of a folder of logs, one file each, in folders ``log=`` or
    named after the log."""
    return _numbered(spark, f"{path}/*").select(_named("path", "log").alias("log"), F.col("row_id").alias("line_no"), F.col("value").alias("line"))


def extracted_addresses(cells: DataFrame) -> DataFrame:
    """``(address, position)``: every 40-digit hexadecimal word of ``cells(position, cell)`` in lower case, at its
    first position.  Null cells have none."""
    rows = cells.select("position", F.explode(addresses(F.col("cell"))).alias("address"))
    return rows.groupBy("address").agg(F.min("position").alias("position"))


def chat_turns(lines: DataFrame, user: str = USER_MARK, model: str = MODEL_MARK, log: str = "log") -> DataFrame:
    """``(log, turn, role, text)`` from ``lines(log, line_no, line)`` of marked multi-line records.

    A marked line opens a turn and the lines up to the next mark belong to it.  A user turn counts if a model turn
    follows it directly; lines before the first mark belong to none.  Null lines are empty ones without a mark, lines
    of one number come by their text, and a null log is a log.  A log is put in order by one task, as a turn goes on
    until the next mark.
    """
    role = F.when(F.col("line").startswith(user), "user").when(F.col("line").startswith(model), "assistant")
    text = F.when(F.col("line").startswith(user), F.substring("line", len(user) + 1, 1 << 30)).when(F.col("line").startswith(model), F.substring("line", len(model) + 1, 1 << 30)).otherwise(F.col("line"))
    w = Window.partitionBy(log).orderBy("line_no")
    rows = lines.select(log, "line_no", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("turn", F.count("role").over(w)).filter("turn > 0")
    parts = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    turns = rows.groupBy(log, "turn").agg(F.max("role").alias("role"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
    order = Window.partitionBy(log).orderBy("turn")
    turns = turns.withColumn("_next", F.lead("role").over(order)).withColumn("_last", F.lag("role").over(order))
    return turns.filter("(role = 'user' AND _next = 'assistant') OR (role = 'assistant' AND _last = 'user')").select(log, "turn", "role", "text")
