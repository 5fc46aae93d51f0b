"""Writers; each writes a folder of part files in parallel.

Empty tables give folders without rows.  Repeated rows are written again; null values are empty lines unless stated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.sources.readers import MODEL_MARK, USER_MARK


def group_lines(groups: DataFrame, path: str) -> None:
    """Groups as comma-joined lines."""
    groups.select(F.col("members").alias("value")).write.mode("overwrite").text(path)


def anchored_lists(groups: DataFrame, path: str) -> None:
    """Groups ``(anchor, members)`` as ``[id, id]`` lines in order, in a folder for each anchor.

    Rows of an anchor are brought together first, so that an anchor has few files rather than one per task.
    """
    line = F.concat(F.lit("["), F.array_join(F.array_sort(F.split("members", ",")), ", "), F.lit("]"))
    rows = groups.select("anchor", line.alias("value")).hint("rebalance", "anchor")
    rows.write.mode("overwrite").partitionBy("anchor").text(path)


def _json_objects(entries: DataFrame, path: str, per_file: int) -> None:
    """``entries(key, value)`` as JSON objects of about ``per_file`` entries, one per file."""
    files = entries.count() // per_file + 1
    dealt = entries.filter("key IS NOT NULL").groupBy(F.pmod(F.xxhash64("key"), F.lit(files)).alias("file"))
    rows = dealt.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value"))))).alias("value"))
    rows.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def label_json(labels: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Labels ``(address, name)``, each address once, as objects ``address -> {name}``."""
    _json_objects(labels.select(F.col("address").alias("key"), F.struct("name").alias("value")), path, per_file)


def entity_json(entities: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Entities ``(entity, name)`` as objects ``entity -> [name]``; names are in order and once."""
    rows = entities.groupBy(F.col("entity").alias("key")).agg(F.sort_array(F.collect_set("name")).alias("value"))
    _json_objects(rows, path, per_file)


def member_lines(component: DataFrame, path: str) -> None:
    """Members of a component, one per line."""
    component.select(F.col("member").alias("value")).write.mode("overwrite").text(path)


def edge_lines(edges: DataFrame, path: str) -> None:
    """Edges as ``source,target`` lines."""
    edges.select(F.concat_ws(",", edges.columns[0], edges.columns[1]).alias("value")).write.mode("overwrite").text(path)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``json``: an export graph as one object.  Exports are limited by their hop sizes, so this is small."""
    n = nodes.agg(F.sort_array(F.collect_list(F.struct("id", "label", "layer"))).alias("nodes"))
    e = edges.agg(F.sort_array(F.collect_list(F.struct("source", "target"))).alias("edges"))
    return n.select(F.to_json(F.struct("nodes", e.scalar().alias("edges"))).alias("json"))


def frequency_lines(frequency: DataFrame, path: str) -> None:
    """``member: n`` lines, the most frequent first."""
    ordered = frequency.orderBy(F.desc("n"), "member")
    ordered.select(F.format_string("%s: %d", "member", "n").alias("value")).write.mode("overwrite").text(path)


def csv_rows(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def chat_lines(turns: DataFrame, path: str, user: str = USER_MARK, model: str = MODEL_MARK) -> None:
    """Turns ``(log, turn, role, text)`` as marked records, in order within a log's folder."""
    mark = F.when(F.col("role") == "user", user).otherwise(model)
    rows = turns.repartition("log").sortWithinPartitions("log", "turn").select("log", F.concat(mark, F.col("text")).alias("value"))
    rows.write.mode("overwrite").partitionBy("log").text(path)
