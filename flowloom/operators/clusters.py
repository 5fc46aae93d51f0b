"""Merging clusters of accounts by creators, name families and entities.

Clusters are ``(row_id, members)`` with members an array in order and row ids from 1, each once.  Everywhere null
keys match nothing, empty tables give no rows, and columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.rules import entity_name
from flowloom.operators.components import connected_components
from flowloom.operators.joins import split_join


def creator_merge(clusters: DataFrame, creations: DataFrame) -> DataFrame:
    """``(row_id, members)``: each row's members, and after each the targets that it created, in order.

    ``creations`` has ``src``, ``dst`` and ``rank``, which orders the targets of a source; those of one rank come by
    ``dst``.  Repeats stay, and so does a null member; rows without members do not come out.
    """
    at = clusters.select("row_id", F.posexplode("members").alias("pos", "member"))
    made = creations.groupBy(F.col("src").alias("member")).agg(F.sort_array(F.collect_list(F.struct("rank", "dst"))).alias("made"))
    targets = F.coalesce(F.transform("made", lambda x: x["dst"]), F.array().cast("array<string>"))
    rows = at.join(made, "member", "left").select("row_id", "pos", F.concat(F.array("member"), targets).alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("pos", "part")))
    return rows.groupBy("row_id").agg(F.flatten(F.transform(parts, lambda x: x["part"])).alias("members"))


def creation_rows(vertices: DataFrame, creations: DataFrame) -> DataFrame:
    """``(id, members)``: each vertex's id and after it the targets that it created, in order, repeats included.

    ``vertices`` has ``id``, ``creations`` is as for ``creator_merge``.  A vertex without creations is alone in its
    row; null ids have no row, repeated ones one.
    """
    ids = vertices.select("id").filter("id IS NOT NULL").distinct()
    made = creations.join(ids, creations["src"] == ids["id"], "left_semi").groupBy(F.col("src").alias("id"))
    made = made.agg(F.sort_array(F.collect_list(F.struct("rank", "dst"))).alias("made"))
    targets = F.coalesce(F.transform("made", lambda x: x["dst"]), F.array().cast("array<string>"))
    return ids.join(made, "id", "left").select("id", F.concat(F.array("id"), targets).alias("members"))


def name_families(names: DataFrame, suffix: str = ".bnb") -> DataFrame:
    """``(prefix, row_id, name)``: names that differ in their last digit only.

    Without the suffix a name needs more than four characters, a digit at the end, and before it not only digits;
    a prefix needs at least two last digits.  All rows of such a prefix come out, repeated ones too; null names do not.
    """
    bare = F.replace(F.col("name"), F.lit(suffix), F.lit(""))
    rows = names.select("row_id", "name", bare.alias("bare")).filter("length(bare) > 4 AND bare RLIKE '[0-9]$'")
    rows = rows.select("row_id", "name", F.expr("substring(bare, 1, length(bare) - 1)").alias("prefix"), F.expr("substring(bare, -1, 1)").alias("digit"))
    rows = rows.filter("NOT prefix RLIKE '^[0-9]+$'")
    family = rows.groupBy("prefix").agg(F.count_distinct("digit").alias("n")).filter("n >= 2").select("prefix")
    return split_join(rows, family, ["prefix"], "left_semi").select("prefix", "row_id", "name")


def family_merge(clusters: DataFrame, families: DataFrame) -> DataFrame:
    """``(row_id, members)``: the rows of a family become one, at the smallest of their ids; a row in two families
    joins both.  Members keep their first place; other rows stay as they are, also those without members.  Row ids that
    are in no cluster unite the others of their family nevertheless."""
    rows = families.select("prefix", "row_id").distinct()
    low = rows.groupBy("prefix").agg(F.min("row_id").alias("low"))
    linked = connected_components(split_join(rows, low, ["prefix"]), "row_id", "low")
    return _united(clusters, linked)


def entity_merge(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """``(row_id, members)``: rows that hold addresses of one entity become one, transitively.

    ``entities`` has ``entity`` and ``address``.  The merged row is at the smallest of the ids.
    """
    at = clusters.select("row_id", F.explode("members").alias("address")).join(entities.select("entity", "address").distinct(), "address").select("entity", "row_id").distinct()
    low = at.groupBy("entity").agg(F.min("row_id").alias("low"))
    linked = connected_components(split_join(at, low, ["entity"]), "row_id", "low")
    return _united(clusters, linked)


def _united(clusters: DataFrame, linked: DataFrame) -> DataFrame:
    rows = clusters.join(linked.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("to", F.coalesce("component", "row_id"))
    parts = F.sort_array(F.collect_list(F.struct("row_id", "members")))
    merged = rows.groupBy("to").agg(F.array_distinct(F.flatten(F.transform(parts, lambda x: x["members"]))).alias("all"), F.count(F.lit(1)).alias("n"), F.first("members").alias("own"))
    return merged.select(F.col("to").alias("row_id"), F.when(F.col("n") > 1, F.col("all")).otherwise(F.col("own")).alias("members"))


def drop_singletons(clusters: DataFrame) -> DataFrame:
    """Clusters of two or more members, repeats counted; null members are none."""
    return clusters.filter("size(members) >= 2")


def label_lookup(addresses: DataFrame, labels: DataFrame) -> DataFrame:
    """``(address, name)``: names of addresses; the last label of an address counts, empty ones do not.

    ``labels`` has ``address``, ``name`` and ``position``; of labels at one position the largest name counts.
    """
    known = labels.filter("name <> ''").groupBy("address").agg(F.max_by("name", F.struct("position", "name")).alias("name"))
    return addresses.select("address").distinct().join(known, "address")


def normalised_names(labels: DataFrame) -> DataFrame:
    """``(address, name, entity)`` of every row, with the entity taken from the name; null of a null name."""
    return labels.select("address", "name", entity_name(F.col("name")).alias("entity"))


def entity_addresses(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """``(entity, address)`` from ``entities(entity, name)`` and ``labels(address, name, position)``; of several
    addresses with one name the last counts, and of those at one position the largest."""
    by_name = labels.filter("name <> ''").groupBy("name").agg(F.max_by("address", F.struct("position", "address")).alias("address"))
    return entities.select("entity", "name").distinct().join(by_name, "name").select("entity", "address")


def majority_choice(votes: DataFrame) -> DataFrame:
    """``(question, choice, n)``: the most frequent choice of each question; ties go to the smaller choice, null being
    the smallest.  Null is a question like others."""
    counted = votes.groupBy("question", "choice").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("question").orderBy(F.desc("n"), "choice")
    return counted.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
