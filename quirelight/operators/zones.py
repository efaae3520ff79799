"""Edits of a zone table, each a table-to-table transform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.operators.hierarchy import hierarchy, zone_nodes
from quirelight.runtime import staged


def delete_cascade(zones: DataFrame, ids: DataFrame) -> DataFrame:
    """Zones without the given ones (zone_id) and all below them; zones on circles go with any member."""
    nodes = staged(zone_nodes(zones), "nodes")
    gone = ids.select(F.lower(F.trim("zone_id")).alias("id")).distinct()
    # cutting the links above the deleted zones makes each of them the root of what goes
    cut = nodes.join(gone.withColumn("_g", F.lit(True)), "id", "left").select("id", "doc_id", F.when(F.col("_g"), F.lit(None)).otherwise(F.col("parent")).alias("parent"))
    below = hierarchy(cut, "doc_id").join(gone.withColumnRenamed("id", "root"), "root", "left_semi").select("id")
    return zones.join(below.select(F.col("id").alias("_id")), F.lower(F.trim("zone_id")) == F.col("_id"), "left_anti")


def set_parent(zones: DataFrame, moves: DataFrame) -> DataFrame:
    """(zone_id, new_parent, accepted): each move (zone_id, new_parent) for itself; one that would close a circle is refused.

    It would if the new parent is the zone or lies below it, that is if the zone is on
    the new parent's path; a parent on or below a circle is refused too.
    """
    nodes = staged(zone_nodes(zones), "nodes")
    m = moves.select(F.lower(F.trim("zone_id")).alias("id"), F.lower(F.trim("new_parent")).alias("to"), "zone_id", "new_parent")
    paths = hierarchy(nodes.select("id", "parent", "doc_id"), "doc_id", with_path=True).select(F.col("id").alias("to"), "path")
    return m.join(paths, "to", "left").select("zone_id", "new_parent", F.coalesce(~F.array_contains("path", F.col("id")), F.lit(False)).alias("accepted"))


def levels(zones: DataFrame) -> DataFrame:
    """(zone_id, level): every zone's level set to its depth; null on or below a circle."""
    nodes = staged(zone_nodes(zones), "nodes")
    h = hierarchy(nodes.select("id", "parent", "doc_id"), "doc_id")
    return nodes.select("id", "zone_id").join(h, "id").select("zone_id", F.when(F.col("depth") >= 0, F.col("depth")).alias("level"))


def merge_chains(links: DataFrame) -> DataFrame:
    """links (zone_id, merge_target) -> (zone_id, chain): the zone that each chain of merges begins with."""
    nodes = links.select(F.col("zone_id").alias("id"), F.col("merge_target").alias("parent"))
    return hierarchy(nodes).select(F.col("id").alias("zone_id"), F.col("root").alias("chain"))
