"""Project files: one JSON document with a list of zones, read to flat rows and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "struct<zone_id:string,page:int,tag:string,bbox:array<double>,text:string,parent_id:string,level:int,serial:int,attributes:map<string,string>>"
SCHEMA = f"schema_version int, pdf_path string, page_count int, zones array<{ZONE}>, settings map<string,string>"


def load_project(spark: SparkSession, path: str) -> DataFrame:
    """(project_file, zone columns, x0..y1) of every zone of the project files under ``path``; a broken file gives no rows."""
    raw = spark.read.schema(SCHEMA + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("project_file", F.input_file_name())
    z = raw.where("zones is not null").select("project_file", F.posexplode("zones").alias("created_order", "z"))
    box = [F.get("z.bbox", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    return z.select("project_file", "created_order", "z.zone_id", "z.page", "z.tag", "z.text", "z.parent_id", "z.level", "z.serial", F.coalesce("z.attributes", F.create_map().cast("map<string,string>")).alias("attributes"), *box)


def project_documents(zones: DataFrame) -> DataFrame:
    """Zones (with doc_id and boxes) -> one project row for each document."""
    z = F.struct("zone_id", "page", "tag", F.array("x0", "y0", "x1", "y1").alias("bbox"), "text", "parent_id", "level", "serial", "attributes")
    rows = zones.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("created_order", "zone_id"))).alias("_o"), F.map_from_entries(F.collect_list(F.struct("zone_id", z.alias("z")))).alias("_m"), F.max("page").alias("page_count"))
    return rows.select("doc_id", F.lit(1).alias("schema_version"), "page_count", F.transform("_o", lambda o: F.element_at("_m", o.zone_id)).alias("zones"))


def save_project(zones: DataFrame, path: str) -> None:
    """One JSON object a line, partitioned by document bucket; Spark's committer makes the write atomic."""
    project_documents(zones).withColumn("bucket", F.pmod("doc_id", F.lit(64))).write.mode("overwrite").partitionBy("bucket").json(path)
