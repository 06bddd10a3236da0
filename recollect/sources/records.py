"""Export and import of records as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TYPES
from ..functions.text import norm_title, tags_to_str
from ..schema import EXPORT


def export_records(memories: DataFrame) -> DataFrame:
    """The current rows in the form of an export: ten columns without vectors, tags as a comma list."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c)
    return memories.where("valid_to is null").select("id", "type", "title", "body", tags_to_str(F.col("tags")).alias("tags"), F.coalesce("links", F.array().cast("array<long>")).alias("links"), iso("created_at"), iso("updated_at"), "device_id", "author")


def write_export(memories: DataFrame, path: str) -> None:
    export_records(memories).orderBy("id").write.mode("overwrite").json(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Records of an export, as lines or as one JSON list; what is no record comes as nulls."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    one_list = first is not None and first.value.lstrip().startswith("[")
    return spark.read.schema(EXPORT).option("multiLine", str(one_list).lower()).json(path)


def usable(records: DataFrame) -> DataFrame:
    """Records that can be imported: of a known type and with a title that is not blank."""
    return records.where(F.col("type").isin(*TYPES) & (norm_title(F.coalesce("title", F.lit(""))) != ""))


def remapped_links(records: DataFrame, id_map: DataFrame) -> DataFrame:
    """(id, other): links of imported records with new ids at both ends; unresolvable ones, a row's link with itself and
    repeated ones are left out. id_map: old_id, id."""
    pairs = records.select(F.col("id").alias("old_a"), F.explode("links").alias("old_b"))
    a, b = id_map.select(F.col("old_id").alias("old_a"), F.col("id").alias("id")), id_map.select(F.col("old_id").alias("old_b"), F.col("id").alias("other"))
    return pairs.join(a, "old_a").join(b, "old_b").where("id <> other").select("id", "other").distinct()
