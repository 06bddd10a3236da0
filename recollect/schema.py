"""Schemas of the store's tables, and their additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "array<long>": T.ArrayType(T.LongType()), "array<float>": T.ArrayType(T.FloatType())}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


MEMORIES = _schema(
    "id long, type string, title string, title_norm string, body string, tags array<string>, links array<long>, created_at timestamp, updated_at timestamp, "
    "device_id string, embedding array<float>, author string, valid_from timestamp, valid_to timestamp, superseded_by long"
)
EDGES = _schema("src long, dst long, kind string, weight double, updated_at timestamp")
SESSIONS = _schema("session_id string, memory_id long, activation double, updated_at timestamp")
DISMISSED = _schema("src long, dst long")
META = _schema("key string, value string")
TABLES = {"memories": MEMORIES, "edges": EDGES, "session_members": SESSIONS, "dismissed": DISMISSED, "meta": META}
EXPORT = _schema("id long, type string, title string, body string, tags string, links array<long>, created_at string, updated_at string, device_id string, author string")
OPS = _schema("seq long, type string, title string, body string, tags array<string>, links array<long>, at timestamp, device_id string, author string, embedding array<float>")


def migrate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring a table of an older layout to ``schema``: missing columns are added as null, others dropped; a missing
    start of validity becomes the creation time."""
    have = {f.name for f in df.schema}
    out = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    if "valid_from" in schema.names and "created_at" in schema.names:
        out = out.withColumn("valid_from", F.coalesce("valid_from", "created_at"))
    return out
