"""The index shown at the start of a session, and the retention sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.scoring import age_days
from ..functions.text import index_line
from ..sources.tables import cut_lineage
from .graph import degrees

EMPTY = "(no memories yet)"
LOAD_BEARING, RECENT = "# Load-bearing", "# Recent"


def _newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("updated_at"), F.desc("id")).limit(n)


def boot_index(memories: DataFrame, edges: DataFrame | None = None, cap: int = 50) -> DataFrame:
    """(section, place, id, line), at most ``cap`` rows in order of section and place.

    Up to the cap all rows, the newest first. Beyond it, with a graph: a quarter of the places, one at least, is for the
    newest; the others go to the rows of most use outside of these, and what they leave again to the newest. Sections
    are "hub" and "recent" where there are hubs, else "all". Only cap rows are ever sorted whole.
    """
    now = memories.where("valid_to is null").select("id", "type", "title", "updated_at")
    line = index_line(F.col("type"), F.col("id"), F.col("title"))
    placed = lambda df, section, *order: df.withColumn("section", F.lit(section)).withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*order))).select("section", "place", "id", line.alias("line"))
    late = (F.desc("updated_at"), F.desc("id"))
    if edges is None or now.limit(cap + 1).count() <= cap:
        return placed(_newest(now, cap), "all", *late)
    reserve = _newest(now, max(1, cap // 4)).select("id", F.lit(True).alias("reserved"))
    rows = now.join(degrees(edges, memories), "id").join(F.broadcast(reserve), "id", "left")
    by_use = (F.desc(F.round("degree", 9)), *late)
    hubs = cut_lineage(rows.where("degree > 0 and reserved is null").orderBy(*by_use).limit(cap - max(1, cap // 4)), "hubs")
    n_hubs = hubs.count()
    if not n_hubs:
        return placed(_newest(now, cap), "all", *late)
    rest = _newest(now.join(F.broadcast(hubs.select("id")), "id", "left_anti"), cap - n_hubs)
    return placed(hubs, "hub", *by_use).unionByName(placed(rest, "recent", *late))


def index_text(index: DataFrame) -> str:
    """The index as text, with headers where it has hubs. It has a bounded number of rows."""
    rows = sorted(index.collect(), key=lambda r: ({"hub": 0}.get(r.section, 1), r.place))
    if not rows:
        return EMPTY
    out, section = [], None
    for r in rows:
        if r.section != section:
            section = r.section
            out += {"hub": [LOAD_BEARING], "recent": [RECENT]}.get(section, [])
        out.append(r.line)
    return "\n".join(out)


def sweep_candidates(memories: DataFrame, edges: DataFrame, now, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(id): what a sweep archives: the oldest rows, so many at most, that are past the age and without any edge of use.

    It does nothing unless it is enabled, some row is in use, and there are twice as many rows as the index shows.
    """
    live = degrees(edges, memories)
    gate = live.agg(F.count(F.lit(1)).alias("n"), F.max("degree").alias("most"))
    rows = memories.where("valid_to is null").join(live, "id").where(F.col("degree") == 0).where(age_days(F.col("updated_at"), now) > config.forget_age_days)
    if not config.forget:
        rows = rows.limit(0)
    open_ = rows.join(F.broadcast(gate)).where((F.col("n") >= 2 * config.boot_index_cap) & (F.col("most") > 0))
    return open_.orderBy("updated_at", "id").limit(config.forget_max_per_sweep).select("id")
