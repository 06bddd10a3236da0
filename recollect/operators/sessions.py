"""Sessions: gaps, decayed activation, and the edges that use together leaves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..sources.ship import ship


def gap_sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """(key, session, start_at, end_at, n_events): a pause longer than the gap begins a new session; one of just the
    gap does not. events: key, ts."""
    order = Window.partitionBy("key").orderBy("ts")
    pause = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    marked = events.withColumn("new", F.when(pause.isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0)).withColumn("session", F.sum("new").over(order))
    return marked.groupBy("key", "session").agg(F.min("ts").alias("start_at"), F.max("ts").alias("end_at"), F.count(F.lit(1)).alias("n_events"))


def session_activation_no_ttl(touches: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(session_id, memory_id, activation) without the removal of small residues, in closed form.

    touches: session_id, touch (1, 2, ...), rank (from 0), memory_id.
    """
    last = touches.groupBy("session_id").agg(F.max("touch").alias("last"))
    bump = F.pow(F.lit(config.hebbian_bump_decay), F.col("rank").cast("double"))
    kept = touches.withColumn("bump", bump).where(F.col("bump") >= config.session_ttl_activation).join(last, "session_id")
    return kept.groupBy("session_id", "memory_id").agg(F.sum(F.col("bump") * F.pow(F.lit(config.session_decay), (F.col("last") - F.col("touch")).cast("double"))).alias("activation"))


def fold_touch(state: dict[int, float], touch: list[int], config: EngineConfig) -> tuple[dict[int, float], list[tuple[int, int]]]:
    """Activation after one more touch, and the pairs that were active together.

    A touch halves what is there, adds 0.5^rank along its list while that is large enough, pairs the most active
    members above the floor, and drops small residues.
    """
    state = {m: a * config.session_decay for m, a in state.items()}
    for rank, m in enumerate(touch):
        bump = config.hebbian_bump_decay**rank
        if bump < config.session_ttl_activation:
            break
        state[m] = state.get(m, 0.0) + bump
    active = sorted((m for m, a in state.items() if a >= config.hebbian_wire_floor), key=lambda m: (-state[m], m))[: config.hebbian_top_m]
    pairs = [(min(a, b), max(a, b)) for i, a in enumerate(active) for b in active[i + 1 :]]
    return {m: a for m, a in state.items() if a >= config.session_ttl_activation}, pairs


def fold_session(state: dict[int, float], touches: list[list[int]], config: EngineConfig) -> tuple[dict[int, float], dict[tuple[int, int], int]]:
    """Activation after a session's touches in order, and how often each pair was active together."""
    state, times = dict(state), {}
    for touch in touches:
        state, pairs = fold_touch(state, touch, config)
        for pair in pairs:
            times[pair] = times.get(pair, 0) + 1
    return state, times


FOLDED = "session_id string, kind string, a long, b long, value double"


def touch_sessions(touches: DataFrame, members: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Fold every session's touches in order: rows (session_id, "member", memory_id, null, activation) and
    (session_id, "pair", a, b, times).

    touches: session_id, touch, rank, memory_id; members: the activation before, if any. A session's rows come to one
    task, sorted, and are folded touch by touch: the state is bounded by what a touch can add and the removal of residues,
    and counts of pairs are passed on in portions, which are summed at the end.
    """
    ship(touches.sparkSession)
    rows = touches.select(F.col("session_id").cast("string").alias("session_id"), F.col("touch").cast("long").alias("touch"), F.col("rank").cast("long").alias("rank"), F.col("memory_id").cast("long").alias("memory_id"), F.lit(None).cast("double").alias("activation"))
    # ranks beyond the last bump leave no trace, so they need not travel
    last = 0
    while config.hebbian_bump_decay**last >= config.session_ttl_activation and last < 10_000:
        last += 1
    rows = rows.where(F.col("rank") < max(last, 1))
    if members is not None:
        rows = rows.unionByName(members.select(F.col("session_id").cast("string").alias("session_id"), F.lit(-1).cast("long").alias("touch"), F.lit(0).cast("long").alias("rank"), "memory_id", "activation"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state, times, last, own = None, {}, {}, None, []
        out: list[tuple] = []

        def fold_own() -> None:
            nonlocal state
            if own:
                state, pairs = fold_touch(state, own, config)
                for pair in pairs:
                    times[pair] = times.get(pair, 0) + 1
                own.clear()

        def pass_on() -> None:
            out.extend((session, "pair", a, b, float(n)) for (a, b), n in times.items())
            times.clear()

        for batch in batches:
            for s, touch, _, m, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != session or touch != last:
                    fold_own()
                if s != session:
                    pass_on()
                    out.extend((session, "member", x, None, v) for x, v in state.items())
                    session, state = s, {}
                last = touch
                if touch < 0:
                    state[m] = a
                else:
                    own.append(m)
                if len(times) > 50_000:
                    pass_on()
                if len(out) > 50_000:
                    yield _folded(out)
                    out = []
        fold_own()
        pass_on()
        out.extend((session, "member", x, None, v) for x, v in state.items())
        if out:
            yield _folded(out)

    dealt = rows.where("session_id is not null").repartition("session_id").sortWithinPartitions("session_id", "touch", "rank", "memory_id")
    return dealt.mapInArrow(fold, FOLDED).groupBy("session_id", "kind", "a", "b").agg(F.sum("value").alias("value"))


def _folded(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["session_id", "kind", "a", "b", "value"])


def learned_edges(folded: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(src, dst, weight): increments of all sessions together, up to the cap."""
    pairs = folded.where("kind = 'pair'").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("value").alias("n"))
    return pairs.select("src", "dst", F.least(F.lit(config.hebbian_cap), F.col("n") * config.hebbian_increment).alias("weight"))


def sweep_stale(members: DataFrame, now, horizon_seconds: int = 86400) -> DataFrame:
    """Members that were touched within the horizon."""
    return members.where(F.unix_micros("updated_at") >= F.unix_micros(now) - horizon_seconds * 1_000_000)


def unprime(members: DataFrame, ids: DataFrame) -> DataFrame:
    """Members without the rows of ``ids`` (id)."""
    return members.join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_anti").select(*members.columns)


def primed(seeds: DataFrame, members: DataFrame, sessions: DataFrame, memories: DataFrame, config: EngineConfig = EngineConfig(), types: DataFrame | None = None) -> DataFrame:
    """(query_id, id, activation): seed scores plus a share of the session's activation. sessions: query_id, session_id.

    types: (query_id, type), null for any; a query's type holds for primed rows as well, and only current ones are primed.
    """
    valid = memories.where("valid_to is null").select(F.col("id").alias("memory_id"), "type")
    active = sessions.join(members, "session_id").join(valid, "memory_id")
    if types is not None:
        active = active.join(types.select("query_id", F.col("type").alias("wanted")), "query_id").where("wanted is null or wanted = type")
    active = active.select("query_id", F.col("memory_id").alias("id"), (F.col("activation") * config.priming_weight).alias("activation"))
    both = seeds.select("query_id", "id", F.col("score").alias("activation")).unionByName(active)
    return both.groupBy("query_id", "id").agg(F.sum("activation").alias("activation"))
