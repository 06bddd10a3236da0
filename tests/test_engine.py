"""The store's verbs end to end, recall with receipts, streams, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from recollect.cli import main
from recollect.config import EngineConfig
from recollect.engine import Engine
from recollect.operators import sessions
from recollect.plans.adapters import at
from recollect.sources.records import read_export
from recollect.streaming.sessions import stream_gap_sessions, stream_touches

AXES = [["car", "truck", "engine"], ["soup", "bread"], ["python", "compiler"]]


def embedder():
    axes = AXES  # held by the function itself: workers do not import this module

    def embed(texts):
        return [[float(sum(w in t.lower() for w in axis)) for axis in axes] for t in texts]

    return embed


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store", EngineConfig(recall_budget=2), embedder())


def test_remember_recall_and_learning(spark, engine):
    made = engine.remember([
        {"type": "project", "title": "Garage", "body": "the truck engine needs work", "tags": "home, car"},
        {"type": "project", "title": "Lunch", "body": "bread with soup"},
        {"type": "user", "title": "Tools", "body": "compiler notes about python", "links": [1]},
        {"type": "reference", "title": "Rules of the garage", "body": "keep it clean", "sources": [1, 2]},
    ])
    ids = {r.title_norm: r.id for r in made.collect()}
    assert sorted(ids.values()) == [1, 2, 3, 4]
    kinds = {(r.src, r.dst, r.kind) for r in engine.tables()["edges"].collect()}
    assert {(1, 3, "explicit"), (4, 1, "crystallized"), (4, 2, "crystallized")} <= kinds
    hits = engine.recall(ask(spark, "automobile engine", "car"))
    rows = hits.where("query_id = 1").orderBy("rank").collect()
    assert rows[0].id == 1 and rows[0].via.seed  # found by meaning: the word itself is not there
    walked = {r.id: r.via for r in rows if r.via.path}
    assert walked[3].path[0]["from"] == 1 and walked[3].hops == 1
    before = engine.tables()["edges"].count()
    asked = spark.createDataFrame([(0, "s"), (1, "s")], "query_id long, session_id string")
    engine.learn(hits.where("query_id = 1").withColumn("in_head", F.lit(True)), asked)
    t = engine.tables()
    assert t["edges"].count() > before and t["session_members"].where("session_id = 's'").count() >= 2
    assert engine.remember([{"type": "project", "title": " garage ", "body": "sold"}]).first().action == "updated"
    assert engine.get(1).body == "sold" and engine.status()["memories"] == 4
    assert engine.memory_index().count("\n") == 3
    with pytest.raises(ValueError):
        engine.remember([{"type": "x", "title": "t", "body": ""}])


def test_forget_restore_purge_link(spark, engine):
    engine.remember([{"type": "user", "title": t, "body": t} for t in ("a", "b")])
    engine.link(1, 2)
    assert engine.get(1).links == [2] and engine.get(2).links == [1]
    with pytest.raises(ValueError):
        engine.link(1, 9)
    assert engine.forget(1) and not engine.forget(1) and engine.get(1) is None
    assert engine.restore(1) == "restored" and engine.restore(1) == "current" and engine.restore(77) == "missing"
    engine.forget(1)
    engine.remember([{"type": "user", "title": "A", "body": "again"}])
    with pytest.raises(ValueError):
        engine.restore(1)
    assert engine.purge(1) and not engine.purge(1)
    assert engine.tables()["memories"].count() == 2 and engine.tables()["edges"].where("src = 1 or dst = 1").isEmpty()
    assert engine.dismiss_cluster(5, 4) and engine.tables()["dismissed"].first().src == 4


def test_versions_are_whole(spark, engine):
    assert engine.snapshots.version() is None and engine.status()["memories"] == 0
    engine.remember([{"type": "user", "title": "a", "body": "x"}])
    first, old = engine.snapshots.version(), engine.tables()["memories"]
    engine.remember([{"type": "user", "title": "b", "body": "x"}])
    assert engine.snapshots.version() != first and old.count() == 1


def test_two_writers_and_lost_lists(spark, engine, tmp_path):
    """Of two writers from one version the later fails, and tables without a list of versions are no new store."""
    engine.remember([{"type": "user", "title": "a", "body": "x"}])
    seen = engine.snapshots._current()
    engine.remember([{"type": "user", "title": "b", "body": "x"}])
    late = Engine(spark, engine.snapshots.path, engine.config)
    late.snapshots._current = lambda: seen
    with pytest.raises(RuntimeError, match="another writer"):
        late.snapshots.write({})
    assert engine.status()["memories"] == 2
    (tmp_path / "store" / "versions").rename(tmp_path / "away")
    with pytest.raises(RuntimeError, match="no list of versions"):
        engine.tables()


def test_backfill_by_model(spark, engine):
    engine.embedder, embed = None, engine.embedder
    engine.remember([{"type": "project", "title": t, "body": b} for t, b in (("a", "car"), ("b", "truck car"), ("c", "soup"))])
    assert engine.backfill("m") == 0 and engine.tables()["edges"].isEmpty()
    engine.embedder = embed
    assert engine.backfill("m") == 3 and engine.backfill("m") == 0
    assert {(r.src, r.dst) for r in engine.tables()["edges"].where("kind = 'semantic'").collect()} == {(1, 2)}
    assert engine.backfill("another") == 3
    engine.embedder = lambda texts: [[1.0, 0.0] for _ in texts]  # as many dimensions no longer
    assert engine.backfill("another") == 3 and {len(r.embedding) for r in engine.tables()["memories"].collect()} == {2}


def test_sessions_are_inherited_within_the_gap(spark, engine):
    first = engine.resolve_session(now="2024-01-01 10:00:00")
    assert engine.resolve_session(now="2024-01-01 10:30:00") == first  # just the gap
    assert engine.resolve_session("mine", now="2024-01-01 10:31:00") == "mine"
    assert engine.resolve_session(now="2024-01-01 10:40:00") == "mine"
    assert engine.resolve_session(now="2024-01-01 11:10:01") not in (first, "mine")
    assert Engine(spark, engine.snapshots.path, engine.config).resolve_session(now="2024-01-01 11:10:02") != engine.resolve_session(now="2024-01-01 11:10:02")


def test_candidates_are_found_again_only_after_a_change(spark, engine):
    engine.remember([{"type": "user", "title": f"t{i}", "body": "soup", "links": [i - 1] if i > 1 else []} for i in range(1, 4)])
    found = engine.crystallization()
    assert [(r.peak_src, r.peak_dst) for r in found.collect()] == [(1, 2)] and engine.crystallization() is found
    engine.dismiss_cluster(2, 1)
    assert engine.crystallization() is not found and engine.crystallization().isEmpty()


def test_recall_with_tags_limit_and_budget(spark, engine):
    engine.remember([{"type": "user" if i % 2 else "project", "title": f"t{i}", "body": "soup" if i < 6 else "x", "tags": "k" if i % 3 == 0 else "", "links": [i - 1] if i > 1 else []} for i in range(1, 12)])
    q = spark.createDataFrame([(0, " ", ["k"], "user"), (1, "", [], None), (2, "soup", [], None)], "query_id long, text string, tags array<string>, type string")
    rows = engine.recall(q, budget=8).collect()
    assert [r.id for r in sorted((r for r in rows if r.query_id == 0), key=lambda r: r.rank)] == [9, 3]
    assert not [r for r in rows if r.query_id == 1] and any(r.via.path for r in rows if r.query_id == 2)
    few = engine.recall(q, limit=2, budget=0).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2), (2, 1), (2, 2)] and not any(r.via and r.via.path for r in few)


def test_command_line(spark, tmp_path, capsys):
    store, out = f"file://{tmp_path}/a", f"{tmp_path}/out"
    Engine(spark, store).remember([{"type": "user", "title": "one", "body": "1", "tags": "t"}, {"type": "project", "title": "two", "body": "2"}])
    assert main(["--store", store, "export", out], spark) == 0
    other = f"file://{tmp_path}/b"
    assert main(["--store", other, "import", out], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["created"] == 2
    assert main(["--store", other, "restore", "1"], spark) == 0 and main(["--store", other, "restore", "9"], spark) == 1
    assert main(["--store", other, "purge", "1"], spark) == 1 and main(["--store", other, "purge", "1", "--yes"], spark) == 0


def test_import_of_odd_records(spark, engine, tmp_path):
    engine.remember([{"type": "user", "title": "kept", "body": ""}])
    path = f"{tmp_path}/in.json"
    with open(path, "w") as f:
        json.dump([{"id": 1, "type": "project", "title": "good", "body": "b", "links": [4, 999]}, {"id": 2, "type": "odd", "title": "x", "body": ""}, {"id": 3, "type": "user", "title": "  ", "body": ""}, {"id": 4, "type": "user", "title": "Kept", "body": "new"}], f)
    told = engine.import_records(read_export(spark, path))
    assert told == {"created": 1, "updated": 1, "skipped": 2, "linked": 1, "dropped_links": 1}
    assert engine.get(2).links == [1] and engine.get(1).body == "new"


def _stream(spark, df, path):
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_streamed_touches_are_as_a_batch(spark, tmp_path):
    rows = [("s", t, r, (t * 3 + r * r) % 7) for t in (1, 2, 3) for r in range(4)] + [("u", 1, 0, 5), ("u", 1, 1, 6)]
    df = spark.createDataFrame(rows, "session_id string, touch long, rank long, memory_id long")
    got = {}
    keep = lambda folded, number: got.update({number: sorted((r.session_id, r.kind, r.a, r.b or 0, r.value) for r in folded.collect())})
    path = f"{tmp_path}/t"
    df.where("touch < 3").coalesce(1).write.parquet(f"{path}/a")
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(path)
    for part in ("b", None):
        q = stream_touches(source, f"{tmp_path}/state", keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        if part:
            df.where("touch = 3").coalesce(1).write.parquet(f"{path}/{part}")
    key = lambda d: sorted((r.session_id, r.kind, r.a, r.b or 0, r.value) for r in d.collect())
    assert got[0] == key(sessions.touch_sessions(df.where("touch < 3")))
    whole = [x for x in key(sessions.touch_sessions(df)) if x[0] == "s" and x[1] == "member"]
    assert [x for x in got[1] if x[1] == "member"] == whole


def test_streamed_gaps_are_as_a_batch(spark, tmp_path):
    e = spark.createDataFrame([("u", 0), ("u", 1800), ("u", 3601), ("v", 5), ("z", 90000)], "key string, s long").select("key", at(F.col("s")).alias("ts"))
    q = stream_gap_sessions(_stream(spark, e, f"{tmp_path}/e")).writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.key, r.start_at, r.end_at, r.n_events) for r in spark.table("gaps").collect())
    want = sorted((r.key, r.start_at, r.end_at, r.n_events) for r in sessions.gap_sessions(e).where("key <> 'z'").collect())
    assert got == want
