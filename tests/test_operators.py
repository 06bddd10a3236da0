"""Small fixtures with results worked out by hand, and models in plain Python."""

import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from recollect import evalkit
from recollect.config import EngineConfig
from recollect.functions import scoring, text
from recollect.operators import cluster, fts, fusion, graph, index, recall, sessions, store, vectors
from recollect.plans.adapters import at
from recollect.schema import MEMORIES, migrate

NO = EngineConfig()


def mem(spark, rows):
    """Rows of dicts as memories; what is missing gets plain values."""
    full = [{"id": i, "type": "project", "title": f"t{i}", "body": "", "tags": [], "links": [], "s": i, "to": None, "embedding": None, **r} for i, r in ((r["id"], r) for r in rows)]
    df = spark.createDataFrame([(r["id"], r["type"], r["title"], r["body"], r["tags"], r["links"], r["s"], r["to"], r["embedding"]) for r in full], "id long, type string, title string, body string, tags array<string>, links array<long>, s long, `to` long, embedding array<float>")
    return migrate(df.withColumns({"title_norm": text.norm_title(F.col("title")), "created_at": at(F.col("s")), "updated_at": at(F.col("s")), "valid_to": F.when(F.col("to").isNotNull(), at(F.col("to")))}), MEMORIES)


def edge(spark, rows):
    return spark.createDataFrame([(a, b, k, float(w)) for a, b, k, w in rows], "src long, dst long, kind string, weight double").withColumn("updated_at", at(0))


def one(df, c):
    return df.select(c.alias("x")).first().x


def test_text_functions(spark):
    d = spark.createDataFrame([("  Prefers\t TDD \n", " a, b ,,c , ")], "t string, g string")
    assert one(d, text.norm_title(F.col("t"))) == "prefers tdd"
    assert one(d, text.parse_tags(F.col("g"))) == ["a", "b", "c"]
    assert one(d, text.has_tags(F.array(F.lit("p:x2")), F.array(F.lit("p:x")))) is False
    assert one(d, text.tokens(F.lit("Füße, naïve_Ñ-42 œ"))) == ["fuße", "naive", "n", "42", "œ"]
    assert one(d, text.phrases(F.lit(' pool-ceiling -- "x" '))) == [["pool", "ceiling"], ["x"]]
    assert one(d, scoring.l2_normalised(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(d, scoring.is_zero(F.array(F.lit(0.0)))) is True
    assert [one(d, scoring.decay_factor(F.lit(a), 30)) for a in (0.0, 30.0, 60.0)] == [1.0, 0.5, 0.25]
    assert one(d, scoring.keyword_axes(F.lit("car and truck"), [["car", "truck"], ["soup"]])) == [1.0, 0.0]


def plain_excerpt(body, query, width=500, snap=40):
    if width <= 0 or len(body) <= width:
        return body
    import re

    low = body.lower()
    found = [low.find(w) for w in re.split(r"\W+", query.lower()) if len(w) >= 3 and w in low]
    if not found:
        return body[:width].rstrip() + "…"
    start = max(0, min(found) - width // 2)
    end = min(len(body), start + width)
    start = max(0, end - width)
    if start > 0 and (p := body.find(" ", start, start + snap)) >= 0:
        start = p + 1
    if end < len(body) and (p := body.rfind(" ", max(start, end - snap), end)) >= 0:
        end = p
    return ("…" if start else "") + body[start:end].strip() + ("…" if end < len(body) else "")


def test_excerpts_as_the_model(spark):
    draw = random.Random(1)
    words = ["alpha", "beta", "x", "longerword", "needle", "of"]
    rows = []
    for i in range(60):
        body = " ".join(draw.choice(words[:4]) for _ in range(draw.randint(1, 60)))
        if draw.random() < 0.7:
            k = draw.randint(0, len(body))
            body = body[:k] + draw.choice([" needle ", "needle"]) + body[k:]
        rows.append((i, body, draw.choice(["needle", "of needle", "zzz", "a b"])))
    for width in (0, 40, 100):
        got = {r.i: r.e for r in spark.createDataFrame(rows, "i int, b string, q string").select("i", text.excerpt(F.col("b"), F.col("q"), width, 10).alias("e")).collect()}
        for i, body, q in rows:
            assert got[i] == plain_excerpt(body, q, width, 10)
            assert not width or len(got[i]) <= width + 2


def test_bm25_as_sqlite(spark):
    draw = random.Random(5)
    words = "login logins pool ceiling fast slow db cache über naïve x1".split()
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 4))), "-".join(draw.choice(words) for _ in range(draw.randint(0, 15))), draw.choice(words)) for i in range(1, 41)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, body, tags)")
    con.executemany("insert into f(rowid, title, body, tags) values (?, ?, ?, ?)", rows)
    asked = ["login", "pool ceiling", "pool-ceiling", "uber fast", "db db", "x1 -- cache", "nothere", "AND slow", "login-fast-db"]
    m = mem(spark, [{"id": i, "title": t, "body": b, "tags": [g]} for i, t, b, g in rows])
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {}
    for r in fts.bm25(m, q).collect():
        got.setdefault(r.query_id, {})[r.id] = r.score
    for n, a in enumerate(asked):
        match = " ".join('"' + w.replace('"', '""') + '"' for w in a.split())
        want = dict(con.execute("select rowid, -bm25(f) from f where f match ?", (match,)).fetchall())
        assert got.get(n, {}).keys() == want.keys(), a
        for i, s in want.items():
            assert math.isclose(got[n][i], s, rel_tol=1e-9, abs_tol=1e-12)


def test_search_filters_validity_and_type(spark):
    m = mem(spark, [{"id": 1, "body": "word one", "s": 5}, {"id": 2, "body": "word one", "s": 9}, {"id": 3, "body": "word one", "to": 7}, {"id": 4, "body": "word one", "type": "user"}, *({"id": i, "body": "other"} for i in range(5, 12))])
    q = spark.createDataFrame([(1, "word", None), (2, "word", "user"), (3, " -- ", None)], "query_id long, text string, type string")
    got = [(r.query_id, r.id) for r in fts.search(m, q).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2), (1, 1), (1, 4), (2, 4)]  # the later update first on ties


def test_vectors(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [0.6, 0.8]), (4, "a", None), (5, "a", [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, type string, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.query_id, r.id) for r in vectors.cosine_search(v, q, 3, 0.5).orderBy("query_id", "rank").collect()]
    assert got == [(9, 1), (9, 5), (9, 3)]
    edges = {(r.src, r.dst): round(r.weight, 4) for r in vectors.semantic_edges(v).collect()}
    assert edges == {(1, 5): 1.0, (1, 3): 0.6, (2, 3): 0.8, (3, 5): 0.6}
    assert vectors.cosine_search(v.limit(0), q).count() == 0 and vectors.semantic_edges(v.limit(0)).count() == 0
    filled = vectors.backfill(v.withColumns({"title": F.lit("x"), "body": F.lit("y")}), lambda texts: [[3.0, 4.0]] * len(texts))
    assert [round(x, 3) for x in filled.where("id = 4").first().embedding] == [0.6, 0.8]


def test_fusion(spark):
    lists = [spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "query_id long, id long, rank int") for ids in ([1, 2, 3], [2, 5, 1])]
    got = [r.id for r in fusion.rrf_fuse(lists).orderBy("rank").collect()]
    assert got[0] == 2 and set(got) == {1, 2, 3, 5}
    m = mem(spark, [{"id": i, "s": i * 86400} for i in (1, 2, 3, 5)])
    late = {r.id: r.score for r in fusion.seed_scores([lists[0]], m, NO).collect()}
    assert math.isclose(late[3], 1 / 63 + 0.25 / 61) and math.isclose(late[1], 1 / 61 + 0.25 / 63)
    old = {r.id: r.score for r in fusion.seed_scores([lists[0]], m, EngineConfig(decay_half_life_days=1.0), at(3 * 86400)).collect()}
    assert math.isclose(old[1], late[1] / 4) and math.isclose(old[3], late[3])


def test_edge_modes(spark):
    e = edge(spark, [(5, 2, "semantic", 0.3), (9, 8, "crystallized", 1.0)])
    new = edge(spark, [(2, 5, "semantic", 0.7), (1, 2, "hebbian", 0.5), (2, 1, "hebbian", 0.5), *[(3, 4, "hebbian", 0.5)] * 15])
    got = {(r.src, r.dst, r.kind): r.weight for r in graph.merge_edges(e, new).collect()}
    assert got == {(2, 5, "semantic"): 0.7, (9, 8, "crystallized"): 1.0, (1, 2, "hebbian"): 1.0, (3, 4, "hebbian"): 5.0}


def test_degrees(spark):
    m = mem(spark, [{"id": 1}, {"id": 2}, {"id": 3}, {"id": 4}, {"id": 5, "to": 9}])
    e = edge(spark, [(1, 2, "semantic", 0.9), (1, 3, "hebbian", 0.5), (2, 3, "explicit", 1.0), (4, 5, "hebbian", 1.0)])
    assert {r.id: r.degree for r in graph.degrees(e, m).collect()} == {1: 0.5, 2: 1.0, 3: 1.5, 4: 0.0}


def plain_spread(start, around, budget, decay=0.4, epsilon=1e-4):
    act, depth, fired, got = dict(start), {i: 0 for i in start}, set(), {}
    for _ in range(budget):
        ready = [i for i in act if i not in fired and act[i] >= epsilon]
        if not ready:
            break
        n = min(ready, key=lambda i: (-act[i], i))
        fired.add(n)
        a = act[n]
        for o, w, kind in sorted(around.get(n, [])):
            t = a * w * decay
            if t < epsilon:
                continue
            act[o] = act.get(o, 0.0) + t
            depth[o] = min(depth.get(o, 10**9), depth[n] + 1)
            if o not in start and t > got.get(o, (0.0,))[0]:
                got[o] = (t, n, kind, round(w, 3), depth[o])
    return act, {i: g[1:] for i, g in got.items()}


def test_spread_as_the_model(spark):
    draw = random.Random(3)
    rows = [(a, b, draw.choice(["explicit", "hebbian", "semantic"]), round(draw.uniform(0.2, 1.5), 2)) for a in range(1, 25) for b in range(a + 1, 25) if draw.random() < 0.12]
    m = mem(spark, [{"id": i, "to": 5 if i == 7 else None} for i in range(1, 25)])
    weight = {"explicit": 1.2, "hebbian": 1.0, "semantic": 1.0}
    around = {}
    for a, b, k, w in rows:
        for x, y in ((a, b), (b, a)):
            if y != 7:
                around.setdefault(x, []).append((y, w * weight[k], k))
    type_of = {i: ("user" if i % 3 else "project") for i in range(1, 25)}
    m = m.withColumn("type", F.when(F.col("id") % 3 != 0, "user").otherwise("project"))
    starts = {1: {1: 1.0, 4: 0.3}, 2: {9: 0.5}, 3: {20: 0.00005}, 4: {1: 1.0, 4: 0.3}}
    wanted = {4: "user"}  # a batch with a query of one type among others
    types = spark.createDataFrame([(q, wanted.get(q)) for q in starts], "query_id long, type string")
    s = spark.createDataFrame([(q, i, a) for q, own in starts.items() for i, a in own.items()], "query_id long, id long, activation double")
    for budget in (0, 1, 5):
        out = graph.spread(s, edge(spark, rows), m, budget=budget, types=types).collect()
        for q, start in starts.items():
            near = {i: [x for x in own if wanted.get(q) in (None, type_of[x[0]])] for i, own in around.items()}
            act, receipts = plain_spread(start, near, budget)
            mine = {r.id: r for r in out if r.query_id == q}
            assert mine.keys() == act.keys()
            assert all(math.isclose(mine[i].activation, a, rel_tol=1e-9) for i, a in act.items())
            assert {i: (r.receipt["from"], r.receipt.kind, r.receipt.w, r.receipt.hops) for i, r in mine.items() if r.receipt} == receipts


def test_components(spark):
    draw = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(draw.randint(1, 60), draw.randint(1, 60)) for _ in range(35)]
    pairs = [(a, b) for a, b in pairs if a != b]
    root = {}
    for a, b in pairs:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == root


def test_session_fold(spark):
    def fold(*touches, config=NO):
        return sessions.fold_session({}, list(touches), config)

    assert fold([1, 2])[0] == {1: 1.0, 2: 0.5}
    assert fold([1, 2], [2])[0] == {1: 0.5, 2: 1.25}
    state, pairs = fold(list(range(1, 21)))
    assert list(state.values()) == [1, 0.5, 0.25, 0.125, 0.0625]
    assert set(fold([1, 2, 3, 4])[1]) == {(1, 2), (1, 3), (2, 3)} and 4 in fold([1, 2, 3, 4])[0]
    assert fold([1, 2], [2], config=EngineConfig(hebbian_bump_decay=1.0, hebbian_wire_floor=0.0))[0] == {1: 0.5, 2: 1.5}
    draw = random.Random(2)
    rows = [(s, t, r, m) for s in "abc" for t in range(1, 6) for r, m in enumerate(draw.sample(range(30), 7))]
    out = sessions.touch_sessions(spark.createDataFrame(rows, "session_id string, touch long, rank long, memory_id long")).collect()
    for s in "abc":
        lists = [[m for x, y, _, m in rows if x == s and y == t] for t in range(1, 6)]
        state, pairs = sessions.fold_session({}, lists, NO)
        assert {r.a: r.value for r in out if r.session_id == s and r.kind == "member"} == state
        assert {(r.a, r.b): r.value for r in out if r.session_id == s and r.kind == "pair"} == pairs


def test_gap_sessions(spark):
    e = spark.createDataFrame([("u", 0), ("u", 1800), ("u", 3601), ("v", 5)], "key string, s long").select("key", at(F.col("s")).alias("ts"))
    got = sorted((r.key, r.session, r.n_events) for r in sessions.gap_sessions(e).collect())
    assert got == [("u", 1, 2), ("u", 2, 1), ("v", 1, 1)]


def ops(spark, rows):
    return spark.createDataFrame([(i, t, title, body, ["a"], links, None, None, None) for i, (t, title, body, links) in enumerate(rows)], "seq long, type string, title string, body string, tags array<string>, links array<long>, device_id string, author string, embedding array<float>").withColumn("at", at(F.col("seq") + 1000))


def test_upsert(spark):
    m = mem(spark, [{"id": 3, "type": "user", "title": "Prefers TDD", "links": [10, 2]}, {"id": 7, "to": 5}])
    after, actions = store.upsert(m, ops(spark, [("user", "  prefers   tdd ", "new", [3, 2]), ("project", "B", "first", []), ("project", "A", "a", []), ("project", "b ", "second", [1])]))
    assert sorted((r.id, r.action) for r in actions.collect()) == [(3, "updated"), (8, "created"), (9, "created")]
    rows = {r.id: r for r in after.collect()}
    assert rows[3].body == "new" and rows[3].links == [10, 2, 3] and rows[3].created_at < rows[3].updated_at
    assert rows[8].body == "second" and rows[8].links == [1] and rows[9].title == "A" and rows[7].valid_to is not None
    with pytest.raises(Exception, match="type must be"):
        store.upsert(m, ops(spark, [("other", "x", "", [])]))[0].collect()
    assert store.rejected(ops(spark, [("other", "x", "", []), ("user", "x", "", [])])).count() == 1
    assert store.duplicate_keys(after).isEmpty()


def test_consolidation(spark):
    m = mem(spark, [{"id": 1, "embedding": [1.0, 0.0]}, {"id": 2, "embedding": [0.0, 1.0]}, {"id": 3, "type": "user", "embedding": [1.0, 0.0]}, {"id": 4, "embedding": [1.0, 0.0]}])
    after, gone = store.consolidate(m, spark.createDataFrame([(4,)], "id long"), at(99), 0.9)
    rows = {r.id: r for r in after.collect()}
    assert rows[1].superseded_by == 4 and rows[1].valid_to is not None and rows[3].valid_to is None and rows[2].valid_to is None
    assert [tuple(r)[:2] for r in gone.collect()] == [(1, 4)]


def test_lifecycle(spark):
    m = mem(spark, [{"id": 1, "title": "a", "to": 4}, {"id": 2, "title": "A "}, {"id": 3, "title": "c", "to": 4}, {"id": 4, "title": "d"}])
    after, told = store.restore(m, spark.createDataFrame([(1,), (3,), (4,), (9,)], "id long"))
    assert {r.id: r.outcome for r in told.collect()} == {1: "clash", 3: "restored", 4: "current", 9: "missing"}
    assert {r.id for r in after.where("valid_to is null").collect()} == {2, 3, 4}
    linked = {r.id: r.links for r in store.link(m, spark.createDataFrame([(2, 4), (2, 3), (2, 2)], "a long, b long"), at(50)).collect()}
    assert linked[2] == [4] and linked[4] == [2] and linked[3] == []
    assert store.bad_pairs(m, spark.createDataFrame([(2, 3), (2, 4)], "a long, b long")).count() == 1


def cluster_edges(spark):
    return edge(spark, [(1, 2, "explicit", 1.0), (2, 3, "semantic", 0.8), (3, 4, "semantic", 0.1)])


def found(df):
    return [(r.peak_src, r.peak_dst, r.members) for r in df.orderBy("peak_src").collect()]


def test_clusters(spark):
    m = mem(spark, [{"id": i, "tags": ["z", "b"][: i % 3]} for i in (1, 2, 3, 4, 10)])
    e = cluster_edges(spark)
    assert found(cluster.candidates(e, m)) == [(1, 2, [1, 2, 3])]
    assert cluster.candidates(e, m).first().description == "t1; t2; t3 | b, z"
    assert found(cluster.candidates(e.where("kind = 'explicit'"), m)) == []
    assert found(cluster.candidates(e.where("kind <> 'explicit'"), m)) == []
    based = e.unionByName(edge(spark, [(10, i, "crystallized", 1.0) for i in (1, 2, 3)]))
    assert found(cluster.candidates(based, m)) == []
    assert found(cluster.candidates(e, m, spark.createDataFrame([(2, 1)], "src long, dst long"))) == []


def test_cluster_fallback(spark):
    m = mem(spark, [{"id": i} for i in range(1, 12)])
    e = edge(spark, [(1, 2, "semantic", 0.95), (1, 3, "semantic", 0.95), *((i, i + 1, "semantic", 0.4) for i in (4, 6, 8, 10))])
    assert found(cluster.candidates(e, m)) == []
    assert found(cluster.candidates(e, m, fallback=True)) == [(1, 1, [1, 2, 3])]
    assert cluster.outliers(edge(spark, [(1, 2, "semantic", 0.9)]), m).isEmpty()


def test_boot_index(spark):
    m = mem(spark, [{"id": i, "s": i * 100} for i in range(1, 9)])
    hub = edge(spark, [(1, i, "hebbian", 1.0) for i in (2, 3, 4)])
    lines = index.index_text(index.boot_index(m, hub, 4)).split("\n")
    assert lines[0] == index.LOAD_BEARING and index.RECENT in lines and "[project] #1 t1" in lines[:3]
    assert len([x for x in lines if x[0] == "["]) == 4
    newest = [f"[project] #{i} t{i}" for i in (8, 7, 6, 5)]
    assert index.index_text(index.boot_index(m, None, 4)).split("\n") == newest
    assert index.index_text(index.boot_index(m, hub.limit(0), 4)).split("\n") == newest
    assert len(index.index_text(index.boot_index(m, hub, 50)).split("\n")) == 8
    assert index.index_text(index.boot_index(m.limit(0), hub, 4)) == index.EMPTY


def test_sweep(spark):
    now = at(400 * 86400)
    m = mem(spark, [{"id": 1, "s": 0}, *({"id": i, "s": 399 * 86400} for i in range(2, 7))])
    used = edge(spark, [(2, 3, "hebbian", 0.5)])
    ids = lambda m, e, **k: [r.id for r in index.sweep_candidates(m, e, now, EngineConfig(boot_index_cap=2, **k)).collect()]
    assert ids(m, used) == [1]
    assert ids(m, used.unionByName(edge(spark, [(1, 2, "explicit", 1.0)]))) == []
    assert ids(m, used.limit(0)) == [] and ids(m, used, forget=False) == [] and ids(m.where("id < 4"), used) == []
    old = mem(spark, [{"id": i, "s": 100 - i} for i in range(1, 9)])
    assert ids(old, used, forget_max_per_sweep=2) == [8, 7]


def test_metrics(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 3), (3, 30, 1)], "query_id long, id long, rank int")
    gold = spark.createDataFrame([(1, 10), (2, 21), (4, 1)], "query_id long, id long")
    v = lambda d: {r.query_id: round(r.value, 6) for r in d.collect()}
    assert v(evalkit.hit_at(run, gold, 2)) == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert v(evalkit.reciprocal(run, gold)) == {1: 1.0, 2: round(1 / 3, 6), 3: 0.0, 4: 0.0}
    assert v(evalkit.ndcg_at(run, gold)) == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0}
    worse = evalkit.hit_at(run.where("query_id > 1"), gold)
    assert evalkit.distribution(evalkit.hit_at(run, gold), worse).first().regressed == 1
    assert not evalkit.no_regression(evalkit.hit_at(run, gold), worse).first().passed


def test_config():
    read = lambda **env: EngineConfig.read({f"RECOLLECT_{k}": v for k, v in env.items()})
    assert read(ASSOC=" OFF ").assoc is False and read(ASSOC="maybe").assoc is True and read(CONSOLIDATE="Yes").consolidate is True
    assert read(SEED_FLOOR="1.5").seed_floor == 0.35 and read(SEED_FLOOR="0").seed_floor == 0.0
    assert read(BOOT_INDEX_CAP="0").boot_index_cap == 50 and read(RECALL_BUDGET="x").recall_budget == 8
    assert read(DECAY_HALF_LIFE_DAYS="-1").decay_half_life_days is None and read(DECAY_HALF_LIFE_DAYS="30").decay_half_life_days == 30.0
    assert read(DEVICE_ID="d").author == "d"
    assert EngineConfig.read({}, {"recollect.rrf_k": "10"}).rrf_k == 10


def test_tags(spark):
    m = mem(spark, [{"id": 1, "tags": ["a", "b", "c"]}, {"id": 2, "tags": ["a"], "s": 9}, {"id": 3, "tags": ["a", "c"], "to": 3}])
    assert [r.id for r in recall.by_tags(m, ["a"]).collect()] == [2, 1] and [r.id for r in recall.by_tags(m, ["c", "a"]).collect()] == [1]


def test_typed_recall_gives_its_type_only(spark):
    """Seeds, primed rows and rows that the walk reaches, in a batch with a query of any type."""
    m = mem(spark, [{"id": 1, "type": "user", "body": "rare word"}, {"id": 2, "type": "project"}, {"id": 3, "type": "user"}, {"id": 4, "type": "project"}, {"id": 5, "type": "user"}])
    e = edge(spark, [(1, 2, "explicit", 1), (1, 3, "explicit", 1), (2, 5, "explicit", 1)])
    q = spark.createDataFrame([(1, "rare", "user"), (2, "rare", None)], "query_id long, text string, type string")
    members = spark.createDataFrame([("s", 4, 1.0), ("s", 3, 0.5)], "session_id string, memory_id long, activation double")
    asked = spark.createDataFrame([(1, "s"), (2, "s")], "query_id long, session_id string")
    got = {}
    for r in recall.recall(m, e, q, members, asked).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got == {1: {1, 3}, 2: {1, 2, 3, 4, 5}}


def test_recall_by_tags_alone(spark):
    m = mem(spark, [{"id": 1, "tags": ["a", "b"], "type": "user"}, {"id": 2, "tags": ["a"], "s": 9}, {"id": 3, "tags": ["b", "a"], "s": 5}, {"id": 4, "tags": ["a", "b"], "to": 3}])
    q = spark.createDataFrame([(1, ["a"], None), (2, ["b", "a"], None), (3, ["a"], "user"), (4, [], None), (5, None, None)], "query_id long, tags array<string>, type string")
    got = sorted((r.query_id, r.rank, r.id) for r in recall.recall_by_tags(m, q).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 1, 3), (2, 2, 1), (3, 1, 1)]


def test_recall_queries_have_the_default_budget(spark, sf, monkeypatch):
    from recollect.plans.catalog import QUERIES

    real, used = recall.spread, []

    def spread(*args, **kw):
        used.append(args[3].recall_budget)
        return real(*args, **kw, budget=0)

    monkeypatch.setattr(recall, "spread", spread)
    for name in ("recall_associative", "via_receipts"):
        QUERIES[name](spark, sf)
    assert used == [EngineConfig().recall_budget] * 2


def test_purge_removes_edges_of_ids_without_a_row(spark):
    members = spark.createDataFrame([("s", 1), ("s", 2), ("s", 11)], "session_id string, memory_id long")
    tables = {"memories": mem(spark, [{"id": 1}, {"id": 2}]), "edges": edge(spark, [(1, 2, "explicit", 1), (2, 11, "hebbian", 1), (11, 12, "hebbian", 1), (2, 3, "hebbian", 1)]), "session_members": members}
    left = store.purge(tables, spark.createDataFrame([(1,), (11,)], "id long"))
    assert [r.id for r in left["memories"].collect()] == [2]
    assert [(r.src, r.dst) for r in left["edges"].collect()] == [(2, 3)]
    assert sorted(r.memory_id for r in left["session_members"].collect()) == [2, 11]
