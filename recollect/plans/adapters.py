"""Test tables in the roles of the data model, for Spark and, with the same rows, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN, norm_title

EPOCH = 1704067200  # 2024-01-01 UTC
NOW = EPOCH + 400 * 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(seconds) -> F.Column:
    return F.timestamp_seconds(F.lit(seconds) if isinstance(seconds, int) else seconds)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: every 17th is no longer current, every 34th superseded; links go 20 rows back within 400 rows,
    and every fifth row has one to the row before."""
    id_, text = F.col("doc_id"), F.col("text")
    type_ = F.when(F.col("lang") == "en", "user").when(F.col("lang") == "fr", "project").when(F.col("lang") == "de", "reference").otherwise("feedback")
    made = at(F.lit(EPOCH) + id_ * 3600)
    links = F.concat(F.when(id_ % 400 >= 20, F.array(id_ - 20)).otherwise(F.array().cast("array<long>")), F.when((id_ % 5 == 0) & (id_ > 0), F.array(id_ - 1)).otherwise(F.array().cast("array<long>")))
    return table(spark, sf_dir, "documents").select(
        id_.alias("id"), type_.alias("type"), F.substring(text, 1, 40).alias("title"), norm_title(F.substring(text, 1, 40)).alias("title_norm"), text.alias("body"), F.array("lang", "source").alias("tags"),
        links.alias("links"), made.alias("created_at"), made.alias("updated_at"), F.lit("device").alias("device_id"), F.lit(None).cast("array<float>").alias("embedding"), F.col("source").alias("author"),
        made.alias("valid_from"), F.when(id_ % 17 == 0, at(F.lit(EPOCH) + id_ * 3600 + 86400)).alias("valid_to"), F.when(id_ % 34 == 0, id_ + 1).alias("superseded_by"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("type"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, as a batch of queries."""
    return vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query_id"), "type", "embedding")


#: query_id, text, type, and its phrases.
QUERIES = [
    (1, "ated", None, [["ated"]]),
    (2, "enes the", "user", [["enes"], ["the"]]),
    (3, "ingor", None, [["ingor"]]),
    (4, "Atti of OF", None, [["atti"], ["of"], ["of"]]),
    (5, "of-the", None, [["of", "the"]]),
    (6, "la éaux", "project", [["la"], ["eaux"]]),
    (7, "zzzz", None, [["zzzz"]]),
    (8, "--", None, []),
    (9, "ouaimentelle", None, [["ouaimentelle"]]),  # words of few rows: what the graph reaches comes into the result
    (10, "enaiaux", "project", [["enaiaux"]]),
    (11, "relyble", None, [["relyble"]]),
    (12, "oransh", "user", [["oransh"]]),
]


def text_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([q[:3] for q in QUERIES], "query_id long, text string, type string")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind, weight, updated_at) between memories: links, and suppliers' co-use over all orders."""
    from ..operators.graph import explicit_edges

    explicit = explicit_edges(memories(spark, sf_dir)).withColumn("kind", F.lit("explicit"))
    used = co_use(spark, sf_dir).withColumn("kind", F.lit("hebbian"))
    made = F.col("id")
    principles = memories(spark, sf_dir).where("id % 50 = 7").select(F.col("id").alias("src"), F.explode(F.array(made + 20, made + 40, made + 60)).alias("dst"), F.lit(1.0).alias("weight"), F.lit("crystallized").alias("kind"))
    return explicit.unionByName(used).unionByName(principles).select("src", "dst", "kind", "weight", at(EPOCH).alias("updated_at"))


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, touch, rank, memory_id): line items of an order as one ranked list of suppliers."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("session_id"), F.lit(1).cast("long").alias("touch"), (F.row_number().over(order) - 1).cast("long").alias("rank"), F.col("l_suppkey").alias("memory_id"))


def customer_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, touch, rank, memory_id): the orders of a customer in time are the touches of a session."""
    from pyspark.sql import Window

    by_time = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("session_id"), F.row_number().over(by_time).cast("long").alias("touch"))
    lists = touches(spark, sf_dir).select(F.col("session_id").cast("long").alias("o_orderkey"), "rank", "memory_id")
    return lists.join(orders, "o_orderkey").select("session_id", "touch", "rank", "memory_id")


def co_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): capped co-occurrence of the first three of every list."""
    from ..operators.graph import capped_counts

    first = touches(spark, sf_dir).where("rank <= 2")
    a, b = first.select("session_id", F.col("rank").alias("ra"), F.col("memory_id").alias("src")), first.select("session_id", F.col("rank").alias("rb"), F.col("memory_id").alias("dst"))
    return capped_counts(a.join(b, "session_id").where("ra < rb").select("src", "dst"))


# --- the same as SQL ------------------------------------------------------------------------------------------

_LAST = "CAST(epoch(updated_at) AS BIGINT)"


def fold_sql(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[\s\p{{Z}}]+', ' ', 'g'))"


TERMS_SQL = ", ".join(f"({q}, {p}, {len(terms)}, {k}, '{t}')" for q, _, _, phrases in QUERIES for p, terms in enumerate(phrases) for k, t in enumerate(terms))
NEEDED_SQL = ", ".join(f"({q}, {len(phrases)}, {'NULL' if type_ is None else repr(type_)})" for q, _, type_, phrases in QUERIES if phrases)

CTES = {
    "mem": f"""mem AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'user' WHEN 'fr' THEN 'project' WHEN 'de' THEN 'reference' ELSE 'feedback' END AS type,
        left(text, 40) AS title, {norm_sql("left(text, 40)")} AS title_norm, text AS body, [lang, source] AS tags,
        list_concat(CASE WHEN doc_id % 400 >= 20 THEN [doc_id - 20] ELSE CAST([] AS BIGINT[]) END, CASE WHEN doc_id % 5 = 0 AND doc_id > 0 THEN [doc_id - 1] ELSE CAST([] AS BIGINT[]) END) AS links,
        {EPOCH} + doc_id * 3600 AS updated_s, source AS author, CASE WHEN doc_id % 17 = 0 THEN {EPOCH} + doc_id * 3600 + 86400 END AS valid_to_s,
        CASE WHEN doc_id % 34 = 0 THEN doc_id + 1 END AS superseded_by FROM documents),
    cur AS (SELECT * FROM mem WHERE valid_to_s IS NULL)""",
    "vec": "vec AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS type, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
    "qv": "qv AS (SELECT id AS query_id, type AS qtype, e AS qe FROM vec WHERE id % 50 = 0)",
    "sims": "sims AS (SELECT query_id, qtype, id, type, list_dot_product(qe, e) AS sim FROM qv, vec)",
    "explicit": "explicit AS (SELECT DISTINCT least(id, other) AS src, greatest(id, other) AS dst, CAST(1.0 AS DOUBLE) AS weight FROM (SELECT id, unnest(links) AS other FROM mem) WHERE id <> other)",
    "touches": "touches AS (SELECT CAST(l_orderkey AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS rank, l_suppkey AS memory_id FROM lineitem)",
    "co_use": """co_use AS (SELECT least(a.memory_id, b.memory_id) AS src, greatest(a.memory_id, b.memory_id) AS dst, least(5.0, 0.5 * count(*))::DOUBLE AS weight
        FROM touches a JOIN touches b ON a.session_id = b.session_id AND a.rank < b.rank AND a.rank <= 2 AND b.rank <= 2 WHERE a.memory_id <> b.memory_id GROUP BY 1, 2)""",
    "edges": """edges AS (SELECT src, dst, 'explicit' AS kind, weight FROM explicit UNION ALL SELECT src, dst, 'hebbian', weight FROM co_use
        UNION ALL SELECT id, unnest([id + 20, id + 40, id + 60]), 'crystallized', 1.0 FROM mem WHERE id % 50 = 7)""",
    "sym": "sym AS (SELECT id, other, kind, max(weight) AS weight FROM (SELECT src AS id, dst AS other, kind, weight FROM edges UNION ALL SELECT dst, src, kind, weight FROM edges) GROUP BY ALL)",
    "nbr": """nbr AS (SELECT id, other, sum(b) AS weight, arg_max(kind, b * 1000 + CASE kind WHEN 'explicit' THEN 4 WHEN 'crystallized' THEN 3 WHEN 'hebbian' THEN 2 ELSE 1 END * 0.001) AS kind
        FROM (SELECT *, weight * CASE kind WHEN 'explicit' THEN 1.2 WHEN 'crystallized' THEN 1.2 ELSE 1.0 END AS b FROM sym WHERE other IN (SELECT id FROM cur)) GROUP BY id, other)""",
    "deg": """deg AS (SELECT c.id, coalesce(d.degree, 0.0) AS degree FROM cur c LEFT JOIN (SELECT id, sum(weight) AS degree FROM (SELECT unnest([src, dst]) AS id, weight FROM edges
        WHERE kind IN ('explicit', 'hebbian', 'crystallized') AND src IN (SELECT id FROM cur) AND dst IN (SELECT id FROM cur)) GROUP BY id) d ON d.id = c.id)""",
    "fields": rf"""fields AS (SELECT id, 'title' AS field, regexp_extract_all({fold_sql("title")}, '[\p{{L}}\p{{N}}]+') AS toks FROM mem
        UNION ALL SELECT id, 'body', regexp_extract_all({fold_sql("body")}, '[\p{{L}}\p{{N}}]+') FROM mem
        UNION ALL SELECT id, 'tags', regexp_extract_all({fold_sql("array_to_string(tags, ',')")}, '[\p{{L}}\p{{N}}]+') FROM mem),
    lens AS (SELECT id, CAST(sum(len(toks)) AS DOUBLE) AS length FROM fields GROUP BY id),
    corpus AS (SELECT CAST(count(*) AS DOUBLE) AS n_rows, avg(length) AS mean_length FROM lens)""",
    "bm25": f"""terms AS (SELECT * FROM (VALUES {TERMS_SQL}) t(query_id, phrase, n_terms, k, term)),
    needed AS (SELECT * FROM (VALUES {NEEDED_SQL}) t(query_id, needed, qtype)),
    places AS (SELECT * FROM (SELECT id, field, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM fields) WHERE term IN (SELECT term FROM terms)),
    met AS (SELECT query_id, phrase, id, field, pos - k AS start FROM places JOIN terms USING (term) GROUP BY query_id, phrase, n_terms, id, field, pos - k HAVING count(DISTINCT k) = n_terms),
    freq AS (SELECT query_id, phrase, id, CAST(count(*) AS DOUBLE) AS f FROM met GROUP BY ALL),
    idfs AS (SELECT query_id, phrase, CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n + 0.5) / (n + 0.5)) END AS idf, mean_length FROM (SELECT query_id, phrase, CAST(count(*) AS DOUBLE) AS n FROM freq GROUP BY ALL), corpus),
    scored AS (SELECT query_id, id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score, count(*) AS n FROM freq JOIN idfs USING (query_id, phrase) JOIN lens USING (id) GROUP BY ALL),
    bm25 AS (SELECT query_id, id, score, qtype FROM scored JOIN needed USING (query_id) WHERE n = needed),
    fts AS (SELECT * FROM (SELECT b.query_id, b.id, b.score, row_number() OVER (PARTITION BY b.query_id ORDER BY round(b.score, 9) DESC, c.updated_s DESC, b.id) AS rank
        FROM bm25 b JOIN cur c USING (id) WHERE qtype IS NULL OR qtype = c.type) WHERE rank <= 200)""",
    "seeds": """rrf AS (SELECT query_id, id, sum(1.0 / (60.0 + rank)) AS score FROM fts GROUP BY ALL),
    seeds AS (SELECT query_id, id, score + 0.25 / (60.0 + row_number() OVER (PARTITION BY query_id ORDER BY updated_s DESC, id DESC)) AS score FROM rrf JOIN mem USING (id))""",
}
ORDER = list(CTES)
NEEDS = {"qv": ["vec"], "sims": ["qv"], "explicit": ["mem"], "co_use": ["touches"], "edges": ["explicit", "co_use", "mem"], "sym": ["edges"], "nbr": ["sym", "mem"], "deg": ["edges", "mem"], "fields": ["mem"], "bm25": ["fields"], "seeds": ["bm25"]}


def sql(body: str, *wanted: str, recursive: bool = False) -> str:
    """A statement on the named common tables and what these need."""
    found: set[str] = set()

    def add(name: str) -> None:
        if name not in found:
            found.add(name)
            for n in NEEDS.get(name, []):
                add(n)

    for w in wanted:
        add(w)
    head = ",\n    ".join(CTES[n] for n in ORDER if n in found)
    text = body.strip()
    if text.upper().startswith("WITH "):
        text = text[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{head + ',' if head else ''}\n    {text}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{text}" if head else text
