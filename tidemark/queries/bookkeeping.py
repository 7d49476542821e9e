"""Versions, upserts, pages, samples, progress, rules and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bookkeeping as b
from tidemark.queries.base import E, events, table

# Url patterns of a stage and the stage's name, first match wins.
RULES = [(r"\?utm_", "campaign"), (r"#", "anchor"), (r"\.html", "page"), (r"/(en|fr)/", "listed")]


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest events of each user and type."""
    return b.newest(events(spark, sf_dir), ["user_id", "event_type"], [F.col("t").desc(), F.col("event_id").desc()], 2).select("user_id", "event_type", "event_id", "rank")


def label_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels overridden by a second pass over all documents, where its version is not the older one; documents without a label are new."""
    base = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("version"))
    change = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"), (F.col("n_chars") % 3).cast("int").alias("version"))
    return b.upserted(base, change, ["doc_id"], "version")


def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.page(events(spark, sf_dir).select("event_id", "user_id", "t"), [F.col("t").desc(), F.col("event_id").desc()], 100, 250)


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.evenly_picked(events(spark, sf_dir).select("user_id", "event_id", "t"), ["user_id"], ["t", "event_id"], 7)


def progress_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.progress(events(spark, sf_dir).select("user_id", "event_id", "t", "value"), ["user_id"], ["t", "event_id"], "value", 20)


def stage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(b.first_match(F.col("url"), RULES, "other").alias("stage")).agg(F.count("*").alias("n"))


def json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of the JSON of each event, malformed or missing ones as 0."""
    e = events(spark, sf_dir)
    k = F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0))
    return e.groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count_if(k >= 50).alias("k_high"), F.count("*").alias("n"))


def event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested report of each user as one JSON document: counts by type and the three strongest events."""
    e = events(spark, sf_dir)
    counts = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("kinds"))
    top = b.newest(e, ["user_id"], [F.col("value").desc(), F.col("event_id")], 3).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "event_id"))).alias("t"))
    out = kinds.join(top, "user_id")
    return out.select("user_id", F.to_json(F.struct(F.col("kinds"), F.col("t.event_id").alias("top"))).alias("report"))


def membership_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types each user had in the first half of the ids, in the second, in both and in neither: set operations on arrays."""
    e = events(spark, sf_dir)
    middle = e.agg(F.max("event_id")).select((F.col("max(event_id)") / 2).alias("m"))
    sets = e.join(F.broadcast(middle)).groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") < F.col("m"), F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") >= F.col("m"), F.col("event_type"))).alias("z"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return sets.select("user_id", text(F.array_except("a", "z")).alias("gone"), text(F.array_except("z", "a")).alias("fresh"), text(F.array_intersect("a", "z")).alias("kept"), F.size(F.array_union("a", "z")).cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (latest_revision, label_upsert, paged_listing, systematic_sample, progress_running_max, stage_rules, json_projection, event_report, membership_changes)}

SQL = {
    "latest_revision": f"WITH {E} SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t DESC, event_id DESC) AS rank FROM e QUALIFY rank <= 2",
    "label_upsert": """WITH b AS (SELECT doc_id, quality, 1 AS version, 0 AS fresh FROM labels UNION ALL SELECT doc_id, (n_chars % 2)::INT, (n_chars % 3)::INT, 1 FROM documents)
 SELECT doc_id, quality, version FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC, fresh DESC) = 1""",
    "paged_listing": f"WITH {E} SELECT event_id, user_id, t FROM e ORDER BY t DESC, event_id DESC LIMIT 100 OFFSET 250",
    "systematic_sample": f"""WITH {E}, r AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
 SELECT user_id, event_id, t FROM r WHERE n <= 7 OR i = 0 OR (i * 6) // greatest(n - 1, 1) > ((i - 1) * 6) // greatest(n - 1, 1)""",
    "progress_running_max": f"WITH {E} SELECT user_id, event_id, t, value, max(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS shown FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) <= 20",
    "stage_rules": "SELECT CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{n}'" for p, n in RULES) + " ELSE 'other' END AS stage, count(*) AS n FROM pages GROUP BY 1",
    "json_projection": "WITH k AS (SELECT event_type, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events) SELECT event_type, sum(k)::BIGINT AS k_sum, count(*) FILTER (k >= 50) AS k_high, count(*) AS n FROM k GROUP BY 1",
    "event_report": f"""WITH {E}, c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY 1, 2), k AS (SELECT user_id, list({{'event_type': event_type, 'n': n}} ORDER BY event_type) AS kinds FROM c GROUP BY 1),
 t AS (SELECT user_id, list(event_id ORDER BY value DESC, event_id) AS top FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3) GROUP BY 1)
 SELECT user_id, to_json({{'kinds': kinds, 'top': top}})::VARCHAR AS report FROM k JOIN t USING (user_id)""",
    "membership_changes": f"""WITH {E}, m AS (SELECT max(event_id) / 2 AS m FROM e), a AS (SELECT DISTINCT user_id, event_type, event_id < m AS early FROM e, m),
 s AS (SELECT user_id, event_type, bool_or(early) AS a, bool_or(NOT early) AS z FROM a GROUP BY 1, 2)
 SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (NOT z), '') AS gone, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (NOT a), '') AS fresh, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (a AND z), '') AS kept, count(*) AS n FROM s GROUP BY 1""",
}
