"""Scalar functions over parts, events and documents."""

from pyspark.sql import functions as F

from ..functions import scalars as X
from .registry import query, r6


@query(
    "exposure_us",
    """WITH n AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size || 'k' WHEN p_size % 3 = 1 THEN (p_size * 100)::VARCHAR ELSE p_type END AS name FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(name, '^\\d+k?$') THEN CAST(replace(name, 'k', '') AS BIGINT) * CASE WHEN name LIKE '%k' THEN 1000 ELSE 1 END END AS us FROM n""",
)
def exposure_us(t):
    size = F.col("p_size")
    name = (
        F.when(size % 3 == 0, F.concat(size.cast("string"), F.lit("k")))
        .when(size % 3 == 1, (size * 100).cast("string"))
        .otherwise(F.col("p_type"))
    )
    return t.part.select("p_partkey", X.exposure_us(name).alias("us"))


TOKENS = ("1", " 2 ", "3.0", "2.7", "never", "N", "-1", "", "?", "NA", "5", "tbd")


@query(
    "coerce_day",
    f"""WITH e AS (SELECT event_id, [{', '.join(repr(x) for x in TOKENS)}][CAST(json_extract(props, '$.k') AS INTEGER) % 12 + 1] AS raw FROM events)
SELECT event_id, lower(trim(raw)) NOT IN ('', '-', 'na', 'n/a', 'null', '?', 'tbd') AS scored,
  CASE WHEN lower(trim(raw)) NOT IN ('', '-', 'na', 'n/a', 'null', '?', 'tbd', '-1', 'never', 'none', 'n') THEN CAST(trunc(TRY_CAST(trim(raw) AS DOUBLE)) AS INTEGER) END AS day FROM e""",
)
def coerce_day(t):
    k = F.from_json("props", "k int")["k"]
    raw = F.get(F.array(*[F.lit(x) for x in TOKENS]), k % len(TOKENS))
    e = t.events.select("event_id", raw.alias("raw"))
    scored = ~X.is_unscored("raw")
    return e.select("event_id", scored.alias("scored"), F.when(scored, X.coerce_day("raw")).alias("day"))


@query(
    "column_index",
    """WITH l AS (SELECT p_partkey, upper(substr(p_name, 1, 2)) AS s FROM part)
SELECT p_partkey, CAST((ascii(substr(s, 1, 1)) - 64) * 26 + ascii(substr(s, 2, 1)) - 65 AS INTEGER) AS idx FROM l""",
)
def column_index(t):
    return t.part.select("p_partkey", X.column_index(X.column_letters(F.upper(F.substring("p_name", 1, 2)))).alias("idx"))


@query("short_label", "SELECT p_partkey, substr(regexp_extract(p_brand, '^([^\\d]*)', 1), 1, 3) || regexp_extract(p_brand, '(\\d*)$', 1) AS short FROM part")
def short_label(t):
    return t.part.select("p_partkey", X.short_label("p_brand").alias("short"))


@query(
    "content_key",
    "SELECT doc_id, substr(sha1(doc_id || ':' || n_chars || ':' || text), 1, 16) AS key, sha256(text) AS sha256 FROM documents",
)
def content_key(t):
    return t.documents.select("doc_id", X.content_key("doc_id", "n_chars", "text").alias("key"), F.sha2("text", 256).alias("sha256"))


@query(
    "unit_names",
    """SELECT c_custkey, 'dish' || c_nationkey || '_R' || (c_custkey % 4) || 'C' || (c_custkey % 7) AS uid, 'dish' || c_nationkey AS grp,
CAST(c_nationkey // 5 + 1 AS INTEGER) AS stratum, CASE WHEN c_custkey % 10 = 1 THEN 0.0::DOUBLE WHEN c_custkey % 10 = 9 THEN 8.0::DOUBLE END AS hours FROM customer""",
)
def unit_names(t):
    uid = X.unit_uid("c_nationkey", F.col("c_custkey") % 4, F.col("c_custkey") % 7)
    return t.customer.select(
        "c_custkey", uid.alias("uid"), X.group_of_uid(uid).alias("grp"), X.stratum_of("c_nationkey").alias("stratum"),
        X.slot_hours(F.col("c_custkey") % 10).alias("hours"),
    )


@query(
    "json_props",
    "SELECT event_type, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS mean_k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type",
)
def json_props(t):
    k = F.from_json("props", "k int")["k"]
    return t.events.groupBy("event_type").agg(r6(F.avg(k)).alias("mean_k"), F.count(F.lit(1)).alias("n"))


@query(
    "path_keys",
    """SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]+/[^/?]+/\\d+') THEN regexp_extract(url, '^https?://[^/]+/([^/?]+)/(\\d+)', 1) END AS section,
TRY_CAST(regexp_extract(url, '^https?://[^/]+/([^/?]+)/(\\d+)', 2) AS INTEGER) AS number FROM pages""",
)
def path_keys(t):
    """Structured keys out of page addresses, as capture keys come out of paths."""
    pattern = r"^https?://[^/]+/([^/?]+)/(\d+)"
    hit = F.regexp_extract("url", pattern, 1)
    return t.pages.select("page_id", F.when(hit != "", hit).alias("section"), F.regexp_extract("url", pattern, 2).try_cast("int").alias("number"))
