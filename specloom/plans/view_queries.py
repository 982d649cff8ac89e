"""Selection, labels, clocks, collapsing and folds over customers, orders and events.

A customer plays the unit, its nation the group, the region the stratum, and its
orders the repeat views.
"""

from pyspark.sql import functions as F

from ..operators import collapse, folds, metrics, select, timing
from .registry import query, r6, rounded

SEED = 20260817


def units(t):
    """Customers with group and stratum."""
    return t.customer.select("c_custkey", "c_nationkey", "c_acctbal").join(
        t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region")), "c_nationkey"
    )


UNITS = "units AS (SELECT c.*, n.n_regionkey AS region FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"


@query(
    "select_views",
    """SELECT o_orderkey, o_custkey, c_nationkey, o_orderstatus, o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus IN ('F', 'O') AND c_nationkey IN (1, 5, 7, 11) AND o_totalprice <= 250000 AND c_acctbal >= 0""",
)
def select_views(t):
    gate = select.selection(isin={"o_orderstatus": ["F", "O"], "o_orderpriority": None}, at_most={"o_totalprice": 250000})
    wells = select.selection(isin={"c_nationkey": [1, 5, 7, 11]}, at_least={"c_acctbal": 0})
    o, c = t.orders.where(gate), t.customer.where(wells)
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", "o_custkey", "c_nationkey", "o_orderstatus", "o_totalprice"
    )


@query(
    "take_rows",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def take_rows(t):
    wanted = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return select.take(t.orders, wanted, "o_custkey").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "exclude_stratum",
    f"WITH {UNITS} SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM units WHERE region NOT IN (2) GROUP BY c_nationkey",
)
def exclude_stratum(t):
    return select.exclude(units(t), "region", [2]).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dense_class_id",
    """SELECT n_nationkey, CAST(coalesce(list_position([0, 1, 3, 4], n_regionkey) - 1, -1) AS INTEGER) AS class_id,
CAST(coalesce(list_position([1, 3], coalesce(list_position([0, 1, 3, 4], n_regionkey) - 1, -1)) - 1, -1) AS INTEGER) AS sub_id
FROM nation""",
)
def dense_class_id(t):
    out = t.nation.withColumn("class_id", select.dense_class_id([0, 1, 3, 4], "n_regionkey"))
    return out.select("n_nationkey", "class_id", select.restrict_classes("class_id", [1, 3]).alias("sub_id"))


@query(
    "three_state_label",
    """SELECT lang, CAST(CASE WHEN l.doc_id IS NULL THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS INTEGER) AS label,
CAST(count(*) AS BIGINT) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""",
)
def three_state_label(t):
    scored = t.labels.select("doc_id", F.when(F.col("quality") == 1, 1).alias("first_day"))
    out = select.three_state(t.documents.select("doc_id", "lang"), scored, "doc_id", "first_day")
    return out.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_orphans",
    "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de')",
)
def label_orphans(t):
    return select.orphans(t.labels, t.documents.where("lang <> 'de'"), "doc_id").select("doc_id", "quality")


@query("unlabelled", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(t):
    return select.unlabelled(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query(
    "attach_clock",
    """WITH clock AS (
  SELECT user_id, min(ts) AS t0, CASE WHEN count(*) > 12 THEN 'proxy' END AS source
  FROM events WHERE event_type = 'signup' AND value > 20 GROUP BY user_id
)
SELECT e.event_id, c.t0 AS capture_time,
       round(coalesce((epoch_us(e.ts) - epoch_us(c.t0)) / 3.6e9::DOUBLE, 'NaN'::DOUBLE), 6) AS capture_hours,
       CASE WHEN c.user_id IS NULL THEN 'none' ELSE coalesce(source, 'measured') END AS capture_time_source
FROM events e LEFT JOIN clock c ON e.user_id = c.user_id""",
)
def attach_clock(t):
    clock = (
        t.events.where("event_type = 'signup' AND value > 20")
        .groupBy("user_id")
        .agg(F.min("ts").alias("time"), F.count(F.lit(1)).alias("k"))
        .select("user_id", "time", F.lit(0.0).alias("hours"), F.when(F.col("k") > 12, "proxy").alias("source"))
    )
    out = timing.attach_clock(t.events.select("event_id", "ts", "user_id"), clock, ["user_id"])
    hours = F.coalesce(timing.hours_between("capture_time", "ts"), F.lit(float("nan")))
    return out.select("event_id", "capture_time", r6(hours).alias("capture_hours"), "capture_time_source")


@query(
    "hours_since_origin",
    """WITH o AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY user_id)
SELECT event_type, round(max((epoch_us(ts) - epoch_us(t0)) / 3.6e9::DOUBLE), 6) AS max_hours,
       round(avg((epoch_us(ts) - epoch_us(t0)) / 3.6e9::DOUBLE), 6) AS mean_hours
FROM events JOIN o USING (user_id) GROUP BY event_type""",
)
def hours_since_origin(t):
    e = timing.hours_since_origin(t.events.select("user_id", "event_type", "ts"), ["user_id"], "ts")
    out = e.groupBy("event_type").agg(F.max("hours").alias("max_hours"), F.avg("hours").alias("mean_hours"))
    return rounded(out, "max_hours", "mean_hours")


VISITS = """
origin AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY user_id),
days AS (
  SELECT user_id, date_trunc('day', ts) AS d, min(ts) AS seen FROM events WHERE event_type = 'view' GROUP BY 1, 2
), visits AS (
  SELECT user_id, list((epoch_us(seen) - epoch_us(t0)) / 3.6e9::DOUBLE ORDER BY seen) AS visits
  FROM days JOIN origin USING (user_id) GROUP BY user_id
), event AS (
  SELECT user_id, min(ts) FILTER (event_type = 'purchase' AND value > 30) AS bought,
         count(*) FILTER (event_type = 'signup' AND value > 60) > 0 AS scored FROM events GROUP BY user_id
), per AS (
  SELECT user_id, scored, visits,
         CASE WHEN bought IS NOT NULL AND n_before < len(visits) THEN n_before + 1 END AS k
  FROM (SELECT e.user_id, e.scored, e.bought, v.visits,
               len(list_filter(v.visits, lambda h: h < (epoch_us(e.bought) - epoch_us(t0)) / 3.6e9::DOUBLE)) AS n_before
        FROM event e JOIN origin USING (user_id) LEFT JOIN visits v ON e.user_id = v.user_id)
)"""


def user_visits(t):
    """One visit per calendar day with a view, as hours since the user's first event.

    Reducing to days first bounds the list by the calendar, not by the user's activity.
    """
    o = timing.origin(t.events, ["user_id"], "ts")
    days = (
        t.events.where("event_type = 'view'")
        .groupBy("user_id", F.date_trunc("day", "ts").alias("d"))
        .agg(F.min("ts").alias("seen"))
    )
    return (
        days.join(o, "user_id")
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(timing.hours_between("t0", "seen"))).alias("visits"))
    )


@query(
    "event_interval",
    f"""WITH {VISITS}
SELECT user_id, CAST(k AS INTEGER) AS k, scored,
  round(CASE WHEN NOT scored THEN 'NaN'::DOUBLE WHEN k IS NULL THEN visits[len(visits)] WHEN k = 1 THEN 0.0
       ELSE visits[k - 1] END, 6) AS lower,
  round(CASE WHEN NOT scored THEN 'NaN'::DOUBLE WHEN k IS NULL THEN 'Infinity'::DOUBLE ELSE visits[k] END, 6) AS upper
FROM per""",
)
def event_interval(t):
    visits = user_visits(t)
    first = t.events.groupBy("user_id").agg(
        F.min("ts").alias("t0"),
        F.min(F.when((F.col("event_type") == "purchase") & (F.col("value") > 30), F.col("ts"))).alias("bought"),
        (F.count_if((F.col("event_type") == "signup") & (F.col("value") > 60)) > 0).alias("scored"),
    )
    at = timing.hours_between("t0", "bought")
    before = F.size(F.filter("visits", lambda h: h < F.col("at")))
    k = F.when((F.col("at").isNotNull()) & (before < F.size("visits")), before + 1)
    unit = first.withColumn("at", at).join(visits, "user_id", "left").select("user_id", "scored", k.alias("k"))
    out = timing.event_interval(unit, visits, "user_id", "k", "scored")
    keep = lambda c: F.when(F.abs(F.col(c)) == F.lit(float("inf")), F.col(c)).otherwise(r6(c))
    return out.select("user_id", "k", "scored", keep("lower").alias("lower"), keep("upper").alias("upper"))


@query(
    "visit_edges",
    f"""WITH {VISITS}, each AS (SELECT unnest(visits) AS h, generate_subscripts(visits, 1) AS visit FROM visits)
SELECT CAST(visit AS INTEGER) AS visit, round(avg(h), 6) AS mean_hours, round(min(h), 6) AS min_hours,
       round(max(h), 6) AS max_hours FROM each GROUP BY visit""",
)
def visit_edges(t):
    return rounded(timing.visit_edges(user_visits(t)), "mean_hours", "min_hours", "max_hours")


@query(
    "views_per_unit",
    """SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS views FROM customer
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <> 10""",
)
def views_per_unit(t):
    seen = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("views"))
    out = t.customer.select("c_custkey").join(seen, "c_custkey", "left")
    return out.withColumn("views", F.coalesce("views", F.lit(0)).cast("bigint")).where("views <> 10")


@query(
    "functional_dependency",
    """SELECT o_custkey, min(o_orderpriority) AS low, max(o_orderpriority) AS high FROM orders
GROUP BY o_custkey HAVING min(o_orderpriority) <> max(o_orderpriority)""",
)
def functional_dependency(t):
    return select.functional_dependency(t.orders, "o_custkey", "o_orderpriority")


ORDER_VECTOR = "[o_totalprice, month(o_orderdate)::DOUBLE, day(o_orderdate)::DOUBLE]"


def order_views(t):
    return t.orders.select(
        "o_custkey",
        "o_orderstatus",
        F.array(
            F.col("o_totalprice"), F.month("o_orderdate").cast("double"), F.dayofmonth("o_orderdate").cast("double")
        ).alias("v"),
    )


@query(
    "collapse_views",
    f"""WITH v AS (SELECT o_custkey, o_orderstatus, {ORDER_VECTOR} AS v FROM orders),
blocks AS (SELECT o_custkey, o_orderstatus, round(avg(v[1]), 6) AS v0, round(avg(v[2]), 6) AS v1, round(avg(v[3]), 6) AS v2,
           count(*) AS views FROM v GROUP BY 1, 2)
SELECT o_custkey, o_orderstatus, v0, v1, v2, CAST(views AS BIGINT) AS views, views < 2 AS one_sided FROM blocks
WHERE o_custkey IN (SELECT o_custkey FROM blocks GROUP BY 1 HAVING count(*) = 3)""",
)
def collapse_views(t):
    out = collapse.side_averaged(order_views(t), "o_custkey", ["o_orderstatus"], "v", 3, 3)
    return out.select(
        "o_custkey", "o_orderstatus", *[r6(F.col("v")[i]).alias(f"v{i}") for i in range(3)], "views", "one_sided"
    )


@query(
    "dropped_units",
    """SELECT o_custkey, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS cells FROM orders
GROUP BY 1 HAVING count(DISTINCT o_orderstatus) < 3""",
)
def dropped_units(t):
    return collapse.dropped_units(t.orders, "o_custkey", ["o_orderstatus"], 3)


@query(
    "delta_block",
    f"""WITH v AS (SELECT o_custkey, o_orderstatus, {ORDER_VECTOR} AS v FROM orders),
blocks AS (SELECT o_custkey, o_orderstatus, avg(v[1]) AS a, avg(v[2]) AS b, avg(v[3]) AS c FROM v GROUP BY 1, 2)
SELECT f.o_custkey, round(o.a - f.a, 6) AS d0, round(o.b - f.b, 6) AS d1, round(o.c - f.c, 6) AS d2
FROM blocks f JOIN blocks o ON f.o_custkey = o.o_custkey AND f.o_orderstatus = 'F' AND o.o_orderstatus = 'O'""",
)
def delta_block(t):
    blocks = order_views(t).groupBy("o_custkey", "o_orderstatus").agg(collapse.mean_vector("v", 3).alias("v"))
    out = collapse.delta_block(blocks, "o_custkey", "o_orderstatus", "v", "F", "O")
    return out.select("o_custkey", *[r6(F.col("v")[i]).alias(f"d{i}") for i in range(3)])


@query(
    "stack_blocks",
    f"""WITH v AS (SELECT o_custkey, o_orderstatus, {ORDER_VECTOR} AS v FROM orders),
blocks AS (SELECT o_custkey, o_orderstatus, avg(v[1]) AS a, avg(v[2]) AS b, avg(v[3]) AS c FROM v GROUP BY 1, 2)
SELECT f.o_custkey, round(f.a, 6) AS x0, round(f.b, 6) AS x1, round(f.c, 6) AS x2,
       round(o.a, 6) AS x3, round(o.b, 6) AS x4, round(o.c, 6) AS x5
FROM blocks f JOIN blocks o ON f.o_custkey = o.o_custkey AND f.o_orderstatus = 'F' AND o.o_orderstatus = 'O'""",
)
def stack_blocks(t):
    blocks = order_views(t).groupBy("o_custkey", "o_orderstatus").agg(collapse.mean_vector("v", 3).alias("v"))
    out = collapse.stack_blocks(blocks, "o_custkey", "o_orderstatus", "v", ["F", "O"]).where("v IS NOT NULL")
    return out.select("o_custkey", *[r6(F.col("v")[i]).alias(f"x{i}") for i in range(6)])


@query(
    "aggregate_scores_argmax",
    """WITH s AS (
  SELECT o_custkey, c_nationkey AS y, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS s0,
         avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS s1,
         avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END) AS s2, count(*) AS views
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
)
SELECT o_custkey, y AS y_true, CAST(views AS BIGINT) AS views, round(greatest(s0, s1, s2), 6) AS best,
       CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS y_pred FROM s""",
)
def aggregate_scores_argmax(t):
    parts = [F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).otherwise(0.0) for s in "FOP"]
    o = t.orders.select("o_custkey", F.array(*parts).alias("score"))
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("y"))
    out = metrics.aggregate_scores(o.join(c, "o_custkey"), "o_custkey", "y", "score", 3)
    return out.select("o_custkey", "y_true", "views", r6(F.array_max("score")).alias("best"), "y_pred")


DAYS = (1, 2, 3, 4, 5, 6, 7)
PROFILE_UNITS = f"""{UNITS}, scored AS (
  SELECT u.region, o.first_day FROM units u JOIN (
    SELECT o_custkey, min(CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN year(o_orderdate) - 1994 END) AS first_day
    FROM orders GROUP BY o_custkey) o ON u.c_custkey = o.o_custkey
)"""


@query(
    "incidence_profile",
    f"""WITH {PROFILE_UNITS}, g AS (
  SELECT CASE WHEN grouping(region) = 1 THEN 'all' ELSE region::VARCHAR END AS grp, count(*) AS n,
  {", ".join(f"count(*) FILTER (first_day = {d}) AS day{d}" for d in DAYS)},
  count(*) - count(first_day) AS never, quantile_cont(first_day::DOUBLE, 0.5) AS median_day
  FROM scored GROUP BY GROUPING SETS ((), (region))
)
SELECT grp, CAST(n AS BIGINT) AS n, {", ".join(f"CAST(day{d} AS BIGINT) AS day{d}" for d in DAYS)},
  CAST(never AS BIGINT) AS never, CAST(n - never AS BIGINT) AS germinated,
  round(100.0::DOUBLE * (n - never) / n, 6) AS pct_germinated, median_day,
  CASE WHEN n > never THEN CAST(list_position([{", ".join(f"day{d}" for d in DAYS)}],
    greatest({", ".join(f"day{d}" for d in DAYS)})) AS INTEGER) END AS modal_day,
  {", ".join(f"round(100.0::DOUBLE * ({' + '.join(f'day{x}' for x in DAYS[:i + 1])}) / n, 6) AS cum_pct_day{d}" for i, d in enumerate(DAYS))}
FROM g""",
)
def incidence_profile(t):
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(
            F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200000), F.year("o_orderdate") - 1994)
        ).alias("first_day")
    )
    out = timing.incidence_profile(units(t).join(first, "c_custkey"), "region", "first_day", DAYS)
    return rounded(out, "pct_germinated", *[f"cum_pct_day{d}" for d in DAYS])


def hexkey(col: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}|' || {col}::VARCHAR), 1, 15) AS BIGINT)"


@query(
    "group_folds",
    f"""SELECT n_nationkey, n_regionkey,
  CAST((row_number() OVER (PARTITION BY n_regionkey ORDER BY {hexkey('n_nationkey')}) - 1) % 5 AS INTEGER) AS fold FROM nation""",
)
def group_folds(t):
    return folds.round_robin_folds(t.nation, "n_nationkey", "n_regionkey", 5, SEED)


LATIN = f"""{UNITS}, rates AS (
  SELECT c_nationkey, region, avg((c_acctbal > 2000)::INT::DOUBLE) AS rate FROM units GROUP BY 1, 2
), offs AS (
  SELECT region, row_number() OVER (ORDER BY {hexkey('region')}) - 1 AS off FROM (SELECT DISTINCT region FROM units)
), latin AS (
  SELECT c_nationkey, region, rate, CAST((row_number() OVER (PARTITION BY region ORDER BY rate, {hexkey('c_nationkey')})
         - 1 + off) % 5 AS INTEGER) AS fold FROM rates JOIN offs USING (region)
)"""


def latin(t):
    u = units(t).withColumn("y", (F.col("c_acctbal") > 2000).cast("int"))
    return u, folds.latin_square_folds(u, "c_nationkey", "region", "y", 5, SEED)


@query("latin_square_folds", f"WITH {LATIN} SELECT c_nationkey, region, round(rate, 6) AS rate, fold FROM latin")
def latin_square_folds(t):
    return rounded(latin(t)[1], "rate")


@query(
    "fold_leakage",
    f"""WITH {LATIN}, a AS (SELECT c_custkey, c_nationkey, region, fold FROM units JOIN latin USING (c_nationkey, region))
SELECT unit, CAST(count(*) FILTER (lo <> hi) AS BIGINT) AS leaking FROM (
  SELECT 'unit' AS unit, min(fold) AS lo, max(fold) AS hi FROM a GROUP BY c_custkey UNION ALL
  SELECT 'group', min(fold), max(fold) FROM a GROUP BY c_nationkey UNION ALL
  SELECT 'stratum', min(fold), max(fold) FROM a GROUP BY region) GROUP BY unit""",
)
def fold_leakage(t):
    u, f = latin(t)
    a = folds.attach_folds(u, f, "c_nationkey")
    counts = [
        folds.leakage(a, col).agg(F.lit(name).alias("unit"), F.count(F.lit(1)).alias("leaking"))
        for name, col in (("unit", "c_custkey"), ("group", "c_nationkey"), ("stratum", "region"))
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "gaps_islands",
    """WITH s AS (SELECT DISTINCT o_orderstatus, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS i FROM orders
            WHERE o_totalprice > 300000),
g AS (SELECT o_orderstatus, i, i - row_number() OVER (PARTITION BY o_orderstatus ORDER BY i) AS k FROM s)
SELECT o_orderstatus, CAST(min(i) AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last FROM g GROUP BY o_orderstatus, k""",
)
def gaps_islands(t):
    days = t.orders.where("o_totalprice > 300000").select(
        "o_orderstatus", F.unix_date(F.to_date("o_orderdate")).alias("day")
    )
    return select.index_runs(days, ["o_orderstatus"], "day").select("o_orderstatus", "first", "last")


@query(
    "dup_keys",
    """SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""",
)
def dup_keys(t):
    return select.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "row_numbers",
    "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS row FROM orders",
)
def row_numbers(t):
    return select.row_numbers(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select(
        "o_orderkey", "row"
    )


@query(
    "first_per_unit",
    """SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus
FROM orders GROUP BY o_custkey""",
)
def first_per_unit(t):
    return select.first_per(t.orders, ["o_custkey"], "o_orderkey", ["o_orderstatus"])


@query(
    "unit_set_algebra",
    """WITH f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000),
o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 250000)
SELECT 'both' AS part, o_custkey FROM (SELECT * FROM f INTERSECT SELECT * FROM o) UNION ALL
SELECT 'only_f', o_custkey FROM (SELECT * FROM f EXCEPT SELECT * FROM o) UNION ALL
SELECT 'any', o_custkey FROM (SELECT * FROM f UNION SELECT * FROM o)""",
)
def unit_set_algebra(t):
    big = t.orders.where("o_totalprice > 250000")
    f = big.where("o_orderstatus = 'F'").select("o_custkey")
    o = big.where("o_orderstatus = 'O'").select("o_custkey")
    tag = lambda name, df: df.select(F.lit(name).alias("part"), "o_custkey")
    return (
        tag("both", f.intersect(o))
        .unionByName(tag("only_f", f.subtract(o)))
        .unionByName(tag("any", f.union(o).distinct()))
    )
