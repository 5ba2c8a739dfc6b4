"""The event log, and analytic forms over orders that complete the engine: as-of and interval joins, rollups, frames."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators import temporal
from quillstone.plans.registry import query
from quillstone.session import table
from quillstone.streaming import events as st

_STATE = "".join(f" WHEN s.state = '{a}' AND e.event_type = '{b}' THEN '{c}'" for (a, b), c in st.TRANSITIONS.items())


@query("""WITH t AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events),
    w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL)
    SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, events, total FROM w, t WHERE start + INTERVAL 1 HOUR <= mark""")
def stream_hourly(spark, sf):
    """A stream of events into hours of event time; hours that the watermark has closed."""
    stream = st.tumbling(st.log(spark, f"{sf}/events.parquet"), ["event_type"], "ts", "value", "1 hour", "10 minutes")
    done = st.drain(stream)
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "events", F.round("total", 6).alias("total"))


@query("SELECT count(*) AS events, count(DISTINCT event_id) AS ids, min(event_id) AS first_id, max(event_id) AS last_id FROM events")
def stream_once(spark, sf):
    """Events taken once each although the log is delivered twice."""
    log = st.log(spark, f"{sf}/events.parquet")
    taken = st.drain(st.once(log.unionByName(log), ["event_id"], "ts", "365 days").select("event_id"))
    return taken.agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 'NEW' AS state, 0::BIGINT AS moves, 0::BIGINT AS conflicts FROM events
        UNION ALL SELECT s.user_id, e.n, CASE{_STATE} ELSE s.state END, s.moves + CASE WHEN (CASE{_STATE} END) IS NOT NULL THEN 1 ELSE 0 END,
            s.conflicts + CASE WHEN (CASE{_STATE} END) IS NULL THEN 1 ELSE 0 END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT user_id, arg_max(state, n) AS state, max(moves) AS moves, max(conflicts) AS conflicts FROM s GROUP BY ALL""")
def stream_states(spark, sf):
    """The state machine of each user, kept by the stream."""
    states = st.drain(st.state_machine(st.log(spark, f"{sf}/events.parquet"), "user_id", "event_type", "event_id"))
    return st.latest_state(states, "user_id")


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 'NEW' AS state, 0::BIGINT AS moves, 0::BIGINT AS conflicts FROM events
        UNION ALL SELECT s.user_id, e.n, CASE{_STATE} ELSE s.state END, s.moves + CASE WHEN (CASE{_STATE} END) IS NOT NULL THEN 1 ELSE 0 END,
            s.conflicts + CASE WHEN (CASE{_STATE} END) IS NULL THEN 1 ELSE 0 END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT user_id, arg_max(state, n) AS state, max(moves) AS moves, max(conflicts) AS conflicts FROM s GROUP BY ALL""")
def replayed_states(spark, sf):
    """The same as a batch."""
    return st.replayed(table(spark, sf, "events"), "user_id", "event_type", "event_id")


@query("SELECT * FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def event_page(spark, sf):
    """A page of the log behind a cursor: 100 rows by definition."""
    return st.after_cursor(table(spark, sf, "events"), 500)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, n""")
def user_sessions(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = st.sessions(rows, ["user_id"], "ts", "30 minutes")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


@query("""SELECT event_type, (props::JSON->>'k')::INT % 10 AS bucket, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def events_by_property(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))


@query("""SELECT v.event_id, p.event_id AS last_purchase, p.value AS paid FROM events v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase'
    QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) p ON v.user_id = p.user_id AND v.ts >= p.ts WHERE v.event_type = 'view'""")
def last_purchase(spark, sf):
    """Each view with the user's last purchase until then."""
    rows = table(spark, sf, "events")
    w = Window.partitionBy("user_id", "ts").orderBy(F.desc("event_id"))
    bought = rows.where("event_type = 'purchase'").withColumn("n", F.row_number().over(w)).where("n = 1").select(
        "user_id", "ts", F.col("event_id").alias("last_purchase"), F.col("value").alias("paid"))
    return temporal.as_of(rows.where("event_type = 'view'").select("user_id", "ts", "event_id"), bought, ["user_id"], "ts", ["last_purchase", "paid"]).select("event_id", "last_purchase", "paid")


@query("""SELECT e.event_id AS error_id, count(*) AS near FROM events e JOIN events v ON v.user_id = e.user_id AND v.ts >= e.ts - INTERVAL 1 HOUR AND v.ts < e.ts + INTERVAL 1 HOUR
    WHERE e.event_type = 'error' AND v.event_type <> 'error' GROUP BY ALL""")
def around_errors(spark, sf):
    """Other events of the user within an hour of each error."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    hour = F.expr("INTERVAL 1 HOUR")
    spans = rows.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), (F.col("ts") - hour).alias("a"), (F.col("ts") + hour).alias("b"))
    near = temporal.interval_join(rows.where("event_type <> 'error'").select("user_id", "ts"), spans, ["user_id"], "ts", "a", "b", 7200)
    return near.groupBy("error_id").agg(F.count("*").alias("near"))


@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total, grouping(r_name) + grouping(n_name) AS level FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def orders_rollup(spark, sf):
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = table(spark, sf, "orders").select("o_custkey", "o_totalprice").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = rows.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), (F.grouping("r_name") + F.grouping("n_name")).alias("level"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf):
    lines = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("discount"))


@query("""SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER w, 2) AS last_three, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING)""")
def order_frames(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"), F.ntile(4).over(w).alias("quarter"))
