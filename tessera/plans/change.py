"""Queries of publishing, validation, hashing and keyed state over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import browse, merge
from tessera.session import shared_folder, table
from tessera.streaming import memory, state

FIELDS = ["o_orderstatus", "o_totalprice"]


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders").select("o_orderkey", *FIELDS)
    status = F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))
    return orders.where("o_orderkey % 7 <> 0"), orders.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", status)


SNAPSHOTS = """
WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0),
j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert'
    WHEN n.o_orderkey IS NULL THEN CASE WHEN o.o_totalprice > 250000 THEN 'retire' ELSE 'delete' END
    WHEN o.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus AND o.o_totalprice IS NOT DISTINCT FROM n.o_totalprice THEN 'skip' ELSE 'update' END AS action,
  CASE WHEN n.o_orderkey IS NULL THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus,
  CASE WHEN n.o_orderkey IS NULL THEN o.o_totalprice ELSE n.o_totalprice END AS o_totalprice
  FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
"""


def _acted(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return merge.actions(old, new, "o_orderkey", FIELDS, F.col("o_totalprice") > 250000)


def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """What each row of two snapshots needs."""
    return _acted(spark, d)


def merge_retire(spark: SparkSession, d: str) -> DataFrame:
    """The table after the merge: rows that are gone but to be kept are retired."""
    return merge.merged(_acted(spark, d))


def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    return _acted(spark, d).groupBy("action").agg(F.count("*").alias("n"))


def merge_guard(spark: SparkSession, d: str) -> DataFrame:
    return merge.shrink_guard(*_snapshots(spark, d), 0.9)


def quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Violations of each rule, in one pass over the lines."""
    rules = {
        "quantity_positive": F.col("l_quantity") > 0,
        "discount_small": F.col("l_discount") <= 0.07,
        "linenumber_known": F.col("l_linenumber").between(1, 6),
        "flag_known": F.col("l_returnflag").isin("A", "R"),
        "shipped_before_2002": F.col("l_shipdate") < "2002-01-01",
    }
    return merge.violations(table(spark, d, "lineitem"), rules)


QUALITY = """
SELECT 'quantity_positive' AS rule, count(*) FILTER (NOT coalesce(l_quantity > 0, false)) AS violations, count(*) AS checked FROM lineitem
UNION ALL SELECT 'discount_small', count(*) FILTER (NOT coalesce(l_discount <= 0.07::DOUBLE, false)), count(*) FROM lineitem
UNION ALL SELECT 'linenumber_known', count(*) FILTER (NOT coalesce(l_linenumber BETWEEN 1 AND 6, false)), count(*) FROM lineitem
UNION ALL SELECT 'flag_known', count(*) FILTER (NOT coalesce(l_returnflag IN ('A', 'R'), false)), count(*) FROM lineitem
UNION ALL SELECT 'shipped_before_2002', count(*) FILTER (NOT coalesce(l_shipdate < '2002-01-01', false)), count(*) FROM lineitem"""


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(F.concat_ws("|", "lang", "source", "text"), 256).alias("sha256"))


CONTENT_HASH = "SELECT doc_id, sha256(lang || '|' || source || '|' || text) AS sha256 FROM documents"


def stable_pick(spark: SparkSession, d: str) -> DataFrame:
    """A hash of a text key picks a place among the customers, the same every day that has the name."""
    nation = table(spark, d, "nation")
    return nation.select("n_nationkey", scalar.stable_hash(F.concat(F.lit("2024-01-01:"), F.col("n_name"))).alias("hash")).withColumn("pick", F.pmod("hash", F.lit(25)))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five documents of each language, by the hash of their id."""
    docs = table(spark, d, "documents").select("doc_id", "lang").withColumn("h", F.md5(F.col("doc_id").cast("string")))
    return browse.top_by(docs, ["lang"], [F.col("h")], 5).select("lang", "doc_id")


STRATIFIED = "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) <= 5"


def json_props(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    k = F.from_json("props", "k long")["k"]
    return events.select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


JSON = """SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most
FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1"""


def rolling_cap_24h(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of the user in the 24 hours before, itself left out, and whether a cap allows another."""
    counted = state.rolling_count(table(spark, d, "events"), "user_id", "ts", 86_400, "event_id")
    return counted.select("event_id", "before", (F.col("before") < 3).alias("allowed"))


ROLLING = """SELECT event_id, b AS before, b < 3 AS allowed FROM (SELECT event_id, count(event_id) OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS b FROM events)"""


def tumbling_rate(spark: SparkSession, d: str) -> DataFrame:
    """Failures by user and hour, over the limit or not."""
    counted = state.tumbling_counts(table(spark, d, "events").where("event_type = 'error'"), "user_id", "ts", "6 hours")
    return counted.select("user_id", "window_start", "n", (F.col("n") > 1).alias("limited"))


TUMBLING = """SELECT user_id, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, count(*) > 1 AS limited FROM events
WHERE event_type = 'error' GROUP BY 1, 2"""


def tumbling_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same counts by a stream with a watermark, run to its end over the files that are there."""
    source, out = f"{d}/events.parquet", shared_folder(spark, "stream")
    events = spark.read.parquet(source)
    files = events.inputFiles()  # a table is a file, or a folder of files
    whole = spark.readStream.schema(events.schema)
    stream = whole.option("pathGlobFilter", "events.parquet").parquet(d) if len(files) == 1 and files[0].endswith("/events.parquet") else whole.parquet(source)
    counted = state.tumbling_counts(stream.where("event_type = 'error'"), "user_id", "ts", "6 hours", "40 days")

    # each batch gives the windows that it changed; the state holds only those that the watermark has not passed
    def store(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/part={n}")

    query = counted.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{out}/rows").groupBy("user_id", "window_start").agg(F.max_by("n", "batch").alias("n"))
    return last.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", (F.col("n") > 1).alias("limited"))


def threshold_cross(spark: SparkSession, d: str) -> DataFrame:
    found = state.crossings(table(spark, d, "events"), "user_id", "ts", "value", [20.0, 50.0], "event_id")
    return found.select("event_id", F.col("zone").cast("int").alias("zone"), F.col("zone_before").cast("int").alias("zone_before"))


CROSS = """
WITH z AS (SELECT event_id, user_id, ts, CAST((value > 20)::INT + (value > 50)::INT AS INT) AS zone FROM events),
b AS (SELECT event_id, zone, lag(zone) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS zone_before FROM z)
SELECT * FROM b WHERE zone > zone_before"""


def first_hit_window(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a day that open at a user's first hit; the first three hits of one are allowed."""
    return state.first_hit_windows(table(spark, d, "events"), "user_id", "ts", 86_400, 3, "event_id")


FIRST_HIT = """
WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w(user_id, i, event_id, ts, window_start, nth) AS (
  SELECT user_id, i, event_id, ts, ts, 1 FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, o.event_id, o.ts, CASE WHEN o.ts - w.window_start >= INTERVAL 1 DAY THEN o.ts ELSE w.window_start END,
    CASE WHEN o.ts - w.window_start >= INTERVAL 1 DAY THEN 1 ELSE w.nth + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
SELECT user_id, event_id, window_start, CAST(nth AS INT) AS nth, nth <= 3 AS allowed FROM w"""


#: What the kinds of events do to a clock.
ACTIONS = {"purchase": "start", "error": "pause", "click": "toggle", "view": "lap", "signup": "reset"}


def lap_clocks(spark: SparkSession, d: str) -> DataFrame:
    """A pausable clock for each user, with laps, that their events start, stop and reset."""
    action = F.lit(None).cast("string")
    for kind, what in ACTIONS.items():
        action = F.when(F.col("event_type") == kind, what).otherwise(action)
    return state.clocks(table(spark, d, "events"), "user_id", "ts", "event_id", action)


#: Event by event, each from the state before it.
LAP_CLOCKS = f"""
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS at_, CASE event_type {" ".join(f"WHEN '{k}' THEN '{a}'" for k, a in ACTIONS.items())} ELSE '' END AS act,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w(user_id, i, event_id, at_, running, elapsed, laps) AS (
  SELECT user_id, i, event_id, at_, act IN ('start', 'toggle'), 0::BIGINT, 0 FROM o WHERE i = 1
  UNION ALL SELECT user_id, i, event_id, at_, CASE act WHEN 'start' THEN true WHEN 'pause' THEN false WHEN 'reset' THEN false WHEN 'toggle' THEN NOT was ELSE was END, now_,
    CASE WHEN act = 'reset' THEN 0 WHEN act = 'lap' AND now_ > 0 THEN least(laps + 1, 30) ELSE laps END FROM (
      SELECT o.user_id, o.i, o.event_id, o.at_, o.act, w.running AS was, w.laps, CASE WHEN o.act = 'reset' THEN 0 ELSE w.elapsed + CASE WHEN w.running THEN o.at_ - w.at_ ELSE 0 END END AS now_
      FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1))
SELECT user_id, event_id, running, elapsed, laps FROM w"""

#: Hours for which a found answer is remembered, and one that failed.
KEPT_HOURS, FAILED_HOURS = 96, 12


def check_memory(spark: SparkSession, d: str) -> DataFrame:
    """Which of a user's events had to be asked for, and which were answered from memory: purchases and views find something."""
    events = table(spark, d, "events").withColumn("found", F.col("event_type").isin("purchase", "view"))
    return memory.remembered(events, "user_id", "ts", "found", "event_id", KEPT_HOURS * 3_600, FAILED_HOURS * 3_600)


def check_memory_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream with keyed state and timers: it is started anew for each fifth of the time, from its checkpoint."""
    events = table(spark, d, "events").withColumn("found", F.col("event_type").isin("purchase", "view")).withColumn("ts", F.col("ts").cast("timestamp"))
    path, out = shared_folder(spark, "arrived"), shared_folder(spark, "answers")
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if first is None:
        return check_memory(spark, d)
    fifth = F.floor((F.unix_micros("ts") - first) * 5 / (last - first + 1))
    before = spark.conf.get(memory.STORE[0])
    spark.conf.set(*memory.STORE)
    try:
        for k in range(5):
            events.where(fifth == k).write.mode("append").parquet(path)
            stream = spark.readStream.schema(events.schema).parquet(path)
            made = memory.remembered_stream(stream, "user_id", "ts", "found", "event_id", "1 hour", KEPT_HOURS * 3_600, FAILED_HOURS * 3_600)
            writer = made.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows")
            writer.format("parquet").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(memory.STORE[0], before)
    return spark.read.schema("user_id long, event_id long, asked boolean, answer boolean").parquet(f"{out}/rows")


CHECKED = f"""
WITH RECURSIVE o AS (SELECT user_id, event_id, ts, event_type IN ('purchase', 'view') AS found, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w(user_id, i, event_id, asked_at, asked, answer) AS (
  SELECT user_id, i, event_id, ts, true, found FROM o WHERE i = 1
  UNION ALL SELECT user_id, i, event_id, CASE WHEN again THEN ts ELSE asked_at END, again, CASE WHEN again THEN found ELSE answer END FROM (
    SELECT o.user_id, o.i, o.event_id, o.ts, o.found, w.asked_at, w.answer,
      o.ts - w.asked_at >= CASE WHEN w.answer THEN INTERVAL {KEPT_HOURS} HOUR ELSE INTERVAL {FAILED_HOURS} HOUR END AS again FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1))
SELECT user_id, event_id, asked, answer FROM w"""


def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """A bucket of three tokens for each user, one more every 600 minutes."""
    return state.token_bucket(table(spark, d, "events"), "user_id", "ts", 1 / 600, 3, "event_id")


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return state.first_seen(table(spark, d, "events"), "user_id", "ts")


FIRST_SEEN = "SELECT user_id, min(ts) AS first_seen FROM events GROUP BY 1"


def alive_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Users with a session that had not expired at a moment, each kind of it once."""
    events = table(spark, d, "events").withColumn("expires", F.col("ts").cast("timestamp") + F.make_interval(hours=F.floor("value").cast("int")))
    held = state.alive(events.where("ts <= '2024-01-20'"), "expires", F.to_timestamp(F.lit("2024-01-20 00:00:00")))
    return state.once(held, ["user_id", "event_type"], "ts", "1 day").select("user_id", "event_type")


ALIVE = """SELECT DISTINCT user_id, event_type FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND ts + to_hours(CAST(floor(value) AS INT)) > TIMESTAMP '2024-01-20'"""


def noop_updates(spark: SparkSession, d: str) -> DataFrame:
    """Which of a row's saves changed it: saves of the same values don't count as edits."""
    from pyspark.sql import Window

    last = Window.partitionBy("user_id").orderBy("event_id")
    saved = table(spark, d, "events").select("user_id", "event_id", F.struct("event_type", (F.floor("value") % 3).alias("v")).alias("now")).withColumn("before", F.lag("now").over(last))
    return saved.where(~F.col("before").eqNullSafe(F.col("now"))).groupBy("user_id").agg(F.count("*").alias("n_edits"), F.max("event_id").alias("last_edit"))


NOOP = """
WITH s AS (SELECT user_id, event_id, event_type AS t, floor(value) % 3 AS v, lag(event_type) OVER w AS bt, lag(floor(value) % 3) OVER w AS bv, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) AS n_edits, max(event_id) AS last_edit FROM s WHERE n = 1 OR t IS DISTINCT FROM bt OR v IS DISTINCT FROM bv GROUP BY 1"""


def festival_phase(spark: SparkSession, d: str) -> DataFrame:
    """The phase of an order as of a day, and the days until it ships at the latest."""
    now = F.to_date(F.lit("1998-06-01"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("end"))
    dated = table(spark, d, "orders").join(lines, "o_orderkey", "left").withColumn("start", F.to_date("o_orderdate"))
    return dated.select("o_orderkey", scalar.phase(F.col("start"), F.col("end"), now).alias("phase"), scalar.days_until(F.col("end"), now).cast("long").alias("days"))


PHASE = """
WITH l AS (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS e FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, e, coalesce(e, CAST(o_orderdate AS DATE)) AS f FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, CASE WHEN f < DATE '1998-06-01' THEN 'over' WHEN s = DATE '1998-06-01' AND f = DATE '1998-06-01' THEN 'today' WHEN s <= DATE '1998-06-01' THEN 'ongoing' ELSE 'upcoming' END AS phase,
  e - DATE '1998-06-01' AS days FROM d"""

QUERIES = {
    "merge_upsert": (merge_upsert, SNAPSHOTS + "SELECT o_orderkey, action, o_orderstatus, o_totalprice FROM j"),
    "merge_retire": (merge_retire, SNAPSHOTS + "SELECT o_orderkey, o_orderstatus, o_totalprice, action = 'retire' AS retired FROM j WHERE action <> 'delete'"),
    "merge_counts": (merge_counts, SNAPSHOTS + "SELECT action, count(*) AS n FROM j GROUP BY 1"),
    "merge_guard": (merge_guard, SNAPSHOTS + "SELECT (SELECT count(*) FROM o) AS n_old, (SELECT count(*) FROM n) AS n_new, (SELECT count(*) FROM n) >= 0.9 * (SELECT count(*) FROM o) AS allowed"),
    "quality_rules": (quality_rules, QUALITY),
    "content_hash": (content_hash, CONTENT_HASH),
    "stable_pick": (stable_pick, None),
    "stratified_sample": (stratified_sample, STRATIFIED),
    "json_props": (json_props, JSON),
    "rolling_cap_24h": (rolling_cap_24h, ROLLING),
    "tumbling_rate": (tumbling_rate, TUMBLING),
    "tumbling_stream": (tumbling_stream, TUMBLING),
    "threshold_cross": (threshold_cross, CROSS),
    "first_hit_window": (first_hit_window, FIRST_HIT),
    "lap_clocks": (lap_clocks, LAP_CLOCKS),
    "check_memory": (check_memory, CHECKED),
    "check_memory_stream": (check_memory_stream, CHECKED),
    "token_bucket": (token_bucket, None),
    "first_seen": (first_seen, FIRST_SEEN),
    "alive_sessions": (alive_sessions, ALIVE),
    "noop_updates": (noop_updates, NOOP),
    "festival_phase": (festival_phase, PHASE),
}
