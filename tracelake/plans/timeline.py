"""Timeline and entity queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators import correlate, graph, pages
from tracelake.session import table
from tracelake.streaming import windows

from .registry import query


def micros(column: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def moment(text: str) -> Column:
    """A TIMESTAMP_NTZ literal, so that comparing needs no cast of the column and reaches the scan."""
    return F.lit(text).cast("timestamp_ntz")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a participant: the actor, and the host that the event was seen on."""
    events, customers = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    actors = events.join(customers, F.col("user_id") == F.col("c_custkey")).select("event_id", F.lit("actor").alias("role"), F.col("c_name").alias("name"))
    hosts = events.select("event_id", F.lit("host").alias("role"), F.concat(F.lit("host"), (F.col("user_id") % 4).cast("string")).alias("name"))
    return actors.unionByName(hosts)


_PARTICIPANTS = """
SELECT event_id, 'actor' AS role, c_name AS name FROM events JOIN customer ON user_id = c_custkey
UNION ALL SELECT event_id, 'host', 'host' || (user_id % 4)::VARCHAR FROM events"""


def with_participants(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """A page's rows with their participants, which only the page's own rows are looked up for."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("actor="), "c_name").alias("actor"))
    host = F.concat(F.lit("host=host"), (F.col("user_id") % 4).cast("string"))
    return events.join(customers, "user_id", "left").withColumn("participants", F.concat_ws(";", "actor", host))


def _page(spark: SparkSession, sf_dir: str, key: tuple | None) -> DataFrame:
    events = table(spark, sf_dir, "events")
    chosen = pages.where_given(events, range=pages.in_range(F.col("ts"), moment("2024-01-05"), moment("2024-01-20")), kind=pages.one_of(F.col("event_type"), ["click", "purchase"]))
    one = pages.page(chosen, ["ts", "event_id"], key, 200)
    return with_participants(spark, sf_dir, one.select("event_id", "user_id", "ts", "event_type", "more")).select("event_id", micros("ts").alias("ts_us"), "event_type", "more", "participants")


def _page_sql(key: str) -> str:
    return f"""
WITH rest AS (SELECT *, count(*) OVER () > 200 AS more FROM events
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('click', 'purchase') {key}),
one AS (SELECT * FROM rest ORDER BY ts, event_id LIMIT 200),
listed AS (SELECT event_id, string_agg(role || '=' || name, ';' ORDER BY role, name) AS participants FROM ({_PARTICIPANTS}) GROUP BY event_id)
SELECT event_id, epoch_us(ts) AS ts_us, event_type, more, coalesce(participants, '') AS participants FROM one LEFT JOIN listed USING (event_id)"""


@query(_page_sql(""))
def timeline_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, None)


@query(_page_sql("AND (ts, event_id) > (TIMESTAMP '2024-01-10 12:00:00', 100)"))
def timeline_page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, (moment("2024-01-10 12:00:00"), 100))


@query("SELECT event_id, epoch_us(ts) AS ts_us, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def timeline_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(pages.in_range(F.col("ts"), moment("2024-01-05"), moment("2024-01-20"))).select("event_id", micros("ts").alias("ts_us"), "event_type")


@query("SELECT event_id, user_id, event_type FROM events WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_mktsegment = 'BUILDING')")
def timeline_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf_dir, "events").join(wanted, F.col("user_id") == F.col("c_custkey"), "left_semi").select("event_id", "user_id", "event_type")


@query(f"SELECT event_id, string_agg(role || '=' || name, ';' ORDER BY role, name) AS participants FROM ({_PARTICIPANTS}) GROUP BY event_id")
def timeline_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = participants(spark, sf_dir).groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "name"))), lambda p: F.concat(p["role"], F.lit("="), p["name"])), ";").alias("participants"))
    return table(spark, sf_dir, "events").select("event_id").join(listed, "event_id", "left").withColumn("participants", F.coalesce("participants", F.lit("")))


@query("SELECT event_id, event_type, count(*) OVER () > 100 AS more FROM (SELECT event_id, event_type FROM events WHERE event_id < 900 ORDER BY event_id DESC LIMIT 101) ORDER BY event_id DESC LIMIT 100")
def page_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], (900,), 100, descending=True)


@query(f"""
SELECT e.event_id, epoch_us(ts) AS ts_us, event_type, participants, coalesce('order:' || o_orderkey, 'events:' || e.event_id) AS locator,
       coalesce(o_orderpriority, 'parser' || (json_extract(props, '$.k')::BIGINT % 3)) AS parser
FROM events e JOIN (SELECT event_id, string_agg(role || '=' || name, ';' ORDER BY role, name) AS participants FROM ({_PARTICIPANTS}) GROUP BY event_id) USING (event_id)
LEFT JOIN orders ON o_orderkey = e.event_id""")
def event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants, and the locator and parser of an artifact, with the event's own where there is none."""
    events, orders = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    full = with_participants(spark, sf_dir, events).join(orders, F.col("event_id") == F.col("o_orderkey"), "left")
    parser = F.concat(F.lit("parser"), (F.get_json_object("props", "$.k").cast("bigint") % 3).cast("string"))
    return full.select("event_id", micros("ts").alias("ts_us"), "event_type", "participants", F.coalesce(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")), F.concat(F.lit("events:"), F.col("event_id").cast("string"))).alias("locator"), F.coalesce("o_orderpriority", parser).alias("parser"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, n, sum(n) OVER ()::BIGINT AS total, row_number() OVER (ORDER BY n DESC, event_type) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def kind_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = event_kind_counts(spark, sf_dir)  # a row for each kind: the windows are small
    return counts.select("event_type", "n", F.sum("n").over(Window.partitionBy()).alias("total"), F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("bigint").alias("place"))


@query("""
WITH b AS (SELECT min(epoch_ms(ts)) AS lo, max(epoch_ms(ts)) - min(epoch_ms(ts)) + 1 AS width FROM events),
c AS (SELECT least(31, (epoch_ms(ts) - lo) * 32 // width) AS bin, count(*) AS n FROM events, b GROUP BY 1)
SELECT r.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(32)) AS bin) r LEFT JOIN c USING (bin)""")
def timeline_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in 32 bins of equal width; one row of bounds is broadcast."""
    events = table(spark, sf_dir, "events").select(F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ms"))
    limits = events.agg(F.min("ms").alias("lo"), (F.max("ms") - F.min("ms") + 1).alias("width"))
    counts = events.join(F.broadcast(limits)).groupBy(F.expr("least(31, (ms - lo) * 32 div width)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(32).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS rank FROM events) WHERE rank <= 5")
def entity_recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = pages.top_per_group(table(spark, sf_dir, "events"), ["user_id"], [F.desc_nulls_last("ts"), F.asc("event_id")], 5)
    return recent.select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id")
def entity_first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z")).select("user_id", micros("a").alias("first_us"), micros("z").alias("last_us"))


@query("""
SELECT c_custkey, c_name, coalesce(n_orders, 0) AS n_orders, coalesce(n_events, 0) AS n_events FROM customer
LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1) USING (c_custkey)
LEFT JOIN (SELECT user_id AS c_custkey, count(*) AS n_events FROM events GROUP BY 1) USING (c_custkey)""")
def entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_events"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left").join(events, "c_custkey", "left").na.fill(0, ["n_orders", "n_events"])


@query("""SELECT c_custkey, c_name, count(*) OVER () > 50 AS more FROM (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY' AND (c_name, c_custkey) > ('Customer#000000040', 0)
ORDER BY c_name, c_custkey LIMIT 51) ORDER BY c_name, c_custkey LIMIT 50""")
def entity_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name")
    return pages.page(found, ["c_name", "c_custkey"], ("Customer#000000040", 0), 50)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges: supplier - part by line items, customer - nation."""
    supplies = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target")).agg(F.count(F.lit(1)).alias("weight"))
    lives = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target"), F.lit(1).cast("bigint").alias("weight"))
    return supplies.withColumn("kind", F.lit("SUPPLIES")).unionByName(lives.withColumn("kind", F.lit("LOCATED_ON")))


_EDGES = """(SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, count(*) AS weight, 'SUPPLIES' AS kind FROM lineitem GROUP BY 1, 2
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 1, 'LOCATED_ON' FROM customer)"""


@query(f"""SELECT node, direction, kind, count(*) AS n FROM (SELECT source AS node, 'out' AS direction, kind FROM {_EDGES} UNION ALL SELECT target, 'in', kind FROM {_EDGES}) GROUP BY 1, 2, 3""")
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.both_ways(edges(spark, sf_dir)).groupBy("node", "direction", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT source, target, kind, weight, coalesce(s_name, c_name) AS source_name, coalesce(p_name, n_name) AS target_name, weight <= 100 AS complete FROM {_EDGES}
LEFT JOIN supplier ON source = 's' || s_suppkey LEFT JOIN customer ON source = 'c' || c_custkey LEFT JOIN part ON target = 'p' || p_partkey LEFT JOIN nation ON target = 'n' || n_nationkey""")
def edge_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends' names; complete tells whether all provenance rows fit a page of 100."""
    name = lambda t, letter, key, label: table(spark, sf_dir, t).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("node"), F.col(label).alias("name"))
    names = name("supplier", "s", "s_suppkey", "s_name").union(name("customer", "c", "c_custkey", "c_name")).union(name("part", "p", "p_partkey", "p_name")).union(name("nation", "n", "n_nationkey", "n_name"))
    return graph.with_ends(edges(spark, sf_dir), names).withColumn("complete", F.col("weight") <= 100).select("source", "target", "kind", "weight", "source_name", "target_name", "complete")


@query(f"""SELECT other, kind, weight FROM (SELECT target AS other, kind, weight FROM {_EDGES} WHERE source = 's1' UNION ALL SELECT source, kind, weight FROM {_EDGES} WHERE target = 's1' AND source <> 's1')""")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(edges(spark, sf_dir), "s1").select("other", "kind", "weight")


@query(f"""WITH nodes AS (SELECT 's1' AS node UNION SELECT target FROM {_EDGES} WHERE source = 's1' UNION SELECT source FROM {_EDGES} WHERE target = 's1'),
more AS (SELECT node FROM nodes UNION SELECT 's2' UNION SELECT 's3')
SELECT source, target, kind, weight FROM {_EDGES} WHERE source IN (SELECT node FROM more) AND target IN (SELECT node FROM more)""")
def graph_induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges among one node's neighbourhood and two nodes opened later."""
    all_edges = edges(spark, sf_dir)
    nodes = graph.neighbours(all_edges, "s1").select(F.col("other").alias("node")).union(spark.createDataFrame([("s1",), ("s2",), ("s3",)], "node string")).distinct()
    return graph.induced(all_edges, nodes).select("source", "target", "kind", "weight")


_TIMES = (("erstellt_unix", "erstellt"), ("geloescht_unix", "geloescht"), ("letzte_aenderung_unix", "geaendert"), ("zeit_unix", "ereignis"))


@query("""
WITH f AS (SELECT event_id, event_type, user_id, epoch_us(ts) // 1000000 AS s, json_extract(props, '$.k')::BIGINT AS k FROM events),
t AS (SELECT event_id, event_type, user_id, 'zeit_unix' AS time_key, 'ereignis' AS event, s::VARCHAR AS v FROM f
 UNION ALL SELECT event_id, event_type, user_id, 'erstellt_unix', 'erstellt', CASE WHEN k % 2 = 0 THEN (s - k)::VARCHAR ELSE 'n/a' END FROM f
 UNION ALL SELECT event_id, event_type, user_id, 'letzte_aenderung_unix', 'geaendert', CASE WHEN k % 3 = 0 THEN (s + k)::VARCHAR END FROM f)
SELECT event_id AS finding_index, event_type AS domain, 'user' || user_id AS name, time_key, event, v::BIGINT AS unix FROM t WHERE regexp_full_match(v, '-?[0-9]+')""")
def super_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every time attribute that is a number; findings carry up to three here."""
    seconds = F.floor(micros("ts") / 1000000).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("bigint")
    attributes = F.create_map(F.lit("zeit_unix"), seconds.cast("string"), F.lit("erstellt_unix"), F.when(k % 2 == 0, (seconds - k).cast("string")).otherwise("n/a"), F.lit("letzte_aenderung_unix"), F.when(k % 3 == 0, (seconds + k).cast("string")))
    findings = table(spark, sf_dir, "events").select(F.col("event_id").alias("finding_index"), F.col("event_type").alias("domain"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"), attributes.alias("attributes"))
    return correlate.super_timeline(findings, _TIMES).select("finding_index", "domain", "name", "time_key", "event", "unix")


@query("""
SELECT o_orderkey AS mft_record, kind, name_index, filetime FROM (
 SELECT o_orderkey, 'B' AS kind, NULL::BIGINT AS name_index, epoch_us(o_orderdate) * 10 + 116444736000000000 AS filetime FROM orders
 UNION ALL SELECT o_orderkey, 'M', NULL, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE epoch_us(o_orderdate) * 10 + 116444736000000001 END FROM orders
 UNION ALL SELECT o_orderkey, 'C', NULL, epoch_us(o_orderdate) * 10 + 116444736000000002 FROM orders
 UNION ALL SELECT o_orderkey, 'A', NULL, 0 FROM orders
 UNION ALL SELECT l_orderkey, 'B', l_linenumber::BIGINT, epoch_us(l_shipdate) * 10 + 116444736000000000 FROM lineitem WHERE l_returnflag <> 'A') WHERE filetime <> 0""")
def macb_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard times of a record and creation times of its names, unset ones and DOS names left out."""
    ticks = lambda c: micros(c) * 10 + 116444736000000000
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mft_record"), F.struct(ticks("o_orderdate").alias("created"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(ticks("o_orderdate") + 1).alias("modified"), (ticks("o_orderdate") + 2).alias("mft_modified"), F.lit(0).cast("bigint").alias("accessed")).alias("times"))
    names = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mft_record"), F.col("l_linenumber").cast("bigint").alias("name_index"), F.when(F.col("l_returnflag") == "A", "DOS").otherwise("Win32").alias("namespace"), F.struct(ticks("l_shipdate").alias("created"), *(F.lit(0).cast("bigint").alias(x) for x in ("modified", "mft_modified", "accessed"))).alias("times"))
    return correlate.macb(records, names)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as correlation traces: entity = user, host, parser and precision from the data."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity_id"), (F.col("user_id") % 4).alias("host_id"), F.col("event_type").alias("kind"), micros("ts").alias("time_us"), F.concat(F.lit("parser"), (k % 3).cast("string")).alias("parser"), F.when(k % 7 == 0, "day").otherwise("microsecond").alias("precision"), F.when(k % 11 == 0, "inferred").otherwise("parsed").alias("derivation"), F.when(k % 5 == 0, F.lit(None)).otherwise(k).alias("byte_offset"))


_TRACES = """(SELECT event_id, user_id AS entity_id, user_id % 4 AS host_id, event_type AS kind, epoch_us(ts) AS time_us, 'parser' || (k % 3) AS parser,
 CASE WHEN k % 7 = 0 THEN 'day' ELSE 'microsecond' END AS precision, CASE WHEN k % 11 = 0 THEN 'inferred' ELSE 'parsed' END AS derivation, CASE WHEN k % 5 <> 0 THEN k END AS byte_offset
 FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events))"""
_ELIGIBLE = f"(SELECT * FROM {_TRACES} WHERE derivation IN ('observed', 'parsed', 'derived') AND precision IN ('nanosecond', 'hundred_nanoseconds', 'microsecond', 'millisecond', 'second') AND byte_offset IS NOT NULL)"


@query("""SELECT event_id, c_name AS entity, n_name AS host, r_name AS evidence, o_orderpriority AS observation FROM events JOIN customer ON c_custkey = user_id
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_orderkey = event_id AND o_custkey = user_id""")
def corr_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their entity, host, evidence and, where the case agrees, observation."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    entities = table(spark, sf_dir, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    full = table(spark, sf_dir, "events").join(entities, F.col("c_custkey") == F.col("user_id")).join(orders, (F.col("o_orderkey") == F.col("event_id")) & (F.col("o_custkey") == F.col("user_id")), "left")
    return full.select("event_id", F.col("c_name").alias("entity"), F.col("n_name").alias("host"), F.col("r_name").alias("evidence"), F.col("o_orderpriority").alias("observation"))


@query(f"SELECT event_id, event_id IN (SELECT event_id FROM {_ELIGIBLE}) AS eligible FROM events")
def corr_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("event_id", correlate.eligible().alias("eligible"))


def _pairs_sql(a: str, b: str, seconds: int, more: str = "true") -> str:
    return f"""SELECT a.event_id AS a_id, b.event_id AS b_id, b.time_us - a.time_us AS delta_us FROM {_ELIGIBLE} a JOIN {_ELIGIBLE} b
ON a.entity_id = b.entity_id AND a.host_id = b.host_id AND b.time_us BETWEEN a.time_us AND a.time_us + {seconds}000000
AND (a.time_us, a.event_id) < (b.time_us, b.event_id) AND a.kind = '{a}' AND b.kind = '{b}' AND {more}"""


@query(_pairs_sql("click", "click", 3600, "a.parser <> b.parser"))
def corr_same_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kind from different parsers within an hour."""
    found = traces(spark, sf_dir).where(correlate.eligible())
    return correlate.interval_pairs(found, ["entity_id", "host_id"], "click", "click", 3600, F.col("a.parser") != F.col("b.parser"))


@query(_pairs_sql("signup", "purchase", 86400))
def corr_create_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity within a day of creation."""
    return correlate.interval_pairs(traces(spark, sf_dir).where(correlate.eligible()), ["entity_id", "host_id"], "signup", "purchase", 86400)


@query(_pairs_sql("view", "error", 7200))
def corr_start_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.interval_pairs(traces(spark, sf_dir).where(correlate.eligible()), ["entity_id", "host_id"], "view", "error", 7200)


@query(f"SELECT a_id, b_id, n, n > 500 AS limited FROM (SELECT a_id, b_id, count(*) OVER () AS n, row_number() OVER (ORDER BY a_id, b_id) AS place FROM ({_pairs_sql('signup', 'purchase', 86400)})) WHERE place <= 500")
def corr_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 matches in a fixed order, and whether there are more."""
    return correlate.limited(corr_create_activity(spark, sf_dir), ["a_id", "b_id"], 500).select("a_id", "b_id", "n", "limited")


@query(f"""SELECT a_id, b_id, c_name AS entity, 'host' || user_id % 4 AS host FROM ({_pairs_sql('view', 'error', 7200)}) JOIN events ON event_id = a_id JOIN customer ON c_custkey = user_id
WHERE (a_id, b_id) > (500, 0) ORDER BY a_id, b_id LIMIT 100""")
def corr_results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, customers = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    full = corr_start_network(spark, sf_dir).join(events, F.col("event_id") == F.col("a_id")).join(customers, F.col("c_custkey") == F.col("user_id"))
    named = full.select("a_id", "b_id", F.col("c_name").alias("entity"), F.concat(F.lit("host"), (F.col("user_id") % 4).cast("string")).alias("host"))
    return pages.page(named, ["a_id", "b_id"], (500, 0), 100).drop("more")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2")
def ev_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windowed(table(spark, sf_dir, "events"), "1 hour").select(micros("start").alias("start_us"), "event_type", "n", "cents")


@query("""SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) - 1800000000 * i AS start_us, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents
FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY 1, 2""")
def ev_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windowed(table(spark, sf_dir, "events"), "1 hour", "30 minutes").select(micros("start").alias("start_us"), "event_type", "n", "cents")


@query("""
WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, session""")
def ev_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events"), "6 hours").select("user_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "n")
