"""Tokens, searches in bytes, the whole timeline, correlation rules, masking at depth, and updates of control tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import catalog, correlate, govern, pages, search, tokens
from tracelake.session import table

from .registry import query
from .search import PAIRS, TERMS, WORDS, _hits_sql
from .timeline import micros, moment


@query("""SELECT event_id, epoch_us(ts) AS ts_us, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '|' || event_id AS token FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10 12:00:00.5', 17) ORDER BY ts, event_id LIMIT 500""")
def timeline_page_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind a token, each row with the token that goes on behind it."""
    time, row_id = tokens.read_moment("2024-01-10T13:00:00.500000+01:00|17", number=True)
    one = pages.page(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], (moment(str(time)), row_id), tokens.page_rows(None))
    return one.select("event_id", micros("ts").alias("ts_us"), tokens.moment_token(F.col("ts"), F.col("event_id")).alias("token"))


@query("SELECT c_custkey, c_name || '|' || c_custkey AS token FROM customer WHERE (c_name, c_custkey) > ('Customer#000000020|x', 20) ORDER BY c_name, c_custkey LIMIT 40")
def entity_page_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by display name; the name in the token holds a bar."""
    name, row_id = tokens.read_name("Customer#000000020|x|20", number=True)
    one = pages.page(table(spark, sf_dir, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"], (name, row_id), 40)
    return one.select("c_custkey", tokens.name_token(F.col("c_name"), F.col("c_custkey")).alias("token"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 0 ELSE 1 END || '|' || p_partkey || '|' || p_name AS token FROM part WHERE (p_size <= 25, p_name, p_partkey) > (true, 'f', 0) ORDER BY p_size <= 25, p_name, p_partkey LIMIT 100")
def directory_page_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large parts as directories, which come first; the page begins among the files."""
    is_file, record, name = tokens.read_entry("1|0|f")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") <= 25).alias("is_file"))
    one = pages.page(rows, ["is_file", "p_name", "p_partkey"], (is_file, name, record), 100)
    return one.select("p_partkey", tokens.entry_token(~F.col("is_file"), F.col("p_partkey"), F.col("p_name")).alias("token"))


@query("""SELECT l_orderkey, l_linenumber, '[' || l_orderkey || ',' || l_linenumber || ',"' || 'a\\"' || l_shipmode || '"]' AS token FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) WHERE (l_orderkey, l_linenumber) > (40, 3) ORDER BY l_orderkey, l_linenumber LIMIT 500""")
def catalog_page_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record, parent and a name with a quotation mark, as JSON; the default page of 500."""
    record, parent, _ = tokens.read_record('[40,3,"a\\"N"]')
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit('a"'), "l_returnflag").alias("name"))
    one = pages.page(rows, ["l_orderkey", "l_linenumber"], (record, parent), tokens.page_rows(None))
    return one.select("l_orderkey", "l_linenumber", tokens.record_token(F.col("l_orderkey"), F.col("l_linenumber"), F.col("name")).alias("token"))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as bytes: UTF-8, and every second UTF-16LE."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16LE")).alias("content"))


_AT = "CASE WHEN doc_id % 2 = 0 THEN strlen(left(text, {0}::INT)) ELSE 2 * {0} END"
_ENCODING = "CASE WHEN doc_id % 2 = 0 THEN 'ascii' ELSE 'utf16le' END AS encoding"


@query(f"""SELECT doc_id, category, term, {_ENCODING}, ({_AT.format('start')})::BIGINT AS start FROM ({_hits_sql(TERMS)} UNION ALL {_hits_sql(WORDS)}) JOIN documents USING (doc_id)""")
def byte_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in bytes of both encodings, with and without whole words."""
    return search.byte_hits(_contents(spark, sf_dir), "doc_id", "content", TERMS + WORDS).select("doc_id", "category", "term", "encoding", "start")


@query(f"""
WITH h AS (SELECT doc_id, category, term, side, ({_AT.format('start')})::BIGINT AS start, ({_AT.format('"end"')})::BIGINT AS "end" FROM ({_hits_sql(PAIRS)}) JOIN documents USING (doc_id)),
o AS (SELECT *, last_value(CASE WHEN side = 'L' THEN struct_pack(s := start, e := "end") END IGNORE NULLS) OVER w AS l, last_value(CASE WHEN side = 'R' THEN struct_pack(s := start, e := "end") END IGNORE NULLS) OVER w AS r
 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY "end", length(term) DESC, term, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT doc_id, start, "end", CASE WHEN side = 'L' THEN r.s ELSE l.s END AS os, CASE WHEN side = 'L' THEN r.e ELSE l.e END AS oe FROM o)
SELECT doc_id, {_ENCODING}, least(start, os) AS start, greatest(start - oe, os - "end", 0) AS gap FROM p WHERE os IS NOT NULL AND greatest(start - oe, os - "end", 0) <= 128""")
def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within 128 bytes, each encoding for itself."""
    hits = search.byte_hits(_contents(spark, sf_dir), "doc_id", "content", PAIRS)
    return search.keyword_pairs(hits, "doc_id", by=["encoding"]).select("doc_id", "encoding", "start", "gap")


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[A-Za-z0-9.:_%-]+')), '\.+$', '') AS token FROM documents)
SELECT doc_id, string_split(token, ':')[1] AS address, 'IPv4' AS kind, count(*) AS n FROM t WHERE length(token) <= 128 AND regexp_full_match(token, '{_OCTET}(\.{_OCTET}){{3}}(:[0-9]{{1,5}})?') AND coalesce(try_cast(string_split(token, ':')[2] AS INT), 0) <= 65535 GROUP BY 1, 2
UNION ALL SELECT doc_id, '2001:db8::' || (doc_id % 9000 + 1000), 'IPv6', 1 FROM documents UNION ALL SELECT doc_id, '::ffff:192.0.2.' || (doc_id % 250), 'IPv6', 1 FROM documents""")
def address_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 and IPv6 literals in whole documents as bytes; two addresses are put behind each."""
    tail = F.concat(F.lit("\n2001:DB8:0::"), (F.col("doc_id") % 9000 + 1000).cast("string"), F.lit("\n::ffff:192.0.2."), (F.col("doc_id") % 250).cast("string"), F.lit(" 01.2.3.4 fe80::1%eth0"))
    text = F.concat(F.coalesce("text", F.lit("")), tail)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "UTF-16LE")).alias("content"))
    return search.address_hits(docs, "doc_id", "content").groupBy("doc_id", "address", "kind").agg(F.count(F.lit(1)).alias("n"))


_KEYS = ", ".join(f"({i}, '{k}', '{e}')" for i, (k, e) in enumerate(correlate.TIME_KEYS))


@query(f"""WITH t AS (SELECT event_id, event_type, k.i, k.key, k.event, epoch_us(ts) // 1000000 + k.i AS unix FROM events JOIN (VALUES {_KEYS}) k(i, key, event) ON (event_id + k.i) % 5 = 0 AND (event_id + k.i) % 10 <> 0)
SELECT unix, event_type AS domain, event, key AS time_key, i AS key_index, event_id AS finding_index, 'f' || event_id AS finding_id, event_id * 8 AS "offset", CASE WHEN event_id % 2 = 0 THEN 'v' || event_id % 3 END AS volume, row_number() OVER (PARTITION BY unix, event_type ORDER BY event_id, i) AS place FROM t""")
def whole_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with some of all 23 time attributes, and some that are no numbers, in the timeline's order."""
    seconds = F.floor(micros("ts") / 1000000).cast("bigint")
    every = [(F.lit(k), F.when((F.col("event_id") + i) % 10 == 0, "n/a").when((F.col("event_id") + i) % 5 == 0, (seconds + i).cast("string"))) for i, (k, _) in enumerate(correlate.TIME_KEYS)]
    volume = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")))
    attributes = F.create_map(*(x for pair in every for x in pair), F.lit("volume"), volume)
    key = F.col("event_id")
    findings = table(spark, sf_dir, "events").select(key.alias("finding_index"), F.concat(F.lit("f"), key.cast("string")).alias("finding_id"), F.col("event_type").alias("domain"), F.lit("x").alias("name"), F.lit("s").alias("source"), (key * 8).alias("offset"), attributes.alias("attributes"))
    return correlate.whole_timeline(findings).select("unix", "domain", "event", "time_key", "key_index", "finding_index", "finding_id", "offset", "volume", "place")


def _rule_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces of the kinds that the rules are about, their times in nanoseconds."""
    pick = lambda *names: F.element_at(F.create_map(*(F.lit(x) for pair in zip(("click", "view", "signup", "purchase", "error"), names, strict=True) for x in pair)), F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").where("event_type IN ('click', 'view', 'signup', 'purchase', 'error')").select(
        "event_id", F.concat(F.lit("a"), (F.col("event_id") % 97).cast("string")).alias("artifact_id"), (F.col("user_id") % 50).alias("entity_id"), pick("process_start", "process_start", "service_installed", "service_started", "network_connection").alias("kind"),
        pick("file", "process", "service", "service", "process").alias("entity_kind"), pick("executable", "process", "service", "service", "process").alias("role"), F.lit("event_time").alias("semantics"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("parser"), (micros("ts") * 1000).alias("time_ns"),
    )


_RULE_TRACES = """(SELECT event_id, 'a' || event_id % 97 AS artifact_id, user_id % 50 AS entity_id, event_type, 'p' || json_extract(props, '$.k')::BIGINT % 3 AS parser, epoch_us(ts) * 1000 AS at FROM events)"""
_CANDIDATES = f"""SELECT v.rule, a.event_id AS a_id, b.event_id AS b_id, b.at - a.at AS delta, b.at - a.at <= v.win AND (v.rule <> 'execution-sources' OR a.parser <> b.parser) AS matches
FROM {_RULE_TRACES} a JOIN {_RULE_TRACES} b ON a.entity_id = b.entity_id AND a.event_id <> b.event_id AND a.artifact_id <> b.artifact_id
JOIN (VALUES ('execution-sources', 'click', 'click', 2000000000), ('persistence-activity', 'signup', 'purchase', 86400000000000), ('process-network', 'view', 'error', 300000000000)) v(rule, x, y, win) ON a.event_type = v.x AND b.event_type = v.y
WHERE a.at <= b.at AND b.at // v.win - a.at // v.win <= 1 AND (v.rule <> 'execution-sources' OR a.at < b.at OR (a.event_id, a.artifact_id) < (b.event_id, b.artifact_id))"""


@query(f"SELECT DISTINCT rule, a_id, b_id FROM ({_CANDIDATES}) WHERE matches")
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of the three fixed rules."""
    return correlate.rule_pairs(_rule_traces(spark, sf_dir), ["entity_id"])


#: all comparisons of a run in its order, with the rule that each meets
_COMPARED = f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY "at", event_id) AS place FROM {_RULE_TRACES} WHERE event_type IN ('click', 'view', 'signup', 'purchase', 'error')),
p AS (SELECT row_number() OVER (ORDER BY a.entity_id, a.place, b.place) - 1 AS number, a.event_id AS x, b.event_id AS y, a.event_type AS xt, b.event_type AS yt, a.parser AS xp, b.parser AS yp, a.artifact_id <> b.artifact_id AS other, b.at - a.at AS delta
 FROM t a JOIN t b ON a.entity_id = b.entity_id AND a.place < b.place AND b.at - a.at < 86401000000000),
m AS (SELECT number, CASE WHEN xt = 'click' AND yt = 'click' AND xp <> yp AND delta <= 2000000000 THEN 'execution-sources' WHEN xt = 'signup' AND yt = 'purchase' AND delta <= 86400000000000 OR delta = 0 AND yt = 'signup' AND xt = 'purchase' THEN 'persistence-activity'
 WHEN xt = 'view' AND yt = 'error' AND delta <= 300000000000 OR delta = 0 AND yt = 'view' AND xt = 'error' THEN 'process-network' END AS rule, delta = 0 AND (yt = 'signup' OR yt = 'view' AND xt = 'error') AS turned, x, y FROM p WHERE other),
k AS (SELECT number, rule, CASE WHEN turned THEN y ELSE x END AS a_id, CASE WHEN turned THEN x ELSE y END AS b_id FROM m WHERE rule IS NOT NULL AND number < 2000 ORDER BY number LIMIT 30),
s AS (SELECT CASE WHEN (SELECT count(*) FROM k) = 30 THEN (SELECT max(number) + 1 FROM k) ELSE least(2000, (SELECT count(*) FROM p)) END AS done)"""


@query(f"{_COMPARED} SELECT rule, a_id, b_id, number, done < (SELECT count(*) FROM p) AS limited FROM k, s")
def rule_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's matches, with its limits: 2000 comparisons here, and 30 matches."""
    return correlate.limited_rules(_rule_traces(spark, sf_dir), ["entity_id"], comparisons=2000, matches=30)


@query(f"{_COMPARED} SELECT done AS comparisons, (SELECT count(*) FROM k) AS matches, done < (SELECT count(*) FROM p) AS limited FROM s")
def rule_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run with limits has compared, and whether that was all."""
    return correlate.evaluated(_rule_traces(spark, sf_dir), ["entity_id"], comparisons=2000, matches=30)[1]


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' AND turn % 2 = 1 THEN '"[maskiert]"' ELSE '{"a":[{"wert":"' || CASE WHEN role <> 'user' THEN '[maskiert]' ELSE 't' || turn END || '"},' || turn || '],"b":{"passwort":"[maskiert]","x":null},' ||
 CASE WHEN role = 'user' THEN '"sensibel":false' ELSE '"sensibel":true' END || '}' END AS document FROM conversations""")
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets at any depth of nested JSON; rows of the secret scope that are no objects are masked whole."""
    turn = F.col("turn").cast("string")
    nested = F.concat(F.lit('{"b": {"x": null, "passwort": 7}, "sensibel": '), F.when(F.col("role") == "user", "false").otherwise("true"), F.lit(', "a": [{"wert": "t'), turn, F.lit('"}, '), turn, F.lit("]}"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((F.col("role") == "system") & (F.col("turn") % 2 == 1), F.lit('["x"]')).otherwise(nested).alias("document"), (F.col("role") == "system").alias("secret"))
    return govern.masked_documents(rows, "document", "secret").drop("secret")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as documents: text in an array in an object, secret by role or by a flag below, every seventh cut short, every eleventh deeper than the limit."""
    turn, text = F.col("turn").cast("string"), F.to_json(F.array("text"))
    body = F.concat(F.lit('{"z": ['), F.substr(text, F.lit(2), F.length(text) - 2), F.lit(', {"wert": '), turn, F.lit('}], "role": "'), F.col("role"), F.lit('", "in": {"wert": "'), turn, F.lit('", "sensibel": "'), (F.col("turn") % 2 == 0).cast("string"), F.lit('", "masterkey_hex": null, "e": {}}}'))
    deep = F.concat(F.repeat(F.lit('{"d":'), 70), F.lit("1"), F.repeat(F.lit("}"), 70))
    number = F.col("conv_id") + F.col("turn")
    document = F.when(number % 11 == 0, deep).when(number % 7 == 0, F.left(body, F.lit(9))).otherwise(body)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", document.alias("document"), (F.col("role") == "system").alias("secret"))


_SEARCHED = """SELECT conv_id, turn, role, (conv_id + turn) % 11 = 0 AS too_deep, CASE WHEN (conv_id + turn) % 11 = 0 THEN repeat('d: ', 64) || '[maskiert]' WHEN (conv_id + turn) % 7 = 0 THEN '' ELSE
 'in: e:  masterkey_hex: [maskiert] sensibel: ' || (turn % 2 = 0) || ' wert: ' || CASE WHEN role = 'system' OR turn % 2 = 0 THEN '[maskiert]' ELSE turn::VARCHAR END || ' role: ' || role || ' z: ' || text || ' wert: ' || CASE WHEN role = 'system' THEN '[maskiert]' ELSE turn::VARCHAR END END AS document FROM conversations"""


@query(f"SELECT conv_id, turn, document, too_deep FROM ({_SEARCHED})")
def masked_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searchable text of nested documents, masked; those that are no JSON or too deep are rows, too."""
    return govern.search_documents(_nested(spark, sf_dir), "document", "secret").select("conv_id", "turn", "document", "too_deep")


@query(f"""SELECT conv_id, turn, preview, count(*) OVER () > 100 AS more FROM (SELECT conv_id, turn, substr(document, greatest(1, strpos(lower(document), 'z: t') - 60), 240) AS preview FROM ({_SEARCHED})
WHERE role = 'user' AND contains(lower(document), 'z: t') AND (conv_id, turn) > (3, 1) ORDER BY conv_id, turn LIMIT 101) ORDER BY conv_id, turn LIMIT 100""")
def masked_artifact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one role's documents with a literal in their masked text, with previews."""
    rows = govern.search_documents(_nested(spark, sf_dir).where("role = 'user'"), "document", "secret")
    found = rows.where(pages.contains_literal(F.col("document"), "Z: T"))
    return pages.page(found.select("conv_id", "turn", search.preview(F.col("document"), "z: t").alias("preview")), ["conv_id", "turn"], (3, 1), 100)


@query("""SELECT c_custkey AS user_id, c_nationkey::BIGINT AS role, 'revoke' AS change FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, (c_nationkey + 1)::BIGINT, 'grant' FROM customer WHERE c_custkey % 3 <> 1""")
def role_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some users get another role, some one more, some keep theirs."""
    users = table(spark, sf_dir, "customer")
    role = lambda plus, test: users.where(test).select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") + plus).cast("bigint").alias("role"))
    return govern.role_update(role(0, F.lit(True)), role(0, F.col("c_custkey") % 3 != 0).union(role(1, F.col("c_custkey") % 3 != 1)))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'updated' WHEN 1 THEN 'conflict' ELSE 'missing' END AS outcome, CASE o_orderkey % 3 WHEN 0 THEN 'neu' WHEN 1 THEN o_orderstatus END AS status FROM orders""")
def optimistic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that expect the version a row has, another, or a row that is not there."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(3).alias("updated_at"))
    changes = orders.select("id", F.lit("neu").alias("status"), F.when(F.col("id") % 3 == 1, 2).otherwise(3).alias("expected"))
    return govern.optimistic_update(orders.where("id % 3 <> 2"), changes, "id", ["status"])


@query("""SELECT o_custkey AS user_id, o_orderstatus AS item, min(epoch_us(o_orderdate)) AS created, max(epoch_us(o_orderdate)) AS changed, arg_max(o_orderkey % 2 = 1, (epoch_us(o_orderdate), o_orderkey % 2 = 0, o_orderkey)) AS deleted, arg_max(o_orderkey, (epoch_us(o_orderdate), o_orderkey % 2 = 0, o_orderkey)) AS note FROM orders GROUP BY 1, 2""")
def bookmarks_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bookmarks of their customers, set (even keys) and deleted (odd ones) over time."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("item"), micros("o_orderdate").alias("at"), (F.col("o_orderkey") % 2 == 1).alias("deleted"), F.col("o_orderkey").alias("note"))
    # of changes at one moment the one with the larger note is later
    one = rows.groupBy("user_id", "item", "at", "deleted").agg(F.max("note").alias("note"))
    return govern.bookmarks_after(one.where("note % 7 = 0"), one.where("note % 7 <> 0"), ["user_id", "item"], "at", "deleted", ["note"])


@query("""SELECT c_custkey AS case_id, c_name AS name, coalesce(e.n, 0) AS n_evidence, e.evidence FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS evidence FROM orders GROUP BY 1) e ON o_custkey = c_custkey""")
def case_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases with their evidence, orders, in the order of import."""
    return catalog.cases_with_evidence(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("name")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("evidence_id"), F.col("o_orderdate").alias("imported")))


@query("""SELECT p_partkey AS evidence_id, CASE p_partkey % 4 WHEN 0 THEN 'conflict' WHEN 1 THEN 'known' ELSE 'new' END AS outcome FROM part""")
def evidence_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence offered again under its id, with the same hash or with another, and new evidence."""
    offered = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("evidence_id"), F.sha2("p_name", 256).alias("sha256"))
    held = offered.where("evidence_id % 4 < 2").withColumn("sha256", F.when(F.col("evidence_id") % 4 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return catalog.registered(held, offered)


@query("SELECT event_id, 'VSS#' || (event_id % 3 + 1) AS scope FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'live' WHEN 2 THEN 'VSS#2' END FROM events WHERE event_id % 5 <> 0")
def source_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that a locator was read from: shadow copies, live bytes, a registry cell of a snapshot, one without an anchor, and one whose snapshot disagrees."""
    k, none = F.col("event_id") % 5, F.lit(None).cast("bigint")
    locator = F.struct(
        F.when(k == 2, "registry").when(k == 1, "byte_range").otherwise("ntfs").alias("type"), F.lit(8).cast("bigint").alias("length"), F.when(k.isin(0, 4), F.lit(1).cast("bigint")).otherwise(none).alias("record_offset"), none.alias("byte_offset"), none.alias("image_offset"),
        F.when(k == 2, F.lit(64).cast("bigint")).otherwise(none).alias("cell_offset"), F.when(k == 0, F.col("event_id") % 3).otherwise(none).alias("shadow_store"),
    )
    snapshot = F.when(k == 2, "VSS#2").when(k == 4, "VSS#9")
    return table(spark, sf_dir, "events").select("event_id", correlate.source_scope(locator, snapshot).alias("scope"))


@query("""SELECT event_id, value FROM (SELECT e.event_id, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) AS value FROM events e LEFT JOIN orders ON o_custkey = user_id AND o_orderdate <= ts GROUP BY 1)""")
def as_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of the last order that a user had made when an event happened."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("c"), F.col("ts").alias("at"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("at")).agg(F.max("o_orderstatus").alias("value"))
    return correlate.as_of(events, orders, ["c"], "at", "value").select("event_id", "value")


@query("""SELECT o_orderkey AS mft_record, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders""")
def macb_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each record's creation in the order of MACB rows."""
    rows = table(spark, sf_dir, "orders").select(micros("o_orderdate").alias("filetime"), F.col("o_orderkey").alias("mft_record"), F.lit(None).cast("int").alias("name_index"), F.lit("B").alias("kind"))
    # numbers without one task for all: counts of whole months, then places in each
    month = F.floor(F.col("filetime") / (30 * 86_400_000_000)).alias("month")
    return correlate.numbered(rows.withColumn("month", month), "month", correlate.macb_order()).select("mft_record", "place")
