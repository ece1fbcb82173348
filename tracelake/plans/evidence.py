"""Queries of the evidence model: provenance, identities, merges and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import ids
from tracelake.operators import model
from tracelake.session import table

from .registry import query
from .timeline import micros


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("artifact_id"), F.col("l_linenumber").cast("bigint").alias("line"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("line"), F.col("l_linenumber").cast("string"))).alias("locator"), F.when(F.col("l_returnflag") == "N", F.lit(None)).otherwise(F.col("l_returnflag")).alias("parser"))


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact_id"), F.lit("line2").alias("locator"), F.col("o_orderstatus").alias("parser"))


_LINKS = "(SELECT l_orderkey AS artifact_id, l_linenumber::BIGINT AS line, CASE WHEN l_linenumber % 2 = 0 THEN 'line' || l_linenumber END AS locator, nullif(l_returnflag, 'N') AS parser FROM lineitem)"
_ARTIFACTS = "(SELECT o_orderkey AS artifact_id, 'line2' AS locator, o_orderstatus AS parser FROM orders)"


@query(f"SELECT artifact_id, line, coalesce(l.locator, a.locator) AS locator, coalesce(l.parser, a.parser) AS parser FROM {_LINKS} l LEFT JOIN {_ARTIFACTS} a USING (artifact_id)")
def provenance_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.provenance_full(_links(spark, sf_dir), _artifacts(spark, sf_dir))


@query(f"SELECT DISTINCT artifact_id, nullif(l.locator, a.locator) AS locator, nullif(l.parser, a.parser) AS parser FROM {_LINKS} l LEFT JOIN {_ARTIFACTS} a USING (artifact_id)")
def provenance_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.provenance_compact(_links(spark, sf_dir).drop("line"), _artifacts(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1 THEN 'primary' ELSE 'supporting' END AS role FROM lineitem")
def provenance_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.provenance_roles(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "role")


@query("""SELECT 'event' AS kind, l_orderkey AS object_id FROM lineitem WHERE l_linenumber % 3 = 0 AND l_orderkey NOT IN (SELECT event_id FROM events)
UNION ALL SELECT 'entity', l_orderkey FROM lineitem WHERE l_linenumber % 3 = 1 AND l_orderkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'artifact', l_orderkey FROM lineitem WHERE l_linenumber % 3 = 2 AND l_orderkey NOT IN (SELECT doc_id FROM documents)""")
def finding_ref_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(F.lit("event"), F.lit("entity"), F.lit("artifact")), F.col("l_linenumber") % 3 + 1)
    refs = table(spark, sf_dir, "lineitem").select(kinds.alias("kind"), F.col("l_orderkey").alias("object_id"))
    objects = {"event": table(spark, sf_dir, "events").select("event_id"), "entity": table(spark, sf_dir, "customer").select("c_custkey"), "artifact": table(spark, sf_dir, "documents").select("doc_id")}
    return model.missing_references(refs, "kind", objects).select("kind", "object_id")


def _prefixed(text: str) -> str:
    return f"unhex(substr(lpad(to_hex(strlen({text})), 8, '0'), 7, 2) || substr(lpad(to_hex(strlen({text})), 8, '0'), 5, 2) || substr(lpad(to_hex(strlen({text})), 8, '0'), 3, 2) || substr(lpad(to_hex(strlen({text})), 8, '0'), 1, 2) || '00000000') || ({text})::BLOB"


_WHERE8 = "lpad(to_hex(doc_id), 16, '0')"
_FINDING_SQL = f"""(SELECT doc_id, text, left(sha256({_prefixed("'document'")} || {_prefixed("lang")} || {_prefixed("source")} || unhex('0800000000000000') ||
 unhex({' || '.join(f'substr({_WHERE8}, {k}, 2)' for k in range(15, 0, -2))}) || {_prefixed("'chars'")} || {_prefixed("n_chars::VARCHAR")} || {_prefixed("'lang'")} || {_prefixed("lang")}), 16) AS id FROM documents)"""


def _finding_hash() -> Column:
    attributes = F.create_map(F.lit("lang"), F.col("lang"), F.lit("chars"), F.col("n_chars").cast("string"))
    return ids.finding_id(F.lit("document"), F.col("lang"), F.col("source"), F.col("doc_id"), attributes)


_SHORT_SQL = f"left(sha256({_prefixed('lang')} || {_prefixed('source')}), 16)"


@query(f"""SELECT doc_id, CASE WHEN n > 1 THEN id || '-' || n ELSE id END AS id FROM (SELECT doc_id, {_SHORT_SQL} AS id, row_number() OVER (PARTITION BY {_SHORT_SQL} ORDER BY doc_id) AS n FROM documents)""")
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a content hash that many documents share, numbered in order."""
    base = F.substring(F.sha2(F.concat(ids.length_prefixed(F.encode("lang", "UTF-8")), ids.length_prefixed(F.encode("source", "UTF-8"))), 256), 1, 16)
    return model.numbered_ids(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), base, ["doc_id"]).select("doc_id", "id")


@query(f"SELECT doc_id, id, doc_id % 10 <> 3 AS intact FROM {_FINDING_SQL}")
def finding_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes computed again and compared with stored ones, of which a tenth are altered."""
    own = _finding_hash()
    stored = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("x"), F.substring(own, 2, 15))).otherwise(own)
    return table(spark, sf_dir, "documents").select("doc_id", own.alias("id"), (stored == own).alias("intact"))


@query("""SELECT o_orderkey, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (l_returnflag = 'A'), '') AS a_refs,
coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (l_returnflag = 'N'), '') AS n_refs, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (l_returnflag = 'R'), '') AS r_refs, any_value(c_name) AS analyst
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_orderkey""")
def finding_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings (orders) with three lists of typed references and their analyst."""
    listed = lambda flag: F.array_join(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == flag, F.col("l_linenumber")))).cast("array<string>"), ",")
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(listed("A").alias("a_refs"), listed("N").alias("n_refs"), listed("R").alias("r_refs"))
    analysts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("analyst"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(refs, "o_orderkey", "left").join(analysts, "o_custkey", "left").na.fill("", ["a_refs", "n_refs", "r_refs"]).select("o_orderkey", "a_refs", "n_refs", "r_refs", "analyst")


@query("""SELECT o_orderkey, coalesce(n, 0) AS n_observations, coalesce(sample, '') AS observations FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_partkey::VARCHAR, ',' ORDER BY place) FILTER (place <= 3) AS sample
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem) GROUP BY 1) ON l_orderkey = o_orderkey""")
def artifact_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact's number of observations and the first three of them."""
    line = table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")))
    first = F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "l_partkey"))))
    counted = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_observations"), F.array_join(F.transform(first, lambda x: x["l_partkey"].cast("string")), ",").alias("observations"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(counted, "o_orderkey", "left").na.fill(0, ["n_observations"]).na.fill("", ["observations"])


_CASE_HEX = "00112233445566778899aabbccddeeff"


def _uuid_sql(kind: str, *parts: str) -> str:
    data = f"unhex('{ids.NAMESPACE_HEX}') || {_prefixed(repr(kind))} || " + " || ".join(parts)
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::BIGINT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT sha1({data}) AS h))"


_CASE_SQL = f"unhex('1000000000000000') || unhex('{_CASE_HEX}')"


@query(f"""SELECT c_custkey, {_uuid_sql('entity', _CASE_SQL, _prefixed("'windows_user'"), _prefixed("'name:' || lower(c_name)"))} AS entity_id, {_uuid_sql('event', _CASE_SQL, _prefixed("'login'"), _prefixed("'evtx:' || c_custkey"))} AS event_id FROM customer""")
def derived_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UUIDs of entities and events from the case, the kind and a canonical key."""
    case = F.unhex(F.lit(_CASE_HEX))
    text = ids.text_part
    entity = ids.derived_uuid("entity", case, text(F.lit("windows_user")), text(F.concat(F.lit("name:"), F.lower("c_name"))))
    event = ids.derived_uuid("event", case, text(F.lit("login")), text(F.concat(F.lit("evtx:"), F.col("c_custkey").cast("string"))))
    return table(spark, sf_dir, "customer").select("c_custkey", entity.alias("entity_id"), event.alias("event_id"))


@query("SELECT p_brand AS name, min(p_type) AS sid FROM part WHERE p_size < 5 GROUP BY p_brand HAVING count(DISTINCT p_type) = 1 UNION ALL SELECT p_name, min(p_type) FROM part GROUP BY p_name HAVING count(DISTINCT p_type) = 1")
def unique_name_to_sid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand for exactly one value."""
    part = table(spark, sf_dir, "part")
    brands = model.unique_mapping(part.where("p_size < 5").select(F.col("p_brand").alias("name"), F.col("p_type").alias("sid")), "name", "sid")
    return brands.unionByName(model.unique_mapping(part.select(F.col("p_name").alias("name"), F.col("p_type").alias("sid")), "name", "sid"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(s_name, 'ambiguous') AS service FROM lineitem LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1) USING (l_partkey) LEFT JOIN supplier ON s_suppkey = s""")
def service_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name is resolved only if one candidate is left."""
    line = table(spark, sf_dir, "lineitem")
    only = model.unique_mapping(line.select("l_partkey", F.col("l_suppkey").alias("s_suppkey")), "l_partkey", "s_suppkey")
    named = only.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("l_partkey", "s_name")
    return line.join(named, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("s_name", F.lit("ambiguous")).alias("service"))


@query("SELECT user_id, event_type AS attribute, arg_min(k, event_id) AS value FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1, 2")
def entity_attr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("attribute"), F.get_json_object("props", "$.k").cast("bigint").alias("value"))
    return model.merged_attributes(rows, "user_id", "attribute", "value", "event_id")


@query("""SELECT o_custkey, coalesce(arg_min(name, o_orderkey) FILTER (name NOT LIKE 'S-1-%'), arg_min(name, o_orderkey)) AS display_name
FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'S-1-5-' || o_orderkey ELSE 'user' || o_orderkey END AS name FROM orders) GROUP BY o_custkey""")
def entity_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("S-1-5-"), key)).otherwise(F.concat(F.lit("user"), key)).alias("name"))
    return model.display_names(rows, "o_custkey", "name", "o_orderkey")


@query("""SELECT event_type AS domain, count(*) FILTER (event_type <> 'view' AND k % 5 <> 0) AS mapped, count(*) FILTER (event_type = 'view') AS no_mapper, count(*) FILTER (event_type <> 'view' AND k % 5 = 0) AS incomplete_locator
FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1""")
def normalize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    known, located = F.col("event_type") != "view", F.col("k") % 5 != 0
    return rows.groupBy(F.col("event_type").alias("domain")).agg(F.count_if(known & located).alias("mapped"), F.count_if(~known).alias("no_mapper"), F.count_if(known & ~located).alias("incomplete_locator"))


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts, event_id")
def distinct_on_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.first_per_group(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""SELECT n_name AS actor FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer UNION SELECT p_brand FROM part WHERE p_brand NOT IN (SELECT s_name FROM supplier)""")
def union_distinct_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("actor")).where("actor IS NOT NULL")
    known = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("actor"))
    return one("nation", "n_name").union(one("region", "r_name")).union(one("customer", "c_mktsegment")).union(one("part", "p_brand").distinct()).distinct().join(known, "actor", "left_anti")


@query("SELECT c_name AS name, c_acctbal AS balance, NULL AS size FROM customer UNION ALL SELECT p_name, NULL, p_size::BIGINT FROM part")
def union_null_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return model.union_padded(customers, table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("size")))


@query("""SELECT k % 4 AS derivation_no, k % 4 >= 3 AS interpretation, count(*) AS n FROM (SELECT json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1, 2""")
def derivation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.get_json_object("props", "$.k").cast("bigint") % 4
    kind = F.element_at(F.array(*(F.lit(x) for x in ("observed", "parsed", "derived", "inferred"))), (number + 1).cast("int"))
    return table(spark, sf_dir, "events").select(number.alias("derivation_no"), model.is_interpretation(kind).alias("interpretation")).groupBy("derivation_no", "interpretation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderkey % 2 = 1 AS inserted FROM orders")
def upsert_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even keys are stored; the delta brings all keys, some twice."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return model.insert_new(orders.where("o_orderkey % 2 = 0"), orders.union(orders.where("o_orderkey % 3 = 0")), ["o_orderkey"])


@query("""WITH b AS (SELECT user_id, min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'stored' END AS name FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
d AS (SELECT user_id, min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l, 'new' AS name FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1)
SELECT user_id, least(b.f, d.f) AS first_us, greatest(b.l, d.l) AS last_us, coalesce(b.name, d.name) AS name FROM b FULL JOIN d USING (user_id)""")
def upsert_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    def seen(test: str, name: Column) -> DataFrame:
        rows = table(spark, sf_dir, "events").where(test).select("user_id", micros("ts").alias("us"))
        return rows.groupBy("user_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us")).withColumn("name", name)

    base = seen("event_type IN ('click', 'view')", F.when(F.col("user_id") % 3 != 0, "stored"))
    return model.upsert_entities(base, seen("event_type NOT IN ('click', 'view')", F.lit("new")), "user_id", "first_us", "last_us", ["name"])


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'old' WHEN doc_id % 3 = 0 THEN sha256(text) END AS sha256, doc_id % 2 = 1 AND doc_id % 3 = 0 AS updated FROM documents""")
def upsert_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "old").alias("sha256"))
    delta = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha256"))
    return model.fill_missing(base, delta, "doc_id", "sha256")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")).select("name", "n") for t in _TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@query("SELECT n_name, count(c_custkey) AS n_evidence, min(c_custkey) AS first_evidence FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def case_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_evidence"), F.min("c_custkey").alias("first_evidence"))
    return table(spark, sf_dir, "nation").join(counted, "n_nationkey", "left").select("n_name", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), "first_evidence")


@query("""SELECT domain, count(*) AS n, count(*) FILTER (warning) AS warnings FROM (SELECT 'event:' || event_type AS domain, value < 5 AS warning FROM events UNION ALL SELECT 'doc:' || lang, n_chars < 100 FROM documents) GROUP BY 1""")
def analyzer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("event:"), "event_type").alias("domain"), (F.col("value") < 5).alias("warning"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "lang").alias("domain"), (F.col("n_chars") < 100).alias("warning"))
    return events.unionByName(docs).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if("warning").alias("warnings"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS n_files, count(*) FILTER (event_type = 'error') AS n_delete, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS bytes FROM events")
def usn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_files"), F.count_if(F.col("event_type") == "error").alias("n_delete"), F.min("ts").alias("a"), F.max("ts").alias("z"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("bytes"))
    return out.select("n", "n_files", "n_delete", micros("a").alias("first_us"), micros("z").alias("last_us"), "bytes")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def oldest_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job each worker (user) would claim next: its oldest waiting one."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
