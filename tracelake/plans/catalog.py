"""Catalog queries: documents and pages as files, region - nation - customer - orders as a directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import textfn
from tracelake.operators import catalog, pages
from tracelake.session import table

from .registry import query


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("\\"), "lang", F.lit("\\doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", "source", path.alias("path"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.octet_length("text").cast("bigint").alias("size"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), "text")


_FILES = r"(SELECT doc_id, source, source || '\' || lang || '\doc' || doc_id || '.txt' AS path, 'doc' || doc_id || '.txt' AS name, strlen(text)::BIGINT AS size, sha256(text) AS sha256, text FROM documents)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the directory tree with record, parent, name and whether they are directories; the root is 5."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    n = lambda c: F.col(c).cast("bigint")
    levels = [
        region.select((n("r_regionkey") + 10).alias("record"), F.lit(5).cast("bigint").alias("parent"), F.col("r_name").alias("name"), F.lit(True).alias("is_dir")),
        nation.select((n("n_nationkey") + 100), (n("n_regionkey") + 10), F.col("n_name"), F.lit(True)),
        customer.select((n("c_custkey") + 1000), (n("c_nationkey") + 100), F.col("c_name"), F.lit(True)),
        orders.select((n("o_orderkey") + 100000000), (n("o_custkey") + 1000), F.concat(F.lit("order"), F.col("o_orderkey").cast("string")), F.lit(False)),
    ]
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


_TREE = """(SELECT r_regionkey::BIGINT + 10 AS record, 5::BIGINT AS parent, r_name AS name, true AS is_dir FROM region
UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, n_name, true FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, c_name, true FROM customer
UNION ALL SELECT o_orderkey + 100000000, o_custkey + 1000, 'order' || o_orderkey, false FROM orders)"""


@query(f"SELECT record, name, is_dir, count(*) OVER () > 200 AS more FROM (SELECT * FROM {_TREE} WHERE parent = 101 AND record <> parent AND (NOT is_dir, name, record) > (false, 'Customer#000000020', 0) ORDER BY NOT is_dir, name, record LIMIT 201) ORDER BY NOT is_dir, name, record LIMIT 200")
def directory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories first, then by name; the root, its own parent, is no child."""
    children = tree(spark, sf_dir).where("parent = 101 AND record <> parent").select("record", "name", "is_dir", (~F.col("is_dir")).alias("is_file"))
    return pages.page(children, ["is_file", "name", "record"], (False, "Customer#000000020", 0), 200).select("record", "name", "is_dir", "more")


@query(f"SELECT record, record IN (SELECT parent FROM {_TREE}) AS has_children FROM {_TREE} WHERE is_dir")
def dir_has_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree(spark, sf_dir)
    return catalog.with_children_flag(nodes.where("is_dir").select("record"), nodes, "record", "parent")


@query(f"SELECT source, count(*) AS n, count(*) FILTER (WHERE size > 2000) AS n_large, sum(size)::BIGINT AS bytes FROM {_FILES} GROUP BY source")
def volume_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("size") > 2000).alias("n_large"), F.sum("size").alias("bytes"))


@query(f"SELECT doc_id, path FROM {_FILES} WHERE lower(right(name, 4)) = '.txt'")
def catalog_ext_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(catalog.has_extension("name", "TXT")).select("doc_id", "path")


@query(rf"SELECT doc_id, path, count(*) OVER () > 500 AS more FROM (SELECT * FROM {_FILES} WHERE contains(lower(path), '\de\doc') AND (doc_id, path) > (50, '') ORDER BY doc_id, path LIMIT 501) ORDER BY doc_id, path LIMIT 500")
def catalog_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files(spark, sf_dir).where(pages.contains_literal(F.col("path"), r"\DE\doc")).select("doc_id", "path")
    return pages.page(found, ["doc_id", "path"], (50, ""), 500)


@query(f"SELECT count(*) AS n, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE size = 0) AS n_empty, count(DISTINCT sha256) AS n_contents, max(size) AS largest FROM {_FILES}")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.count_if(F.col("size") == 0).alias("n_empty"), F.count_distinct("sha256").alias("n_contents"), F.max("size").alias("largest"))


@query(rf"""WITH RECURSIVE t AS (SELECT * FROM {_TREE}), p AS (SELECT record, name AS path FROM t WHERE parent = 5 UNION ALL SELECT t.record, p.path || '\' || t.name FROM t JOIN p ON t.parent = p.record) SELECT record, path FROM p""")
def path_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree(spark, sf_dir).select("record", F.lit(1).alias("sequence"), "name", "parent", F.lit(1).alias("parent_sequence"))
    return catalog.rebuilt_paths(nodes, rounds=8)


@query(f"SELECT sha256, min(doc_id) AS hashed_from, count(*) AS n_links FROM {_FILES} GROUP BY sha256")
def hardlink_hash_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of equal content, told by a hash made where they lie: 32 bytes of each are shuffled, and no content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return docs.groupBy("sha256").agg(F.min("doc_id").alias("hashed_from"), F.count(F.lit(1)).alias("n_links"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'gzip' WHEN 3 THEN 'registry_hive' WHEN 4 THEN CASE WHEN text = '' THEN 'leer' ELSE 'unbekannt' END ELSE 'png' END AS kind FROM documents""")
def signature_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types told from first bytes; heads of known types are put before most texts."""
    heads = F.array(*(F.unhex(F.lit(h)) for h in ("255044462D", "504B0304", "1F8B", "72656766", "", "89504E470D0A1A0A")))
    content = F.concat(F.element_at(heads, (F.col("doc_id") % 6 + 1).cast("int")), F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", textfn.signature_type(content).alias("kind"))


@query("""WITH p AS (SELECT doc_id AS id, doc_id // 100 AS page, n_chars AS size FROM documents UNION ALL SELECT doc_id, doc_id // 100 + 1, n_chars + 1 FROM documents WHERE doc_id % 100 >= 90)
SELECT id, arg_max(size, page) AS size, min(page) AS first_page FROM p GROUP BY id""")
def page_overlap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    once = docs.select(F.col("doc_id").alias("id"), F.expr("doc_id div 100").alias("page"), F.col("n_chars").alias("size"))
    again = docs.where("doc_id % 100 >= 90").select(F.col("doc_id").alias("id"), F.expr("doc_id div 100 + 1").alias("page"), (F.col("n_chars") + 1).alias("size"))
    return pages.last_page_wins(once.union(again), "id", "page", ["size"])


@query(rf"""WITH snap AS (SELECT doc_id, upper(path) AS path, CASE WHEN doc_id % 7 = 0 THEN sha256('x' || text) WHEN doc_id % 5 <> 0 THEN sha256 END AS sha256, size FROM {_FILES}), live AS (SELECT * FROM {_FILES} WHERE doc_id % 11 <> 0)
SELECT path, status FROM (SELECT snap.path, CASE WHEN live.path IS NULL THEN 'only_snapshot' WHEN snap.size <> live.size THEN 'different' WHEN snap.sha256 IS NULL THEN 'not_checkable' WHEN snap.sha256 <> live.sha256 THEN 'different' END AS status
FROM snap LEFT JOIN live ON lower(snap.path) = lower(live.path)) WHERE status IS NOT NULL""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog against an altered copy of itself: other letter case, some other contents, some unhashed, some deleted since."""
    live = files(spark, sf_dir)
    other = F.sha2(F.encode(F.concat(F.lit("x"), "text"), "UTF-8"), 256)
    old = live.select(F.upper("path").alias("path"), F.when(F.col("doc_id") % 7 == 0, other).when(F.col("doc_id") % 5 != 0, F.col("sha256")).alias("sha256"), "size")
    return catalog.snapshot_diff(old, live.where("doc_id % 11 <> 0").select("path", "sha256", "size"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog on two volumes, live and in five snapshots: each lacks some files, has some others' contents, leaves some unhashed, and has some that are gone."""
    live = files(spark, sf_dir).withColumn("volume", F.col("doc_id") % 2 * 1048576)
    n, store = F.col("doc_id"), F.col("store")
    old = live.withColumn("store", F.explode(F.sequence(F.lit(0), F.lit(4)))).where((n + store) % 9 != 0)
    sha = F.when((n + store) % 7 == 0, F.sha2("sha256", 256)).when((n + store) % 5 != 0, F.col("sha256"))
    old = old.select("volume", store.cast("int").alias("store"), F.when(store % 2 == 0, F.upper("path")).otherwise(F.col("path")).alias("path"), (n + 100 * store).alias("mft_record"), (F.col("size") + F.when((n + store) % 13 == 0, 1).otherwise(0)).alias("size"), sha.alias("sha256"))
    return old.unionByName(live.where(n % 11 != 0).select("volume", F.lit(None).cast("int").alias("store"), "path", n.alias("mft_record"), "size", "sha256"))


_SNAPSHOTS = rf"""WITH live AS (SELECT *, doc_id % 2 * 1048576 AS volume FROM {_FILES}),
s AS (SELECT l.volume, store, CASE WHEN store % 2 = 0 THEN upper(path) ELSE path END AS path, doc_id, doc_id + 100 * store AS mft_record, size + CASE WHEN (doc_id + store) % 13 = 0 THEN 1 ELSE 0 END AS size,
 CASE WHEN doc_id % 11 = 0 THEN 'nur_im_snapshot' WHEN (doc_id + store) % 13 = 0 OR (doc_id + store) % 7 = 0 THEN 'inhalt_abweichend' WHEN (doc_id + store) % 5 = 0 THEN 'nicht_pruefbar' END AS status FROM live l, range(5) r(store) WHERE (doc_id + store) % 9 <> 0)"""


@query(rf"""{_SNAPSHOTS} SELECT volume, store::INT AS store, regexp_extract(path, '([^\\]*)$', 1) AS name, path AS source, status, size::VARCHAR AS size, CASE WHEN doc_id % 11 <> 0 THEN doc_id::VARCHAR END AS live_record FROM s WHERE status IS NOT NULL ORDER BY volume, store, path, mft_record LIMIT 700""")
def snapshot_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing files of five snapshots in one window, the first 700."""
    found = catalog.snapshot_findings(catalog.snapshot_statuses(_snapshots(spark, sf_dir)), 700)[0]
    return found.select("volume", "store", "name", "source", F.col("attributes.status").alias("status"), F.col("attributes.groesse").alias("size"), F.col("attributes.live_mft_record").alias("live_record"))


@query(f"""{_SNAPSHOTS} SELECT volume, store::INT AS store, 'Schattenkopie ' || (store + 1) AS name, count(*)::VARCHAR AS files, (count(*) FILTER (status = 'nur_im_snapshot'))::VARCHAR AS only_there, (count(*) FILTER (status = 'inhalt_abweichend'))::VARCHAR AS different, (count(*) FILTER (status = 'nicht_pruefbar'))::VARCHAR AS unknown,
 greatest((SELECT count(*) FROM s WHERE status IS NOT NULL) - 700, 0) AS left_out FROM s GROUP BY ALL""")
def snapshot_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each snapshot with its counts, and how many differing files are not told one by one."""
    statuses = catalog.snapshot_statuses(_snapshots(spark, sf_dir))
    of = lambda name, alias: F.col("attributes")[name].alias(alias)
    counts = catalog.snapshot_summaries(statuses).select("volume", "store", "name", of("dateien_im_snapshot", "files"), of("nur_im_snapshot", "only_there"), of("inhalt_abweichend", "different"), of("nicht_pruefbar", "unknown"))
    return counts.crossJoin(F.broadcast(catalog.snapshot_findings(statuses, 700)[1]))  # one row


@query(f"SELECT f.doc_id AS evidence_id, first_id FROM {_FILES} f JOIN (SELECT source, sha256, min(doc_id) AS first_id FROM {_FILES} GROUP BY 1, 2) g ON f.source = g.source AND f.sha256 = g.sha256 AND f.doc_id > first_id")
def same_source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.same_source(files(spark, sf_dir).select("doc_id", "source", "sha256"), "source", "doc_id", "sha256")


@query("SELECT a.o_orderkey AS a_id, b.o_orderkey AS b_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1")
def possibly_same_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files seen by drive letter (even keys) and by device (odd keys)."""
    rest = F.concat(F.lit("\\c"), F.col("o_custkey").cast("string"))
    path = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("C:")).otherwise(F.lit("\\Device\\HarddiskVolume3")), rest)
    seen = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), path.alias("path"))
    volume, tail = textfn.path_parts(F.col("path"))
    return catalog.possibly_same(seen.select("file_id", volume.alias("volume"), tail.alias("rest")))
