"""Search queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import pages, search
from tracelake.operators.search import Term
from tracelake.session import table

from .registry import query

TERMS = (Term("licence", "license"), Term("licence", "version 3"), Term("function", "the and"), Term("credential", "token"), Term("credential", "secret"))
WORDS = (Term("function", "the", True), Term("function", "von", True), Term("credential", "token", True))
PAIRS = (Term("near", "token", False, "L"), Term("near", "\"", False, "R"))


def _hits_sql(terms: tuple[Term, ...]) -> str:
    """Every place of every term, found by looking at all places of the texts that hold it."""
    one = """SELECT doc_id, '{c}' AS category, '{t}' AS term, '{s}' AS side, i AS start, i + {n} AS "end" FROM (
SELECT doc_id, text, unnest(range(length(text) - {n} + 1)) AS i FROM documents WHERE contains(lower(text), '{t}')) WHERE lower(substr(text, i + 1, {n})) = '{t}'"""
    whole = """ AND NOT regexp_matches(substr(text, i, 1), '^[A-Za-z0-9_]') AND NOT regexp_matches(substr(text, i + {n} + 1, 1), '^[A-Za-z0-9_]')"""
    return " UNION ALL ".join((one + (whole.replace("substr(text, i, 1)", "CASE WHEN i = 0 THEN '' ELSE substr(text, i, 1) END") if t.whole_word else "")).format(c=t.category, t=t.text, s=t.side, n=len(t.text)) for t in terms)


@query(_hits_sql(TERMS))
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_hits(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)


@query(_hits_sql(WORDS))
def keyword_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_hits(table(spark, sf_dir, "documents"), "doc_id", "text", WORDS)


@query(f"""
WITH h AS ({_hits_sql(PAIRS)}),
o AS (SELECT *, last_value(CASE WHEN side = 'L' THEN struct_pack(s := start, e := "end") END IGNORE NULLS) OVER w AS l, last_value(CASE WHEN side = 'R' THEN struct_pack(s := start, e := "end") END IGNORE NULLS) OVER w AS r
 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY "end", length(term) DESC, term, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT doc_id, category, start, "end", CASE WHEN side = 'L' THEN r.s ELSE l.s END AS os, CASE WHEN side = 'L' THEN r.e ELSE l.e END AS oe FROM o),
g AS (SELECT *, greatest(start - oe, os - "end", 0) AS gap FROM p WHERE os IS NOT NULL)
SELECT doc_id, category, least(start, os) AS start, 'token' AS left_term, '"' AS right_term, gap FROM g WHERE gap <= 40""")
def keyword_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.keyword_hits(table(spark, sf_dir, "documents"), "doc_id", "text", PAIRS)
    return search.keyword_pairs(hits, "doc_id", 40)


@query(rf"""SELECT doc_id, term, start, left(regexp_replace(substr(text, greatest(start - 24, 0) + 1, "end" + 24 - greatest(start - 24, 0)), '[\x00-\x1f\x7f]', '.', 'g'), 200) AS context
FROM ({_hits_sql(TERMS)}) JOIN documents USING (doc_id)""")
def keyword_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = search.keyword_hits(docs, "doc_id", "text", TERMS).join(docs, "doc_id")
    return hits.select("doc_id", "term", "start", search.snippet(F.col("text"), F.col("start"), F.col("end") - F.col("start")).alias("context"))


_ADDRESS = "CASE WHEN doc_id % 3 = 0 THEN ' http://' || translate(left(sha256(text), 56), '0189', 'wxyz') || '.onion/x' ELSE '' END"


@query(rf"""SELECT doc_id, unnest(regexp_extract_all(lower(text || {_ADDRESS}), '([a-z2-7]{{56}})\.onion', 1)) AS address FROM documents""")
def onion_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in texts, to a third of which one made of the text's hash is added."""
    made = F.concat(F.lit(" http://"), F.translate(F.left(F.sha2(F.encode("text", "UTF-8"), 256), F.lit(56)), "0189", "wxyz"), F.lit(".onion/x"))
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, made).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(search.onion_addresses(text)).alias("address"))


@query(f"""SELECT category, doc_id, start, limited FROM (SELECT category, doc_id, start, row_number() OVER (PARTITION BY category ORDER BY doc_id, start, term) AS n, count(*) OVER (PARTITION BY category) > 100 AS limited FROM ({_hits_sql(TERMS)})) WHERE n <= 100""")
def cap_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.capped(keyword_hits(spark, sf_dir), ["category"], ["doc_id", "start", "term"], 100).select("category", "doc_id", "start", "limited")


@query("""SELECT doc_id, i AS start FROM (SELECT doc_id, text, unnest(range(length(text) - 4)) AS i FROM documents WHERE contains(text, 'token') AND length(text) >= 5) WHERE substr(text, i + 1, 5) = 'token'""")
def chunked_search_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal found in overlapping chunks of 1000 characters; a match belongs to the chunk that it starts in."""
    size, word = 1000, "token"
    chunks = search.chunks(table(spark, sf_dir, "documents").where(F.contains("text", F.lit(word))), "doc_id", "text", size, len(word) - 1).where(F.contains("chunk", F.lit(word)))
    found = search.literal_offsets(chunks, ["doc_id", "base"], "chunk", word)
    return found.where(F.col("start") < size).select("doc_id", (F.col("base") + F.col("start")).alias("start"))


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[A-Za-z0-9.:_%-]+')), '\.+$', '') AS token FROM documents)
SELECT doc_id, string_split(token, ':')[1] AS ip, count(*) AS n FROM t WHERE length(token) <= 128 AND regexp_full_match(token, '{_OCTET}(\.{_OCTET}){{3}}(:[0-9]{{1,5}})?') AND coalesce(try_cast(string_split(token, ':')[2] AS INT), 0) <= 65535 GROUP BY 1, 2""")
def ip_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(search.ipv4_literals(F.col("text"))).alias("ip"))
    return found.groupBy("doc_id", "ip").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, i AS start FROM (SELECT conv_id, turn, text, unnest(range(length(text) - 1)) AS i FROM conversations WHERE contains(text, 'th')) WHERE substr(text, i + 1, 2) = 'th'""")
def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").where(F.contains("text", F.lit("th")))
    return search.literal_offsets(talks, ["conv_id", "turn"], "text", "th").select("conv_id", "turn", "start")


@query(r"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM s),
o AS (SELECT doc_id, line_no, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM x)
SELECT doc_id, line_no, "offset", strlen(regexp_replace(line, '\r$', ''))::BIGINT AS bytes, suffix(regexp_replace(line, '\r$', ''), '`') AS continued FROM o WHERE trim(regexp_replace(line, '\r$', ''), ' ') <> ''""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.lines_with_offsets(table(spark, sf_dir, "documents"), "doc_id", "text", 1 << 30)
    return found.select("doc_id", "line_no", "offset", "bytes", "continued")


_FIELDS = "('lang: ' || lang || ' role: ' || source || ' text: ' || text)"


@query(f"SELECT doc_id, {_FIELDS} AS document FROM documents")
def search_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "document")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("text"), F.col("text"), F.lit("role"), F.col("source"), F.lit("lang"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", search.search_document(fields).alias("document"))


@query("SELECT doc_id, substr(text, greatest(1, strpos(lower(text), 'license') - 60), 240) AS preview FROM documents WHERE contains(lower(text), 'license')")
def search_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").where(pages.contains_literal(F.col("text"), "License"))
    return found.select("doc_id", search.preview(F.col("text"), "License").alias("preview"))


@query(f"""SELECT doc_id, preview, count(*) OVER () > 100 AS more FROM (SELECT doc_id, substr(d, greatest(1, strpos(lower(d), 'the') - 60), 240) AS preview FROM (SELECT doc_id, source, {_FIELDS} AS d FROM documents)
WHERE source = 'src3' AND contains(lower(d), 'the') AND doc_id > 20 ORDER BY doc_id LIMIT 101) ORDER BY doc_id LIMIT 100""")
def artifact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case's artifacts by a literal in their search document, with previews, a page at a time."""
    found = pages.where_given(_documents(spark, sf_dir), case=F.col("source") == "src3", text=pages.contains_literal(F.col("document"), "THE"))
    return pages.page(found.select("doc_id", search.preview(F.col("document"), "the").alias("preview")), ["doc_id"], (20,), 100)


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(role || ' ' || text), 'user th')")
def text_search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(pages.contains_literal(F.concat("role", F.lit(" "), "text"), "USER th")).select("conv_id", "turn")
