"""The keyword analyzer over documents as files, with limits that cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import keyword
from tracelake.session import table
from tracelake.workspace import shared_folder

from .registry import query
from .search import TERMS, WORDS, _hits_sql

LIMITS = {"most": 12, "most_of_category": 8, "most_of_domain": 150}
_NAMES = (r"Users\a\d{}.txt", r"Windows\d{}.txt", r"Users\a\AppData\d{}.log", r"users\b\d{}.exe", r"Data\d{}.JSON")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.get(F.array(*(F.replace(F.lit(n), F.lit("{}"), F.col("doc_id").cast("string")) for n in _NAMES)), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")


_SQL = f"""WITH h AS MATERIALIZED (SELECT doc_id, category, term, start, "end" FROM ({_hits_sql(TERMS)} UNION ALL {_hits_sql(WORDS)}) WHERE doc_id % 5 IN (0, 4)),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY "end", length(term) DESC, term) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY "end", length(term) DESC, term) AS every FROM h),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY every) AS place FROM c WHERE n <= {LIMITS['most_of_category']}),
f AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id, place) AS d FROM a WHERE place <= {LIMITS['most']}),
stop AS (SELECT doc_id, min(every) AS at FROM (SELECT a.doc_id, c.every FROM a JOIN c ON c.doc_id = a.doc_id AND c.every > a.every WHERE a.place = {LIMITS['most']}) GROUP BY 1)"""


@query(rf"""{_SQL} SELECT doc_id AS file_id, category AS domain, term AS name, CASE WHEN doc_id % 5 = 0 THEN 'Users\a\d' || doc_id || '.txt' ELSE 'Data\d' || doc_id || '.JSON' END AS source, start, "end" FROM f WHERE d <= {LIMITS['most_of_domain']}""")
def keyword_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in files of users, cut by all three limits."""
    return keyword.keyword_findings(_files(spark, sf_dir), TERMS + WORDS, shared_folder(spark, "keyword-hits"), **LIMITS)[0]


@query(f"""{_SQL} SELECT doc_id AS file_id, NULL AS domain, 'Gesamt-Treffergrenze {LIMITS['most']} erreicht' AS warning FROM stop
UNION ALL SELECT DISTINCT c.doc_id, category, 'Kategorie ' || category || ': Grenze {LIMITS['most_of_category']} erreicht' FROM c LEFT JOIN stop s ON s.doc_id = c.doc_id WHERE n > {LIMITS['most_of_category']} AND (s.at IS NULL OR every < s.at)
UNION ALL SELECT NULL, category, 'Domäne ' || category || ': globale Grenze {LIMITS['most_of_domain']} erreicht' FROM f GROUP BY category HAVING count(*) > {LIMITS['most_of_domain']}""")
def keyword_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the limits left out: by file and category, by file, and by domain."""
    return keyword.keyword_findings(_files(spark, sf_dir), TERMS + WORDS, shared_folder(spark, "keyword-hits"), **LIMITS)[1]
