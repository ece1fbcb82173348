"""The keyword analyzer: terms in the text files of users, within limits a file, a category and a domain.

A file is scanned by one task, so that its own limits are kept while it is scanned and no more leaves the task. The limit of a domain
goes over all files in their order: hits a file are counted, the files that the limit can reach are found by a sort with a limit for each domain
(every task keeps its first ones, then those are merged), their prefix sums say where the domain is cut, and only hits before the cut stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import artifacts, search
from tracelake.operators.search import Term

#: fixed values: endings of files that are read as text, and the limits
TEXT_ENDINGS = (
    "txt", "log", "csv", "tsv", "ini", "cfg", "conf", "json", "xml", "yaml", "yml", "html", "htm", "md", "eml", "vcf", "rtf", "sql", "ps1", "bat", "cmd", "sh", "py", "js", "php", "reg", "url", "srt", "sub",
)
MOST_OF_FILE, MOST_OF_CATEGORY, MOST_OF_DOMAIN = search.MOST_HITS, search.MOST_PER_CATEGORY, search.MOST_PER_DOMAIN


def in_scope(path: Column) -> Column:
    """A user's file with the ending of a text."""
    ending = F.lower(F.regexp_extract(artifacts.file_name(path), r"\.([^.]+)$", 1))
    return artifacts.is_user_content(path) & ending.isin(*TEXT_ENDINGS)


def limited_hits(files: DataFrame, key: str, text: str, terms: Sequence[Term], most: int = MOST_OF_FILE, most_of_category: int = MOST_OF_CATEGORY) -> DataFrame:
    """``search.keyword_hits`` within a file's limits: key, category, term, start, end, ``n`` (the hit's number in its file and category, from 1) and ``warning``.

    Hits count in the order of their ends, of hits that end at one place the longest first. A category that has
    its ``most_of_category`` adds no more, others do; at ``most`` hits the scan ends. Where hits are missing the file has a row
    with a warning, which names the category or is of all of them.
    """
    kind = files.schema[key].dataType.simpleString()
    source = search.holding_any(files, text, terms).select(key, text)

    def scanned(content: str, automaton) -> tuple[list[tuple], set[str], bool]:
        found, counts, cut = [], {}, set()
        for last, (n, own) in automaton.iter(search._ascii_low(content)):
            for t in sorted(own, key=lambda t: t.text):
                if not search._edges_fit(t, content, last + 1 - n, last + 1):
                    continue
                if len(found) >= most:
                    return found, cut, True
                if counts.get(t.category, 0) >= most_of_category:
                    cut.add(t.category)
                    continue
                counts[t.category] = counts.get(t.category, 0) + 1
                found.append((t.category, t.text, last + 1 - n, last + 1, counts[t.category], None))
        return found, cut, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = search._automaton(terms)
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            at, rows = [], []
            for k, content in enumerate(batch.column(1)):
                found, cut, ended = scanned(content.as_py(), automaton)
                found += [(c, None, None, None, None, f"Kategorie {c}: Grenze {most_of_category} erreicht") for c in sorted(cut)]
                found += [(None, None, None, None, None, f"Gesamt-Treffergrenze {most} erreicht")] if ended else []
                rows += found
                at += [k] * len(found)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "category", "term", "start", "end", "n", "warning"])

    return source.mapInArrow(run, f"`{key}` {kind}, category string, term string, start bigint, end bigint, n bigint, warning string")


def within_domains(hits: DataFrame, key: str, domains: Sequence[str], most: int = MOST_OF_DOMAIN) -> tuple[DataFrame, DataFrame]:
    """The hits (key, domain, n: a hit's number in its file and domain) before each domain's limit, files in the order of their keys; and the domains that were cut: domain, found.

    ``domains`` is the term table's, a few. Hits are read twice, so write them before.
    """
    counts = hits.groupBy("domain", key).agg(F.count(F.lit(1)).alias("hits"))
    # every file here has a hit, so that the limit can't reach further
    first = reduce(DataFrame.unionByName, [counts.where(F.col("domain") == d).orderBy(key).limit(most) for d in domains])
    before = Window.partitionBy("domain").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)  # over at most that many rows
    begun = first.withColumn("before", F.coalesce(F.sum("hits").over(before), F.lit(0))).where(F.col("before") < most).select("domain", key, "before")
    kept = hits.join(begun, ["domain", key]).where(F.col("before") + F.col("n") <= most).drop("before")
    totals = counts.groupBy("domain").agg(F.sum("hits").alias("found"))
    return kept, totals.where(F.col("found") > most)


def keyword_findings(files: DataFrame, terms: Sequence[Term], folder: str, key: str = "file_id", most: int = MOST_OF_FILE, most_of_category: int = MOST_OF_CATEGORY, most_of_domain: int = MOST_OF_DOMAIN) -> tuple[DataFrame, DataFrame]:
    """Findings of a term table in users' text files (key, path, text): key, domain (the category), name (the term), source (the path), start and end; and warnings: domain, key (null for all files), warning.

    The scan's hits are written to ``folder``, a new one in a shared place. A key names one file; files without path or text have no finding.
    """
    spark = files.sparkSession
    scoped = files.where(in_scope(F.col("path")) & F.col("text").isNotNull())
    limited_hits(scoped, key, "text", terms, most, most_of_category).withColumnRenamed("category", "domain").write.parquet(folder)
    hits = spark.read.parquet(folder)
    kept, cut = within_domains(hits.where("warning IS NULL"), key, sorted({t.category for t in terms}), most_of_domain)
    findings = kept.join(scoped.select(key, "path"), key).select(key, "domain", F.col("term").alias("name"), F.col("path").alias("source"), "start", "end")
    warnings = hits.where("warning IS NOT NULL").select("domain", key, "warning").unionByName(cut.select("domain", F.lit(None).cast(hits.schema[key].dataType).alias(key), F.concat(F.lit("Domäne "), "domain", F.lit(f": globale Grenze {most_of_domain} erreicht")).alias("warning")))
    return findings, warnings
