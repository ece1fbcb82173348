"""Audit of how the sources of a language differ in their terms, by joint histograms of counts.

The distance of two sources is a sum, over all terms, of a function of the two counts alone. So terms are not compared: for
each pair of sources the distinct (count, count) combinations are tallied, and the function is evaluated once for each,
times its multiplicity. Combinations of two counts above zero come from the terms that both sources have; those with a zero
are implied: how many terms of the one source have the count, less those of them that the other source has too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sparkio import bound_batches, saved

#: documents of a language that a kept term is in
LEAST_DOCS = 3
#: ranks of terms returned for each group
TOP = 200
#: what the smallest share is multiplied by
SCALE = 1_000_000_000
#: different terms that a task holds before it passes them on, and bytes of a text split at a time
HELD, CHUNK = 200_000, 1 << 20

#: bytes of terms: letters, A-Z as a-z, and all of other characters; the rest are spaces
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def count_terms(text: bytes) -> Counter:
    """How often each term occurs in a text."""
    out, at = Counter(), 0
    text = text.translate(_TERM_BYTES)
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        end = len(text) if end < 0 else end
        out.update(text[at:end].split())
        at = end
    return out


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial ``n`` occurrences and ``docs`` documents of each (lang, source, term), several rows for one."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        held = 0

        def rows() -> pa.RecordBatch:
            keys = [k for k, terms in groups.items() for _ in terms]
            terms = [t for g in groups.values() for t in g]
            counts = np.array([c for g in groups.values() for c in g.values()], np.int64).reshape(-1, 2)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts[:, 0]), pa.array(counts[:, 1])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                group = groups.setdefault((lang, source), {})
                held -= len(group)
                for term, n in count_terms(text.as_buffer().to_pybytes()).items():
                    if (seen := group.get(term)) is None:
                        group[term] = [n, 1]
                    else:
                        seen[0] += n
                        seen[1] += 1
                held += len(group)
                if held >= HELD:
                    yield rows()
                    groups, held = {}, 0
        yield rows()

    return docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def joint_counts(terms: DataFrame) -> DataFrame:
    """Partial multiplicities ``m`` of (lang, a, b, n_a, n_b), a before b, over the terms that both have, several rows for one.

    ``terms`` has ``lang`` and ``sources``, the (source, n) of each term in the sources' order.
    """
    names = ["lang", "a", "b", "n_a", "n_b", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch.column(1)
            entries = each.flatten()
            term = np.repeat(np.arange(len(each)), each.value_lengths().to_numpy())
            langs, sources = batch.column(0).dictionary_encode(), entries.field(0).dictionary_encode()
            lang, source, n = langs.indices.to_numpy()[term].astype(np.int64), sources.indices.to_numpy().astype(np.int64), entries.field(1).to_numpy()
            values, count = np.unique(n, return_inverse=True)
            first, found = np.arange(len(term)), []
            for away in range(1, len(term)):
                first = first[first + away < len(term)]
                first = first[term[first] == term[first + away]]  # what has left its term stays out
                if not len(first):
                    break
                pair = (lang[first] * len(sources.dictionary) + source[first]) * len(sources.dictionary) + source[first + away]
                found.append(np.stack(np.unique((pair * len(values) + count[first]) * len(values) + count[first + away], return_counts=True)))
            if not found:
                continue
            key, m = np.concatenate(found, axis=1)
            key, at = np.unique(key, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, m)
            key, n_b = np.divmod(key, len(values))
            key, n_a = np.divmod(key, len(values))
            key, b = np.divmod(key, len(sources.dictionary))
            lang_of, a = np.divmod(key, len(sources.dictionary))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang_of)), sources.dictionary.take(pa.array(a)), sources.dictionary.take(pa.array(b)), pa.array(values[n_a]), pa.array(values[n_b]), pa.array(total)], names=names)

    return terms.select("lang", "sources").mapInArrow(run, "lang string, a string, b string, n_a bigint, n_b bigint, m bigint")


def share(n: str | Column, total: str, terms: str) -> Column:
    """The exact scaled share of a count: 1 + floor(SCALE * (n + 1) / (total + terms)); null without terms."""
    n = F.col(n) if isinstance(n, str) else n
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + 1)
    return F.call_function("div", scaled, F.nullif(F.col(total) + F.col(terms), F.lit(0)).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``: distances to the language's other sources (part `pair`, all of them) and the terms a source is richest in (part `term`, ``top`` ranks).

    Nulls of all three columns are empty; every row counts as a document, whether repeated or not; texts may be of any length;
    ties of value go by item in the order of UTF-8; a group without terms is compared like any other; an empty table gives no
    rows. Other columns aren't read. What is held for one term, and returned for one source, grows with the number of sources of its language.
    """
    bound_batches(docs.sparkSession)
    named = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    dealt = term_counts(named).repartition("lang", "term")  # for both sums
    counted = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources")).where(F.col("docs") >= least_docs)
    kept = saved(kept.drop("docs"), "audit-terms")
    each = kept.select("lang", "term", "lang_n", F.inline("sources"))

    groups = named.select("lang", "source").distinct()
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = saved(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("terms"), zero("lang_total")), "audit-groups")

    marginal = saved(each.groupBy("lang", "source", "n").agg(F.count("*").alias("m")), "audit-marginals")
    side = lambda n: groups.select("lang", F.col("source").alias(n))
    pairs = side("a").join(side("b"), "lang").where("a < b")  # as many as the result has rows
    cell = lambda n_a, n_b, m: F.struct(n_a.cast("bigint").alias("n_a"), n_b.cast("bigint").alias("n_b"), m.cast("bigint").alias("m"))
    none, m = F.lit(0), F.col("m")
    joint = joint_counts(kept).groupBy("lang", "a", "b", "n_a", "n_b").agg(F.sum("m").alias("m"))
    both = joint.select("lang", "a", "b", F.inline(F.array(cell(F.col("n_a"), F.col("n_b"), m), cell(F.col("n_a"), none, -m), cell(none, F.col("n_b"), -m), cell(none, none, m))))
    own = lambda s, n_a, n_b: pairs.join(marginal.withColumnRenamed("source", s), ["lang", s]).select("lang", "a", "b", F.inline(F.array(cell(n_a, n_b, m), cell(none, none, -m))))
    neither = pairs.join(groups.select("lang", "terms").distinct(), "lang").select("lang", "a", "b", F.inline(F.array(cell(none, none, F.col("terms")))))
    cells = both.unionByName(own("a", F.col("n"), none)).unionByName(own("b", none, F.col("n"))).unionByName(neither)
    cells = cells.groupBy("lang", "a", "b", "n_a", "n_b").agg(F.sum("m").alias("m"))

    of = lambda s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), *(["terms"] if s == "a" else []))
    shares = cells.join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"]).withColumns({"p_a": share("n_a", "total_a", "terms"), "p_b": share("n_b", "total_b", "terms")})
    times = lambda p, q: distance(F.col(p), F.col(q)).cast("decimal(20,0)") * F.col("m").cast("decimal(18,0)")
    summed = shares.groupBy("lang", "a", "b").agg(F.sum(times("p_a", "p_b")).alias("ab"), F.sum(times("p_b", "p_a")).alias("ba"))
    row = lambda s, item, value: F.struct(F.col(s).alias("source"), F.col(item).alias("item"), F.coalesce(value, F.lit(0)).cast("bigint").alias("value"))
    pair = summed.select("lang", F.lit("pair").alias("part"), F.inline(F.array(row("a", "b", F.col("ab")), row("b", "a", F.col("ba")))))

    rich = each.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total", "terms"), "q": share("lang_n", "lang_total", "terms")}).where("p > q")
    term = rich.select("lang", F.lit("term").alias("part"), "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    # the limit on row_number is applied before the shuffle too
    out = pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")
