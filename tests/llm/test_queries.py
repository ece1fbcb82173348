"""The registered queries and the pipeline on the smallest driver tables, where they exist."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tracelake.llm import queries, secrets, warc

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_contracts(spark):
    wanted = {
        "op1_multi_index_hashing": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")],
        "op2_quality": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
        "op3_line_dedup": [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")],
        "op7_secret_scan": [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")],
        "op9_language_id": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
        "op10_decontamination": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")],
    }
    for name, columns in wanted.items():
        assert queries.queries()[name](spark, SF).dtypes[: len(columns)] == columns


def test_line_dedup_query(spark):
    got = sorted(tuple(r) for r in queries.op3_line_dedup(spark, SF).collect())
    assert got == sorted((i, n, d, brute.sha(t)) for i, n, d, t in brute.line_dedup(documents(spark)))


def test_secret_query(spark):
    texts = dict(documents(spark))
    for r in queries.op7_secret_scan(spark, SF).collect():
        base = brute.secrets(texts[r.doc_id])
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{z}" for k, a, z in base))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex"))


def test_secret_query_spans(spark, tmp_path):
    """All spans of the driver's documents and of random strings, the entropy ones from windows counted afresh each."""
    rnd = random.Random(4)
    strings = ["".join(rnd.choice(a) for _ in range(rnd.randrange(10, 60))) for a in ("0123456789abcdefABCDEF", "abcxyzABCXYZ019", "aB3+/_-=zQ7kLmN0pR") for _ in range(60)]
    more = [(10_000 + i, f"é {rnd.choice(['', 'sig=', 'id:', 'a-'])}{t}{rnd.choice(['', '.', '=='])} ß") for i, t in enumerate(strings)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    allow = "(?:[A-Za-z_]{1,15}=)?(?:" + "|".join(f"(?:{a})" for a in secrets.ALLOW) + ")"
    classes = [(c.alphabet.decode(), c.window, c.bits) for c in secrets.CLASSES]
    seen = 0
    for r in queries.op7_secret_scan(spark, str(tmp_path)).collect():
        base = brute.secrets(texts[r.doc_id])
        found = brute.entropy_spans(texts[r.doc_id], allow, classes, base)
        seen += len(found)
        both = sorted([(a, secrets.KINDS.index(k), z, k) for k, a, z in base] + [(a, 3, z, "entropy") for a, z in found])
        assert r.spans == ",".join(f"{k}:{a}:{z}" for a, _, z, k in both)
    assert seen


def test_warc_query(spark):
    """Records of all pages against the standard library's HTML parser and digests."""
    import base64
    import hashlib

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    digest = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    rows = queries.op5_warc_derivatives(spark, SF).collect()
    assert sorted((r.page_id, r.warc_type) for r in rows) == sorted((p, k) for p in pages for k in ("metadata", "conversion"))
    own = {(r.page_id, r.warc_type): r.record_id for r in rows}
    for r in rows:
        p = pages[r.page_id]
        title, lang, links, lines = brute.page(p.html or "", warc._BREAKS, warc._LINKS)
        head = dict(x.split(": ", 1) for x in r.headers.split("\n"))
        source = (p.html or "").encode()
        assert r.payload_digest == digest(source) and r.block_digest == digest(r.block.encode()) == head["WARC-Block-Digest"]
        assert head["WARC-Refers-To"] == r.refers_to and head["WARC-Target-URI"] == p.url and head["WARC-Date"] == warc.NO_DATE
        assert int(head["Content-Length"]) == r.content_length == len(r.block.encode())
        if r.warc_type == "conversion":
            assert r.block.split("\n") == (lines or [""]) and head["WARC-Concurrent-To"] == own[r.page_id, "metadata"]
        else:
            fields = [x.split(": ", 1) for x in r.block.split("\r\n") if x]
            assert [v for n, v in fields if n == "outlink"] == links
            assert dict(fields).get("title") == title and dict(fields).get("language") == lang


def test_neighbour_query(spark):
    """Recall against all distances, and exact ones."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = sorted((i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {}
    for r in queries.op1_multi_index_hashing(spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    asked = [i for i in ids.tolist() if i % 100 == 0]
    assert sorted(got) == asked
    hits = 0
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[:10]
        hits += len(set(ids[order].tolist()) & {v for v, _ in got[q].values()})
        assert sorted(got[q]) == list(range(1, 11)) and all(abs(d[ids == v][0] - s) < 1e-12 for v, s in got[q].values())
        assert [v for _, v in sorted(got[q].items())] == sorted(got[q].values(), key=lambda x: (x[1], x[0]))
    assert hits >= 0.9 * 10 * len(asked)


def test_jaccard_query(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op8_jaccard_join(spark, SF).collect()), key=str)
    assert got == brute.near_duplicates(documents(spark), 3, 90)


def test_decontamination_query(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op10_decontamination(spark, SF).collect())
    assert got == sorted((i, n, h, len(ids), brute.sha(",".join(sorted(map(str, ids)))), c) for i, n, h, ids, c in brute.contamination(documents(spark), items))


def test_decontamination_query_with_items_without_an_id(spark, tmp_path):
    """Every second id is null: the query against its SQL, and the pipeline's stage."""
    duckdb = pytest.importorskip("duckdb")
    from tracelake.llm import oracle

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("item_id", F.when(F.col("item_id") % 2 == 0, F.col("item_id")))
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    out = queries.op10_decontamination(spark, str(tmp_path))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_words", "longest_at")
    got = sorted(tuple(r[c] for c in columns) for r in out.collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({oracle.SQL['op10_decontamination']})").fetchall())
    assert any(r[5] and r[4] == brute.sha("") for r in got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.decontaminate_benchmark(spark, docs, str(tmp_path)).count() == sum(not r[5] for r in got)


def test_span_query(spark):
    got = sorted((r.doc_id, r.n_sentences, r.n_removed, r.text) for r in queries.op6_sentence_spans(spark, SF).collect())
    assert got == sorted(brute.sentence_spans(documents(spark)))


def test_models_hold_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = queries.op9_language_id(spark, SF).where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert said >= 0.9
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = queries.op2_quality(spark, SF).where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert scored >= 0.8


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    told = stage["language_id"](spark, docs, SF)
    assert told.columns == docs.columns
    rejected = docs.join(told, "doc_id", "left_anti").collect()
    assert len(rejected) < 0.05 * docs.count()
    rows = sorted((r.doc_id, r.text) for r in told.collect())
    rows = [(i, t) for i, _, _, t in brute.line_dedup(rows)]
    rows = [r for r, (i, _, c) in zip(sorted(rows), sorted(brute.near_duplicates(rows, 5, 80)), strict=True) if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r, c in zip(rows, brute.contamination(rows, items), strict=True) if not c[4]]
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == rows
    assert all(r.ids for r in out.where("length(text) > 0").collect())
    # blank texts have no letter and are gone
    assert not [r for r in rows if not re.search(r"\w", r[1])]
