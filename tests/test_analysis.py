"""Tokens, byte searches, sinks, masking and audit on small hand-made rows."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions import bytesfn, jsonfn, netfn, textfn
from tracelake.operators import artifacts, correlate, dimensions, govern, registry, search, tokens
from tracelake.operators.search import Term
from tracelake.sources import sinks


def test_tokens_read_back_and_reject():
    time = datetime.datetime(2024, 1, 2, 3, 4, 5, 600000)
    assert tokens.read_moment("2024-01-02T03:04:05.600000Z|12345678-1234-1234-1234-123456789abc") == (time, "12345678-1234-1234-1234-123456789abc")
    assert tokens.read_moment("2024-01-02T04:04:05.6+01:00|7", number=True) == (time, 7)
    assert tokens.read_name("a|b|9", number=True) == ("a|b", 9)
    assert tokens.read_entry("0|5|a|b") == (False, 5, "a|b")
    assert tokens.read_record('[1,2,"a\\"|"]') == (1, 2, 'a"|')
    bad = [
        (tokens.read_moment, ("", "x", "2024-01-02|7", "2024-01-02T03:04:05|7", "2024-01-02T03:04:05Z|no", "2024-13-02T03:04:05Z|12345678-1234-1234-1234-123456789abc")),
        (tokens.read_name, ("", "a", "a|b")), (tokens.read_entry, ("", "2|5|a", "0|x|a", "0|5", "1|٣|a")), (tokens.read_record, ("", "{}", "[1,2]", '[1,"2","a"]', '[true,2,"a"]', "[1,2,3]")),
    ]
    for read, texts in bad:
        for t in texts:
            with pytest.raises(tokens.TokenError):
                read(t)
    assert (tokens.page_rows(None), tokens.page_rows(0), tokens.page_rows(5000)) == (500, 1, 1000)
    with pytest.raises(ValueError, match="1024"):
        tokens.checked_filters(None, "x" * 1025)


def test_byte_hits(spark):
    """Both encodings, whole words by the term's own edges, text contexts, and hits that overlap."""
    contents = [b"TOKEN atokenb", "x tokEn-".encode("utf-16-le"), b"\x00\x01tok\x00", b"aaaa", b"", None, b"padding: token \xff"]
    files = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(contents)], "id bigint, content binary")
    terms = (Term("w", "token", True), Term("o", "aa"), Term("t", "tok"))
    found = sorted((r.id, r.category, r.encoding, r.start, r["end"]) for r in search.byte_hits(files, "id", "content", terms).collect())
    assert found == [(0, "t", "ascii", 0, 3), (0, "t", "ascii", 7, 10), (0, "w", "ascii", 0, 5), (1, "t", "utf16le", 4, 10), (1, "w", "utf16le", 4, 14), (2, "t", "ascii", 2, 5), (3, "o", "ascii", 0, 2), (3, "o", "ascii", 1, 3), (3, "o", "ascii", 2, 4), (6, "t", "ascii", 9, 12), (6, "w", "ascii", 9, 14)]
    texts = sorted((r.id, r.category) for r in search.byte_hits(files, "id", "content", terms, text_only=True).collect())
    assert texts == [(0, "t"), (0, "t"), (0, "w"), (1, "t"), (1, "w"), (6, "t"), (6, "w")]
    plain = sorted((r.category, r.encoding, r.start) for r in search.byte_hits(files.where("id = 1"), "id", "content", terms).collect())
    assert plain == sorted((c, e, at) for c, _, e, at in search.scanned_bytes(contents[1], terms))


def test_literal_offsets_and_limits(spark):
    rows = spark.createDataFrame([(1, bytearray(b"aaa")), (2, bytearray("aa".encode("utf-16-le"))), (3, None)], "id bigint, content binary")
    found = sorted((r.id, r.encoding, r.start, r.limited) for r in search.literal_offsets(rows, ["id"], "content", "aa", 1).collect())
    assert found == [(1, "utf8", 0, True), (2, "utf16le", 0, False)]
    text = spark.createDataFrame([(1, "äaä äaä")], "id bigint, t string")
    assert [r.start for r in search.literal_offsets(text, ["id"], "t", "äa").orderBy("start").collect()] == [0, 4]


def test_address_hits(spark):
    """Ports, mapped addresses, bad numbers, and an odd phase of UTF-16."""
    text = b"192.0.2.1:80 2001:DB8::1 ::ffff:192.0.2.3 10.0.0.1. 01.2.3.4 1.2.3 12:30 fe80::1%eth0"
    rows = spark.createDataFrame([(1, bytearray(text)), (2, bytearray(b"\x01" + "10.1.2.3".encode("utf-16-le")))], "id bigint, content binary")
    found = {(r.id, r.address, r.original, r.kind, r.encoding, r.start, r.bytes) for r in search.address_hits(rows, "id", "content").collect()}
    assert found == {(1, "192.0.2.1", "192.0.2.1", "IPv4", "ascii", 0, 9), (1, "2001:db8::1", "2001:DB8::1", "IPv6", "ascii", 13, 11), (1, "::ffff:192.0.2.3", "::ffff:192.0.2.3", "IPv6", "ascii", 25, 16), (1, "10.0.0.1", "10.0.0.1", "IPv4", "ascii", 42, 8), (2, "10.1.2.3", "10.1.2.3", "IPv4", "utf16le", 1, 16)}
    words = spark.createDataFrame([(1, "at 10.0.0.1"), (2, "none"), (3, None)], "id bigint, t string")
    assert [(r.id, r.address) for r in search.address_hits(words, "id", "t").collect()] == [(1, "10.0.0.1")]


def test_json_lines_are_the_same_each_time(spark, tmp_path):
    rows = spark.createDataFrame([(0, f"p{i % 7}", i) for i in range(100)], "volume_offset bigint, pfad string, mft_record bigint")
    seen = []
    for name, n in (("a", 3), ("b", 11)):
        sinks.write_json_lines(rows.repartition(n), str(tmp_path / name), sinks.CATALOG_ORDER)
        seen.append("".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*"))))
    assert seen[0] == seen[1] and [json.loads(x)["pfad"] for x in seen[0].splitlines()] == sorted(f"p{i % 7}" for i in range(100))


def test_catalog_blocks_and_reports(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS mft, '2026-04-18T09:40:47.3257138Z' AS erstellt, CAST(18446744073709551615 AS DECIMAL(20,0)) AS groesse UNION ALL SELECT 2L, 'x', CAST(7 AS DECIMAL(20,0))")
    path = str(tmp_path / "catalog")
    assert [sinks.append_blocks(rows, path, ["mft"], ["erstellt"]) for _ in range(2)] == [2, 0]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 134209788473257138, None), (2, None, 7)]
    data, digest = sinks.report({"<a>": rows.select("mft")}, 5)
    assert json.loads(data) == {"<a>": [{"mft": 1}, {"mft": 2}]} and len(digest) == 64 and "&lt;a&gt;" in sinks.report_html(data)
    with pytest.raises(ValueError, match="over 1 rows"):
        sinks.report({"x": rows}, 1)
    listed = spark.createDataFrame([('[{"a":1},{"a":null}]',), ("[]",)], "doc string")
    assert [r.a for r in sinks.from_json_table(listed, "doc", "a bigint").collect()] == [1, None]
    seen_rows, seen = sinks.watched(rows, "w")
    seen_rows.collect()
    assert seen.get == {"rows": 2, "errors": 0}


def test_masking_at_depth_and_audited_reads(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"a":[{"passwort":"x","wert":"y"}]}', False), (2, '{"wert":"y"}', True), (3, "[1]", True), (4, "no json", True), (5, None, True)], "id bigint, doc string, s boolean")
    out = {r.id: r.doc for r in govern.masked_documents(rows, "doc", "s").collect()}
    assert out == {1: '{"a":[{"passwort":"[maskiert]","wert":"y"}]}', 2: '{"wert":"[maskiert]"}', 3: '"[maskiert]"', 4: None, 5: None}
    payload = govern.audit_row("ann", "suche", "case", "2024", searched="geheim", n=3)
    assert "geheim" not in payload and json.loads(payload)["details"]["n"] == 3
    assert govern.audited(rows, str(tmp_path / "trail"), payload).count() == 5
    assert [r.payload for r in spark.read.parquet(str(tmp_path / "trail")).collect()] == [payload]


def test_rules_and_limits(spark):
    """+2 s matches and 1 ns more does not; a thousand equal rows reach the limits."""
    base = {"entity_id": 1, "entity_kind": "file", "role": "executable", "semantics": "event_time", "kind": "process_start"}
    row = lambda i, at, parser="p", **more: {**base, "event_id": i, "artifact_id": f"a{i}", "time_ns": at, "parser": parser, **more}
    rows = [row(1, 0), row(2, 2 * 10**9, "q"), row(3, 4 * 10**9 + 1, "p"), row(4, 10**12, entity_kind="service", kind="service_installed"), row(5, 10**12 + 10**11, entity_kind="service", kind="service_started"), row(6, 10**12 - 1, entity_kind="service", kind="service_started")]
    df = spark.createDataFrame([tuple(r[k] for k in sorted(r)) for r in rows], ", ".join(f"{k} {'bigint' if k in ('event_id', 'time_ns', 'entity_id') else 'string'}" for k in sorted(rows[0])))
    assert sorted(map(tuple, correlate.rule_pairs(df, ["entity_id"]).collect())) == [("execution-sources", 1, 2), ("persistence-activity", 4, 5)]
    many = df.where("event_id = 1").crossJoin(spark.range(40).withColumnRenamed("id", "n")).withColumns({"event_id": F.col("n"), "artifact_id": F.concat(F.lit("a"), F.col("n").cast("string")), "parser": F.concat(F.lit("p"), (F.col("n") % 2).cast("string"))}).drop("n")
    assert {r.limited for r in correlate.limited_rules(many, ["entity_id"]).collect()} == {False}
    out = correlate.limited_rules(many, ["entity_id"], comparisons=50, matches=10).collect()
    assert len(out) == 10 and all(r.limited for r in out)


def test_binary_values(spark):
    data = [bytes.fromhex("0101000000000005" + "12000000"), bytes.fromhex("01000000000000ff"), b"\x01", "hé".encode("utf-16-le") + b"\0\0", b"\x00\xd8", None]
    df = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(data)], "i int, d binary").orderBy("i")
    out = df.select(bytesfn.sid_text(F.col("d")).alias("sid"), bytesfn.utf16_text(F.col("d")).alias("text"), bytesfn.unsigned(F.col("d"), 0, 2).alias("n")).collect()
    assert [r.sid for r in out] == ["S-1-5-18", "S-1-255", None, None, None, None]
    assert [r.text for r in out][2:] == [None, "hé", None, None] and [None if r.n is None else int(r.n) for r in out] == [257, 1, None, 104, 0xD800, None]


def test_empty_inputs(spark):
    values = spark.createDataFrame([], "image bigint, hive string, user string, key string, name string, text string, data binary, hive_offset bigint, key_offset bigint, key_filetime bigint")
    for analyzer in (registry.autostarts, registry.services, registry.usb_devices, registry.mounts, registry.last_executions, registry.typed_urls, registry.mru_entries, registry.user_assist):
        assert analyzer(values).columns == ["image", "domain", "name", "source", "attributes"] and analyzer(values).count() == 0
    files = spark.createDataFrame([(1, "Windows\\System32\\Tasks\\x", None), (2, None, None)], "file_id bigint, path string, text string")
    assert artifacts.task_findings(files).count() == artifacts.hidden_service_findings(files).count() == artifacts.startup_findings(files).count() == 0
    assert [r.limited for r in dimensions.capped(spark.range(3).withColumn("g", F.lit(1)), ["g"], ["id"], 2).collect()] == [True, True]


VALUE = "image bigint, hive string, user string, key string, name string, text string, data binary, hive_offset bigint, key_offset bigint, key_filetime bigint"


def test_list_positions_are_not_broadcast(spark, tmp_path):
    """Positions grow with the entries; a small estimate of either must not send them to the driver."""
    key = registry.EXPLORER + "\\RunMRU"
    rows = [(i, "NTUSER", user, key, name, text, None, 0, 0, 0) for i in range(2) for user in "ab" for name, text in (("a", "x\\1"), ("b", user), ("c", "z"), ("MRUList", "ba" if i else "abb"))]
    spark.createDataFrame(rows, VALUE).write.parquet(str(tmp_path / "values"))
    found = registry.mru_entries(spark.read.parquet(str(tmp_path / "values")), ["image", "user"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    position = {(r.image, r.user, r.name): r.attributes.get("mru_position") for r in found.collect()}
    assert position == {(i, user, name): at for i in range(2) for user in "ab" for name, at in (("x", "1" if i else "0"), (user, "0" if i else "2"), ("z", None))}


def test_control_sets_are_not_broadcast(spark, tmp_path):
    """There are as many sets as installations; of each, services, devices and executions of the one in use are found, whatever their number."""
    rows = []
    for image, current in ((1, "2"), (2, None), (3, "1"), (None, None)):
        add = lambda key, name, text, data=None, image=image: rows.append((image, "SYSTEM", None, key, name, text, data, 0, 0, 0))
        if current:
            add("Select", "Current", current)
        for n in (1, 2):
            at = f"controlset00{n}\\"
            add(at + "services\\S", "imagepath", f"a{n}.exe")
            add(at + "services\\S", "START", str(n))
            add(at + "services\\S", "Start", "")
            add(at + "services\\S\\Sub", "ImagePath", "x.exe")
            add(at + "services\\Empty", "Start", "3")
            add(at + "Enum\\USBSTOR\\D\\1", "FriendlyName", f"d{n}")
            add(at + "Services\\BAM\\UserSettings\\S-1", f"C:\\p{n}", None, bytearray(8))
    spark.createDataFrame(rows, VALUE).write.parquet(str(tmp_path / "values"))
    values = spark.read.parquet(str(tmp_path / "values"))
    names = {}
    for analyzer in (registry.services, registry.usb_devices, registry.last_executions):
        found = analyzer(values)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        names[analyzer.__name__] = sorted((r.image, r.name, r.source, r.attributes.get("befehl"), r.attributes.get("start_typ")) for r in found.collect() if r.image)
    sets = {1: 2, 2: 1, 3: 1}
    path = lambda n, rest: f"SYSTEM\\controlset00{n}\\{rest}"
    assert names["services"] == [(i, "S", path(n, "services\\S"), f"a{n}.exe", str(n)) for i, n in sets.items()]
    assert names["usb_devices"] == [(i, f"d{n}", path(n, "Enum\\USBSTOR\\D\\1"), None, None) for i, n in sets.items()]
    assert names["last_executions"] == [(i, f"C:\\p{n}", path(n, "Services\\BAM\\UserSettings\\S-1"), None, None) for i, n in sets.items()]


def test_addresses_by_the_standard_library(spark):
    """Canonical forms of random literals, and addresses at any place of contents in both encodings, with their limit."""
    import ipaddress
    import random

    rnd = random.Random(3)
    rows = ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "::1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", ":::", "12345::", "::1%eth0", "01.2.3.4", "256.1.1.1", "1:0:0:2:0:0:0:3", "1:0:0:2:0:0:3:4", "1::2::3", "", "x"]
    for _ in range(800):
        t = ":".join(rnd.choice(["0", "0", "0", "1", "ffff", "0a", "00b0", "FE80", ""]) for _ in range(rnd.randrange(1, 10)))
        rows.append(t + rnd.choice(["", "", "", ":1.2.3.4", ":01.2.3.4"]))

    def canonical(t):
        try:
            a = ipaddress.ip_address(t.partition("%")[0] if "%" not in t else "no")
        except ValueError:
            return None
        return f"::ffff:{a.ipv4_mapped}" if a.version == 6 and a.ipv4_mapped else str(a)

    frame = spark.createDataFrame([(t,) for t in rows], "t string")
    assert {(r.t, r.a) for r in frame.select("t", netfn.ip_canonical(F.col("t")).alias("a")).collect()} == {(t, canonical(t)) for t in rows}

    words = ["192.0.2.1", "10.0.0.1:443", "10.0.0.1:99999", "fe80::1.", "host192.0.2.2", "1.2.3", "a.b", "::ffff:1.2.3.4", "x" * 140, "é", "\0", ":", "12:30", "2001:db8::5", "1" * 126 + "::"]
    contents = [rnd.choice([" ", "\n", "é"]).join(rnd.choice(words) for _ in range(rnd.randrange(12))) for _ in range(300)]
    raw = [(i, bytearray(rnd.choice([b"", b"\x01"]) + c.encode(rnd.choice(["utf-8", "utf-16-le"])) + rnd.choice([b"", b"\n"]))) for i, c in enumerate(contents)]
    found = sorted((r.id, r.start, r.encoding, r.address, r.original, r.bytes) for r in search.address_hits(spark.createDataFrame(raw, "id bigint, content binary"), "id", "content").collect())
    assert found == sorted(x for i, data in raw for x in plain_hits(i, bytes(data), canonical))
    many = spark.createDataFrame([(1, " ".join(f"10.0.{k // 250}.{k % 250}" for k in range(600))), (2, "10.0.0.1")], "id bigint, t string")
    counted = {r.id: (r.n, r.limited) for r in search.address_hits(many, "id", "t").groupBy("id").agg(F.count("*").alias("n"), F.max("limited").alias("limited")).collect()}
    assert counted == {1: (500, True), 2: (1, False)}
    assert search.address_hits(many, "id", "t", most=3).where("id = 1").count() == 3
    with pytest.raises(ValueError):
        search.address_hits(many, "id", "t", most=501)


def plain_hits(i, data, canonical):
    """Tokens of the three readings of bytes, one byte after the other."""
    good = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.:_%-")
    for first, step in ((0, 1), (0, 2), (1, 2)):
        units = [data[k] if step == 1 or data[k + 1] == 0 else 0 for k in range(first, len(data) - step + 1, step)]
        dangling = (len(data) - first) % step
        start = None
        for k, u in enumerate([*units, *([] if dangling else [0])]):
            if u in good:
                start = k if start is None else start
                continue
            if start is not None:
                token = bytes(units[start:k]).decode()
                original = token.rstrip(".")
                host, _, port = original.partition(":")
                if port.isdigit() and len(port) <= 5 and int(port) <= 65535 and canonical(host) and ":" not in canonical(host):
                    original = host
                if len(token) <= 128 and ("." in original or ":" in original) and canonical(original):
                    yield i, first + start * step, "ascii" if step == 1 else "utf16le", canonical(original), original, len(original) * step
            start = None


def test_hosts_with_ipv6(spark):
    texts = ["http://[2001:DB8:0::1]:80/x", "2001:0db8::1", "[::1]", "http://[::1", "::ffff:1.2.3.4.", "example.org:80", "http://[1.2.3.4]/"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t: r.h for r in frame.select("t", textfn.host_normalize(F.col("t")).alias("h")).collect()}
    assert [found[t] for t in texts] == ["2001:db8::1", "2001:db8::1", None, None, "::ffff:1.2.3.4", "example.org", None]


def test_json_of_any_form(spark):
    """Random documents against a recursive version; depth, text, and documents that are none."""
    import random

    rnd = random.Random(7)
    keys = ["wert", "passwort", "sensibel", "a", "ä b", 'q"', "masterkey_hex"]

    def value(depth):
        kind = rnd.randrange(9 if depth else 5)
        if kind > 6:
            return {k: value(depth - 1) for k in rnd.sample(keys, rnd.randrange(5))}
        if kind > 4:
            return [value(depth - 1) for _ in range(rnd.randrange(4))]
        return rnd.choice([None, True, False, 3, -7, 2.5, "", "x\n\\", "true", "é😀", "[{", "}"])

    def text(v):
        if isinstance(v, dict):
            return " ".join(f"{k}: {text(v[k])}" for k in sorted(v))
        if isinstance(v, list):
            return " ".join(map(text, v))
        return {None: "", True: "true", False: "false"}[v] if v is None or isinstance(v, bool) else str(v)

    values = [(i, value(5), rnd.random() < 0.3) for i in range(300)]
    rows = spark.createDataFrame([(i, json.dumps(v), s) for i, v, s in values], "id int, doc string, s boolean")
    found = {r.id: r.m for r in rows.select("id", jsonfn.masked(F.col("doc"), F.col("s")).alias("m")).collect()}
    for i, v, s in values:
        wanted = govern.MASK if s and not isinstance(v, dict) else govern.masked_json(v, s)
        assert json.loads(found[i].json) == wanted and found[i].text == text(wanted) and not found[i].too_deep
    odd = ["", "{", "NaN", '{"a":NaN}', '"\\ud800"', "[" * 900 + "]" * 900, "[" * 3000 + "]" * 3000, '{"a":1} 2', '{"a":1,"a":2}', None]
    made = spark.createDataFrame([(i, d) for i, d in enumerate(odd)], "id int, doc string").select("id", jsonfn.masked(F.col("doc")).alias("m")).collect()
    by = {r.id: r.m for r in made}
    assert [by[i] for i in (0, 1, 2, 3, 6, 9)] == [None] * 6 and by[7].json == '{"a":1}' and by[4].json == '"?"' and by[5].too_deep and by[8].json == '{"a":2}'
    shallow = spark.createDataFrame([('{"a":{"wert":{"passwort":1}}}',)], "doc string").select(jsonfn.masked(F.col("doc"), deepest=1).alias("m")).first().m
    assert shallow.json == '{"a":"[maskiert]"}' and shallow.too_deep
    documents = govern.search_documents(rows, "doc", "s")
    assert documents.columns == ["id", "doc", "s", "too_deep"] and "Python" not in documents._jdf.queryExecution().executedPlan().toString()
