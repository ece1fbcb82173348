"""Identities, times, texts, mappers, merges, correlation rules, governance and records on small frames."""

from __future__ import annotations

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from tracelake.functions import ids, textfn, timefn
from tracelake.operators import catalog, correlate, govern, graph, model, normalize, pages, search
from tracelake.operators.search import Term
from tracelake.sources import records
from tracelake.streaming import windows

CASE = "00112233445566778899aabbccddeeff"


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_times(spark):
    ticks = 134209788473257138
    r = one(spark, iso=timefn.filetime_iso(F.lit(ticks)), back=timefn.iso_filetime(F.lit("2026-04-18T09:40:47.3257138Z")), zero=timefn.filetime_iso(F.lit(0).cast("bigint")), twin=timefn.filetime_iso(F.lit(0).cast("bigint"), False), late=timefn.filetime_iso(F.lit(-1).cast("bigint")), bad=timefn.iso_filetime(F.lit("2026-02-30T00:00:00Z")), ole=timefn.ole_millis(F.lit(25569.5)), no_ole=timefn.ole_millis(F.lit(0.5)), chromium=timefn.chromium_unix(F.lit(13350000000000001)), early=timefn.chromium_unix(F.lit(5)), stamp=timefn.filetime_timestamp(F.lit(ticks)))
    assert (r.iso, r.back, r.zero, r.twin) == ("2026-04-18T09:40:47.3257138Z", ticks, None, "1601-01-01T00:00:00.0000000Z")
    assert r.late.startswith("60056-05-28T") and r.bad is None and (r.ole, r.no_ole, r.chromium, r.early) == (43200000, None, 1705526400, None)
    assert r.stamp.replace(tzinfo=None) == dt.datetime(2026, 4, 18, 9, 40, 47, 325713)


def test_browser_seconds_beyond_exact_doubles(spark):
    """The last microsecond of a second belongs to it, where a double only has every second microsecond."""
    seconds = [1704267632, 1704267633, 1705366295, 9_007_199_254]
    rows = spark.createDataFrame([(s, m) for s in seconds for m in (0, 1, 999_998, 999_999)], "s bigint, m bigint")
    since_1970 = F.col("s") * 1_000_000 + F.col("m")
    for got in (timefn.chromium_unix(since_1970 + F.lit(11_644_473_600_000_000)), timefn.firefox_unix(since_1970), timefn.firefox_unix(since_1970 + F.lit(11_644_473_600_000_000)) - 11_644_473_600):
        assert rows.where(got != F.col("s")).collect() == []


def test_identities(spark):
    import hashlib
    import uuid

    def expected(kind, *parts):
        data = b"".join(struct.pack("<Q", len(p)) + p for p in (kind.encode(), *parts))
        return str(uuid.UUID(bytes=bytes.fromhex(hashlib.sha1(bytes.fromhex(ids.NAMESPACE_HEX) + data).hexdigest()[:32]), version=5))

    r = one(spark, a=ids.derived_uuid("event", F.unhex(F.lit(CASE)), F.encode(F.lit("login"), "UTF-8"), F.encode(F.lit("ä:1"), "UTF-8")), f=ids.finding_id(F.lit("d"), F.lit("n"), F.lit("s"), F.lit(None).cast("bigint"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))))
    assert r.a == expected("event", bytes.fromhex(CASE), b"login", "ä:1".encode())
    data = b"".join(struct.pack("<Q", len(p)) + p for p in (b"d", b"n", b"s", b"", b"a", b"1", b"b", b"2"))
    assert r.f == hashlib.sha256(data).hexdigest()[:16]


def test_texts(spark):
    r = one(spark, fu=textfn.file_url_path(F.lit("file:///C:/a%20b/%zz%C3%A4")), h1=textfn.host_normalize(F.lit("https://u@Exa-mple.org:8/x")), h2=textfn.host_normalize(F.lit("1.2.3.04")), u=textfn.user_from_path(F.lit("C:\\users\\Ann\\x")), sid=textfn.user_canonical(F.lit("s-1-5-21-1"), F.lit("D"), F.lit("n")), name=textfn.user_canonical(F.lit(None).cast("string"), F.lit("."), F.lit("Ann")), rot=textfn.rot13(F.lit("Uryyb")), pe=textfn.signature_type(F.lit(b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0")), none=textfn.signature_type(F.lit(b"abc")))
    assert tuple(r) == ("C:\\a b\\%zzä", "exa-mple.org", None, "Ann", "sid:S-1-5-21-1", "name:ann", "Hello", "pe", "unbekannt")


def findings(spark):
    rows = [
        (0, "eventlog", "x", "Security.evtx", {"event_id": "4624", "event_record_id": "7", "volume_offset": "0", "mft_record": "9", "datei_offset": "1", "filetime": "134209788473257138", "benutzer": "Ann", "benutzer_sid": "S-1-5-21-1", "quell_ip": "10.0.0.1", "ausfuehrender": "-"}),
        (1, "eventlog", "x", "Security.evtx", {"event_id": "6005", "event_record_id": "8", "filetime": "134209788473257139"}),
        (2, "prefetch", "CMD.EXE", "CMD.EXE-1.pf", {"mft_record": "11", "volume_offset": "0", "letzte_ausfuehrung_unix": "1700000000"}),
        (3, "programmausfuehrung", "C:\\x\\a.exe", "SYSTEM\\k", {"quelle": "amcache", "pfad": "C:\\x\\a.exe", "sha1": "AB" * 20, "hive_offset": "5", "registriert_unix": "1700000001"}),
        (4, "programmausfuehrung", "C:\\x\\a.exe", "SYSTEM\\k", {"art": "bam", "sid": "S-1-5-21-1", "letzte_ausfuehrung_unix": "1700000002"}),
        (5, "tor", "torrc", "f", {}),
        (6, "eventlog", "x", "Security.evtx", {"event_id": "4624", "event_record_id": "7", "volume_offset": "0", "mft_record": "9", "datei_offset": "1", "filetime": "134209788473257138", "benutzer": "Ann", "benutzer_sid": "S-1-5-21-1"}),
    ]
    return spark.createDataFrame([(*r, "PC") for r in rows], "ordinal bigint, domain string, name string, source string, attributes map<string,string>, host string")


def test_mappers(spark):
    mapped = normalize.map_findings(findings(spark), CASE)
    events = {r.event_id: r for r in normalize.events(mapped).collect()}
    assert sorted((r.kind, r.derivation) for r in events.values()) == [("amcache_recorded", "parsed"), ("process_start", "parsed"), ("process_start", "parsed"), ("system_boot", "derived"), ("user_logon", "parsed")]
    roles = {(events[r.event_id].kind, r.role) for r in normalize.participants(mapped, CASE).collect()}
    assert {("user_logon", "user"), ("user_logon", "source"), ("user_logon", "host"), ("process_start", "executable"), ("process_start", "user")} <= roles and ("user_logon", "actor") not in roles
    names = {(r.entity_kind, r.canonical_key): r.display_name for r in normalize.entities(mapped, CASE).collect()}
    assert names["windows_user", "sid:S-1-5-21-1"] == "Ann" and names["application", "programm:cmd.exe"] == "CMD.EXE" and ("file", "pfad:c:\\x\\a.exe") in names
    assert [r.role for r in normalize.provenance(mapped).orderBy("ordinal").collect()] == ["primary"] * 5 + ["supporting"]
    stats = {r.domain: (r.mapped, r.no_mapper, r.incomplete_locator) for r in normalize.statistics(mapped).collect()}
    assert stats == {"eventlog": (3, 0, 1), "prefetch": (1, 0, 0), "programmausfuehrung": (2, 0, 1), "tor": (0, 1, 0)}
    edges = {r.kind: r.n_sources for r in normalize.relationships(mapped, CASE).collect()}
    assert edges == {"ACCOUNT_ON": 3, "HAS_HASH": 1}
    again = normalize.map_findings(findings(spark), CASE)
    assert {r.event_id for r in normalize.events(again).collect()} == set(events)


def test_event_selection(spark):
    rows = spark.createDataFrame([("MICROSOFT-windows-Security-Auditing", 4624, 1), ("Other", 4624, 2), ("EventLog", 6005, 3), ("EventLog", 6005, 3)], "provider string, event_id bigint, record bigint")
    assert sorted(r.record for r in normalize.select_events(rows).collect()) == [1, 3, 3]
    assert sorted(r.record for r in normalize.usable_records(rows, "record", "provider").collect()) == [1, 2]


def trace(event, at, kind="process_start", entity_kind="application", role="executable", parser="a", artifact=None, semantics="event_time", host="h", scope="live"):
    return (event, "e", host, "v", scope, artifact or event, kind, entity_kind, role, parser, at, semantics)


TRACE = "event_id string, entity_id string, host_id string, evidence_id string, scope string, artifact_id string, kind string, entity_kind string, role string, parser string, time_ns bigint, semantics string"
S = 1_000_000_000


@pytest.mark.parametrize(("a", "b", "rule"), [
    (trace("1", 0), trace("2", 2 * S, parser="b"), "execution-sources"), (trace("1", 0), trace("2", 2 * S + 1, parser="b"), None), (trace("1", 0), trace("2", S), None),
    (trace("1", 0), trace("2", S, parser="b", host="x"), None), (trace("1", 0), trace("2", S, parser="b", scope="VSS#1"), None), (trace("1", 0), trace("2", S, parser="b", artifact="1"), None),
    (trace("1", 0), trace("2", S, parser="b", semantics="artifact_time"), None), (trace("1", 0), trace("2", S, parser="b", role="file"), None), (trace("1", 0), trace("2", S, parser="b", entity_kind="application", kind="logon"), None),
    (trace("1", 0, "service_installed", "service", "x", semantics="artifact_time"), trace("2", 86400 * S, "service_started", "service", "x"), "persistence-activity"),
    (trace("1", 10, "service_installed", "service", "x"), trace("2", 0, "service_started", "service", "x"), None),
    (trace("2", 5, "service_installed", "service", "x"), trace("1", 5, "service_started", "service", "x"), "persistence-activity"),
    (trace("1", 0, entity_kind="process", role="process"), trace("2", 300 * S, "dns_query", "process", "process"), "process-network"), (trace("1", 0, entity_kind="process", role="process"), trace("2", 301 * S, "dns_query", "process", "process"), None),
])
def test_correlation_rules(spark, a, b, rule):
    found = correlate.rule_pairs(spark.createDataFrame([a, b, a], TRACE)).collect()
    assert [(r.rule, r.a_id, r.b_id) for r in found] == ([] if rule is None else [(rule, a[0], b[0])])


def test_source_scope(spark):
    fields = "type string, length bigint, record_offset bigint, byte_offset bigint, image_offset bigint, cell_offset bigint, shadow_store bigint"
    rows = [(("ntfs", None, 1, None, None, None, None), None, "live"), (("ntfs", None, 1, None, None, None, 0), None, "VSS#1"), (("ntfs", None, 1, None, None, None, 0), "live", None), (("ntfs",) + (None,) * 6, None, None), (("byte_range", 0, None, None, None, None, None), None, None), (("byte_range", 5, None, None, None, None, None), None, "live"), (("registry", None, None, None, None, 4, None), "VSS#2", "VSS#2"), (("registry", None, None, None, None, 4, None), "VSS#0", None), (("registry",) + (None,) * 6, "live", None), (("pcap",) + (None,) * 6, "live", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, locator struct<{fields.replace(' ', ':').replace(',:', ',')}>, snapshot string, expected string")
    for r in df.withColumn("got", correlate.source_scope(F.col("locator"), F.col("snapshot"))).collect():
        assert r.got == r.expected, r


def test_limits(spark):
    rows = spark.createDataFrame([(i, i) for i in range(10)], "a int, b int")
    out = correlate.limited(rows, ["a", "b"], 3).collect()
    assert len(out) == 3 and all(r.limited and r.n == 10 for r in out)
    assert not correlate.limited(rows, ["a"], 10).first().limited


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c")], "k int, t int, v string")
    assert sorted((r.k, r.t, r.v) for r in correlate.as_of(left, right, ["k"], "t", "v").collect()) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]


def test_pages(spark):
    rows = spark.createDataFrame([(i // 2, i) for i in range(10)], "a int, id int")
    first = pages.page(rows, ["a", "id"], None, 4).collect()
    assert [r.id for r in first] == [0, 1, 2, 3] and all(r.more for r in first)
    rest = pages.page(rows, ["a", "id"], (1, 3), 100).collect()
    assert [r.id for r in rest] == [4, 5, 6, 7, 8, 9] and not any(r.more for r in rest)
    assert [r.id for r in pages.page(rows, ["id"], (3,), 2, descending=True).collect()] == [2, 1]
    assert pages.page(rows, ["id"], None, 0).count() == 1
    with pytest.raises(ValueError):
        pages.contains_literal(F.col("a"), "x" * 600)
    assert rows.withColumn("t", F.lit("50%_x")).where(pages.contains_literal(F.col("t"), "%_X")).count() == 10


def test_paths(spark):
    rows = [(7, 1, "a", 5, 5), (8, 2, "b", 7, 1), (9, 1, "c", 8, 1), (10, 1, "d", 11, 1), (11, 1, "e", 10, 1), (12, 1, "f", 99, 1)]
    out = {r.record: r.path for r in catalog.rebuilt_paths(spark.createDataFrame(rows, "record bigint, sequence int, name string, parent bigint, parent_sequence int")).collect()}
    assert out == {7: "a", 8: "a\\b", 9: None, 10: None, 11: None, 12: None}


def test_merges_and_upserts(spark):
    base = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    delta = spark.createDataFrame([(2, "n"), (3, "n"), (3, "n"), (1, "n")], "id int, v string")
    once = model.insert_new(base, delta, ["id"])
    assert sorted((r.id, r.inserted) for r in once.collect()) == [(1, False), (2, False), (3, True)]
    assert not any(r.inserted for r in model.insert_new(once.drop("inserted"), delta, ["id"]).collect())
    filled = model.fill_missing(base, delta, "id", "v")
    assert sorted((r.id, r.v, r.updated) for r in filled.collect()) == [(1, "x", False), (2, "n", True)]
    assert not any(r.updated for r in model.fill_missing(filled.drop("updated"), delta, "id", "v").collect())
    names = spark.createDataFrame([(1, "S-1-5-1", 0), (1, "Ann", 1), (2, "S-1-5-2", 0)], "e int, n string, o int")
    assert {r.e: r.display_name for r in model.display_names(names, "e", "n", "o").collect()} == {1: "Ann", 2: "S-1-5-2"}
    unique = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), (None, 3)], "k string, v int")
    assert [tuple(r) for r in model.unique_mapping(unique, "k", "v").collect()] == [("a", 1)]
    edges = graph.merged(spark.createDataFrame([("k", 1, 2, 0), ("k", 1, 2, 1)], "kind string, source int, target int, ordinal int"))
    assert [r.role for r in edges.orderBy("ordinal").collect()] == ["primary", "supporting"]


def test_snapshot_diff(spark):
    schema = "path string, sha256 string, size bigint"
    old = spark.createDataFrame([("A", "1", 1), ("b", "2", 1), ("c", None, 1), ("d", "4", 1), ("e", None, 2)], schema)
    live = spark.createDataFrame([("a", "1", 1), ("B", "x", 1), ("c", "3", 1), ("e", None, 3)], schema)
    assert {r.path: r.status for r in catalog.snapshot_diff(old, live).collect()} == {"b": "different", "c": "not_checkable", "d": "only_snapshot", "e": "different"}


def test_audit(spark):
    vector = one(spark, h=govern.chain_hash(F.lit(govern.GENESIS), F.lit(1), F.lit("{}")))
    assert vector.h == "857ee6299d26533d1f5f46c02209ae8bc34dc4898a8a9545493946b4ea59d6f3"
    rows = govern.build_chains(spark.createDataFrame([("c", n, f"p{n}") for n in (2, 1, 3)], "chain string, n bigint, p string"), "chain", "n", "p")
    assert not govern.verify_chains(rows, "chain").where("gap OR predecessor OR content").count()
    cut = govern.verify_chains(rows.where("sequence <> 2"), "chain").where("gap OR predecessor OR content").collect()
    assert [(r.sequence, r.gap, r.predecessor, r.content) for r in cut] == [(3, True, True, False)]
    heads = spark.createDataFrame([("c", "0", 3), ("gone", "0", 1)], "chain string, head_hash string, head_sequence bigint")
    assert not any(r.head_ok for r in govern.head_matches(rows, heads, "chain").collect())


def test_masking(spark):
    fields = F.create_map(F.lit("wert"), F.lit("x"), F.lit("klartext"), F.lit(None).cast("string"), F.lit("name"), F.lit("n"))
    r = one(spark, a=govern.mask_fields(fields, F.lit(True)), b=govern.mask_fields(fields, F.lit(False)))
    assert r.a == {"wert": "[maskiert]", "klartext": None, "name": "n"} and r.b["wert"] == "x"
    nested = {"klartext": "s", "passwort": "p", "wert": "open", "in": {"sensibel": True, "wert": "w", "list": [{"wert": "v"}]}}
    # plain text is secret in findings' fields, not at any depth of a document
    assert govern.masked_json(nested) == {"klartext": "s", "passwort": "[maskiert]", "wert": "open", "in": {"sensibel": True, "wert": "[maskiert]", "list": [{"wert": "[maskiert]"}]}}


TERMS = (Term("c", "Token"), Term("c", "ok", True), Term("p", "left", False, "L"), Term("p", "right", False, "R"))


def test_search(spark):
    docs = spark.createDataFrame([(1, "tokentoken OK ok2 left xx right right left"), (2, None), (3, "none")], "id int, text string")
    hits = search.keyword_hits(docs, "id", "text", TERMS)
    assert sorted((r.term, r.start) for r in hits.collect()) == [("Token", 0), ("Token", 5), ("left", 18), ("left", 38), ("ok", 11), ("right", 26), ("right", 32)]
    pairs = sorted((r.start, r.gap) for r in search.keyword_pairs(hits, "id", 10).collect())
    assert pairs == [(18, 4), (18, 10), (32, 1)]
    r = one(spark, at=search.positions(F.lit("aaa"), F.lit("aa")), none=search.positions(F.lit("a"), F.lit("aa")), ip=search.ipv4_literals(F.lit("a 10.0.0.1. 1.2.3.04 256.1.1.1 192.0.2.1:80 192.0.2.1:99999")), onion=search.onion_addresses(F.lit("a" * 60 + ".ONION")), doc=search.search_document(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))), pre=search.preview(F.lit("x" * 100 + "Hit"), "hit"))
    assert r.at == [0, 1] and r.none == [] and r.ip == ["10.0.0.1", "192.0.2.1"] and r.onion == ["a" * 56] and r.doc == "a: 1 b: 2" and r.pre == "x" * 60 + "Hit"


def test_bytes_and_chunks():
    content = b"..token.." + "right".encode("utf-16-le") + b"TOKEN2 ok" + b"\0" * 5 + b"ok_ left"
    whole = sorted(search.scanned_bytes(content, TERMS), key=lambda m: m[3])
    assert ("p", "right", "utf16le", 9) in whole and ("c", "Token", "ascii", 19) in whole
    assert [m for m in whole if m[1] == "ok"] == [("c", "ok", "ascii", 26)]
    for chunk in (1, 3, 7, 100):
        assert search.scanned_chunks(content, TERMS, chunk) == whole
    assert search.ip_literals("192.0.2.1 2001:DB8::1 10.0.0.1:443 ::ffff:192.0.2.3 001.2.3.4") == ["192.0.2.1", "2001:db8::1", "10.0.0.1", "::ffff:192.0.2.3"]
    assert search.ip_literals("x10.0.0.7".replace("x", " ").encode("utf-16-le")).count("10.0.0.7") == 1


def test_line_offsets(spark):
    docs = spark.createDataFrame([(1, "é`\r\n\n  \nabc")], "id int, text string")
    assert [(r.line_no, r.offset, r.bytes, r.line, r.continued) for r in search.lines_with_offsets(docs, "id", "text").collect()] == [(1, 0, 3, "é`", True), (4, 9, 3, "abc", False)]


def usn(name: str, major: int = 2, reason: int = 0x100) -> bytes:
    raw = name.encode("utf-16-le")
    head = 60 if major == 2 else 76
    size = (head + len(raw) + 7) // 8 * 8
    refs = struct.pack("<QQ", 5 | 3 << 48, 5) if major == 2 else bytes(range(32))
    return (struct.pack("<IHH", size, major, 0) + refs + struct.pack("<qqIIIIHH", 1, 134209788473257138, reason, 0, 0, 32, len(raw), head) + raw).ljust(size, b"\0")


def test_usn(spark):
    data = b"\0" * 16 + usn("a.txt") + b"\xff" * 8 + usn("ü", 3, 0x80000200) + b"\0" * 8
    for size in (1, 7, 64, len(data)):
        scanner = records.UsnScanner()
        found = [r for k in range(0, len(data), size) for r in scanner.feed(data[k : k + size])]
        assert [(r["name"], r["stream_offset"], r["mft_record"], r["sequence"]) for r in found] == [("a.txt", 16, 5, 3), ("ü", 16 + len(usn("a.txt")) + 8, None, None)]
    rows = records.read_usn(spark.createDataFrame([("j", data), ("none", None)], "path string, content binary"))
    assert sorted((r.name, r.reasons, r.unknown_reason_bits, r.time_utc) for r in rows.collect()) == [("a.txt", ["FILE_CREATE"], 0, "2026-04-18T09:40:47.3257138Z"), ("ü", ["FILE_DELETE", "CLOSE"], 0, "2026-04-18T09:40:47.3257138Z")]
    assert tuple(records.usn_summary(rows).first())[:4] == (2, 1, 2, 1)


def test_recycled_and_zones(spark):
    path = "C:\\x\\ä.txt"
    v1 = struct.pack("<QQQ", 1, 7, 116444736010000000) + path.encode("utf-16-le").ljust(520, b"\0")
    v2 = struct.pack("<QQQI", 2, 1 << 63, 0, len(path) + 1) + (path + "\0").encode("utf-16-le")
    rows = records.read_recycled(spark.createDataFrame([("d:\\$Recycle.Bin\\S-1-5-21\\$I1", v1), ("x", v2), ("y", b"short"), ("z", None)], "path string, content binary")).collect()
    assert sorted((r.original_path, int(r["size"]), r.deleted_unix, r.sid) for r in rows)[0] == (path, 7, 1, "S-1-5-21") and len(rows) == 2
    text = "[ZoneTransfer]\r\nZoneId=3\r\nHostUrl=http://a\r\nzoneid=4\r\nodd\r\nX=1\r\n[Other]\r\nZoneId=9"
    zones = {r.path: r for r in records.read_zones(spark.createDataFrame([("a", text.encode()), ("b", b"\xff\xfe" + text.encode("utf-16-le")), ("c", b"x=1"), ("d", b"\xff\xff")], "path string, content binary")).collect()}
    assert zones["a"].fields == zones["b"].fields == {"zoneid": "3", "hosturl": "http://a", "x": "1"} and zones["a"].other_fields == ["X=1"] and len(zones["a"].notes) == 2
    assert zones["c"].error and zones["d"].error


def test_histories(spark, tmp_path):
    import sqlite3

    shell = records.read_shell_history(spark.createDataFrame([("C:\\Users\\Ann\\h.txt", b"\xef\xbb\xbfdir\r\nls `\n\n"), ("x", b"\xff\xfe")], "path string, content binary")).collect()
    assert [(r.line_no, r.offset, r.line, r.continued, r.profile) for r in shell] == [(1, 3, "dir", False, "Ann"), (2, 8, "ls `", True, "Ann")]
    base = sqlite3.connect(tmp_path / "History")
    base.execute("CREATE TABLE urls (url, title, visit_count, last_visit_time)")
    base.executemany("INSERT INTO urls VALUES (?, ?, ?, ?)", [("http://a", "A", 2, 13350000000000001), ("http://b", None, 1, 0)])
    base.commit()
    base.close()
    files = records.read_files(spark, str(tmp_path))
    assert [(r.url, r.visits, r.last_visit) for r in records.read_browser_histories(files).collect()] == [("http://a", 2, 1705526400), ("http://b", 1, None)]
    assert one(spark, n=records.prefetch_name(F.lit("C:\\CMD.EXE-0123abcd.pf"))[0]).n == "CMD.EXE"
    records.write_json_lines(spark.createDataFrame([(2, "b"), (1, None)], "id int, v string"), str(tmp_path / "out"), ["id"])
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"id":1,"v":null}', '{"id":2,"v":"b"}']


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=7 * i), i % 3, "click" if i % 2 else "view", float(i)) for i in range(60)]
    table = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    table.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    for name, f in (("w1", lambda d: windows.windowed(d, "1 hour")), ("w2", lambda d: windows.windowed(d, "1 hour", "30 minutes"))):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        key = lambda r: (r.start, r.event_type, r.n, r.cents)
        assert sorted(map(key, spark.table(name).collect())) == sorted(map(key, f(table).collect()))
    for _ in range(2):
        windows.ingest_new(stream, str(tmp_path / "out"), "event_id", str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    (tmp_path / "check2").mkdir()
    windows.ingest_new(stream, str(tmp_path / "out2"), "event_id", str(tmp_path / "check2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out2")).select("event_id").distinct().count() == 60
