"""Time: super-timeline, MACB rows, and correlation of events by bounded intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: what a correlation may rest on
DERIVATIONS = ("observed", "parsed", "derived")
PRECISIONS = ("nanosecond", "hundred_nanoseconds", "microsecond", "millisecond", "second")
SEMANTICS = ("event_time", "artifact_time")
MOST_COMPARISONS, MOST_MATCHES = 200_000, 500


def eligible(derivation: str = "derivation", precision: str = "precision", anchor: str = "byte_offset") -> Column:
    """Sources that are observed, precise to the second at least, and anchored at a byte."""
    return F.col(derivation).isin(*DERIVATIONS) & F.col(precision).isin(*PRECISIONS) & F.col(anchor).isNotNull()


def source_scope(locator: Column, snapshot: Column) -> Column:
    """The state a source was read from, ``live`` or ``VSS#n``; null if the locator has no byte anchor or the two disagree."""
    kind = locator["type"]
    anchored = locator["record_offset"].isNotNull() | locator["byte_offset"].isNotNull() | locator["image_offset"].isNotNull()
    ntfs = F.when(anchored, F.when(locator["shadow_store"].isNotNull(), F.concat(F.lit("VSS#"), (locator["shadow_store"] + 1).cast("string"))).otherwise("live"))
    ntfs = F.when(snapshot.isNull() | (snapshot == ntfs), ntfs)
    bytes_ = F.when(F.coalesce(locator["length"], F.lit(1)) != 0, F.coalesce(snapshot, F.lit("live")))
    other = F.when((kind == "ese") | ((kind == "registry") & locator["cell_offset"].isNotNull()) | ((kind == "file_line") & locator["byte_offset"].isNotNull()), snapshot)
    scope = F.when(kind == "ntfs", ntfs).when(kind == "byte_range", bytes_).otherwise(other)
    return F.when((scope == "live") | scope.rlike("^VSS#0*[1-9][0-9]*$"), scope)


def interval_pairs(traces: DataFrame, group: Sequence[str], first_kind: str, second_kind: str, seconds: int, also: Column | None = None, time: str = "time_us", bucket_from: int = 3600) -> DataFrame:
    """Pairs of a first and a second kind in one group, the second at most ``seconds`` later (inclusive, in microseconds).

    Windows of ``bucket_from`` seconds or more are joined on time buckets as well, which cuts hot groups into
    slices of their time: the first goes to its bucket and the next, the second to its own only.
    """
    a = traces.where(F.col("kind") == first_kind)
    b = traces.where(F.col("kind") == second_kind)
    keys = list(group)
    if seconds >= bucket_from:
        width = seconds * 1_000_000
        at = F.floor(F.col(time) / width)
        a = a.withColumn("bucket", F.explode(F.array(at, at + 1)))
        b = b.withColumn("bucket", at)
        keys.append("bucket")
    a, b = a.alias("a"), b.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    delta = F.col(f"b.{time}") - F.col(f"a.{time}")
    later = (delta > 0) | ((delta == 0) & (F.col("a.event_id") < F.col("b.event_id")))
    test = (delta <= seconds * 1_000_000) & later & (also if also is not None else F.lit(True))
    for c in on:
        test = test & c
    return a.join(b, test).select(F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"), delta.alias("delta_us"))


#: fixed values: the longest time between the two events of each rule, in nanoseconds
RULE_WINDOWS = (("execution-sources", 2 * 10**9), ("persistence-activity", 86_400 * 10**9), ("process-network", 300 * 10**9))


def rule_sides(traces: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The traces that a fixed rule can begin with, and those that it can end with, by ``rule``: equal ones once, with the rule's window, and whether their event has ``several``.

    All traces of an event are brought to one task for that. The parser is kept for the rule that compares it.
    """
    timed = F.col("semantics") == "event_time"
    program = timed & (F.col("kind") == "process_start") & F.col("entity_kind").isin("file", "application") & (F.col("role") == "executable")
    of_entity = lambda service, task: ((F.col("entity_kind") == "service") & (F.col("kind") == service)) | ((F.col("entity_kind") == "scheduled_task") & (F.col("kind") == task))
    process = timed & (F.col("entity_kind") == "process") & (F.col("role") == "process")
    begins = {"execution-sources": program, "persistence-activity": of_entity("service_installed", "scheduled_task_created"), "process-network": process & (F.col("kind") == "process_start")}
    ends = {"execution-sources": program, "persistence-activity": timed & of_entity("service_started", "scheduled_task_executed"), "process-network": process & F.col("kind").isin("network_connection", "dns_query", "http_request")}

    def side(tests: dict[str, Column]) -> DataFrame:
        rules = F.array_compact(F.array(*(F.when(tests[rule], F.struct(F.lit(rule).alias("rule"), F.lit(window).alias("window"))) for rule, window in RULE_WINDOWS)))
        rows = traces.select(*group, "event_id", "artifact_id", "parser", F.col("time_ns").alias("at"), F.inline(rules))
        rows = rows.withColumn("parser", F.when(F.col("rule") == "execution-sources", F.col("parser"))).repartition("rule", "event_id").distinct()
        return rows.withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("rule", "event_id")) > 1)

    return side(begins), side(ends)


def rule_pairs(traces: DataFrame, group: Sequence[str] = ("entity_id", "host_id", "evidence_id", "scope")) -> DataFrame:
    """The three fixed rules over eligible traces with nanosecond times: rule, a_id, b_id. Equal pairs count once.

    A rule's traces are joined on its group and on time buckets as wide as its window: the first goes to its bucket and the next, the
    second to its own, so a hot group is cut by time. Pairs grow with the square of a group's traces, so they are not shuffled to
    find equal ones: two events with one trace each on their sides make one pair. Only pairs with an event of several traces can be equal,
    and only they are compared. Both kinds come from one join by a tag, which two traces share exactly once: 0 if both are their events' only ones.
    """
    first, second = rule_sides(traces, group)
    own = F.col("at") - F.pmod("at", "window")  # the bucket's begin
    tags = lambda several, one: F.explode(F.when(F.col("several"), F.array(*map(F.lit, several))).otherwise(F.array(*map(F.lit, one))))
    a = first.withColumn("bucket", F.explode(F.array(own, own + F.col("window")))).withColumn("tag", tags([1], [0, 2])).alias("a")
    b = second.withColumn("bucket", own).withColumn("tag", tags([1, 2], [0, 1])).alias("b")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    sources = (x("parser") != y("parser")) & ((x("at") < y("at")) | (F.struct(x("event_id"), x("artifact_id")) < F.struct(y("event_id"), y("artifact_id"))))
    test = (x("at") <= y("at")) & (y("at") <= x("at") + x("window")) & (x("event_id") != y("event_id")) & (x("artifact_id") != y("artifact_id")) & ((x("rule") != "execution-sources") | sources)
    for k in ("rule", *group, "bucket", "tag"):
        test = test & (x(k) == y(k))
    pairs = a.join(b, test).select(x("rule").alias("rule"), x("event_id").alias("a_id"), y("event_id").alias("b_id"), x("tag").alias("tag"))
    return pairs.where("tag = 0").drop("tag").union(pairs.where("tag > 0").drop("tag").distinct())


#: fixed value: what a run compares lies less than a day and a second apart
COMPARED_NS = 86_401 * 10**9


def comparisons_of(traces: DataFrame, group: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` comparisons of a run, as pairs ``a`` and ``b`` with their ``number`` from 0, and one row with the ``total`` of all.

    A run takes groups in order, a group's traces in order of time, and compares each with those behind it less than ``COMPARED_NS`` later.
    Comparisons are counted before any is made: a window over a time bucket and the next (so that a hot group is cut by time) gives
    each trace the number of those that it is compared with, and prefix sums over buckets, then within those that begin below the limit, give its first
    comparison's number. Only traces below the limit are then joined, by their places: no more pairs are made than returned.
    """
    named = [c for c in traces.columns if c not in ("bucket", "own", "place", "count")]
    whole = F.struct(*named)
    bucket = F.floor(F.col("time_ns") / COMPARED_NS)
    rows = traces.select(*group, whole.alias("trace"), F.explode(F.array(F.struct(bucket.alias("bucket"), F.lit(True).alias("own")), F.struct((bucket - 1).alias("bucket"), F.lit(False).alias("own")))).alias("_b")).select(*group, "trace", "_b.*")
    keys = [*group, "bucket"]
    order = Window.partitionBy(*keys).orderBy("trace.time_ns", "trace.event_id", "trace.artifact_id", "trace")
    reach = Window.partitionBy(*keys).orderBy("trace.time_ns").rangeBetween(Window.unboundedPreceding, COMPARED_NS - 1)
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("count", F.count(F.lit(1)).over(reach) - F.col("place"))
    compared = placed.where("own AND count > 0")
    counts = compared.groupBy(*keys).agg(F.sum("count").alias("n"))
    # every bucket has a comparison, so that no more buckets than comparisons can be below the limit
    first = counts.orderBy(*keys).limit(most)
    so_far = F.coalesce(F.sum("n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = first.withColumn("begin", so_far).where(F.col("begin") < most).drop("n")
    inside = F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a = compared.join(begun, keys).withColumn("begin", F.col("begin") + inside).where(F.col("begin") < most)
    a = a.select(*keys, F.col("trace").alias("a"), "place", "begin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("count", F.lit(most) - F.col("begin")))).alias("k"))
    a = a.select(*keys, "a", (F.col("place") + F.col("k")).alias("place"), (F.col("begin") + F.col("k") - 1).alias("number"))
    pairs = a.join(placed.select(*keys, F.col("place").cast("bigint").alias("place"), F.col("trace").alias("b")), [*keys, "place"])
    return pairs.select("number", "a", "b"), counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def rule_of(a: Column, b: Column) -> Column:
    """The fixed rule that an earlier and a later trace meet, their times aside; null for none."""
    timed = lambda t: t["semantics"] == "event_time"
    kinds = lambda x, y: (a["kind"] == x) & (b["kind"] == y)
    sources = kinds("process_start", "process_start") & a["entity_kind"].isin("file", "application") & (a["role"] == "executable") & (b["role"] == "executable") & timed(a) & timed(b) & (a["parser"] != b["parser"])
    persistence = timed(b) & (((a["entity_kind"] == "service") & kinds("service_installed", "service_started")) | ((a["entity_kind"] == "scheduled_task") & kinds("scheduled_task_created", "scheduled_task_executed")))
    network = (a["entity_kind"] == "process") & (a["role"] == "process") & (b["role"] == "process") & (a["kind"] == "process_start") & b["kind"].isin("network_connection", "dns_query", "http_request") & timed(a) & timed(b)
    rule = F.when(sources, "execution-sources").when(persistence, "persistence-activity").when(network, "process-network")
    return F.when((a["event_id"] != b["event_id"]) & (a["artifact_id"] != b["artifact_id"]), rule)


def evaluated(traces: DataFrame, group: Sequence[str] = ("entity_id", "host_id", "evidence_id", "scope"), comparisons: int = MOST_COMPARISONS, matches: int = MOST_MATCHES) -> tuple[DataFrame, DataFrame]:
    """A run of the fixed rules over eligible traces: its matches (rule, a_id, b_id, number), and one row with ``comparisons``, ``matches`` and ``limited``.

    The run stops at its limits, which are the feature: after ``comparisons`` comparisons, or at the one after the last of ``matches`` matches. Of two traces at
    one moment either may be the earlier. Equal matches count once. ``limited`` tells that not everything was compared.
    """
    pairs, all_of_them = comparisons_of(traces, group, comparisons)
    together = F.col("a.time_ns") == F.col("b.time_ns")
    forward, back = rule_of(F.col("a"), F.col("b")), F.when(together, rule_of(F.col("b"), F.col("a")))
    window = F.element_at(F.create_map(*(F.lit(x) for pair in RULE_WINDOWS for x in pair)), F.col("rule"))
    turned = pairs.select("number", F.coalesce(forward, back).alias("rule"), F.when(forward.isNull() & together, F.struct(F.col("b").alias("x"), F.col("a").alias("y"))).otherwise(F.struct(F.col("a").alias("x"), F.col("b").alias("y"))).alias("p"))
    found = turned.where(F.col("rule").isNotNull()).where(F.col("p.y.time_ns") - F.col("p.x.time_ns") <= window).groupBy("rule", "p").agg(F.min("number").alias("number"))
    kept = found.orderBy("number").limit(matches)
    last = kept.agg(F.count(F.lit(1)).alias("matches"), F.max("number").alias("last"))
    done = F.when(F.col("matches") == matches, F.col("last") + 1).otherwise(F.least("total", F.lit(comparisons)))
    summary = all_of_them.crossJoin(F.broadcast(last)).select(done.cast("bigint").alias("comparisons"), "matches", (done < F.col("total")).alias("limited"))
    return kept.select("rule", F.col("p.x.event_id").alias("a_id"), F.col("p.y.event_id").alias("b_id"), "number"), summary


def limited_rules(traces: DataFrame, group: Sequence[str] = ("entity_id", "host_id", "evidence_id", "scope"), comparisons: int = MOST_COMPARISONS, matches: int = MOST_MATCHES) -> DataFrame:
    """The matches of ``evaluated``, each with the run's ``limited``."""
    found, summary = evaluated(traces, group, comparisons, matches)
    return found.crossJoin(F.broadcast(summary.select("limited")))  # one row


def limited(pairs: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows in a fixed order, ``n`` of all, and whether rows are missing. The cut is a sort with a limit."""
    total = pairs.agg(F.count(F.lit(1)).alias("n"))
    return pairs.orderBy(*order).limit(most).join(F.broadcast(total)).withColumn("limited", F.col("n") > most)


# Time attributes of findings, in the order that ties keep, and the event each tells of.
TIME_KEYS = (
    ("erste_installation_unix", "usb_erste_installation"), ("installation_unix", "usb_installation"), ("letzte_verbindung_unix", "usb_verbunden"), ("letztes_trennen_unix", "usb_getrennt"),
    ("zuletzt_verwendet_unix", "shellbag_zuletzt_verwendet"), ("aktivitaet_start_unix", "aktivitaet_start"), ("aktivitaet_ende_unix", "aktivitaet_ende"), ("aktivitaet_geaendert_unix", "aktivitaet_geaendert"),
    ("element_erstellt_unix", "element_erstellt"), ("element_geaendert_unix", "element_geaendert"), ("element_zugriff_unix", "element_zugegriffen"), ("geloescht_unix", "geloescht"),
    ("letzter_zugriff_unix", "zugegriffen"), ("key_letzte_aenderung_unix", "registry_key_geaendert"), ("ziel_erstellt_unix", "ziel_erstellt"), ("ziel_geaendert_unix", "ziel_geaendert"),
    ("ziel_zugriff_unix", "ziel_zugegriffen"), ("zeit_unix", "ereignis"), ("besucht_unix", "besucht"), ("letzte_ausfuehrung_unix", "ausgefuehrt"), ("registriert_unix", "registriert"),
    ("erstellt_unix", "erstellt"), ("letzte_aenderung_unix", "geaendert"),
)
TIMELINE_ORDER = ("unix", "domain", "finding_index", "key_index")


def whole_timeline(findings: DataFrame) -> DataFrame:
    """All time attributes of findings (finding_index, finding_id, domain, name, source, offset, attributes) as rows in the timeline's order, with volume and ``place`` in it.

    The order is a range-partitioned sort, ties by finding and then by the keys' order; ``place`` counts from 1 within equal seconds and domains.
    """
    rows = super_timeline(findings, TIME_KEYS).withColumn("volume", F.try_element_at("attributes", F.lit("volume")))
    ties = Window.partitionBy("unix", "domain").orderBy("finding_index", "key_index")
    return rows.withColumn("place", F.row_number().over(ties)).select("unix", "domain", "event", "name", "source", "finding_index", "finding_id", "key_index", "time_key", "offset", "volume", "place").orderBy(*TIMELINE_ORDER)


def super_timeline(findings: DataFrame, time_keys: Sequence[tuple[str, str]]) -> DataFrame:
    """A row for every time attribute that reads as a 64-bit number; ``key_index`` keeps the keys' order for ties."""
    rows = F.array(*(F.struct(F.lit(i).alias("key_index"), F.lit(k).alias("time_key"), F.lit(e).alias("event"), F.try_element_at("attributes", F.lit(k)).try_cast("bigint").alias("unix")) for i, (k, e) in enumerate(time_keys)))
    known = F.filter(rows, lambda r: r["unix"].isNotNull())
    return findings.select("*", F.inline(known))


_KINDS = (("B", "created"), ("M", "modified"), ("C", "mft_modified"), ("A", "accessed"))


def macb(records: DataFrame, names: DataFrame) -> DataFrame:
    """Times of records and of their names as rows: mft_record, kind, name_index, filetime. Unset times and DOS names are left out."""
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.col("times")[c].alias("filetime")) for k, c in _KINDS))
    of_records = records.select("mft_record", F.lit(None).cast("bigint").alias("name_index"), F.inline(rows))
    of_names = names.where("namespace <> 'DOS'").select("mft_record", "name_index", F.inline(rows))
    return of_records.unionByName(of_names).where("filetime <> 0").select("mft_record", "kind", "name_index", "filetime")


def macb_order() -> list[Column]:
    """Time, record, name (records' own last), then B, M, C, A."""
    return [F.col("filetime"), F.col("mft_record"), F.coalesce("name_index", F.lit(2**31 - 1)), F.instr(F.lit("BMCA"), F.col("kind"))]


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """For each left row the right value last known at its time; by union and window, so no pair is built."""
    both = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)}).unionByName(right.select(*keys, time, F.lit(0).alias("_side"), F.col(value).alias("_value")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_value")


def numbered(rows: DataFrame, bucket: str, order: Sequence[Column]) -> DataFrame:
    """The rows with ``place`` in an order that begins with the bucket (whole numbers, rising with it), without one task for all rows.

    Rows are numbered in their bucket; the sizes of the earlier buckets, one number each, are added.
    """
    sizes = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy().orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(bucket, "_before")
    own = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return rows.withColumn("_own", own).join(before, bucket).withColumn("place", F.col("_own") + F.col("_before")).drop("_own", "_before")
