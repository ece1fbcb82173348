"""Search in texts: term tables, proximity pairs, addresses, literal words, line offsets and search documents."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import netfn

WORD = "[A-Za-z0-9_]"
#: fixed values
DEFAULT_DISTANCE, MOST_HITS, MOST_PER_CATEGORY, MOST_PER_DOMAIN = 128, 100_000, 20_000, 20_000


class Term(NamedTuple):
    """One entry of a term table. In pair categories ``side`` is ``L`` or ``R``."""

    category: str
    text: str
    whole_word: bool = False
    side: str = ""


def term_table(spark, terms: Sequence[Term]) -> DataFrame:
    return spark.createDataFrame([tuple(t) for t in terms], "category string, term string, whole_word boolean, side string")


def positions(text: Column, word: Column) -> Column:
    """Start offsets (0-based code points) of a literal in a short text, overlapping ones included; for tables of long texts use ``literal_offsets``."""
    last = F.length(text) - F.length(word)
    found = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substr(text, i + 1, F.length(word)) == word)
    return F.when((F.length(word) > 0) & (last >= 0), found).otherwise(F.array().cast("array<int>"))


def chunks(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """``key``, ``base`` and ``chunk``: texts in pieces of ``size`` characters, each with the ``overlap`` that follows."""
    base = F.explode(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size)))
    cut = docs.where(F.col(text).isNotNull()).select(key, text, base.alias("base"))
    return cut.select(key, F.col("base").cast("bigint").alias("base"), F.substr(text, F.col("base") + 1, F.lit(size + overlap)).alias("chunk"))


def literal_offsets(docs: DataFrame, keys: Sequence[str], text: str, word: str, most: int | None = None) -> DataFrame:
    """``keys``, ``encoding`` and ``start`` of every occurrence of a literal, overlapping ones included, letter case counting.

    A string column is searched in code points, a binary one in bytes, as UTF-8 and as UTF-16LE. With ``most``,
    of each row only the first so many by offset; the row's ``limited`` tells that there were more.
    """
    kind = docs.schema[text].dataType.simpleString()
    needles = [("utf8", word)] if kind == "string" else [("utf8", word.encode()), ("utf16le", word.encode("utf-16-le"))]
    if not word:
        raise ValueError("an empty word is everywhere")

    def offsets(content) -> list[tuple[int, str]]:
        out = []
        for encoding, needle in needles:
            at = content.find(needle)
            while at >= 0:
                out.append((at, encoding))
                at = content.find(needle, at + 1)
        return sorted(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, content in enumerate(batch.column(len(keys)).to_pylist()):
                found = offsets(content) if content is not None else []
                rows += [(k, e, at, most is not None and len(found) > most) for at, e in found[:most]]
            row, encoding, start, limited = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row, pa.int64())) for i in range(len(keys))), pa.array(encoding, pa.string()), pa.array(start, pa.int64()), pa.array(limited, pa.bool_())], names=[*keys, "encoding", "start", "limited"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, text).mapInArrow(run, f"{schema}, encoding string, start bigint, limited boolean")


def _automaton(terms: Sequence[Term]):
    """All terms in one automaton, so that a text is read once however many there are."""
    import ahocorasick

    by_text: dict[str, list[Term]] = {}
    for t in terms:
        by_text.setdefault(_ascii_low(t.text), []).append(t)
    out = ahocorasick.Automaton()
    for low, own in by_text.items():
        out.add_word(low, (len(low), own))
    out.make_automaton()
    return out


def _ascii_low(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _is_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _edges_fit(t: Term, text: str, start: int, end: int) -> bool:
    """A whole word's edge must be one where the term itself begins or ends with a word character."""
    if not t.whole_word:
        return True
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    return not (_is_word(t.text[0]) and before and _is_word(before)) and not (_is_word(t.text[-1]) and after and _is_word(after))


def holding_any(docs: DataFrame, text: str, terms: Sequence[Term]) -> DataFrame:
    """The rows whose text holds any term, ASCII case aside: one regular expression in the JVM."""
    anything = "|".join(sorted({re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", t.text) for t in terms}))
    return docs.where(F.col(text).rlike(f"(?i){anything}"))


HITS = "category string, term string, side string, start bigint, end bigint"


def keyword_hits(docs: DataFrame, key: str, text: str, terms: Sequence[Term]) -> DataFrame:
    """A row for every match of every term, overlapping ones included, ASCII case ignored: key, category, term, side, start and end in code points.

    The term table is configuration of bounded size and travels with the task. Texts without any term, told by
    one regular expression in the JVM, never reach Python.
    """
    kind = docs.schema[key].dataType.simpleString()
    likely = holding_any(docs, text, terms).select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(terms)
        for batch in batches:
            rows = []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for last, (n, own) in automaton.iter(_ascii_low(s)) if s else ():
                    rows += [(k, t.category, t.text, t.side, last + 1 - n, last + 1) for t in own if _edges_fit(t, s, last + 1 - n, last + 1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [batch.column(0).type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "category", "term", "side", "start", "end"])

    return likely.mapInArrow(run, f"`{key}` {kind}, {HITS}")


TEXT_RUN = 8  #: fixed value: printable characters around a match in a text context


def _printable(b: int) -> bool:
    return 0x20 <= b < 0x7F or b in (9, 10, 13)


def in_text(content: bytes, start: int, end: int, width: int) -> bool:
    """Whether a match lies in a run of at least ``TEXT_RUN`` printable characters of its encoding."""
    good = lambda at: _printable(content[at]) and (width == 1 or content[at + 1] == 0)
    lo, hi = start, end
    while lo >= width and (hi - lo) // width < TEXT_RUN and good(lo - width):
        lo -= width
    while hi + width <= len(content) and (hi - lo) // width < TEXT_RUN and good(hi):
        hi += width
    return (hi - lo) // width >= TEXT_RUN


def byte_hits(files: DataFrame, key: str, content: str, terms: Sequence[Term], text_only: bool = False) -> DataFrame:
    """Matches of a term table in binary content, each term as ASCII and as UTF-16LE, ASCII case aside: key, category, term, side, encoding, start and end in bytes.

    All terms in both encodings are one automaton, so the content is read once. ``text_only`` keeps matches in a
    run of printable characters. The term table is configuration of bounded size and travels with the task.
    """
    kind = files.schema[key].dataType.simpleString()

    def automaton():
        import ahocorasick

        own: dict[str, list] = {}
        for t in terms:
            for encoding, width, needle in (("ascii", 1, t.text.encode()), ("utf16le", 2, t.text.encode("utf-16-le"))):
                own.setdefault(needle.lower().decode("latin-1"), []).append((t, encoding, width))
        out = ahocorasick.Automaton()
        for needle, found in own.items():
            out.add_word(needle, (len(needle), found))
        out.make_automaton()
        return out

    def edges_fit(t: Term, data: bytes, start: int, end: int, width: int) -> bool:
        if not t.whole_word:
            return True
        word = lambda at: 0 <= at and at + width <= len(data) and _is_word(chr(data[at])) and (width == 1 or data[at + 1] == 0)
        return not (_is_word(t.text[0]) and word(start - width)) and not (_is_word(t.text[-1]) and word(end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = []
            for k, data in enumerate(batch.column(1)):
                data = data.as_py()
                for last, (n, found) in machine.iter(data.lower().decode("latin-1")) if data else ():
                    start, end = last + 1 - n, last + 1
                    rows += [(k, t.category, t.text, t.side, encoding, start, end) for t, encoding, width in found if edges_fit(t, data, start, end, width) and (not text_only or in_text(data, start, end, width))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], names=[key, "category", "term", "side", "encoding", "start", "end"])

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, category string, term string, side string, encoding string, start bigint, end bigint")


def scanned_bytes(content: bytes, terms: Sequence[Term], base: int = 0) -> list[tuple[str, str, str, int]]:
    """Matches in bytes, each term as ASCII and as UTF-16LE: category, term, encoding, offset; in the order of their ends."""
    low, out = content.lower(), []
    for t in terms:
        for encoding, needle in (("ascii", t.text.lower().encode()), ("utf16le", t.text.lower().encode("utf-16-le"))):
            width = 1 if encoding == "ascii" else 2
            at = low.find(needle)
            while at >= 0:
                before, after = content[at - width : at] if at >= width else b"", content[at + len(needle) : at + len(needle) + width]
                is_word = lambda b: bool(b) and re.match(WORD.encode(), b[:1]) is not None and not b[1:].strip(b"\0")
                edge = t.whole_word and ((re.match(WORD, t.text[0]) and is_word(before)) or (re.match(WORD, t.text[-1]) and is_word(after)))
                if not edge:
                    out.append((at + len(needle), t.category, t.text, encoding, base + at))
                at = low.find(needle, at + 1)
    return [x[1:] for x in sorted(out, key=lambda x: (x[0], -len(x[2]), x[2], x[3]))]


def scanned_chunks(content: bytes, terms: Sequence[Term], chunk: int) -> list[tuple[str, str, str, int]]:
    """The same matches from overlapping chunks: a match belongs to the chunk it starts in. Terms must not need more context than they are long."""
    overlap = max(2 * len(t.text) for t in terms) + 2
    out = set()
    for start in range(0, len(content), chunk):
        lead = min(start, 2)
        part = content[start - lead : start + chunk + overlap]
        out |= {m for m in scanned_bytes(part, terms, start - lead) if start <= m[3] < start + chunk}
    return sorted(out, key=lambda m: m[3])


def keyword_pairs(hits: DataFrame, key: str, distance: int = DEFAULT_DISTANCE, by: Sequence[str] = ()) -> DataFrame:
    """A left term and the latest right term before it within the distance, or the other way round: one row a pair. Hits are visited by their ends; ``by`` (as the encoding of matches in bytes) keeps apart what is no pair."""
    w = Window.partitionBy(key, "category", *by).orderBy("end", F.desc(F.length("term")), "term", "start").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda side: F.last(F.when(F.col("side") == side, F.struct("start", "end", "term")), ignorenulls=True).over(w)
    other = F.when(F.col("side") == "L", last("R")).otherwise(last("L"))
    gap = F.greatest(F.col("start") - F.col("other.end"), F.col("other.start") - F.col("end"), F.lit(0))
    return hits.where("side IN ('L', 'R')").withColumn("other", other).where("other IS NOT NULL").withColumn("gap", gap).where(F.col("gap") <= distance).select(key, "category", *by, F.least("start", "other.start").alias("start"), F.when(F.col("side") == "L", F.col("term")).otherwise(F.col("other.term")).alias("left_term"), F.when(F.col("side") == "L", F.col("other.term")).otherwise(F.col("term")).alias("right_term"), "gap")


def snippet(text: Column, start: Column, length: Column, around: int = 24, most: int = 200) -> Column:
    """The match with its surroundings; control characters become dots."""
    begin = F.greatest(start - around, F.lit(0))
    return F.left(F.regexp_replace(F.substr(text, (begin + 1).cast("int"), (start + length + around - begin).cast("int")), r"[\x00-\x1f\x7f]", "."), F.lit(most))


def capped(hits: DataFrame, keys: Sequence[str], order: Sequence[Column | str], most: int) -> DataFrame:
    """At most ``most`` hits of each group, and whether the group had more."""
    return hits.withColumns({"_n": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), "limited": F.count(F.lit(1)).over(Window.partitionBy(*keys)) > most}).where(F.col("_n") <= most).drop("_n")


def onion_addresses(text: Column) -> Column:
    """Names of 56 characters right before ``.onion``."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z2-7]{56})\.onion"), 1)


def ipv4_literals(text: Column) -> Column:
    """IPv4 literals, with a port or without, among tokens of ``[A-Za-z0-9.:_%-]``; final dots do not count."""
    number = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    tokens = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9.:_%-]+)"), 1), lambda t: F.regexp_replace(t, r"\.+$", ""))
    good = F.filter(tokens, lambda t: (F.length(t) <= 128) & t.rlike(rf"^{number}(?:\.{number}){{3}}(?::[0-9]{{1,5}})?$"))
    good = F.filter(good, lambda t: F.coalesce(F.try_element_at(F.split(t, ":"), F.lit(2)).cast("int"), F.lit(0)) <= 65535)
    return F.transform(good, lambda t: F.element_at(F.split(t, ":"), 1))


def ip_literals(data: bytes | str) -> list[str]:
    """IPv4 and IPv6 literals of a text or of bytes (ASCII and both phases of UTF-16LE), canonical."""
    import ipaddress

    texts = [data] if isinstance(data, str) else [data.decode("latin-1"), *("".join(chr(data[i]) if not data[i + 1] else "\0" for i in range(phase, len(data) - 1, 2)) for phase in (0, 1))]
    out = []
    for text in texts:
        for token in re.findall(r"[A-Za-z0-9.:_%-]+", text):
            token = token.rstrip(".")
            if len(token) > 128 or not {".", ":"} & set(token):
                continue
            plain = re.fullmatch(r"([0-9.]+):([0-9]{1,5})", token)
            candidate = plain[1] if plain and int(plain[2]) <= 65535 else token
            try:
                out.append(str(ipaddress.ip_address(candidate.partition("%")[0])))
            except ValueError:
                continue
    return out


def address_hits(files: DataFrame, key: str, content: str, most: int = netfn.MOST_HITS) -> DataFrame:
    """IPv4 and IPv6 literals of a text or binary column: key, canonical address, its text, kind, encoding, start and length, and whether the content has more than ``most``.

    Tokens of ``[A-Za-z0-9.:_%-]`` up to 128 long, final dots aside, that are an address, or an IPv4 address and
    a port. Binary content is read as ASCII and as both phases of UTF-16LE. All of it are Column functions.
    """
    binary = files.schema[content].dataType.simpleString() == "binary"
    return files.select(key, F.inline(netfn.addresses(F.col(content), binary, most)))


def lines_with_offsets(docs: DataFrame, key: str, text: str, most_bytes: int = 65536) -> DataFrame:
    """Physical lines: number from 1, byte offset, length without its end, text, and whether a backtick continues it. Blank and overlong ones are left out.

    One pass over each text where it lies: no line is shuffled, and the work is linear in the text.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, offset, size, lines = [], [], [], [], []
            for k, content in enumerate(batch.column(1).to_pylist()):
                at = 0
                for n, raw in enumerate(content.encode().split(b"\n"), 1):
                    line = raw.removesuffix(b"\r")
                    if line.strip(b" ") and len(line) <= most_bytes:
                        row.append(k)
                        number.append(n)
                        offset.append(at)
                        size.append(len(line))
                        lines.append(line.decode())
                    at += len(raw) + 1
            continued = [x.endswith("`") for x in lines]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int64()), pa.array(offset, pa.int64()), pa.array(size, pa.int64()), pa.array(lines, pa.string()), pa.array(continued, pa.bool_())], names=[key, "line_no", "offset", "bytes", "line", "continued"])

    return docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"`{key}` {kind}, line_no bigint, offset bigint, bytes bigint, line string, continued boolean")


def search_document(fields: Column) -> Column:
    """``key: value`` of a map, by key, as one searchable text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " ")


def preview(document: Column, query: str | None) -> Column:
    """240 characters from 60 before the first match; from the beginning without a query."""
    if not query:
        return F.left(document, F.lit(240))
    at = F.greatest(F.lit(1), F.locate(query.lower(), F.lower(document)) - 60)
    return F.substr(document, at, F.lit(240))
