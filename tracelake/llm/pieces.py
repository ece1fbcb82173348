"""SentencePiece encoding and decoding over a relational lattice.

The text, with ``\\u2581`` for spaces and one in front (as the model says), is cut between two characters
that are neighbours in no piece; no piece can lie across such a cut, so its parts, here called words,
can be encoded apart and every distinct word only once:

1. All texts are cut, and the distinct words counted (map-side first).
2. Lattice: substrings of bounded length of every distinct word are exploded and equi-joined to the
   piece table (on a hash, with the strings compared besides); the edges are grouped by word, which they are already distributed by.
3. Viterbi: a Spark higher-order ``reduce`` (``aggregate``) folds over a word's edges by end and start,
   keeping the best score and path to each end. As Spark copies the state at every step, words over ``SHORT``
   characters are exploded and grouped in blocks and folded in two levels: over a block's edges with the scores
   of the last ends only, as many as the longest piece reaches back, and one step back from each end of the
   block; and over the blocks, which alone carries the whole log. A second such fold walks the log from its end.
   A character that no piece covers costs 10 more than the worst piece and
   becomes its bytes' pieces (or the unknown piece). Ties go to the longer last piece.
4. The words' ids go back to the texts: from a broadcast, if the distinct words are at most
   ``broadcast_words`` (counted first). Of more, the most frequent ones are broadcast, and only the occurrences of the
   others are shuffled: joined on the word, grouped by text and joined to the documents, where each fills its place.

Scores are those of the model file, as a unigram model uses them. (The public file at hand holds a BPE
vocabulary; its ids here are those of the best path over its scores, not of its merges, and decode to
the very text.) A model that changes texts before cutting them (a normaliser's map, trimmed spaces) or has
user-defined pieces is refused.

Edge cases: null gives null ids, empty text none; any character, spaces and control characters
included, survives a round trip if the model has byte pieces and does not trim spaces, except that a
text's own ``\u2581`` becomes a space, as in the SentencePiece library; with ``literal`` it is kept
apart from spaces (as a space in the prepared text, which has no others), spelled in bytes, and survives
too. Repeated rows are encoded alike; columns called ``ids`` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .sparkio import bound_batches, lean, saved, slices, unused

SPACE = "▁"
SHORT = 64
BLOCK_CHARS = 128
BROADCAST_WORDS = 4_000_000
TASK_WORDS = 50_000
FLUSH_CHARS = 1 << 20
DECODED_ROWS = 128
STEP_BITS = 22


class Model(NamedTuple):
    """Pieces by text with (id, score); each id's bytes; the ids of the 256 bytes (empty: none); and how text begins."""

    pieces: dict[str, tuple[int, float]]
    outputs: list[bytes]
    byte_ids: list[int]
    unk_id: int
    unk_score: float
    longest: int
    prefix: bool


def load_model(path: str) -> Model:
    """Read a SentencePiece file's pieces and scores (on the driver)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    _refuse_normaliser(sp)
    pieces, outputs, byte_ids = {}, [b""] * sp.get_piece_size(), [0] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
            outputs[i] = bytes([int(piece[3:-1], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[piece] = (i, sp.get_score(i))
            outputs[i] = piece.replace(SPACE, " ").encode()
        elif sp.is_unknown(i):
            outputs[i] = " ⁇ ".encode()
    return Model(pieces, outputs, byte_ids if any(byte_ids) else [], sp.unk_id(), min(s for _, s in pieces.values()) - 10, max(map(len, pieces)), not sp.encode("a", out_type=str)[0].startswith("a"))


def _refuse_normaliser(sp) -> None:
    """Texts must reach the pieces as they are, but for spaces: full-width letters, ligatures, double, leading and trailing spaces."""
    given = " \uff21 \ufb01  x\u00a0 "
    if sp.normalize(given).lstrip(SPACE) != given.replace(" ", SPACE).lstrip(SPACE):
        raise ValueError("the model changes texts before cutting them")


def hash_words(cps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each of the spans that ``at`` parts the code points into, the same wherever it stands: a polynomial, from running sums."""
    p, inverse = tb._power(len(cps) + 1)
    total = np.zeros(len(cps) + 1, np.uint64)
    terms = cps.astype(np.uint64)
    terms += np.uint64(1)
    terms *= p[: len(cps)]
    np.cumsum(terms, out=total[1:])
    return tb.mix(np.diff(total[at]) * inverse[at[:-1]] + np.diff(at).astype(np.uint64), 41)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes as they first come, the places where they do, and the number of each place's hash."""
    coded = pa.array(h).dictionary_encode()
    number = coded.indices.to_numpy()
    return coded.dictionary.to_numpy(), np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1)), number


def spell(cps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Spans of code points as strings."""
    own = cps[tb.ranges(starts, sizes)]
    octets = np.concatenate([[0], np.cumsum(1 + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000))])
    at = octets[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(own.tobytes().decode("utf-32-le").encode()))


class Cutter:
    """Cuts code points into words; if ``literal``, the texts' own U+2581 stand as spaces, each a word."""

    def __init__(self, model: Model, literal: bool = False):
        self.literal = literal
        chars = sorted({c for p in model.pieces for c in p})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        n = len(chars) + 1
        self.joined = np.zeros((n, n), bool)
        for p in model.pieces:
            for a, b in zip(p, p[1:], strict=False):
                self.joined[self.number[ord(a)], self.number[ord(b)]] = True
        self.prefix = model.prefix

    def cut(self, piece: tb.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The code points of the rows' prepared texts, the words' starts in them (with the end), the row of each word, and a hash of each."""
        texts = [piece.text(k).decode("utf-8", "replace") for k in range(piece.last - piece.first)]
        texts = [(" " + t if self.prefix else t) if t else "" for t in texts]
        whole = "".join(texts)
        if self.literal and SPACE in whole:
            whole = SPACE.join(part.replace(SPACE, " ") for part in whole.split(" "))
        else:
            whole = whole.replace(" ", SPACE)
        cps = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not len(cps):
            return cps, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        number = self.number[cps]
        new = np.ones(len(cps), bool)
        new[1:] = ~self.joined[number[:-1], number[1:]]
        new[at[:-1][at[:-1] < len(cps)]] = True
        starts = np.flatnonzero(new)
        bounds = np.append(starts, len(cps))
        return cps, bounds, np.searchsorted(at, starts, side="right") - 1, hash_words(cps, bounds)

    def hash_rows(self, piece: tb.Piece) -> np.ndarray:
        """The hashes of rows that are words."""
        texts = [piece.text(k).decode() for k in range(piece.last - piece.first)]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        return hash_words(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), at)


def distinct_words(docs: DataFrame, cutter) -> DataFrame:
    """``word`` and ``times`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            cps, sizes, h = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            _, first, number = distinct(h)
            return pa.RecordBatch.from_arrays([spell(cps, (np.cumsum(sizes) - sizes)[first], sizes[first]), pa.array(np.bincount(number))], names=["word", "times"])

        chars = 0
        for batch in batches:
            for piece in tb.pieces(batch.column(0)):
                cps, at, _, h = cutter.value.cut(piece)
                held.append((cps, np.diff(at), h))
                chars += len(cps)
                if chars >= FLUSH_CHARS:
                    yield flush()
                    chars = 0
        if chars:
            yield flush()

    return docs.select("text").mapInArrow(lean(run), "word string, times bigint").groupBy("word").agg(F.sum("times").alias("times"))


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    # by Arrow: from a list, Spark would start more Python workers beside those of the queries, and a daemon that stays
    ids, scores = zip(*model.pieces.values(), strict=True)
    return spark.createDataFrame(pa.table({"piece": pa.array(model.pieces, pa.string()), "id": pa.array(ids, pa.int32()), "score": pa.array(scores, pa.float64())}))


def _edge(unk_score: float) -> Column:
    # a character without a piece is -1 less its code point; a space stands for a text's own U+2581
    return F.struct("end", "start", F.coalesce("id", -1 - F.ascii(F.translate("piece", " ", SPACE))).alias("id"), F.coalesce("score", F.lit(unk_score)).alias("score"))


def _edges(spans: DataFrame, pieces: DataFrame) -> DataFrame:
    """The spans that are pieces; a character that is none stays as an unknown edge. The piece table is bounded by the vocabulary.

    A single number as the key is looked up faster than a string. The strings are compared besides, as two may have one hash; by
    order, since an equality would become a part of the key.
    """
    table = F.broadcast(pieces.select(F.xxhash64("piece").alias("hash"), F.col("piece").alias("known"), "id", "score"))
    same = (F.xxhash64("piece") == F.col("hash")) & (F.col("piece") >= F.col("known")) & (F.col("piece") <= F.col("known"))
    return spans.join(table, same, "left").drop("hash", "known").where("id IS NOT NULL OR end - start = 1")


def lattice(words: DataFrame, pieces: DataFrame, longest: int, unk_score: float, n_words: int) -> DataFrame:
    """``word``, ``times`` and ``edges`` (end, start, id, score): every substring of at most ``longest`` characters that is a piece, or one unknown character."""
    # plain generators stay inside generated code; the words are dealt by word, so grouping needs no further shuffle
    starts = words.repartition(slices(n_words, TASK_WORDS), "word").select("word", "times", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    spans = starts.select("word", "times", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start")))).alias("size"))
    exploded = spans.select("word", "times", "start", (F.col("start") + F.col("size")).alias("end"), F.substr("word", F.col("start") + 1, F.col("size")).alias("piece"))
    return _edges(exploded, pieces).groupBy("word").agg(F.first("times").alias("times"), F.collect_list(_edge(unk_score)).alias("edges"))


def long_lattice(words: DataFrame, pieces: DataFrame, longest: int, unk_score: float) -> DataFrame:
    """``word``, ``times`` and ``blocks`` (number, edges by end and start) of long words: the same edges, without the word in every row."""
    keyed = words.withColumn("key", F.sha2("word", 256))
    parts = keyed.select("key", "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1, F.lit(BLOCK_CHARS))).alias("first"))
    parts = parts.select("key", "first", F.substr("word", F.col("first") + 1, F.lit(BLOCK_CHARS + longest - 1)).alias("part")).repartition("key", "first")
    starts = parts.select("key", "first", "part", F.explode(F.sequence(F.lit(0), F.least(F.lit(BLOCK_CHARS), F.length("part")) - 1)).alias("at"))
    spans = starts.select("key", "first", "part", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("part") - F.col("at")))).alias("size"))
    start = F.col("first") + F.col("at")
    exploded = spans.select("key", start.alias("start"), (start + F.col("size")).alias("end"), F.substr("part", F.col("at") + 1, F.col("size")).alias("piece"))
    blocks = _edges(exploded, pieces).groupBy("key", F.floor((F.col("end") - 1) / BLOCK_CHARS).cast("int").alias("block")).agg(F.sort_array(F.collect_list(_edge(unk_score))).alias("edges"))
    whole = blocks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "edges"))).alias("blocks"))
    return keyed.join(whole, "key").select("word", "times", "blocks")


def _ids_of(piece: Column, model: Model) -> Column:
    """A step's piece as ids: itself, or, for an unknown character, those of its UTF-8 bytes."""
    if not model.byte_ids:
        return F.array(F.when(piece < 0, F.lit(model.unk_id)).otherwise(piece))
    point = -1 - piece
    tail = lambda shift: F.shiftright(point, shift).bitwiseAND(63) + 128
    octets = F.when(point < 0x80, F.array(point)).when(point < 0x800, F.array(F.shiftright(point, 6) + 0xC0, tail(0)))
    octets = octets.when(point < 0x10000, F.array(F.shiftright(point, 12) + 0xE0, tail(6), tail(0))).otherwise(F.array(F.shiftright(point, 18) + 0xF0, tail(12), tail(6), tail(0)))
    return F.when(piece < 0, F.transform(octets, lambda b: F.element_at(F.lit(model.byte_ids), b + 1))).otherwise(F.array(piece))


def fold_viterbi(edges: Column, model: Model) -> Column:
    """The ids of the best path, as a higher-order fold over the edges by end and start.

    The state holds, for each end reached, the best score and the pieces that lead there. An edge to the
    next end opens it; a better one to the same end replaces it, so among equals the smallest start stays.
    """

    def step(state: Column, e: Column) -> Column:
        before = F.element_at(state, e["start"] + 1)
        score = before["score"] + e["score"]
        found = F.struct(score.alias("score"), F.array_append(before["path"], e["id"]).alias("path"))
        opens = F.size(state) == e["end"]
        better = score > F.element_at(state, -1)["score"]
        return F.when(opens, F.array_append(state, found)).when(better, F.array_append(F.slice(state, F.lit(1), e["end"]), found)).otherwise(state)

    def ids(path: Column) -> Column:
        return F.when(F.exists(path, lambda piece: piece < 0), F.flatten(F.transform(path, lambda piece: _ids_of(piece, model)))).otherwise(path)

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("path")))
    return F.reduce(F.sort_array(edges), first, step, lambda state: ids(F.element_at(state, -1)["path"]))


def fold_long(word: Column, blocks: Column, model: Model) -> Column:
    """The same ids as ``fold_viterbi``, by folds whose inner state does not grow with the word.

    ``scores`` are those of the last ends up to ``at``, the last as ``-1``; ``back`` is the best step into ``at``,
    its start and piece in one number; ``log`` and ``done`` hold the steps into earlier ends, one for each.
    """
    inner, outer = "struct<at:int,scores:array<double>,back:bigint,log:array<bigint>>", "struct<at:int,scores:array<double>,back:bigint,done:array<array<bigint>>>"
    most, half = model.longest + 1, 1 << (STEP_BITS - 1)
    blank = F.array().cast("array<bigint>")

    def step(s: Column, e: Column) -> Column:
        score = F.element_at(s["scores"], e["start"] - s["at"] - 1) + e["score"]
        opens = e["end"] > s["at"]
        takes = opens | (score > F.element_at(s["scores"], -1))
        size = F.size(s["scores"])
        kept = F.when(opens, F.slice(s["scores"], F.greatest(F.lit(1), size + 2 - most), F.lit(most))).otherwise(F.slice(s["scores"], F.lit(1), size - 1))
        back = F.shiftleft(e["start"].cast("bigint"), STEP_BITS) + e["id"] + half
        return F.struct(
            F.greatest(e["end"], s["at"]).alias("at"),
            F.when(takes, F.concat(kept, F.array(score))).otherwise(s["scores"]).alias("scores"),
            F.when(takes, back).otherwise(s["back"]).alias("back"),
            F.when(opens & s["back"].isNotNull(), F.concat(s["log"], F.array(s["back"]))).otherwise(s["log"]).alias("log"),
        )

    def block(o: Column, b: Column) -> Column:
        begin = F.struct(o["at"].alias("at"), o["scores"].alias("scores"), o["back"].alias("back"), blank.alias("log")).cast(inner)
        return F.reduce(b["edges"], begin, step, lambda s: F.struct(s["at"].alias("at"), s["scores"].alias("scores"), s["back"].alias("back"), F.concat(o["done"], F.array(s["log"])).alias("done")))

    first = F.struct(F.lit(0).alias("at"), F.array(F.lit(0.0)).alias("scores"), F.lit(None).alias("back"), F.array().alias("done")).cast(outer)
    steps = F.reduce(blocks, first, block, lambda o: F.concat(o["done"], F.array(F.array(o["back"]))))

    def walk(s: Column, back: Column) -> Column:
        reached = s["end"] == s["at"]
        return F.struct(F.when(reached, F.shiftright(back, STEP_BITS).cast("int")).otherwise(s["at"]).alias("at"), (s["end"] - 1).alias("end"), F.when(reached, F.concat(s["log"], F.array(back))).otherwise(s["log"]).alias("log"))

    def walk_chunk(o: Column, chunk: Column) -> Column:
        begin = F.struct(o["at"].alias("at"), o["end"].alias("end"), blank.alias("log")).cast("struct<at:int,end:int,log:array<bigint>>")
        return F.reduce(F.reverse(chunk), begin, walk, lambda s: F.struct(s["at"].alias("at"), s["end"].alias("end"), F.concat(o["done"], F.array(s["log"])).alias("done")))

    last = F.struct(F.length(word).alias("at"), F.length(word).alias("end"), F.array().alias("done")).cast("struct<at:int,end:int,done:array<array<bigint>>>")
    path = F.reduce(F.reverse(steps), last, walk_chunk, lambda o: F.reverse(F.flatten(o["done"])))
    return F.flatten(F.transform(path, lambda back: _ids_of((back.bitwiseAND((1 << STEP_BITS) - 1) - half).cast("int"), model)))


def encoded_words(words: DataFrame, model: Model) -> DataFrame:
    """``word``, ``times`` and ``ids`` of each distinct word."""
    short, long = words.where(F.length("word") <= SHORT), words.where(F.length("word") > SHORT)
    table = piece_table(words.sparkSession, model)
    # one lattice, two ways to keep the fold's state; the short words' is the quicker one
    found = lattice(short, table, model.longest, model.unk_score, words.count()).select("word", "times", fold_viterbi(F.col("edges"), model).alias("ids"))
    rest = long_lattice(long, table, model.longest, model.unk_score).select("word", "times", fold_long(F.col("word"), F.col("blocks"), model).alias("ids"))
    # most corpora have no long words; then their branch, and its second copy of the piece table, is left out of the plan
    return found.unionByName(rest) if long.take(1) else found


def least_times(words: DataFrame, most: int) -> int:
    """Words that occur so many times are at most ``most``: 1 if all of them are, else a power of two, by the counts of each binary length."""
    n = 0
    for bits, count in sorted(words.groupBy(F.length(F.bin("times"))).count().collect(), reverse=True):
        n += count
        if n > most:
            return 1 << bits
    return 1


class Dictionary(NamedTuple):
    """Word hashes, sorted, and each one's ids."""

    hashes: np.ndarray
    at: np.ndarray
    ids: np.ndarray

    def known(self, h: np.ndarray) -> np.ndarray:
        """Which words are here."""
        if not len(self.hashes):
            return np.zeros(len(h), bool)
        keys, _, number = distinct(h)
        return (self.hashes[np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)] == keys)[number]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words on end, and how many each has."""
        keys, _, number = distinct(h)  # each word is searched for once
        k = np.searchsorted(self.hashes, keys)
        start = self.at[k].astype(np.int64)
        n = (self.at[k + 1] - start)[number]
        start = start[number]
        return self.ids[tb.ranges(start, n)].astype(np.int32), n

    def look_up_with(self, h: np.ndarray, others: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The same, where ``others`` holds the ids of each word that isn't here, in order."""
        known = self.known(h)
        if len(others) != len(h) - known.sum():
            raise ValueError("a word has no ids")
        n = np.empty(len(h), np.int64)
        ids, n[known] = self.look_up(h[known])
        n[~known] = np.diff(others.offsets.to_numpy())
        start = np.cumsum(n) - n
        out = np.empty(n.sum(), np.int32)
        out[tb.ranges(start[known], n[known])] = ids
        out[tb.ranges(start[~known], n[~known])] = others.flatten().to_numpy(zero_copy_only=False)
        return out, n


def dictionary(words: DataFrame, cutter, n_ids: int) -> Dictionary:
    """All encoded words, packed by the executors; only for a counted, bounded number of words. Ids are below ``n_ids``."""
    kind = np.uint16 if n_ids <= 1 << 16 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            h = np.concatenate([cutter.value.hash_rows(p) for p in tb.pieces(column)]) if len(column) else np.zeros(0, np.uint64)
            ids = batch.column(1)
            n = np.diff(ids.offsets.to_numpy()).astype(np.int32)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (h, n, flat)], names=["h", "n", "ids"])

    parts = [(np.frombuffer(r.h, np.uint64), np.frombuffer(r.n, np.int32), np.frombuffer(r.ids, kind)) for r in words.select("word", "ids").mapInArrow(lean(run), "h binary, n binary, ids binary").toLocalIterator()]
    if not parts:
        return Dictionary(np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, kind))
    h, n, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    order = np.argsort(h, kind="stable")
    h = h[order]
    if (h[1:] == h[:-1]).any():
        raise ValueError("two words have one 64-bit hash")
    start = (np.cumsum(n, dtype=np.int64) - n)[order]
    n = n[order]
    at = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).astype(np.uint32)
    out = np.empty(len(ids), kind)
    for i in range(0, len(n), TASK_WORDS):  # some at a time, as the places take four times as much as the ids
        j = min(i + TASK_WORDS, len(n))
        out[at[i] : at[j]] = ids[tb.ranges(start[i:j], n[i:j].astype(np.int64))]
    return Dictionary(h, at, out)


class Speller(NamedTuple):
    """Each id's bytes, and how text begins."""

    outputs: pa.LargeBinaryArray
    prefix: bool

    def texts(self, ids: list[np.ndarray | None]) -> list[str | None]:
        """What the ids of some rows decode to; null for null ids."""
        given = [x for x in ids if x is not None]
        spelled = self.outputs.take(pa.array(np.concatenate([np.zeros(0, np.int32), *given])))
        _, where, raw = spelled.buffers()
        octets = np.frombuffer(where, np.int64)[np.concatenate([[0], np.cumsum([len(x) for x in given])]).astype(np.int64)].tolist()
        whole = memoryview(raw or b"")
        found = (bytes(whole[a:z]) for a, z in zip(octets, octets[1:], strict=False))
        return [None if x is None else self._text(next(found)) for x in ids]

    def _text(self, raw: bytes) -> str:
        return (raw[1:] if self.prefix and raw.startswith(b" ") else raw).decode("utf-8", "replace")


def speller(model: Model) -> Speller:
    return Speller(pa.array(model.outputs, pa.large_binary()), model.prefix)


EXTRAS = {"ids": T.ArrayType(T.IntegerType()), "n_pieces": T.LongType(), "ids_sha256": T.StringType(), "decoded": T.StringType(), "round_trip": T.BooleanType()}


def _extra(name: str, ids: list[np.ndarray | None], texts: list[str | None], spelled_out: Speller) -> pa.Array:
    """A column made of the ids of some rows; null for null ids."""
    each = lambda f, kind: pa.array([None if x is None else f(x) for x in ids], kind)
    if name == "n_pieces":
        return each(len, pa.int64())
    if name == "ids_sha256":
        return each(lambda x: hashlib.sha256(x.astype("<i4").tobytes()).hexdigest(), pa.string())
    if name == "decoded":
        return pa.array(spelled_out.texts(ids), pa.string())
    if name == "round_trip":
        return pa.array([found == t for found, t in zip(spelled_out.texts(ids), texts, strict=True)], pa.bool_())
    at = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat), mask=pa.array([x is None for x in ids]))


def encode(docs: DataFrame, model: Model, broadcast_words: int = BROADCAST_WORDS, keep: list[str] | None = None, extras: tuple[str, ...] = ("ids",), literal: bool = False) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``extras``: ``ids``, and what is made of them in the same pass: ``n_pieces``, ``ids_sha256`` (of the ids as 32-bit numbers, low byte first), ``decoded``, ``round_trip`` (whether the ids decode to the text). ``literal``: a text's own U+2581 is spelled in bytes, not read as a space."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    cutter = spark.sparkContext.broadcast(Cutter(model, literal))
    words = saved(encoded_words(saved(distinct_words(docs.where("text IS NOT NULL"), cutter), "pieces-words"), model), "pieces-encoded")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in extras]
    scanned = next((c for c in names if c.lower() == "text"), None) or unused(docs, "scanned")
    given = [F.col(f"`{c}`") for c in names]
    source = docs.select(*given) if scanned in names else docs.select(*given, F.col("text").alias(scanned))
    at_text = source.columns.index(scanned)
    schema = T.StructType([*(source.schema[c] for c in names), *(T.StructField(x, EXTRAS[x]) for x in extras)])
    spelled_out = spark.sparkContext.broadcast(speller(model))
    least = least_times(words, broadcast_words)
    table = spark.sparkContext.broadcast(dictionary(words.where(F.col("times") >= least), cutter, len(model.outputs)))

    def fill(batch: pa.RecordBatch, others: pa.ListArray | None) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batch.column(at_text)):
            part = batch.slice(piece.first, piece.last - piece.first)
            texts = part.column(at_text).to_pylist()
            _, _, row, h = cutter.value.cut(piece)
            ids, n = table.value.look_up(h) if others is None else table.value.look_up_with(h, others.slice(piece.first, part.num_rows).flatten())
            at = np.concatenate([[0], np.cumsum(np.bincount(row, weights=n, minlength=part.num_rows))]).astype(np.int64)
            each = [None if t is None else ids[at[k] : at[k + 1]] for k, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *(_extra(x, each, texts, spelled_out.value) for x in extras)], names=schema.names)

    if least == 1:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from fill(batch, None)

        return source.mapInArrow(lean(run), schema)

    rare = words.where(F.col("times") < least).select("word", F.col("ids").alias("word_ids"))

    def clashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tb.pieces(batch.column(0)):
                yield batch.slice(piece.first, piece.last - piece.first).filter(pa.array(table.value.known(cutter.value.hash_rows(piece))))

    if rare.select("word").mapInArrow(lean(clashes), "word string").take(1):
        raise ValueError("two words have one 64-bit hash")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places, counted in their text, of the words that the dictionary lacks."""
        for batch in batches:
            for piece in tb.pieces(batch.column(0)):
                cps, at, row, h = cutter.value.cut(piece)
                k = np.flatnonzero(~table.value.known(h))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row[k] + piece.first)), pa.array((k - np.searchsorted(row, row[k])).astype(np.int32)), spell(cps, at[k], at[k + 1] - at[k])], names=["key", "place", "word"])

    # equal texts have equal ids, so texts are keyed by 128-bit digests, and copies of a place count once
    key, joined_ids = unused(source, "key"), unused(source, "ids_in")
    keyed = source.withColumn(key, F.substring(F.unhex(F.sha2(F.encode(scanned, "UTF-8"), 256)), 1, 16))
    parts = keyed.where(F.col(scanned).isNotNull()).select(scanned, key).mapInArrow(lean(spread), "key binary, place int, word string").join(rare, "word")
    places = parts.select("key", "place", "word_ids").repartition("key").groupBy("key", "place").agg(F.first("word_ids").alias("word_ids"))
    whole = places.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word_ids"))), lambda x: x["word_ids"]).alias(joined_ids))
    joined = keyed.join(whole.withColumnRenamed("key", key), key, "left").select(*(F.col(f"`{c}`") for c in source.columns), joined_ids)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(start, DECODED_ROWS)
                yield from fill(part, part.column(part.num_columns - 1))

    return joined.mapInArrow(lean(finish), schema)


def decode(encoded: DataFrame, model: Model, into: str = "decoded") -> DataFrame:
    """Adds the text of ``ids``; null for null."""
    names = [c for c in encoded.columns if c.lower() != into.lower()]
    source = encoded.select(*(F.col(f"`{c}`") for c in names), F.col("ids").alias("_ids_in"))
    schema = T.StructType([*source.drop("_ids_in").schema.fields, T.StructField(into, T.StringType())])
    spelled_out = encoded.sparkSession.sparkContext.broadcast(speller(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(at, DECODED_ROWS)
                texts = spelled_out.value.texts([x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in part.column(len(names))])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
