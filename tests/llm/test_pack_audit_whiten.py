"""Packing, the divergence audit and whitening against plain versions, on fixtures with nulls, ties, copies and long texts."""

from __future__ import annotations

import collections
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tracelake.llm import divergence, packing, queries, whitening

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    return queries.bpe_tokenizer()


def whole_ids(json: str, text: str) -> list[int]:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json).encode(text, add_special_tokens=False).ids


# ---- packing


def bins_one_by_one(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Best-two-fit, a document and a bin at a time, with a search of all pairs."""
    left, out = collections.Counter(counts), []
    while left.total():
        inside, gap = [], capacity
        while fits := [n for n in left if left[n] and n <= gap]:
            inside.append(max(fits))
            left[inside[-1]] -= 1
            gap -= inside[-1]
        least = min(inside)
        lengths = [n for n in left if left[n]]
        pairs = [(a + b, a, b) for a in lengths for b in lengths if a >= b and (a != b or left[a] > 1) and least < a + b <= gap + least]
        if gap and pairs:
            _, a, b = max(pairs)
            inside.remove(least)
            inside += [a, b]
            left.subtract([a, b])
            left[least] += 1
        out.append(tuple(sorted(inside, reverse=True)))
    return out


def test_bins_are_those_decided_one_by_one():
    rnd = random.Random(3)
    for capacity in (1, 2, 10, 37, 100):
        for _ in range(30):
            counts = {rnd.randint(1, capacity): rnd.choice([1, 2, 3, 40]) for _ in range(rnd.randint(0, 12))}
            made = collections.Counter()
            for b in packing.best_two_fit(counts, capacity):
                made[tuple(n for n, many in b.lengths for _ in range(many))] += b.number
            assert made == collections.Counter(bins_one_by_one(counts, capacity))
    with pytest.raises(ValueError):
        list(packing.best_two_fit({11: 1}, 10))


def test_two_for_the_smallest():
    """7 + 2 leaves one of ten; 2 gives way to 3, which is two documents of 2 and 1."""
    assert [b.lengths for b in packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)][0] == [(6, 1), (2, 2)]


def test_bins_of_millions():
    bins = list(packing.best_two_fit({n: 1_000_000 + n for n in range(1, 2049)}, 2048))
    assert len(bins) < 20_000
    used = collections.Counter()
    for b in bins:
        assert sum(n * m for n, m in b.lengths) <= 2048
        for n, m in b.lengths:
            used[n] += m * b.number
    assert used == {n: 1_000_000 + n for n in range(1, 2049)}


def test_ids_are_the_tokenizers(tokenizer, monkeypatch):
    rnd = random.Random(1)
    parts = ["a", "bc", " ", "  ", "\n", "\t", "é", "ß", "'s", "'t", "12", ".", "!?", " ", "\x1c", "\x85", " ", "　", "<|endoftext|>", "<|end", "日本", "😀", "Ω", "\x00", "\x7f", "x y"]
    enc = packing.Encoder(tokenizer, remembered=40)
    monkeypatch.setattr(packing, "CHUNK", 30)
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(80)))
        assert list(np.frombuffer(enc.encode(text), "<u4")) == whole_ids_of(enc, text)


def whole_ids_of(enc: packing.Encoder, text: str) -> list[int]:
    return enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_other_tokenizers():
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = Tokenizer(models.WordLevel({"a": 5, "b": 6, "?": 7}, unk_token="?"))
    words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    enc = packing.Encoder(words.to_str())
    assert not enc.by_words and list(np.frombuffer(enc.encode("b a  zz"), "<u4")) == [6, 5, 7]


def test_pack(spark, tokenizer):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["the", "river", "naïve", "x1", "end.\n"]) for _ in range(rnd.choice([0, 1, 3, 9, 30, 70]))) for _ in range(60)]
    rows = [(i, t, 9, "k") for i, t in enumerate(texts)] + [(None, None, 1, None), (3, "", 1, "k"), (3, texts[3], 1, "k"), (99, "long word " * 120_000, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int, other string").repartition(4)
    out = packing.pack(docs, tokenizer, capacity=16, ids=True)
    assert out.columns == ["doc_id", "other", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    found = out.collect()
    pieces = collections.defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 16 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        pieces[r.doc_id].append((r.piece, r.start, r.length, tuple(ids)))
    wanted = collections.defaultdict(list)
    for i, t, *_ in rows:
        ids = [*whole_ids(tokenizer, t or ""), 0]
        start, piece = 0, 0
        while start < len(ids):
            n = 16 if piece else (len(ids) - 1) % 16 + 1
            wanted[i].append((piece, start, n, tuple(ids[start : start + n])))
            start, piece = start + n, piece + 1
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in wanted.items()}
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for parts in sequences.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= 16
    assert len(sequences) == len(bins_one_by_one(collections.Counter(r.length for r in found), 16))
    for s in packing.sequences(out).collect():
        parts = sorted(sequences[s.sequence_id])
        assert bytes(s.ids) == b"".join(p[2] for p in parts) and s.starts == [p[0] for p in parts]


def test_pack_empty(spark, tokenizer):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(docs, tokenizer, keep=["doc_id"]).collect() == []


@given
def test_pack_query(spark, tokenizer):
    """All documents of the table, once each, in close to as few sequences as their ids need."""
    found = queries.op11_best_two_fit(spark, SF).collect()
    ids = {r.doc_id: [*whole_ids(tokenizer, r.text or ""), 0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = collections.defaultdict(list)
    for r in found:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r.doc_id].append((r.piece, r.start, r.length))
    for i, pieces in seen.items():
        assert [p for p, _, _ in sorted(pieces)] == list(range(len(pieces))) and sum(n for _, _, n in pieces) == len(ids[i])
    assert set(seen) == set(ids)
    counts = collections.Counter(r.length for r in found)
    assert len({r.sequence_id for r in found}) == len(bins_one_by_one(counts, 2048))
    assert len({r.sequence_id for r in found}) <= -(-sum(map(len, ids.values())) // 2048) + 1


# ---- divergence


def audit(rows, least_docs=3, top=200):
    """Every term of every pair, in whole numbers."""
    counts, held, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for lang, source, text in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    out = []
    for lang, source in groups:
        kept = [w for w, n in held[lang].items() if n >= least_docs]
        total = {s: sum(counts[lang, s][w] for w in kept) for g, s in groups if g == lang}
        whole = sum(total.values())
        p = lambda s, w: 1 + 10**9 * (counts[lang, s][w] + 1) // (total[s] + len(kept))  # noqa: E731, B023
        q = lambda w: 1 + 10**9 * (sum(counts[lang, s][w] for s in total) + 1) // (whole + len(kept))  # noqa: E731, B023
        pair = [(s, sum((p(source, w) - p(s, w)) ** 2 // p(s, w) for w in kept)) for s in total if s != source]
        term = [(w, (p(source, w) - q(w)) ** 2 // q(w)) for w in kept if counts[lang, source][w] and p(source, w) > q(w)]
        for part, found, most in (("pair", pair, None), ("term", term, top)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_audit(spark, monkeypatch):
    rnd = random.Random(2)
    words = ["the", "The", "río", "RÍO", "a1b", "x_y", "z", "日本", "ﬁn", "q" * 50] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for _ in range(150):
        source = rnd.choice(["hot", "hot", "s1", "s2", None, ""])
        rows.append((rnd.choice(["en", "de", None]), source, rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randrange(40)))))
    rows += [("en", "null", None), ("en", "empty", ""), ("en", "one", "the"), ("en", "one", "the"), ("none", "a", "alone"), ("none", "b", None), ("en", "digits", "1 2 3 !"), ("de", "s1", "the river " * 30_000), ("no terms", None, None)]
    docs = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "doc_id bigint, lang string, source string, text string, value int, rank string").repartition(5)
    monkeypatch.setattr(divergence, "CHUNK", 100)
    assert divergence.count_terms(("The río " * 100).encode()) == {b"the": 100, "río".encode(): 100}
    monkeypatch.setattr(divergence, "HELD", 20)
    wanted = audit(rows, top=7)
    assert sorted(tuple(r) for r in divergence.audit(docs, top=7).collect()) == wanted
    assert {r[1] for r in wanted if r[0] == "none"} == {"a", "b"} and all(r[4] == 0 for r in wanted if r[0] == "none")


def test_audit_empty(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(docs).collect() == []


def test_joint_counts(spark):
    terms = spark.createDataFrame([("l", [("a", 1), ("b", 2), ("c", 1)]), ("l", [("a", 1), ("b", 2)]), ("l", [("c", 9)]), ("m", [])], "lang string, sources array<struct<source: string, n: bigint>>").coalesce(1)
    found = collections.Counter()
    for r in divergence.joint_counts(terms).collect():
        found[tuple(r)[:5]] += r.m
    assert found == {("l", "a", "b", 1, 2): 2, ("l", "a", "c", 1, 1): 1, ("l", "b", "c", 2, 1): 1}


# ---- whitening


def plain_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    total = Fraction(sum(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in fit), n**3)
    return n, deviation, ((n * x - s) / n) @ v / np.sqrt(e), e / float(total)


def check_whitening(found, ids, vectors, k):
    n, deviation, white, explained = plain_whitening(vectors, k)
    got = {(r.vec_id, r.component): r for r in found}
    assert len(got) == len(found) == len(ids) * k
    for c in range(k):
        column = np.array([got[i, c + 1].whitened for i in ids])
        sign = np.sign(column @ white[:, c])
        assert np.abs(sign * column - white[:, c]).max() < 1e-8
        assert abs(got[ids[0], c + 1].explained / explained[c] - 1) < 1e-9
    for i, d in zip(ids, deviation, strict=True):
        assert all(got[i, c + 1].deviation == d and got[i, c + 1].n == n for c in range(k))
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9


def test_whitening(spark):
    rnd = np.random.default_rng(1)
    vectors = (rnd.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.2] + 1).round(3).tolist()
    rows = [(i, v, "n", 1.5) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0], None, 0.0) for i in range(100)]
    bad = [(None, None, None, None), (1, [], "e", 0.0), (2, [1.0, None, 1.0, 1.0, 1.0, 1.0], "n", 0.0), (3, [float("nan")] * 6, "n", 0.0), (4, [float("inf")] + [0.0] * 5, "n", 0.0)]
    frame = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, n string, x double").repartition(4)
    out = whitening.whiten(frame, components=4)
    assert out.columns == ["vec_id", "x", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(out.collect(), [r[0] for r in rows], [r[1] for r in rows], 4)


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(same).collect() == []
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [0.0, 0.0]), (None, [3.0, 6.0])], "vec_id bigint, embedding array<float>")
    found = whitening.whiten(line).collect()  # one dimension of two varies
    assert sorted(r.component for r in found) == [1] * 4 and found[0].explained == pytest.approx(1)
    assert whitening.whiten(same.limit(0)).collect() == []
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(mixed)


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[1 << 40, 5], [7, 1 << 41]], np.int64)
    n, sums = 10**6, [(1 << 40) + 7, (1 << 41) + 5]
    assert whitening.deviations(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(np.array([[3, 4]], np.int64), 2, [5, 5]) == [1 + 9]


@given
def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = queries.op13_whitening(spark, SF)
    assert dict(found.dtypes)["deviation"] == "bigint"
    check_whitening(found.collect(), [i for i, _ in rows], [v for _, v in rows], 16)
