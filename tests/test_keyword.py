"""The keyword analyzer and its three limits against a loop over the files."""

from __future__ import annotations

import random

from tracelake.operators import keyword
from tracelake.operators.search import Term

TERMS = (Term("a", "ab"), Term("a", "b"), Term("b", "abc"), Term("b", "c", True))


def in_order(text):
    low, out = text.lower(), []
    for t in TERMS:
        for i in range(len(low) - len(t.text) + 1):
            if low[i : i + len(t.text)] == t.text:
                around = low[i - 1 : i] if i else "", low[i + len(t.text) : i + len(t.text) + 1]
                if not t.whole_word or not any(c.isalnum() or c == "_" for c in around):
                    out.append((t.category, t.text, i, i + len(t.text)))
    return sorted(out, key=lambda h: (h[3], -len(h[1]), h[1]))


def plain(files, most, of_category, of_domain):
    found, warnings, totals = [], set(), {}
    for key, path, text in sorted(f for f in files if f[1] and f[2]):
        if path not in ("Users\\x.txt", "data.LOG"):
            continue
        counts, n = {}, 0
        for h in in_order(text):
            if n == most:
                warnings.add((None, key, f"Gesamt-Treffergrenze {most} erreicht"))
                break
            if counts.get(h[0], 0) == of_category:
                warnings.add((h[0], key, f"Kategorie {h[0]}: Grenze {of_category} erreicht"))
                continue
            counts[h[0]], n = counts.get(h[0], 0) + 1, n + 1
            totals[h[0]] = totals.get(h[0], 0) + 1
            if totals[h[0]] <= of_domain:
                found.append((key, *h[:2], path, *h[2:]))
    return sorted(found), warnings | {(d, None, f"Domäne {d}: globale Grenze {of_domain} erreicht") for d, n in totals.items() if n > of_domain}


def test_limits(spark, tmp_path):
    rnd = random.Random(5)
    paths = ["Users\\x.txt", "data.LOG", "windows\\x.txt", "Users\\appdata\\x.txt", "Users\\AppData\\x.txt", "x.exe", "txt", None]
    files = [(k, rnd.choice(paths[:2]) if k % 2 else rnd.choice(paths), rnd.choice([None, "", "".join(rnd.choice("abcAB c") for _ in range(rnd.randrange(60)))])) for k in range(80)]
    frame = spark.createDataFrame(files, "file_id bigint, path string, text string").repartition(5)
    for k, limits in enumerate([(10**6, 10**6, 10**6), (7, 4, 40), (3, 100, 15), (100, 2, 1)]):
        found, warnings = keyword.keyword_findings(frame, TERMS, str(tmp_path / str(k)), "file_id", *limits)
        wanted, said = plain(files, *limits)
        assert sorted(map(tuple, found.collect())) == wanted and wanted
        assert {tuple(r) for r in warnings.collect()} == said
    found, warnings = keyword.keyword_findings(frame.limit(0), TERMS, str(tmp_path / "none"))
    assert found.collect() == [] and warnings.collect() == []
