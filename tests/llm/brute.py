"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import collections
import functools
import hashlib
import html.parser
import math
import re

import numpy as np

from tracelake.llm import textbytes

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACES = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows, min_chars=40, min_docs=5):
    held = collections.defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                key = x.strip(SPACES).translate(LOWER)
                if len(key) >= min_chars:
                    held[key].add(i)
    kept_in = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = lines if i is None else [x for x in lines if kept_in.get(x.strip(SPACES).translate(LOWER), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def secrets(text):
    patterns = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    found = [(m.start(), k, m.end(), n) for k, (n, p, g, least) in enumerate(patterns) for m in re.finditer(p, text or "", re.A) if len(m[g]) >= least]
    return [(n, a, z) for a, _, z, n in sorted(found)]


def contamination(rows, items, window=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        if w and i is not None:
            for k in range(max(1, len(w) - window + 1)):
                windows[tuple(w[k : k + window])].add(i)
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= own
        out.append((i, len(w), len(hit), sorted(ids), bool(hit)))
    return out


def shingles(text, length):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < length else (tuple(w[k : k + length]) for k in range(len(w) - length + 1)))


def near_duplicates(rows, length, percent):
    sets, parent = {}, {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, length))
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(shingles(t, length)), None if i is None else find(i)) for i, t in rows), key=str)


@functools.cache
def word_hash(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(textbytes.hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])


def units(text, long_words=60):
    """Sentences as (start, words); over ``long_words`` words they are cut before one word in 4, chosen by hash."""
    ws = [(m.start(), m.group().translate(LOWER)) for m in re.finditer("[^\x20\x09-\x0d]+", text or "")]
    whole = []
    for i, (a, w) in enumerate(ws):
        if i == 0 or re.search(r"[.!?][\"')\]}]?$", ws[i - 1][1]) or "\n" in text[ws[i - 1][0] : a]:
            whole.append([])
        whole[-1].append((a, w))
    out = []
    for s in whole:
        for k, (a, w) in enumerate(s):
            if k == 0 or (len(s) > long_words and word_hash(w) % 4 == 0):
                out.append((a, []))
            out[-1][1].append(w)
    return out


def sentence_spans(rows, run=2, min_words=20):
    seen, gone = {}, collections.defaultdict(set)
    known = sorted({(i, t or "") for i, t in rows if i is not None})
    for i, t in known:
        u = units(t)
        for a in range(len(u)):
            n = 0
            for z in range(a, len(u)):
                n += len(u[z][1])
                if n >= min_words and z - a + 1 >= run:
                    break
            else:
                continue
            key = tuple(w for x in u[a : z + 1] for w in x[1])
            if key in seen:
                gone[i, t] |= set(range(a, z + 1))
            seen.setdefault(key, i)
    out = []
    for i, t in rows:
        t, u = t or "", units(t)
        b = [x[0] for x in u] + [len(t)]
        lost = gone[i, t]
        out.append((i, len(u), len(lost), (t[: b[0]] + "".join(t[b[k] : b[k + 1]] for k in range(len(u)) if k not in lost)) if lost else t))
    return out


def byte_labels(net, raw, window, context):
    """The mean label probabilities over the bytes of a text, one step at a time."""
    squash = lambda x: (y := np.clip(x, -3, 3)) * (y * y + 27) / (9 * y * y + 27)
    size = net.states.shape[1]

    def states(d, begin, end):
        h, out, steps = np.zeros(size), {}, range(begin, end) if d == 0 else range(end - 1, begin - 1, -1)
        for t in steps:
            a, u = net.inputs[d][raw[t]].astype(float), h @ net.states[d]
            z, r = (squash((a[k : k + size] + u[k : k + size]) / 2) / 2 + 0.5 for k in (0, size))
            h = h + z * (squash(a[2 * size :] + r * u[2 * size :]) - h)
            out[t] = h
        return out

    total = np.zeros(len(net.bias))
    for start in range(0, len(raw), window):
        end = min(start + window, len(raw))
        forwards, backwards = states(0, max(0, start - context), end), states(1, start, min(len(raw), start + window + context))
        for t in range(start, end):
            e = np.exp(np.concatenate([forwards[t], backwards[t]]) @ net.out + net.bias)
            total += e / e.sum()
    return total / max(1, len(raw))


def entropy_spans(text, allow, classes, base):
    """Every window's entropy from its own counts; ``classes`` are (alphabet, window, bits), the widest last; ``base`` the spans already reported."""
    entropy = lambda w: -sum(n / len(w) * math.log2(n / len(w)) for n in collections.Counter(w).values())
    marked, out = set(), []
    for run in re.finditer("[" + re.escape(classes[-1][0]) + "]+", text or ""):
        if re.fullmatch(allow, run[0]):
            continue
        spans = []
        for alphabet, window, bits in classes:
            for m in re.finditer("[" + re.escape(alphabet) + "]+", run[0]):
                if not re.fullmatch(allow, m[0]):
                    spans += [(run.start() + m.start() + k, run.start() + m.start() + k + window) for k in range(len(m[0]) - window + 1) if entropy(m[0][k : k + window]) >= bits - 1e-9]
        marked = sorted(p for p in {p for a, z in spans for p in range(a, z)})
        for p in marked:
            if out and out[-1][1] == p and out[-1][2] == run.start():
                out[-1] = (out[-1][0], p + 1, run.start())
            else:
                out.append((p, p + 1, run.start()))
    return [(a, z) for a, z, _ in out if not any(p <= a and z <= q for _, p, q in base)]


class _Page(html.parser.HTMLParser):
    """A page by the standard library's parser: title, language, links and text."""

    def __init__(self, breaks, links):
        super().__init__(convert_charrefs=True)
        self.breaks, self.link_tags, self.text, self.links, self.title, self.lang, self.inside, self.titling = breaks, links, [], [], None, None, [], False

    def handle_starttag(self, tag, attrs):
        if tag in self.link_tags:
            for n, v in attrs:
                if n in ("href", "src"):
                    self.links.append(f"{v or ''} {tag}/{n}")
                    break
        if tag == "html" and self.lang is None:
            self.lang = dict(attrs).get("lang")
        if tag == "title" and self.title is None:
            self.titling = True
            self.title = ""
        if tag in ("script", "style", "noscript", "template", "head"):
            self.inside.append(tag)
            if len(self.inside) == 1:
                self.text.append(" ")
        if tag in self.breaks and not self.inside:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.titling = False
        if self.inside and self.inside[0] == tag:
            self.inside = []
        elif tag in self.breaks and not self.inside:
            self.text.append("\n")

    def handle_comment(self, data):
        if not self.inside:
            self.text.append(" ")

    def handle_data(self, data):
        if self.titling:
            self.title += data
        if not self.inside:
            self.text.append(data)


def page(source, breaks, links):
    """Title, language, links and lines of a page."""
    p = _Page(breaks, links)
    p.feed(source)
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.text).split("\n")]
    return (None if p.title is None else " ".join(p.title.split())), p.lang, p.links, [x for x in lines if x]
