"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def substrings(docs, length=400):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)}; ids are unique."""
    texts = {d: (t or "").encode() for d, t in docs}
    count = collections.Counter(t[p : p + length] for t in texts.values() for p in range(len(t) - length + 1))
    out = {}
    for d, t in texts.items():
        mark = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if mark[i] and (i == 0 or not mark[i - 1]))
        out[d] = (len(t), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(t, mark, strict=True) if not m)).hexdigest())
    return out


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components(docs):
    """{doc_id: (n_shingles, component_id)} by all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def measures(text):
    words = WORD.findall(text or "")
    grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def quality(docs, least_docs=50, share=0.05, most_docs=10_000):
    """{doc_id: (kept, cleaned text)}; docs: (doc_id, text, host)."""
    fold = lambda line: re.sub("[0-9]", "0", line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER))
    holders, hosts = collections.defaultdict(set), collections.defaultdict(set)
    for _, text, host in docs:
        hosts[host].add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders[host, fold(line)].add(text or "")
    out = {}
    for d, text, host in docs:
        limit = min(most_docs, max(least_docs, share * len(hosts[host])))
        lines = [(line, bool(WORD.search(line)) and len(holders[host, fold(line)]) > limit) for line in (text or "").split("\n")]
        n_words, *_, repeated = measures(text)
        left = sum(len(WORD.findall(line)) for line, gone in lines if not gone)
        failed = n_words < 10 or 100 * repeated > 20 * n_words
        out[d] = (not failed and left >= 10 and left >= 0.3 * n_words, "\n".join(line for line, gone in lines if not gone) if any(g for _, g in lines) else text)
    return out


def units(line, words=12):
    return line.split(" ") if line.count(" ") >= words - 1 else list(line)


def lines_removed(docs, edits=2, least=20):
    """{doc_id: (exact, near)} for documents with such lines. Lines of twelve words or more are compared by words."""
    places = [(d, i, line) for d, t in sorted(docs) for i, line in enumerate((t or "").split("\n")) if len(line) >= least]
    first = {}
    for d, i, line in places:
        first.setdefault(line, (d, i))
    ordered, near = sorted(first, key=first.get), set()
    parts = [(line.count(" ") >= 11, units(line), collections.Counter(units(line))) for line in ordered]
    for k, (kind, own, bag) in enumerate(parts):
        for other_kind, other, other_bag in parts[:k]:
            if kind == other_kind and abs(len(own) - len(other)) <= edits and sum((bag - other_bag).values()) <= edits and levenshtein(own, other) <= edits:
                near.add(ordered[k])
                break
    out = {}
    for d, i, line in places:
        if first[line] != (d, i):
            out.setdefault(d, ([], []))[0].append(i)
        elif line in near:
            out.setdefault(d, ([], []))[1].append(i)
    return out


def tiled(item, text, least=5):
    """Words of item under greedy tiles, by trying every pair of places."""
    in_item, in_text, total = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not in_item[i + n] and not in_text[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        in_item[i : i + n] = in_text[j : j + n] = [True] * n
        total += n


PLAIN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def contaminated(text, items):
    words = PLAIN.findall((text or "").lower())
    grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    for item in items:
        other = PLAIN.findall((item or "").lower())
        if any(tuple(other[k : k + 5]) in grams for k in range(len(other) - 4)) and tiled(other, words) >= 0.5 * len(other):
            return True
    return False


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def personal(text):
    """The rules' spans, joined."""
    luhn = lambda d: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
    out = []
    for order, (kind, pattern) in enumerate(RULES):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))
