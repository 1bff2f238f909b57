"""Small tables and plain versions of the contracts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=3, n=60):
    """Rows with copies, near copies, shared passages, nulls, blanks, repeated rows and one long text."""
    rng = random.Random(seed)
    shared = prose(rng, 70, 9000)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randrange(1, 220), 9000)
        if i % 5 == 0:
            at = rng.randrange(len(words))
            words[at:at] = shared[rng.randrange(10):]
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 0))
    base = prose(rng, 150, 9000)
    for i in range(n, n + 12):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "x"
        rows.append((i, "  ".join(words) + "\n", "fr", "a", 0))
    rows += [(n + 20 + k, rows[k][1], "en", "b", 0) for k in (3, 3, 10, 25)]
    rows += [(n + 30, None, None, None, None), (n + 31, "", "en", "a", 0), (n + 32, " \t\n", "en", "a", 3)]
    rows += [(None, rows[10][1], "en", "a", 0), (None, "only here " * 3, "zz", None, 0), rows[10], rows[10]]
    rows += [(n + 40, " ".join(prose(rng, 30_000, 20_000)), "en", "c", 0), (n + 41, "ÅÄÖ ſecret K É one", "es", "c", 0)]
    return rows


def words(text):
    return SPACE_WORD.findall(text or "")


def shingle_set(text):
    w = [x.translate(ASCII_LOWER) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_duplicates(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) as often as rows; rows of one id are one document."""
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by_id = {}
    for i, r in enumerate(rows):
        if r[0] is not None and sets[i] and by_id.setdefault(r[0], i) != i:
            parent[find(i)] = find(by_id[r[0]])
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        least = (min(known) if known else None) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return out


def without_repeats(rows, window=50):
    """(doc_id, n_words, n_removed, kept words joined)."""
    last = float("inf")
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, last), last if r[0] is None else r[0])
    out = []
    for r in rows:
        w, own, gone = words(r[1]), last if r[0] is None else r[0], set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < own:
                gone.update(range(i, i + window))
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def benchmark_hits(rows, items, window=13):
    """(doc_id, n_words, n_hit, sorted item ids, contaminated)."""
    def low(t):
        return BENCH_WORD.findall((t or "").translate(ASCII_LOWER))

    wanted = defaultdict(set)
    for name, text in items:
        w = low(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            wanted[tuple(w[i : i + m])].add(str(name))
    out = []
    for r in rows:
        w, hit, found = low(r[1]), set(), set()
        for m in {len(k) for k in wanted}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in wanted:
                    hit.update(range(i, i + m))
                    found |= wanted[tuple(w[i : i + m])]
        out.append((r[0], len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def rule_counts(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, list) else (False, "", str(x)) for x in r))
