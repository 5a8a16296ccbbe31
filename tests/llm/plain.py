"""Brute-force versions of the operators, in plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def base_numbers(text: str | None) -> dict:
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dup, "n_repeat_words": len(hit)}
    return out | {"base_failed": len(w) < 10 or 100 * len(hit) > 20 * len(w)}


def repeats(w: list[str], least: int) -> tuple[set[int], int]:
    """Words in runs of ``least`` or more that occur twice, and the longest run, by comparing all pairs of places."""
    n, hit, longest = len(w), set(), 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                hit |= {*range(i, i + k), *range(j, j + k)}
    return hit, longest


def shingles(text: str | None, size: int) -> frozenset:
    w = words(lower(text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def groups(docs: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            at[x].append(d)
    for a in sorted(sets):
        shared = Counter(b for x in sets[a] for b in at[x] if b > a)
        for b, n in shared.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def removed(docs: list[tuple[int, str | None]], window: int) -> dict[int, tuple[list[str], set[int]]]:
    first = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, t in docs:
        w = words(t)
        out[d] = w, {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < (d, i) for k in range(window)}
    return out


def simhash(text: str | None, size: int) -> int:
    w = words(lower(text or ""))
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_prints(prints: list[tuple[int, int]], distance: int) -> dict[int, int]:
    """The least id that each id reaches, by comparing all pairs of fingerprints."""
    parent = {d: d for d, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, p) in enumerate(prints):
        for b, q in prints[:i]:
            if (p ^ q).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in parent}


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def node(children: list[str]) -> str:
    return sha("".join(children))


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """(root, for each leaf the siblings to its left and to its right, level by level)."""
    steps = [[] for _ in leaves]
    level, below = list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        runs = [range(a, min(a + 8, len(level))) for a in range(0, len(level), 8)]
        for run in runs:
            for k in run:
                for leaf in below[k]:
                    steps[leaf].append(([level[x] for x in run if x < k], [level[x] for x in run if x > k]))
        level, below = [node([level[k] for k in run]) for run in runs], [[x for k in run for x in below[k]] for run in runs]
    return (level[0] if level else "", steps)


def manifest(docs: list[dict]) -> list[tuple]:
    """Result rows for documents with distinct digests or equal ones side by side."""
    out = []

    def leaf(d: dict) -> str:
        return sha("".join(field(d[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))

    langs = sorted({d["lang"] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        rows = sorted((d for d in docs if d["lang"] == lang), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d)))
        trees.append((rows, *tree([leaf(d) for d in rows])))
    top, above = tree([t[1] for t in trees])
    for (rows, subroot, steps), over in zip(trees, above, strict=True):
        for d, own in zip(rows, steps, strict=True):
            changed = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0
            h = leaf(d | {"text": d["text"] and lower(d["text"])}) if changed else leaf(d)
            for left, right in own + over:
                h = node([*left, h, *right])
            out.append((d["doc_id"], leaf(d), subroot, top, sha("".join(x for left, right in own + over for x in left + right)), h, h == top))
    return out


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(docs: list[tuple[str | None, str | None, str | None]], least: int = 3, top: int = 200) -> set[tuple]:
    """Result rows for (lang, source, text) of each document."""
    docs = [tuple(x or "" for x in d) for d in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        seen, counts = Counter(), defaultdict(Counter)
        for _, source, text in (d for d in docs if d[0] == lang):
            terms = [lower(t) for t in TERM.findall(text)]
            seen.update(set(terms))
            counts[source].update(terms)
        kept = {t for t, n in seen.items() if n >= least}
        v, sizes = len(kept), {s: sum(n for t, n in c.items() if t in kept) for s, c in counts.items()}
        p = {s: {t: 1 + 10**9 * (counts[s][t] + 1) // (sizes[s] + v) for t in kept} for s in counts}
        q = {t: 1 + 10**9 * (sum(c[t] for c in counts.values()) + 1) // (sum(sizes.values()) + v) for t in kept}
        for s in counts:
            pairs = [("pair", b, sum((p[s][t] - p[b][t]) ** 2 // p[b][t] for t in kept)) for b in counts if b != s]
            terms = [("term", t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for rows in (pairs, terms):
                ranked = sorted(rows, key=lambda x: (-x[2], x[1].encode()))
                out |= {(lang, s, *x, i + 1) for i, x in enumerate(ranked) if x[0] == "pair" or i < top}
    return out
