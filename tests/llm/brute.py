"""Plain Python versions of what the operators compute."""

import hashlib
import math
import random
import re
from collections import Counter

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa", "ti", "vo") for b in ("ban", "den", "fis", "gol", "hum", "jar", "kel", "lim")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def hits(text, items, window=13):
    words, found = ALNUM.findall(lower(text)), set()
    hit = [False] * len(words)
    for item_id, item in items:
        w = ALNUM.findall(lower(item))
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else []:
            if tuple(words[i : i + n]) in grams:
                hit[i : i + n] = [True] * n
                found.add(str(item_id))
    return len(words), sum(hit), sorted(found)


def fingerprint(text, shingle=4):
    w = SPACED.findall(lower(text))
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows, distance=4):
    """{id: least id of its class}."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    label = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= distance and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def cut(rows, window=50):
    """{id: (words, removed, kept text)}; ids in any order."""
    first = {}
    for i, t in rows:
        w = SPACED.findall(t or "")
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out[i] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)
    return out


def unit(seed, *parts):
    text = "|".join([str(seed), *("" if p is None else str(p) for p in parts)])
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def copies(rows, weights, default=1.0, size=1.0, seed=17):
    """{(id, copy)} of rows (id, source)."""
    n = Counter(s for _, s in rows)
    total = sum(weights.get(s, default) for s in n)
    out = set()
    for i, s in rows:
        rate = weights.get(s, default) / total * size * len(rows) / n[s]
        u, k, p = unit(seed, i), 0, math.exp(-rate)
        cdf = p
        while cdf <= u and k < 1000:
            k += 1
            p = p * rate / k
            cdf += p
        out |= {(i, c) for c in range(1, k + 1)}
    return out


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = SPACED.findall(text)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(triples)
    hit = {i + k for i, t in enumerate(triples) if n[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)
