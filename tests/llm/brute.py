"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def contamination(docs, items, size=13):
    """docs, items: (id, text) pairs -> list of (doc_id, n_words, n_hit, n_items, sha, contaminated)."""
    windows = defaultdict(set)
    for item, text in items:
        words = TERM.findall(low(text or ""))
        if words:
            for s in range(max(len(words) - size, 0) + 1):
                windows[tuple(words[s : s + size])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = TERM.findall(low(text or ""))
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(words) - n + 1):
                w = tuple(words[s : s + n])
                if w in windows:
                    hit.update(range(s, s + n))
                    found |= windows[w]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def statistics(text, window=8):
    words = BLANK.findall(text or "")
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    grams = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    hit = set()
    for i in range(len(words) - window + 1):
        if grams[tuple(words[i : i + window])] > 1:
            hit.update(range(i, i + window))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def removed_lines(docs, threshold=0.8, least=5):
    """{(doc_id, line_no)} that equal or resemble an earlier line; docs have distinct ids."""
    lines = sorted((doc, i, line) for doc, text in docs for i, line in enumerate((text or "").split("\n")) if len(set(BLANK.findall(line))) and len(set(BLANK.findall(low(line)))) >= least)
    sets = {}
    for _, _, line in lines:
        sets.setdefault(line, frozenset(BLANK.findall(low(line))))
    gone, by_word, order, fate = set(), defaultdict(list), [], {}
    for doc, i, line in lines:
        if line in fate:
            gone.add((doc, i))
            continue
        mine = sets[line]
        counts = Counter(j for w in mine for j in by_word[w])
        match = any(1000 * c >= round(threshold * 1000) * (len(mine) + len(order[j]) - c) for j, c in counts.items())
        fate[line] = match
        if match:
            gone.add((doc, i))
        for w in mine:
            by_word[w].append(len(order))
        order.append(mine)
    return gone


def shingles(text):
    words = BLANK.findall(low(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(docs):
    """[(doc_id, n_shingles, component_id)] in the order of docs."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        counts = Counter(j for x in s for j in holders[x])
        for j, c in counts.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                parent[root(i)] = root(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(docs)]


def in_fold(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def nearly(a, b):
    return math.isclose(a, b, abs_tol=1e-9)
