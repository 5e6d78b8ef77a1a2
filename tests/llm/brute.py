"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def roots(nodes, links):
    """The least node reachable from each."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, words=2):
    found = WORD.findall((text or "").translate(UPPER))
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def near_duplicates(docs, words=2, percent=80):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {i: shingle_set(t, words) for i, t in docs}
    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 100 * len(sets[a]) < percent * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    root = roots(sets, links)
    return {i: (len(sets[i]), root[i]) for i in sets}


def line_key(line):
    return line.strip(" \t\n\v\f\r").translate(UPPER)


def dedup_lines(docs):
    """{doc_id: (n_lines, n_dropped, text)}"""
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 20:
                holders[line_key(line)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [
            line for line in lines
            if len(holders.get(line_key(line), ())) < 3 or max(holders[line_key(line)]) == i
        ]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def remove_repeats(docs, length=35):
    """[(n_words, n_removed, text)] in the order of the documents."""
    words = [WORD.findall(t or "") for _, t in docs]
    windows = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if windows[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), " ".join(kept)))
    return out


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(triples), set()
    for i, t in enumerate(triples):
        if count[t] > 1:
            covered |= {i, i + 1, i + 2}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    )


def targets(sizes, weights=(3, 1, 2)):
    """{source: target} by sharing the excess again until none is above."""
    sources = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in sources if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if share * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else share * weight[s] for s in sources}
        full |= set(over)
