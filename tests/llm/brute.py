"""Plain versions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def near(rows, threshold=75):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text); all pairs that share a shingle are compared."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(UPPER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    have = {}
    for i, s in sets.items():
        for x in s:
            have.setdefault(x, []).append(i)
    seen, parent = set(), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for ids in have.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def lines(rows, least_chars=40, least_docs=5):
    """{doc_id: (n_lines, n_dropped, sha)}"""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if len(h := holders.get(key(x), ())) < least_docs or max(h) == i]
        out[i] = (len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def passages(rows, window=50):
    """{doc_id: (n_words, n_removed, sha)}"""
    owner, texts = {}, {i: WORD.findall(text or "") for i, text in rows}
    for i, w in texts.items():
        for k in range(len(w) - window + 1):
            t = tuple(w[k : k + window])
            owner[t] = min(owner.get(t, i), i)
    out = {}
    for i, w in texts.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if owner[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


KINDS = {
    "assign": (re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def secrets(rows):
    """{doc_id: (n_assign, n_access, n_hex, base_sha)}"""
    out = {}
    for i, text in rows:
        spans, counts = [], []
        for k, (pattern, group, least) in enumerate(KINDS.values()):
            found = [m.span() for m in pattern.finditer(text or "") if len(m[group]) >= least]
            counts.append(len(found))
            spans += [(a, k, b) for a, b in found]
        names = list(KINDS)
        told = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
        out[i] = (*counts, hashlib.sha256(told.encode()).hexdigest())
    return out


def language_vectors(texts, letter):
    """Of each text the bundle of its trigrams' vectors; letter gives a code point's vector of +1 and -1 (0: a gap)."""
    import numpy as np

    out = []
    for text in texts:
        codes = [0]
        for c in text:
            codes.append(ord(c.lower()[0]) if c.isalpha() else 0)
        codes.append(0)
        codes = [c for i, c in enumerate(codes) if c or not i or codes[i - 1]]
        total = 0
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            if b:
                total = total + np.roll(letter(a), 128) * np.roll(letter(b), 64) * letter(c)
        out.append(total)
    return out
