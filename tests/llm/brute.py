"""Plain versions of the operators, one text at a time."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(FOLD))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near(docs):
    """doc -> (size of set, component) for rows (doc, text) with distinct docs."""
    sets = {d: shingles(t) for d, t in docs}
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def repeats(docs, length=100):
    """doc -> (bytes, removed, spans, kept bytes) for rows (doc, text) with distinct docs."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone, strict=True) if not g))
    return out


def base_spans(text):
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.ASCII):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, (name, rx, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        found += [(m.start(), kind, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(rx, text or "") if len(m[0]) >= least]
    return [s for _, _, s in sorted(found)]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()
