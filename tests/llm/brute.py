"""What the pipeline's stages should give, in plain Python that shares no code with the operators."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def order(i):
    return -(1 << 63) if i is None else i


def good(text):
    """Quality rules: n_words < 50, repeats of three words, repeats of ten words over 30 %, or one repeat over 100 words."""
    w = WORD.findall(text or "")
    n = len(w)
    if n < 50:
        return False

    def cover(k):
        seen = Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        return {p for i in range(n - k + 1) if seen[tuple(w[i : i + k])] > 1 for p in range(i, i + k)}

    return 100 * len(cover(3)) <= 50 * n and len(cover(10)) <= 0.3 * n and not cover(101)


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def without_shared_lines(rows):
    """rows of (doc_id, text, ...): the texts after line dedup."""
    holders = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(line_key(x)) >= 40:
                holders.setdefault(line_key(x), set()).add(order(i))
    lost = lambda i, x: len(holders.get(line_key(x), ())) >= 5 and max(holders[line_key(x)]) != order(i)
    return ["\n".join(x for x in (t or "").split("\n") if not lost(i, x)) for i, t, *_ in rows]


def shingle_set(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_classes(rows):
    """Class number of each row: connected by five-word shingle sets of similarity 0.8."""
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(rows))]


def one_of_each(rows):
    """The rows that stay: one for the least doc_id (null last) of each class."""
    best = {}
    for c, r in zip(near_classes(rows), rows):
        key = (r[0] is None, r[0] or 0, repr(r))
        if c not in best or key < best[c][0]:
            best[c] = (key, r)
    return [r for _, r in best.values()]


def terms(text):
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", (text or "").lower())


def leaks(rows, items, threshold=0.7, overlap=0.8):
    """(doc_id, text) -> {item_id: (score, share)}: every passage against every item."""
    kept = [(i, terms(t), t) for i, t in items if terms(t)]
    n, mean = len(kept), sum(len(w) for _, w, _ in kept) / max(1, len(kept))
    df = Counter(t for _, w, _ in kept for t in set(w))
    step = max([1, *(len(w) for _, w, _ in kept)])
    impacts, parts = [], []
    for _, w, text in kept:
        gain = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, f in Counter(w).items()}
        impacts.append({t: g / sum(gain.values()) for t, g in gain.items()})
        sentences = [terms(s) for s in re.split(r"(?<=[.?!])\s+|\n+", text) if terms(s)]
        parts.append([sum(sentences[:-1], []), sentences[-1]] if len(sentences) > 1 else sentences)

    def share(part, passage):
        k = min(5, len(part))
        want = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}
        return len(want & {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}) / len(want)

    out = {}
    for i, text, *_ in rows:
        w = terms(text)
        got = {}
        start = 0
        while True:
            passage = w[start : start + 2 * step]
            have = set(passage)
            for (item, _, _), gain, two in zip(kept, impacts, parts):
                score = sum(g for t, g in gain.items() if t in have)
                if score >= threshold - 1e-9 and (least := min(share(p, passage) for p in two)) >= overlap - 1e-9:
                    got[item] = max(got.get(item, (0, 0)), (score, least))
            if start + 2 * step >= len(w):
                break
            start += step
        if got:
            out[i, text] = got
    return out


def encoded(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    raw, back = b"".join(x.to_bytes(4, "little") for x in ids), tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
