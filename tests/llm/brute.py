"""Straightforward versions of the operators, for a few hundred documents."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().lower().split()


def shingles(own, n=5):
    return [tuple(own[i : i + n]) for i in range(len(own) - n + 1)] if len(own) >= n else [tuple(own)] if own else []


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def near_components(docs):
    """doc_id -> (set size, component) for unique ids."""
    sets = {i: set(shingles(words(t))) for i, t in docs}
    of, parent = defaultdict(list), {i: i for i in sets}
    for i, own in sets.items():
        for s in own:
            of[s].append(i)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in sets.items():
        for j, both in Counter(j for s in own for j in of[s] if j < i).items():
            if 100 * both >= 75 * (len(own) + len(sets[j]) - both):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def without_repeats(docs, width=13):
    """doc_id -> (words, removed, digest) for unique ids; null comes last."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    first, out = {}, {}
    for i, text in order:
        own = (text or "").encode().split()
        for j in range(len(own) - width + 1):
            first.setdefault(tuple(own[j : j + width]), i)
    for i, text in order:
        own = (text or "").encode().split()
        gone = [False] * len(own)
        for j in range(len(own) - width + 1):
            if first[tuple(own[j : j + width])] != i:
                gone[j : j + width] = [True] * width
        kept = b" ".join(w for w, g in zip(own, gone) if not g)
        out[i] = (len(own), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def contaminated(docs, items):
    """(doc_id, item_id) -> largest similarity of a window, from 0.75; items below five words occur or not."""
    bags = {i: Counter(shingles(t.lower().split())) for i, t in items if t and len(t.split()) >= 5}
    short = {i: t.lower().split() for i, t in items if t and 1 <= len(t.split()) < 5}
    out = {}
    for d, text in docs:
        plain = (text or "").lower().split()
        for i, item in short.items():
            if any(plain[k : k + len(item)] == item for k in range(len(plain) - len(item) + 1)):
                out[d, i] = 1.0
        own = shingles(plain)
        for i, bag in bags.items():
            size = sum(bag.values())
            if not size or not bag.keys() & set(own):
                continue
            best = 0
            for start in range(max(1, len(own) - size + 1)):
                window = Counter(own[start : start + size])
                both = sum((window & bag).values())
                best = max(best, both / (sum(window.values()) + size - both))
            if best >= 0.75:
                out[d, i] = best
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out
