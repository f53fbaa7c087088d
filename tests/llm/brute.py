"""Plain versions of the operators, for small tables."""

import re
from collections import Counter
from hashlib import sha256

from lexiforge.llm import pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def repeats(rows, length):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def statistics(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(rows, k, percent=80):
    """id -> (set size, least id reachable)."""
    sets = [(d, shingles(t, k)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    """kind:start:end of the base spans, comma-joined."""
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def sha(text):
    return sha256(text.encode()).hexdigest()


def sainte_lague(claims, seats):
    own = [0] * len(claims)
    for _ in range(seats):
        i = max(range(len(claims)), key=lambda i: (claims[i] / (2 * own[i] + 1), -i))
        own[i] += 1
    return own


KINDS = ("email", "ip", "card", "phone")


def _features(text, a, b):
    hit, before = text[a:b], text[max(0, a - pii.CONTEXT) : a]
    n, groups = sum(c in "0123456789" for c in hit), re.findall("[0-9]+", hit)
    level = sum(n >= x for x in (7, 9, 12, 13, 20))
    last = len(re.search(r"([0-9]*)\Z", hit).group())
    flags = " " in hit, "[" in hit or "(" in hit, "." in hit, "-" in hit, re.search(pii._HINTS, before) is not None
    return (level, min(len(groups), 4), min(last, 5), *map(int, flags))


def _evidence(text, kind, a, b, base):
    hit = text[a:b]
    meets = {k: any(x < b and a < y for x, y in base[k]) for k in KINDS}
    other = any(v for k, v in meets.items() if k != kind)
    if kind == "phone":
        touch = (text[a - 1] if a else "") + (text[b] if b < len(text) else "")
        return True if meets[kind] else False if other or re.search(r"[^\W_]|[_=/#@]", touch) else None
    d = re.sub("[^0-9]", "", hit)
    sound = {"card": 13 <= len(d) <= 19 and luhn(d), "ip": all(int(x) <= 255 for x in re.findall("[0-9]+", hit)), "email": re.search(r"[A-Za-z].*[^A-Za-z0-9-][A-Za-z]{2,24}\Z", hit) is not None}[kind]
    return sound and not other


def all_personal(texts, held):
    """spans of each text, base and chosen ones; ``held`` tells which texts set the thresholds."""
    rows, tables = [], (Counter(), Counter())
    for t, h in zip(texts, held):
        t = t or ""
        base = {k: [] for k in KINDS}
        for x in filter(None, personal(t).split(",")):
            k, a, b = x.split(":")
            base[k].append((int(a), int(b)))
        loose = [(kind, m.start(), m.end()) for kind, _, p in pii.LOOSE for m in re.finditer(p, t)]
        for kind, a, b in loose:
            y = _evidence(t, kind, a, b, base)
            if y is not None:
                tables[h][kind, *_features(t, a, b), y] += 1
        rows.append((t, base, loose))
    cells = []
    for table in tables:
        keys = {k[:-1] for k in table}
        cells.append([(*k, table[*k, True], table[*k, True] + table[*k, False]) for k in keys])
    trees = pii.boost(cells[0])
    margins = pii.calibrated(trees, cells[1])
    out = []
    for t, base, loose in rows:
        for kind, a, b in loose:
            fits = pii.predict(trees, (KINDS.index(kind), *_features(t, a, b))) >= margins[kind]
            if fits and _evidence(t, kind, a, b, {k: [x for x in base[k] if len(x) == 2] for k in KINDS}) in (True, None) and not any(x[0] < b and a < x[1] for x in base[kind]):
                base[kind].append((a, b, "chosen"))
        out.append(",".join(f"{k}:{x[0]}:{x[1]}" for k in KINDS for x in sorted(base[k])))
    return out
