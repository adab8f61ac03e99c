"""Plain-Python statements of what the operators return, for small inputs: lists of (doc_id, text) rows."""

import collections
import hashlib
import math
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=False):
    t = text or ""
    return WORD.findall(t.translate(FOLD) if lower else t)


def removed_lines(rows, least=1):
    """Sets of (doc_id, line) that have an earlier line with a Jaccard index of 0.8 or more."""
    lines = [(d, i, frozenset(words(x))) for d, t in rows if d is not None for i, x in enumerate((t or "").split("\n"))]
    lines = sorted((x for x in lines if len(x[2]) >= least), key=lambda x: x[:2])
    out = set()
    for k, (d, i, w) in enumerate(lines):
        for e, j, v in lines[:k]:
            if (e, j) != (d, i) and 5 * len(w & v) >= 4 * len(w | v):
                out.add((d, i))
                break
    return out


def bytes_removed(text, doc, seen, n=50):
    b = (text or "").encode()
    gone = bytearray(len(b))
    for i in range(len(b) - n + 1):
        if doc is not None and seen[b[i : i + n]] < doc:
            gone[i : i + n] = b"\1" * n
    kept = bytes(x for x, g in zip(b, gone) if not g)
    return len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


def first_bytes(rows, n=50):
    seen = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - n + 1):
                seen[b[i : i + n]] = min(d, seen.get(b[i : i + n], d))
    return seen


def first_windows(rows, n=13):
    seen = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            for i in range(len(w) - n + 1):
                seen[tuple(w[i : i + n])] = min(d, seen.get(tuple(w[i : i + n]), d))
    return seen


def words_removed(text, doc, seen, n=13):
    w = words(text)
    gone = [False] * len(w)
    for i in range(len(w) - n + 1):
        if doc is not None and seen[tuple(w[i : i + n])] < doc:
            gone[i : i + n] = [True] * n
    kept = [x for x, g in zip(w, gone) if not g]
    return len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()


def shingles(text, k=5):
    w = words(text, True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, num, den, k=5):
    """doc_id -> least doc_id linked to it."""
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(d), root(e)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d, _ in sets}


def base_quality(text):
    w = words(text)
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = sum(hit)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)


def base_scores(rows, train):
    """Per row (n_tokens, n_known, train_tokens, base score)."""
    count = collections.Counter()
    for _, t in train:
        count.update([*words(t, True), None])
    n, v, out = sum(count.values()), len(count), []
    for _, t in rows:
        w = [*words(t, True), None]
        out.append((len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out


def raked(cells, powers, rounds=100, tolerance=1e-9):
    """cells: {(source, lang, topic): tokens} -> their fitted shares, margin after margin."""
    total = sum(cells.values())
    x = {k: v / total for k, v in cells.items()}
    target = []
    for m, power in enumerate(powers):
        share = collections.defaultdict(float)
        for k, v in x.items():
            share[k[m]] += v
        lifted = {k: v**power if v > 0 else 0.0 for k, v in share.items()}
        target.append({k: v / sum(lifted.values()) for k, v in lifted.items()})
    for _ in range(rounds):
        worst = 0.0
        for m in range(len(powers)):
            now = collections.defaultdict(float)
            for k, v in x.items():
                now[k[m]] += v
            worst = max(worst, *(abs(now[k] - t) for k, t in target[m].items()))
            x = {k: v * target[m][k[m]] / now[k[m]] if now[k[m]] > 0 else 0.0 for k, v in x.items()}
        if worst < tolerance:
            break
    total = sum(x.values())
    return {k: v / total for k, v in x.items()}


def scaled(tokens, weights, budget):
    """c with sum(t * min(1, c * w)) = budget, by halving an interval."""
    low, high = 0.0, 1.0
    taken = lambda c: sum(t * min(1.0, c * w) for t, w in zip(tokens, weights))
    while taken(high) < budget and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if taken(mid) < budget else (low, mid)
    return high


def paths(text, code, length):
    """(preceding symbols, path so far with a leading one, depth, decision) of every binary decision of a text."""
    sym = [max(b, 1) for b in (text or "").translate(FOLD).encode()] + [0]
    for i, s in enumerate(sym):
        before = [sym[i - j] if i - j >= 0 else 0 for j in range(1, 7)]
        n, c = int(length[before[0], s]), int(code[before[0], s])
        for d in range(n):
            yield before, (c >> (n - d)) | (1 << d) if d else 1, d, (c >> (n - d - 1)) & 1


def slot(before, node, order, bits):
    """Where a predictor counts: a hash of the preceding symbols and the path, in 32 bits."""
    m = 0xFFFFFFFF
    h = ((before[0] + 1) * 0x85EBCA6B) & m
    for j in range(1, order):
        h = (((h ^ (h >> 13)) + before[j] + 1) * 0xC2B2AE35) & m
    k = ((h ^ (h >> 16)) * 0x27D4EB2F) & m
    k ^= k >> 15
    p = (node * 0x9E3779B1) & m
    p ^= p >> 15
    return (k ^ (p & 0x0FFFFFFF)), p & 0x0FFFFFFF


ALNUM = re.compile(r"(?:[0-9A-Za-z\x80-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+")


def template(text, view, units):
    """[(word, slot value or None)] with typed placeholders; view: 0 names, numbers and units, 1 numbers and units, 2 none."""
    out, end = [], 0
    for m in ALNUM.finditer(text or ""):
        t, gap = m[0], (text or "")[end : m.start()]
        first, end = not out and end == 0, m.end()
        low = t.translate(FOLD)
        prev = out[-1] if out else None
        if view == 2:
            out.append([low, None, False])
        elif t[0].isdigit() and t[0] in "0123456789":
            out.append(["<number>", low, False])
        elif prev and prev[0] == "<number>" and low in units:
            out.append(["<unit>", low, False])
        elif view == 0 and not first and not set(gap) & set('.!?:;\n\r"|>([{') and t[0].isupper():
            if prev[2]:
                prev[1] = tuple(sorted((*prev[1], low)))
            else:
                out.append(["<name>", (low,), True])
        else:
            out.append([low, None, False])
    return [(w, s) for w, s, _ in out]


def leaks(doc, item, units, length=8, shortest=4, enough=6):
    """Whether a document holds an item: windows of templates on one alignment with one value for each slot value."""
    for view in (0, 1, 2):
        d, q = template(doc, view, units), template(item, view, units)
        n = length if len(q) >= length else len(q)
        if n < (1 if view == 2 else shortest):
            continue
        fits = lambda t, i: 2 * sum(s is not None for _, s in t[i : i + n]) <= n
        own = [i for i in range(len(q) - n + 1) if fits(q, i)]
        hits = collections.defaultdict(set)
        for p in range(len(d) - n + 1):
            for i in own:
                if [w for w, _ in d[p : p + n]] == [w for w, _ in q[i : i + n]]:
                    hits[p - i].add(i)
        good = set()
        for shift, starts in hits.items():
            at = sorted({i + k for i in starts for k in range(n) if q[i + k][1] is not None})
            met = collections.defaultdict(collections.Counter)
            for i in at:
                met[q[i][1]][d[i + shift][1]] += 1
            holds = {v: max(c, key=lambda x, c=c, v=v: (c[x], x == v)) for v, c in met.items()}
            bad = {i for i in at if d[i + shift][1] != holds[q[i][1]]}
            good |= {i for i in starts if not any(i + k in bad for k in range(n))}
        if good and len(good) >= min(enough, -(-len(own) // 2)):
            return True
    return False
