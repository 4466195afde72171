"""Plain versions of the operators for small tables, written without the library's code."""

import hashlib
import math
import re
from collections import Counter, defaultdict


def noisy_or(text, bias, weights, usual=0.0):
    """1 - prod((1 - p) / (1 - p of a sentence without a telling word)) over sentences; of those below 0.6 what exceeds the usual."""
    silent, sure, weak = 1 / (1 + math.exp(-bias)), 1.0, 1.0
    for sentence in re.split(r"(?<=[.!?])(?![.!?])|\n", text or ""):
        words = {w for w in re.findall(r"[^\W\d_]+", sentence.lower())}
        found = [*words, *(w[:4] + "*" for w in words if len(w) >= 4)]
        if any(f in weights for f in found):
            p = 1 / (1 + math.exp(-bias - sum(weights.get(f, 0.0) for f in found)))
            if p >= 0.6:
                sure *= (1 - p) / (1 - silent)
            else:
                weak *= (1 - p) / (1 - silent)
    return 1 - sure * min(1.0, weak * math.exp(usual * len(re.findall(r"[^.!?\n]+", text or ""))))


def components(rows, percent=80):
    """doc_id -> (set size, smallest doc_id linked)."""
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    holders = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            holders[s].append(i)
    for i in ids:
        shared = Counter(j for s in sets[i] for j in holders[s] if j > i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_boilerplate(rows, ratio, least, most=1.0):
    """doc_id -> text that is left, of rows (doc_id, text, host); doc_ids are distinct. Texts that would lose more than `most` stay."""
    pages, total = defaultdict(set), Counter()
    key = lambda line: line.strip(" \t\r")
    for i, t, host in rows:
        total[host] += 1
        for line in (t or "").split("\n"):
            pages[host, key(line)].add(i)
    stays = lambda host, line: not key(line) or len(pages[host, key(line)]) < least or len(pages[host, key(line)]) <= ratio * total[host]
    left = {i: None if t is None else "\n".join(x for x in t.split("\n") if stays(host, x)) for i, t, host in rows}
    return {i: t if most < 1 and t is not None and len(left[i]) < (1 - most) * len(t) else left[i] for i, t, host in rows}


def fill(given, children):
    """Budgets of siblings name -> (weight, supply): those that can't take their share are filled, the rest share on."""
    out, rest = {}, dict(children)
    while rest:
        total = sum(w for w, _ in rest.values())
        full = [k for k, (w, s) in rest.items() if s * total <= w * given]
        if not full:
            return out | {k: w * given // total for k, (w, _) in rest.items()}
        k = min(full, key=lambda k: (rest[k][1] / rest[k][0], str(k)))
        out[k] = rest.pop(k)[1]
        given -= out[k]
    return out


def mixed(rows, share, weights, seed, epochs=1):
    """doc_id -> tokens taken of it in each epoch, of rows (doc_id, text, leaf) with a leaf of three levels; weights: a mapping a level."""
    size = {i: len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")) for i, t, _ in rows}
    leaves = defaultdict(list)
    for i, _, leaf in rows:
        leaves[leaf].append(i)
    tokens = {leaf: sum(size[i] for i in ids) for leaf, ids in leaves.items()}
    leaves = {leaf: ids for leaf, ids in leaves.items() if tokens[leaf]}
    budgets = {(): math.floor(sum(tokens.values()) * share)}
    for depth, own in enumerate(weights, 1):
        supply = Counter()
        for leaf in leaves:
            supply[leaf[:depth]] += tokens[leaf] * epochs
        budgets = {n: b for up, given in budgets.items() for n, b in fill(given, {n: (own.get(n[-1], 1), s) for n, s in supply.items() if n[:-1] == up}).items()}
    taken = defaultdict(list)
    for leaf, ids in leaves.items():
        whole, part = divmod(budgets[leaf], tokens[leaf])
        for i in ids:
            taken[i] += [size[i]] * whole
        for i in sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{whole}:{i}".encode()).hexdigest()):
            if size[i] > part:
                taken[i] += [part] * (part > 0)
                break
            part -= size[i]
            taken[i].append(size[i])
    return {i: t for i, t in taken.items() if t}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "card":
                doubled = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or doubled % 10:
                    continue
            out.append((kind, m.start(), m.end()))
    return out


def anchors(text, hash_of, k, s):
    """Closed syncmers [(hash, position)]: the distinct hashes below 2^28, or the 128 smallest if that is more, each at its first position."""
    first = {}
    for at in range(len(text) - k + 1):
        inner = [hash_of(text[at + i : at + i + s]) for i in range(k - s + 1)]
        if inner.index(min(inner)) in (0, k - s):
            first.setdefault(hash_of(text[at : at + k]), at)
    found = sorted(first.items())
    return found[: max(128, sum(h < 1 << 28 for h, _ in found))]


def likeness(a, b, kept=128):
    """Of two fingerprints [(hash, position)], by trying all chains of matching anchors."""
    if not a or not b:
        return float(not a and not b)
    limit = min([max(x[-1][0], (1 << 28) - 1) for x in (a, b) if len(x) >= kept] or [max(a[-1][0], b[-1][0])])
    of_a, of_b = ({h: p for h, p in x if h <= limit} for x in (a, b))
    places = [of_b[h] for h in sorted(of_a.keys() & of_b.keys(), key=lambda h: (of_a[h], h))]
    best = []
    for k, p in enumerate(places):
        best.append(1 + max([best[j] for j in range(k) if places[j] < p], default=0))
    same = max(best, default=0) / len(of_a.keys() | of_b.keys())
    return 2 * same / (1 + same)
