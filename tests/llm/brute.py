"""Plain Python forms of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(sets: dict, percent: int) -> dict:
    """Smallest name reachable over links between sets that share ``percent`` in a hundred."""
    parent, shared, holders = {d: d for d in sets}, Counter(), defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for name, items in sets.items():
        for item in items:
            holders[item].append(name)
    for names in holders.values():
        for i, b in enumerate(names):
            for a in names[:i]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in sets}


def shingles(text, width: int) -> frozenset:
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(words)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def removed(texts: list, length: int) -> list:
    """``n_bytes, n_removed, n_spans, kept_sha256`` of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def without_boilerplate(rows: list, sites: int) -> dict:
    """Text left of each ``(doc_id, text, source)`` with ids that differ; lines of ``sites`` sources stay in the first only."""
    spread, first = defaultdict(set), {}
    for name, text, source in rows:
        for line in (text or "").split("\n"):
            if line.strip(" "):
                spread[line].add(source)
                first[line] = min(name, first.get(line, name))
    common = {line for line, where in spread.items() if len(where - {None}) >= sites}
    return {
        name: None if text is None else "\n".join(x for x in text.split("\n") if x not in common or first[x] == name)
        for name, text, _ in rows
    }


def copies(rows: list, weights=(5, 2, 1), share=1.5, cap=2.0) -> tuple[dict, dict]:
    """Times each ``(doc_id, text, source)`` is taken, and the target of each source."""
    sizes = {name: len(WORD.findall(text or "")) for name, text, _ in rows}
    totals = Counter()
    for name, _, source in rows:
        totals[source] += sizes[name]
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, level = set(), 0.0
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            break
        level = (share * sum(totals.values()) - sum(cap * totals[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if cap * totals[s] < weight[s] * level}
        if not over:
            break
        capped |= over
    target = {s: min(cap * totals[s], weight[s] * level) for s in order}
    taken = {}
    for name, text, source in rows:
        rate = target[source] / totals[source] if totals[source] else 0.0
        key = str(name) if name is not None else hashlib.md5((text or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"0:{key}".encode()).hexdigest()[:13], 16) / 2**52
        taken[name] = int(rate) + (draw < rate - int(rate))
    return taken, target
