"""Plain versions of the contracts, one row at a time, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def pii(text: str | None) -> tuple[list[int], str]:
    """Counts by kind and the base spans spelled out."""
    text, counts, spans = text or "", [], []
    for k, (kind, pattern, ok) in enumerate(PII):
        own = [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
        counts.append(len(own))
        spans += own
    return counts, ",".join(f"{PII[k][0]}:{a}:{b}" for a, k, b in sorted(spans))


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    marked = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), failed


def decontaminated(texts: list[str | None], items: list[tuple[object, str | None]], n: int = 10) -> list[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        words = PLAIN.findall(lower(text or ""))
        k = min(n, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            windows[tuple(words[i : i + k])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        words, hit, found = PLAIN.findall(lower(text or "")), set(), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                if own := windows.get(tuple(words[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= own
        out.append((len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def repeats_removed(rows: list[tuple[int, str | None]], n: int = 13) -> dict[int, tuple]:
    first: dict[tuple, int] = {}
    words = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), d)
    out = {}
    for d, own in words.items():
        gone = {j for i in range(len(own) - n + 1) if first[tuple(own[i : i + n])] < d for j in range(i, i + n)}
        out[d] = (len(own), len(gone), sha(" ".join(w for j, w in enumerate(own) if j not in gone)))
    return out


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if len(words) < 3:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2))


def components(rows: list[tuple[int, str | None]], percent: int = 90) -> dict[int, tuple[int, int, int]]:
    """Set size, component and number of other linked sets of each document."""
    sets = {d: shingles(t) for d, t in rows}
    partners = defaultdict(set)
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    seen = set()
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        if sets[a] != sets[b]:
                            partners[a].add(sets[b])
                            partners[b].add(sets[a])
                        x, y = sorted((root(a), root(b)))
                        up[y] = x
    return {d: (len(s), root(d), len(partners[d])) for d, s in sets.items()}
