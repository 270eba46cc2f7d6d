"""Pairs of the papers of one subject, counted and ranked without listing them.

Every paper has a highest and a lowest result. Of two papers the pair furthest apart takes the highest of the one whose
product of both is larger and the lowest of the other, for values above zero: with x before y in that order,
``lo(x) / hi(y)`` is the smaller quotient exactly when ``hi(x) * lo(x) < hi(y) * lo(y)``. Equal products tie, and the ids
of the profiles decide; that, too, is an order of the papers. So all pairs of a subject follow from one order: each paper
gives its highest to every earlier one, and counting is a count of earlier papers whose lowest is small enough, by sorts.

Doubles keep the order of quotients of numbers under 2 ** 26. Papers with other values, zero and below included, are met
with every paper one by one.
"""

from __future__ import annotations

from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CONDITIONS = ("model_size", "language", "setting")
VERDICTS = ("GENUINE", "EXPLAINED", "NOT_COMPARABLE")
PLAIN = 1 << 26
SUBJECT = 3  # columns in front


def below(values: np.ndarray, start: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of values[start:end] are under each limit; values and limits from 0. A wavelet matrix, bit by bit."""
    top = int(max(values.max(initial=0), limit.max(initial=0)))
    found = np.zeros(len(start), np.int64)
    for bit in reversed(range(max(1, top.bit_length()))):
        ones = (values >> bit) & 1 == 1
        zeros = np.concatenate((np.zeros(1, np.int32), np.cumsum(~ones, dtype=np.int32)))
        up, a, b = (limit >> bit) & 1 == 1, zeros[start], zeros[end]
        found += np.where(up, b - a, 0)
        start, end = np.where(up, zeros[-1] + start - a, a), np.where(up, zeros[-1] + end - b, b)
        values = np.concatenate((values[~ones], values[ones]))
    return found


def relative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b) / np.maximum(np.maximum(np.abs(a), np.abs(b)), 1)


def reach(hi: np.ndarray, least: float) -> np.ndarray:
    """The largest whole number that lies more than ``least`` below each ``hi``, as doubles have it."""
    t = np.floor(hi * (1 - least)).astype(np.int64) + 2
    for _ in range(5):
        t -= ~((hi - t) / hi > least)
    return t


def ranks(texts: list[pa.Array]) -> list[np.ndarray]:
    """Place of each text in the order of all, equal ones sharing it."""
    places = pc.rank(pa.chunked_array(texts), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    return np.split(places, np.cumsum([len(t) for t in texts])[:-1])


class Papers:
    """The papers of one subject; ``plain`` ones first, in the order in which each gives its highest to earlier ones."""

    def __init__(self, table: pa.Table, least: float) -> None:
        self.least = least
        hi, lo = (table[f"{x}_cents"].to_numpy().astype(np.int64) for x in ("hi", "lo"))
        column = lambda c: table[c].combine_chunks()
        (paper,) = ranks([column("paper_id")])
        hi_id, lo_id = ranks([column("hi_profile_id"), column("lo_profile_id")])
        odd = (lo < 1) | (hi >= PLAIN)
        product_ = np.where(odd, 0, hi) * np.where(odd, 0, lo)
        kind = np.sign(lo_id - hi_id)  # of equal products: 1 gives its highest to later papers, -1 takes theirs
        order = np.lexsort((np.where(kind < 0, paper, -paper), kind, product_, odd))
        self.n, self.n_plain = len(order), int(len(order) - odd.sum())
        self.table, self.order = table, order
        self.hi, self.lo, self.paper, self.hi_id, self.lo_id = hi[order], lo[order], paper[order], hi_id[order], lo_id[order]
        self.codes = []
        for c in CONDITIONS:
            both = pa.chunked_array([column(f"hi_{c}"), column(f"lo_{c}")]).combine_chunks().dictionary_encode()
            codes = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            self.codes.append((codes[: self.n][order], codes[self.n :][order]))
        self.t = reach(self.hi[: self.n_plain], least)

    def subject(self) -> list:
        return [self.table.column(i)[0].as_py() for i in range(SUBJECT)]

    def text(self, column: str, i: int) -> str:
        return self.table[column][int(self.order[i])].as_py()

    def odd_pairs(self):
        """Mined pairs with a paper that is not plain, for one such paper at a time: x gives its highest, y its lowest, rel."""
        for i in range(self.n_plain, self.n):
            o = np.arange(i)
            a, b = np.where(self.paper[o] < self.paper[i], o, i), np.where(self.paper[o] < self.paper[i], i, o)
            one, two = relative(self.hi[a], self.lo[b]), relative(self.lo[a], self.hi[b])
            by_id = np.sign(self.hi_id[a] - self.lo_id[a]) * 2 + np.sign(self.lo_id[b] - self.hi_id[b])
            first = (one > two) | ((one == two) & (by_id <= 0))
            rel = np.maximum(one, two)
            kept = rel > self.least
            yield np.where(first, a, b)[kept], np.where(first, b, a)[kept], rel[kept]

    def verdicts(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        """Which verdict the pairs have, and the conditions that differ as bits."""
        differs, apart = 0, False
        for i, (hi, lo) in enumerate(self.codes):
            h, w = hi[x], lo[y]
            differs = differs | (((h >= 0) & (w >= 0) & (h != w)).astype(np.int64) << i)
            if CONDITIONS[i] != "setting":
                apart = apart | ((h < 0) != (w < 0))
        return np.where(differs > 0, 1, np.where(apart, 2, 0)), differs

    def counter(self, limits: np.ndarray):
        """Counts pairs of plain papers whose lowest is within the limit of the one that gives its highest.

        A pattern says for each condition: f any, b recorded on both sides, e recorded and equal, z on neither side.
        """
        n, known = self.n_plain, {}
        values, low = np.unique(self.lo[:n], return_inverse=True)
        low, top = low.astype(np.int32), np.searchsorted(values, limits, side="right").astype(np.int32)
        place = np.arange(n)

        def count(pattern: tuple[str, ...]) -> int:
            if pattern not in known:
                asks, held, key_a, key_h = np.ones(n, bool), np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for p, (hi, lo) in zip(pattern, self.codes):
                    hi, lo = hi[:n], lo[:n]
                    if p != "f":
                        asks, held = asks & ((hi < 0) == (p == "z")), held & ((lo < 0) == (p == "z"))
                    if p == "e":
                        width = int(max(hi.max(initial=0), lo.max(initial=0))) + 1
                        key_a, key_h = key_a * width + hi, key_h * width + lo
                a, h = place[asks], place[held]
                h = h[np.argsort(key_h[h], kind="stable")]
                keys = key_h[h] * (n + 1) + h
                start, end = np.searchsorted(keys, key_a[a] * (n + 1)), np.searchsorted(keys, key_a[a] * (n + 1) + a)
                known[pattern] = int(below(low[h], start, end, top[a]).sum())
            return known[pattern]

        nulls = [bool((hi[:n] < 0).any() or (lo[:n] < 0).any()) for hi, lo in self.codes]

        def total(*terms: dict[str, int]) -> int:
            """The product of sums of patterns, one sum a condition."""
            parts = Counter()
            for chosen in product(*(t.items() for t in terms)):
                # Without nulls "both recorded" is "any", and "neither" holds for none.
                if not any(p == "z" and not null for (p, _), null in zip(chosen, nulls)):
                    parts[tuple("f" if p == "b" and not null else p for (p, _), null in zip(chosen, nulls))] += int(np.prod([c for _, c in chosen]))
            return sum(c * count(p) for p, c in parts.items() if c)

        return total


ANY, DIFFERS, AGREES, SAME = {"f": 1}, {"b": 1, "e": -1}, {"f": 1, "b": -1, "e": 1}, {"z": 1, "e": 1}
GENUINE = [AGREES if c == "setting" else SAME for c in CONDITIONS]


class Totals:
    """Number of pairs, largest rel, first profile of the first paper."""

    def __init__(self, least: float) -> None:
        self.least = least

    def __call__(self, table: pa.Table) -> pa.Table:
        p, s = Papers(table, self.least), SUBJECT
        n, hi, lo, t, paper = p.n_plain, p.hi[: p.n_plain], p.lo[: p.n_plain], p.t, p.paper[: p.n_plain]
        n_pairs, most, firsts = p.counter(t)(ANY, ANY, ANY), -1.0, []
        if n_pairs:
            before = np.minimum.accumulate(lo)[:-1]
            most = float(relative(hi[1:], before).max())
            after = np.maximum.accumulate(t[::-1])[::-1][1:]
            gives, takes = 1 + np.flatnonzero(before <= t[1:]), np.flatnonzero(lo[:-1] <= after)
            ids, at, gave = np.concatenate((p.hi_id[gives], p.lo_id[takes])), np.concatenate((gives, takes)), np.arange(len(gives) + len(takes)) < len(gives)
            for k in np.argsort(ids, kind="stable"):  # few are looked at: most papers have a later one among their pairs
                i = at[k]
                met = (lo[:i] <= t[i]) & (paper[:i] > paper[i]) if gave[k] else (t[i + 1 :] >= lo[i]) & (paper[i + 1 :] > paper[i])
                if met.any():
                    firsts.append(p.text("hi_profile_id" if gave[k] else "lo_profile_id", i))
                    break
        for x, y, rel in p.odd_pairs():
            if len(rel):
                n_pairs, most = n_pairs + len(rel), max(most, float(rel.max()))
                ids = np.where(p.paper[x] < p.paper[y], p.hi_id[x], p.lo_id[y])
                k = int(ids.argmin())
                firsts.append(p.text("hi_profile_id", x[k]) if p.paper[x[k]] < p.paper[y[k]] else p.text("lo_profile_id", y[k]))
        rows = [(*p.subject(), n_pairs, most, min(firsts))] if n_pairs else []
        return _table(table, rows, [("n_pairs", pa.int64()), ("most", pa.float64()), ("first_a", pa.string())])


class KindCounts:
    """Number of pairs by verdict, differing conditions and whether they lie far apart."""

    def __init__(self, least: float, large: float) -> None:
        self.least, self.large = least, large

    def __call__(self, table: pa.Table) -> pa.Table:
        p, found = Papers(table, self.least), Counter()
        total = p.counter(p.t)
        for bits in range(1 << len(CONDITIONS)):
            found[1 if bits else 2, bits, False] = total(*(DIFFERS if bits >> i & 1 else AGREES for i in range(len(CONDITIONS))))
        genuine = total(*GENUINE)
        far = p.counter(np.minimum(p.t, reach(p.hi[: p.n_plain], self.large)))(*GENUINE)
        found[2, 0, False] -= genuine
        found[0, 0, False], found[0, 0, True] = genuine - far, far
        for x, y, rel in p.odd_pairs():
            verdict, differs = p.verdicts(x, y)
            found.update(zip(verdict.tolist(), differs.tolist(), ((verdict == 0) & (rel > self.large)).tolist()))
        rows = [(*p.subject(), VERDICTS[v], ",".join(c for i, c in enumerate(CONDITIONS) if bits >> i & 1), far, n) for (v, bits, far), n in found.items() if n]
        return _table(table, rows, [("verdict", pa.string()), ("differing", pa.string()), ("large", pa.bool_()), ("n", pa.int64())])


class FirstPairs:
    """The first pairs by verdict, rel and papers."""

    def __init__(self, least: float, n: int) -> None:
        self.least, self.wanted = least, n

    def __call__(self, table: pa.Table) -> pa.Table:
        p, rows = Papers(table, self.least), []
        odd = {v: [] for v in range(len(VERDICTS))}
        for x, y, rel in p.odd_pairs():
            verdict, _ = p.verdicts(x, y)
            for v, kept in odd.items():
                own = np.flatnonzero(verdict == v)
                kept += self._pairs(p, x[own], y[own], rel[own])
                kept[:] = sorted(kept)[: self.wanted]
        for v, best in odd.items():
            if len(rows) < self.wanted:
                best = self._plain(p, v, best)
                for rel, a, b, x, y in best[: self.wanted - len(rows)]:
                    x, y = (x, y) if p.paper[x] < p.paper[y] else (y, x)
                    rows.append((*p.subject(), VERDICTS[v], -rel, p.text("paper_id", x), p.text("paper_id", y)))
        return _table(table, rows, [("verdict", pa.string()), ("rel", pa.float64()), ("paper_a", pa.string()), ("paper_b", pa.string())])

    def _pairs(self, p: Papers, x: np.ndarray, y: np.ndarray, rel: np.ndarray) -> list[tuple]:
        a, b = np.minimum(p.paper[x], p.paper[y]), np.maximum(p.paper[x], p.paper[y])
        first = np.lexsort((b, a, -rel))[: self.wanted]
        return list(zip((-rel[first]).tolist(), a[first].tolist(), b[first].tolist(), x[first].tolist(), y[first].tolist()))

    def _plain(self, p: Papers, verdict: int, best: list[tuple]) -> list[tuple]:
        """Papers from the highest down, each with those of the lowest values; stops when no later one can come before the last kept."""
        n = p.n_plain
        y = np.lexsort((p.paper[:n], p.lo[:n]))  # the order of the pairs of one paper
        lo = p.lo[y]
        for x in np.argsort(-p.hi[:n], kind="stable"):
            if len(best) == self.wanted and relative(p.hi[x], lo[0]) < -best[-1][0]:
                break
            kept = np.flatnonzero((y < x) & (lo <= p.t[x]))
            kept = kept[p.verdicts(x, y[kept])[0] == verdict][: self.wanted]
            if len(kept):
                best = sorted(best + self._pairs(p, np.full(len(kept), x), y[kept], relative(p.hi[x], lo[kept])))[: self.wanted]
        return best


def _table(own: pa.Table, rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.Table:
    schema = pa.schema([own.schema.field(i) for i in range(SUBJECT)] + [pa.field(*c) for c in columns])
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
