"""NumPy kernels for pairs of strings that are alike: edit distances by bits, k-mer sets by matrix products. No Spark here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs whose distances are computed at once, and pairs that a block of two tables may have.
LANES, CELLS = 4096, 2_000_000
#: Columns of k-mer sets; more distinct k-mers share them.
COLUMNS = 4096

Links = tuple[np.ndarray, np.ndarray, np.ndarray]


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row for each string, 0 beyond its end; and the lengths."""
    n = np.array([len(s) for s in strings], dtype=np.int64)
    wide = max(1, int(n.max(initial=0)))
    return np.array(strings, dtype=f"U{wide}").view(np.uint32).reshape(len(strings), wide), n


def edit_distances(a: list[str], b: list[str], ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Edit distances of the pairs a[ia], b[ib]: a column of Myers' bit vectors at a time, 64 letters of ``a`` a word, for many pairs at once."""
    out = np.zeros(len(ia), dtype=np.int64)
    if not len(ia):
        return out
    (ca, la), (cb, lb) = codes(a), codes(b)
    letters = np.unique(np.concatenate([ca.ravel(), cb.ravel()]))
    ca, cb = np.searchsorted(letters, ca), np.searchsorted(letters, cb)
    words = -(-la // 64)
    at = [np.zeros((len(a), len(letters)), dtype=np.uint64) for _ in range(int(words.max(initial=0)))]  # by word: where each letter is
    for p in range(ca.shape[1]):
        rows = np.flatnonzero(la > p)
        at[p >> 6][rows, ca[rows, p]] |= np.uint64(1 << (p & 63))
    at = [m.ravel() for m in at]
    order = np.lexsort((lb[ib], words[ia]))
    bounds = np.r_[0, np.flatnonzero(np.diff(words[ia[order]])) + 1, len(order)]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        for start in range(lo, hi, LANES):
            pairs = order[start : min(hi, start + LANES)]
            out[pairs] = _columns(at, len(letters), la[ia[pairs]], lb[ib[pairs]], ia[pairs], cb[ib[pairs]].T, int(words[ia[pairs[0]]]))
    return out


def _columns(at: list[np.ndarray], letters: int, la: np.ndarray, lb: np.ndarray, ia: np.ndarray, text: np.ndarray, words: int) -> np.ndarray:
    """Distances of pairs in the order of ``lb``, whose first strings have so many ``words``."""
    if not words:
        return lb
    one, top = np.uint64(1), np.uint64(63)
    score, last, base = la.copy(), ((la - 1) & 63).astype(np.uint64), ia * letters
    up, down = [np.full(len(la), ~np.uint64(0)) for _ in range(words)], [np.zeros(len(la), dtype=np.uint64) for _ in range(words)]
    out, done = np.empty_like(score), 0
    for t in range(int(lb[-1])):
        ended = int(np.searchsorted(lb, t, "right"))  # pairs whose text is over
        if ended > done:
            cut = ended - done
            out[done:ended] = score[:cut]
            score, last, base, up, down, done = score[cut:], last[cut:], base[cut:], [v[cut:] for v in up], [v[cut:] for v in down], ended
        place = base + text[t, done:]
        more, less = one, np.uint64(0)
        for w in range(words):
            v, m, same = up[w], down[w], at[w][place]
            cross = same | m
            same |= less
            flat = (((same & v) + v) ^ v) | same
            plus, minus = m | ~(flat | v), v & flat
            if w == words - 1:
                score = score + ((plus >> last) & one).astype(np.int64) - ((minus >> last) & one).astype(np.int64)
            next_more, next_less = plus >> top, minus >> top
            plus, minus = (plus << one) | more, (minus << one) | less
            up[w], down[w] = minus | ~(cross | plus), plus & cross
            more, less = next_more, next_less
    out[done:] = score
    return out


def likeness(a: list[str], b: list[str], ia: np.ndarray, ib: np.ndarray, least: float, places: list[int] | None = None) -> Links:
    """The pairs a[ia], b[ib] that are alike by ``least``, and how much: functions.sequences.position_similarity, pair by pair."""
    (ca, la), (cb, lb) = codes(a), codes(b)
    sim = np.zeros(len(ia))
    longer, gap = np.maximum(la[ia], lb[ib]), np.abs(la[ia] - lb[ib])
    sim[longer == 0] = 1.0
    near = (np.minimum(la[ia], lb[ib]) > 0) & (gap / np.maximum(longer, 1) <= 0.3)
    if places:
        level = gap == 0
        wide = max(ca.shape[1], cb.shape[1], max(places) + 1)
        pa, pb = (np.pad(c, ((0, 0), (0, wide - c.shape[1])))[:, places] for c in (ca, cb))
        for part in range(0, len(ia), 100_000):
            some = part + np.flatnonzero(level[part : part + 100_000])
            sim[some] = (pa[ia[some]] == pb[ib[some]]).sum(1) / len(places)
        near &= ~level
    if least > 0:  # letters that one string has more of are edits
        letters = np.unique(np.concatenate([ca.ravel(), cb.ravel()]))
        over, under = np.zeros(len(ia), dtype=np.int64), np.zeros(len(ia), dtype=np.int64)
        for c in letters[letters > 0][:8]:
            more = (ca == c).sum(1)[ia] - (cb == c).sum(1)[ib]
            over, under = over + np.maximum(more, 0), under + np.maximum(-more, 0)
        near &= 1 - np.maximum(over, under) / np.maximum(longer, 1) >= least
    rest = np.flatnonzero(near)
    sim[rest] = 1 - edit_distances(a, b, ia[rest], ib[rest]) / longer[rest]
    keep = sim >= least
    return ia[keep], ib[keep], sim[keep]


def blocks(a: list[str], b: list[str]) -> Iterator[slice]:
    """Slices of ``b`` that have at most ``CELLS`` pairs with ``a``."""
    step = max(1, CELLS // max(1, len(a)))
    return (slice(at, at + step) for at in range(0, len(b), step))


def joined(parts: list[Links]) -> Links:
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))


def like_brackets(a: list[str], b: list[str], identity: float) -> Links:
    """Pairs (row of ``a``, row of ``b``, similarity) of strings whose lengths are within 30 % and whose edit similarity reaches ``identity``."""
    la, lb, out = np.array([len(s) for s in a]), np.array([len(s) for s in b]), []
    for part in blocks(a, b):
        ia, ib = np.nonzero(np.abs(la[:, None] - lb[None, part]) <= 0.3 * np.maximum(la[:, None], lb[None, part]))
        out.append(likeness(a, b, ia, ib + part.start, identity))
    return joined(out)


def gram_sets(strings: list[str], k: int) -> list[set[str]]:
    return [{s[i : i + k] for i in range(len(s) - k + 1)} for s in strings]


def like_sequences(a: list[str], b: list[str], k: int, pre: float, identity: float, places: list[int]) -> Links:
    """Pairs (row of ``a``, row of ``b``, similarity) of strings that share a k-mer, whose sets of k-mers have a Jaccard similarity of ``pre``, and which are alike by ``identity``."""
    ga, gb = gram_sets(a, k), gram_sets(b, k)
    names = {g: i for i, g in enumerate(sorted(set().union(*ga, *gb)))}
    wide, shared = max(1, min(len(names), COLUMNS)), len(names) > COLUMNS

    def counted(sets: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(sets), wide), dtype=np.float32)
        rows = np.repeat(np.arange(len(sets)), [len(g) for g in sets])
        np.add.at(out, (rows, np.array([names[x] % wide for g in sets for x in g], dtype=np.int64)), 1)
        return out

    xa, na, nb, out = counted(ga), np.array([len(g) for g in ga]), np.array([len(g) for g in gb]), []
    for part in blocks(a, b):
        both = (xa @ counted(gb[part]).T).astype(float)  # with shared columns: at least what the sets share
        union = na[:, None] + nb[None, part] - both
        ia, ib = np.nonzero((both >= pre * union - 1e-6) & (both > 0))
        n = both[ia, ib] if not shared else np.array([len(ga[i] & gb[j + part.start]) for i, j in zip(ia.tolist(), ib.tolist(), strict=True)], dtype=float)
        keep = (n > 0) & (n / (na[ia] + nb[ib + part.start] - n) >= pre)
        out.append(likeness(a, b, ia[keep], ib[keep] + part.start, identity, places))
    return joined(out)


def founders(n: int, ia: np.ndarray, ib: np.ndarray) -> list[int]:
    """Of ``n`` rows with links ia < ib: those that no earlier founder is linked to."""
    order = np.argsort(ia, kind="stable")
    ib, bounds, free, out = ib[order], np.searchsorted(ia[order], np.arange(n + 1)), np.ones(n, dtype=bool), []
    for i in range(n):
        if free[i]:
            out.append(i)
            free[ib[bounds[i] : bounds[i + 1]]] = False
    return out
