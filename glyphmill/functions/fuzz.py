"""Edit-style similarity of two strings, and features of a text beside its rewrites, in Python: no built-in has these measures.

Likeness is 2 LCS / (characters of both) in per cent, of the longest common subsequence, as the rapidfuzz library defines it.
"""

from __future__ import annotations


#: Characters of the shorter text that may stay unmatched in the first band at least, characters up to which the whole table is no dearer, and
#: characters whose places are noted at once.
BAND, WHOLE, BLOCK = 48, 256, 8192


def _masks(a: str) -> dict[str, int]:
    """The places of each character as bits."""
    import numpy as np

    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}


def in_band(a: str, b: str, k: int, drift: int = 0) -> int:
    """Length of the longest common subsequence among those whose places in a are never more than some k before those in b, or k + drift after.

    A row of the table is one number, whose zeros are where the length grows. Rows are cut to a window that moves along the diagonal, some
    characters of b at a time; what falls out below is counted, what comes in above has not grown yet.
    """
    step = max(32, (2 * k + drift) // 4)
    width, base, grown = step + 2 * k + drift, 0, 0
    row, noted, upto, masks = (1 << width) - 1, 0, 0, {}
    for at in range(0, len(b), step):
        start = max(0, at - k)
        if shift := start - base:
            grown += shift - (row & ((1 << shift) - 1)).bit_count() if shift < width else width - row.bit_count()
            row = row >> shift | ((1 << min(shift, width)) - 1) << (width - min(shift, width))
            base = start
        inside = min(width, max(0, len(a) - start))
        if not inside:
            break
        if start + inside > upto:
            noted, upto = start, min(len(a), start + max(BLOCK, 4 * width))
            masks = _masks(a[noted:upto])
        full, own = (1 << inside) - 1, {}
        beyond, row, by = row & ~full, row & full, start - noted
        for c in b[at : at + step]:
            try:
                u = row & own[c]
            except KeyError:
                own[c] = masks.get(c, 0) >> by & full
                u = row & own[c]
            if u:
                row = ((row + u) | (row - u)) & full
        row |= beyond
    left = max(0, min(width, len(a) - base))
    return grown + left - (row & ((1 << left) - 1)).bit_count()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence of texts of any length, in time like their length times their differences.

    If some p characters of the shorter text are unmatched, its places are never more than p before those of the longer one, or p and
    their difference in length after. So a band as wide as that for what it finds has found the best; it grows fourfold until then. Common
    ends are taken off first.
    """
    low, high = 0, 0
    most = min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    while high < most - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if len(a) < len(b):
        a, b = b, a
    k, drift = max(BAND, len(b) // 40), len(a) - len(b)
    while len(a) > WHOLE and 2 * k + drift < len(a):
        found = in_band(a, b, k, drift)
        if len(b) - found <= k:
            return low + high + found
        k = min(4 * k, len(b) - found)
    return low + high + in_band(a, b, max(len(a), 1))


def ratio(a: str, b: str) -> float:
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """The best likeness among the common tokens, and these with the others of either text; 0 if a text has no tokens."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, p, q = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not p or not q):
        return 100.0
    n = len(both)
    np, nq = n + (n > 0) + len(p), n + (n > 0) + len(q)
    out = [100.0 - 100.0 * (len(p) + len(q) - 2 * common_subsequence(p, q)) / (np + nq)]
    if n:
        out += [200.0 * n / (n + np), 200.0 * n / (n + nq)]
    return max(out)


def grams(t: list[str], most: int = 4) -> list[set[tuple[str, ...]]]:
    """The different n-grams of a list of tokens, of 1 to most tokens."""
    return [set(zip(*(t[k:] for k in range(n)))) for n in range(1, most + 1)]


def overlaps(a: list[str], b: list[str], most: int = 4) -> list[int]:
    """Different n-grams that two lists of tokens share, of 1 to most tokens."""
    return shared(grams(a, most), grams(b, most))


def shared(a: list[set], b: list[set]) -> list[int]:
    return [len(x & y) for x, y in zip(a, b, strict=True)]


def rewrite_features(text: str, rewrites: list[str]) -> list[float]:
    """For 1- to 4-grams, per word: the mean overlap with the rewrites, that with each, and that with all joined; then both ratios with each."""
    words = text.lower().split()
    n = max(1, len(words))
    own = grams(words)
    each = [shared(own, grams(r.lower().split())) for r in rewrites]
    mean = [sum(x) / len(rewrites) for x in zip(*each, strict=True)]
    joined = shared(own, grams(" ".join(rewrites).lower().split()))
    return [v / n for x in (mean, *each, joined) for v in x] + [f(text, r) for r in rewrites for f in (ratio, token_set_ratio)]
