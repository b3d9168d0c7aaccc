"""Operator 12 against brute force: the trie, its runs, ranges, flushes and whole audits."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from glyphmill.llm import byte_tries, common

KEPT = 3


def brute(rows, top=200):
    docs = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) for l, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in df if df[t] >= KEPT]
        counts = defaultdict(Counter)
        for _, s, terms in own:
            counts[s].update(t for t in terms if df[t] >= KEPT)
        total = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) * (p - q) // q
        for s, c in counts.items():
            pairs = [(sum(f(share(c, t), share(o, t)) for t in kept), n) for n, o in counts.items() if n != s]
            terms = [(f(share(c, t), share(total, t)), t) for t in kept if c[t] and share(c, t) > share(total, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def corpus(n=300, seed=1):
    rnd = random.Random(seed)
    words = ["a", "ab", "abc", "ABD", "b", "über", "üb", "漢字", "漢", "é", "zz", *[f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]]
    rows = [(rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1", "ß", None]), " ".join(rnd.choices(words, k=rnd.choice([0, 3, 30])))) for _ in range(n)]
    return [*rows, rows[0], rows[0], ("xx", "alone", "one two"), ("yy", "p", None), ("yy", "q", "1 2 3"), ("en", "s1", "lang " * 5000)]


@given(st.lists(st.binary(min_size=1, max_size=6)), st.lists(st.binary(min_size=1, max_size=6)), st.sampled_from([1, 2, 512]))
def test_trie_keeps_counts_in_byte_order(one, two, bucket):
    """Two tries, written as runs, read and merged, are the sorted count of both; with buckets that fork at once, too."""
    held, byte_tries.BUCKET = byte_tries.BUCKET, bucket
    try:
        whole = byte_tries.Trie()
        for source, terms in (("a", one), ("b", two)):
            trie = byte_tries.Trie()
            for t in terms:
                trie.add(t, {None: 1, source: 1})
            for run in trie.runs():
                prefix, leaves = byte_tries.unpacked(byte_tries.packed(run))
                for end, counts in leaves:
                    whole.add(prefix + end, counts)
        found = [(p + e, c) for p, leaves in whole.runs() for e, c in leaves]
    finally:
        byte_tries.BUCKET = held
    assert [t for t, _ in found] == sorted({*one, *two})
    assert {t: (c[None], c.get("a", 0), c.get("b", 0)) for t, c in found} == {t: ((one + two).count(t), one.count(t), two.count(t)) for t in {*one, *two}}


def test_shares_are_exact():
    rnd = random.Random(2)
    for _ in range(500):
        whole = rnd.randrange(1, 9 * 10**15)
        c = rnd.randrange(0, whole)
        assert byte_tries.shares(np.array([c]), whole)[0] == 1 + 10**9 * (c + 1) // whole


@pytest.mark.parametrize("settings", [{}, {"LEAVES": 20, "BUCKET": 3, "RANGE": 10, "ENTRIES": 8}, {"TEXT_BYTES": 300, "TOP": 3}])
def test_against_brute_force(spark, monkeypatch, folder, settings):
    """Also with tries that are full after a few terms, small buckets, many ranges, and ties at the last rank."""
    for k, v in settings.items():
        monkeypatch.setattr(byte_tries, k, v)
    monkeypatch.setattr(common, "BATCH_ROWS", 20)
    rows = corpus()
    path = folder("audit", documents=spark.createDataFrame(rows, "lang string, source string, text string").repartition(5))
    got = sorted(tuple(r) for r in byte_tries.op12_divergence(spark, path).collect())
    assert got == brute(rows, settings.get("TOP", 200))


def test_too_many_groups_are_an_error(spark, monkeypatch, edge):
    monkeypatch.setattr(byte_tries, "MOST_GROUPS", 0)
    with pytest.raises(ValueError, match="groups"):
        byte_tries.audit(edge)
