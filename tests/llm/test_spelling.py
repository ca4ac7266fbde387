import random
import re
import zlib
from collections import Counter

import pytest
from headway.llm import spelling


def vocabulary(rows, least=5, count=3, every=97):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= count}


def close(a, b):
    """Whether a and b differ by exactly one insertion, deletion or replacement."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :]


def brute(words):
    near = {w: [v for v in words if close(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 2 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def test_pairs_of_a_trie():
    rng = random.Random(3)
    for _ in range(200):
        short = rng.randint(1, 4)
        zones = list({"".join(rng.choices("abc", k=short + rng.randint(0, 1))) for _ in range(12)})
        for append in (False, True):
            want = set()
            for i, a in enumerate(zones):
                for j, b in enumerate(zones):
                    both_long = len(a) > short and len(b) > short
                    at_end = len(a) != len(b) and (a.startswith(b) or b.startswith(a))
                    if close(a, b) and not both_long and (append or not at_end):
                        want.add((i, j))
            got = list(spelling.trie_pairs(zones, short, append))
            assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize(("limit", "zone"), [(20_000, 32), (100, 1), (100, 3)])
def test_near_words(spark, limit, zone):
    rng = random.Random(limit + zone)
    words = {"".join(rng.choices("ab", k=rng.randint(5, 8))) for _ in range(250)} | {"x" * 40 + c + "y" * 30 for c in ("", "a", "b", "aa")} | {"ab" * 400 + c for c in ("", "a", "c")}
    words = {w: rng.randint(1, 9) for w in words}
    got = {(r.word, r.n_near, r.best, r.best_n) for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), partition_words=limit, zone=zone).collect()}
    want = set()
    for w in words:
        vs = [v for v in words if close(w, v)]
        if vs:
            b = min(vs, key=lambda v: (-words[v], v))
            want.add((w, len(vs), b, words[b]))
    assert got == want


def test_large_partitions_are_cut_again(spark, monkeypatch):
    # more words than a partition may hold share all letters outside a short zone
    words = [("start" + a + b + c + "ending", 1) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    got = {r.word: r.n_near for r in spelling.near_words(spark.createDataFrame(words, "word string, n long"), partition_words=100).collect()}
    assert len(got) == 512 and set(got.values()) == {21}


def test_variants_equal_brute_force(spark, make_docs):
    rng = random.Random(11)
    base = ["station", "Straße", "transit", "vehicle", "éclairé", "fahrplan", "ÀÉÎÕÜ", "energy", "a", "four"]
    slips = lambda w: w if rng.random() < 0.6 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "x", "Y", w[k] * 2]) + w[k + 1 :]
    rows = [(i, " ".join(slips(rng.choice(base)) for _ in range(80))) for i in range(120)]
    rows += [(None, "station STATION 9station"), (7, None), (8, ""), (9, "!! 12"), (10, "transit " * 3000), (10, "transit " * 3000), (11, "q" * 5000 + " " + "q" * 5000)]
    got = {tuple(r) for r in spelling.variants(make_docs(rows).selectExpr("*", "1 as word", "2 as n")).collect()}
    want = brute(vocabulary(rows))
    assert got == want and any(f for _, f, *_ in want)


def test_forms_of_forms_and_ties(spark, make_docs):
    rows = [(1, "aaaaa " * 3 + "aaaab " * 6 + "aaabb " * 20 + "aaaac " * 6 + "zzzzz " * 3)]
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(make_docs(rows), slip_every=None).collect()}
    assert got == {"aaaaa": ("aaaab", "aaabb", 2, 6), "aaaab": ("aaabb", "aaabb", 3, 20), "aaaac": (None, "aaaac", 2, None), "aaabb": (None, "aaabb", 1, None), "zzzzz": (None, "zzzzz", 0, None)}


def test_empty_table(spark, make_docs):
    assert spelling.variants(make_docs([(1, "a")]).filter("false")).count() == 0
    with pytest.raises(ValueError):
        spelling.near_words(spark.createDataFrame([("a", 1)], "word string, n long"), partition_words=10)
