import hashlib
import random
import zlib

import pytest
from headway.llm import manifest
from headway.llm.queries import merkle_rows


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """(root, steps of each node as (left, right))."""
    steps, level, at = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        for i, a in enumerate(at):
            run, k = runs[a // 16], a % 16
            steps[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        level, at = [h("".join(r)) for r in runs], [a // 16 for a in at]
    return level[0], steps


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, over = tree([subs[s][0] for s in names])
    out = []
    for s, up in zip(names, over, strict=True):
        for (_, _, node, r), steps in zip(sorted(by[s], key=lambda x: x[:3]), subs[s][1], strict=True):
            proof = [*steps, *up]
            claimed = leaf(r[0], r[3], r[2], r[4], lower(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else node
            for left, right in proof:
                claimed = h(left + claimed + right)
            out.append((r[0], node, subs[s][0], root, h("".join(a + b for a, b in proof)), claimed, claimed == root))
    return out


KEY = lambda r: (str(r[0]), r[1], r[4])


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 1}, {"a": 4097, "b": 300, "é": 257, "": 3, None: 40}, {f"s{k}": 1 + k % 3 for k in range(300)}])
def test_equals_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(manifest, "RANGE_ROWS", 700)
    rng = random.Random(1)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7919 % 100_003, rng.choice([None, "", "abc", "ABC é", "x:1-"]), rng.choice([None, "en"]), source, rng.choice([None, 3])))
    rows += [(5, "twice A", "en", "a", 1), (5, "twice A", "en", "a", 1), (5, "once", "en", "a", 1), (None, "No id", "en", "a", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).selectExpr("*", "1 as pos", "2 as src", "3 as total", "4 as leaf")
    got = sorted((tuple(r) for r in merkle_rows(df).collect()), key=KEY)
    assert got == sorted(brute(rows), key=KEY)


def test_many_equal_rows_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(manifest, "RANGE_ROWS", 500)
    rows = [(1, "same", "en", "a", 4)] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((tuple(r) for r in merkle_rows(df).collect()), key=KEY) == sorted(brute(rows), key=KEY)
    assert merkle_rows(df.filter("false")).count() == 0
