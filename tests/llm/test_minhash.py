import random
import re

import numpy as np
import pyarrow as pa
from headway.llm import minhash
from headway.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def words(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    docs = []
    passage = words(rng, 60)
    for _ in range(40):  # unrelated, sharing a long passage
        docs.append(words(rng, 30) + passage + words(rng, 20))
    core = words(rng, 200)
    for _ in range(60):  # near copies of one text
        d = list(core)
        for _ in range(rng.randrange(6)):
            d[rng.randrange(len(d))] = f"x{rng.randrange(10**6)}"
        docs.append(d)
    chain = words(rng, 100)
    for i in range(12):  # each near its predecessor only
        chain = chain[3:] + words(rng, 3)
        docs.append(list(chain))
    for _ in range(60):
        docs.append(words(rng, rng.choice([1, 2, 4, 5, 6, 30, 300])))
    docs += [docs[i] for i in (0, 45, 45, 100, 130, 131)]
    rng.shuffle(docs)
    texts = [" ".join(d) for d in docs]
    texts += ["", None, " \n\t", "Ä b", "ä b", "A B c", "a\tb\x0bC", " ".join(words(rng, 20_000))]
    return list(enumerate(texts))


def test_groups_equal_brute_force(spark, make_docs):
    rows = corpus()
    got = sorted(tuple(r) for r in minhash.near_duplicates(make_docs(rows).selectExpr("*", "1 as digest", "2 as rep")).collect())
    assert got == brute(rows)


def test_sketch_of_random_sets_is_complete(spark, make_docs):
    rng = random.Random(3)
    base = [words(rng, n) for n in (20, 60, 90, 200, 400)]
    rows = []
    for d in base:
        for p in (0.01, 0.03, 0.05, 0.06):
            rows.append((len(rows), " ".join(w if rng.random() > p else "zz" + str(rng.random()) for w in d)))
    got = sorted(tuple(r) for r in minhash.near_duplicates(make_docs(rows)).collect())
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark, make_docs):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (None, text), (2, text + " eight"), (3, None), (3, "")]
    got = sorted(map(str, (tuple(r) for r in minhash.near_duplicates(make_docs(rows)).collect())))
    assert got == sorted(map(str, [(1, 3, 1, True), (1, 3, 1, True), (None, 3, None, True), (2, 4, 1, False), (3, 0, 3, True), (3, 0, 3, True)]))
    assert minhash.near_duplicates(make_docs(rows).filter("false")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 150)] + [(149, 60), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 60 for i in range(100, 150)) and got[60] == 60


def test_hash_sets(monkeypatch):
    texts = ["a b c d e a b c d e", "A b", "a  B\n", "", None, "e a b c d", "x" * 5000, " lead and trail ", "Ä b"]
    sets = minhash.shingle_sets(pa.array(texts))
    assert [len(x) for x in sets] == [len(shingles(t)) for t in texts]
    assert np.array_equal(sets[1], sets[2]) and not np.array_equal(sets[1], sets[8])
    assert set(sets[5]) < set(sets[0])
    # a slice of an array, and a text that is hashed in pieces, give the same
    assert all(map(np.array_equal, minhash.shingle_sets(pa.array(texts)[3:]), sets[3:]))
    rng = random.Random(1)
    long = " ".join(words(rng, 3000)) + " " + "y" * 4000 + " tail"
    whole = minhash.shingle_sets(pa.array(["a b", long, "c"]))
    monkeypatch.setattr(minhash, "PIECE", 500)
    assert all(map(np.array_equal, minhash.shingle_sets(pa.array(["a b", long, "c"])), whole))
    assert len(whole[1]) == len(shingles(long))


def test_shared_counts():
    rng = random.Random(2)
    sets = [np.unique([rng.randrange(150) for _ in range(rng.randrange(40))]).astype(np.int64) for _ in range(40)]
    got = minhash._shared_counts(sets, chunk=7)
    assert all(got[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(40) for j in range(i))


def test_the_kept_row_of_a_repeated_id_is_always_the_same(spark, make_docs):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven"), (2, "one two three four five six"), (3, None), (None, "x"), (None, "x"), (4, "other words " * 9)]
    df = make_docs(rows).selectExpr("*", "7 as _id", "8 as kept", "9 as _row")
    got = [sorted(map(str, minhash.without_near_duplicates(df.repartition(n)).collect())) for n in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 5
    assert minhash.without_near_duplicates(df).columns == df.columns


def test_blocks_find_what_long_lists_leave(spark, make_docs):
    rng = random.Random(9)
    passage = words(rng, 80)
    texts = [" ".join(words(rng, 10) + passage + words(rng, 12)) for _ in range(60)]  # four fifths shared: apart
    texts += [t.replace(t.split()[3], "changed") for t in texts[:20]]
    rows = list(enumerate(texts))
    docs = make_docs(rows)
    want = brute(rows)
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == want
    classes = minhash.sketches(docs, 64).select(minhash.F.col("doc_id").alias("rep"), "n_shingles", "sketch")
    members = classes.select(minhash.F.lit(1).alias("v"), "rep", minhash.F.col("n_shingles").alias("n"), minhash.F.col("rep").alias("component"))
    deep = minhash.sketches(docs, 1024).select(minhash.F.col("doc_id").alias("rep"), "n_shingles", "sketch")
    pairs = {tuple(sorted((r.a, r.b))) for r in minhash._dense(members, deep, 1024, 690, block=16).collect()}
    sets = [shingles(t) for t in texts]
    true = {(a, b) for b in range(80) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert pairs == true  # every member is a group of its own here
    merged = members.withColumn("component", minhash.F.when(minhash.F.col("rep") < 60, minhash.F.lit(0)).otherwise(minhash.F.lit(1)))
    few = minhash._dense(merged, deep, 1024, 690, block=1000).collect()
    assert len(few) == 1 and tuple(sorted((few[0].a, few[0].b))) in true
