import random
import re

from headway.llm import decontam

ITEM = "item_id long, text string"


def brute(docs, items, window=24, share=0.75):
    """Every shift of every item, without hashing; as the seeds do, it needs one place with a mask's words in agreement."""
    tok = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for d, text in docs:
        w = tok(text)
        for i, b in items:
            b = tok(b)
            masks = decontam.MASKS if len(b) >= 9 else ("1" * len(b),)
            for ip in range(len(b)):
                for dp in range(len(w)):
                    for m in masks:
                        if ip + len(m) <= len(b) and dp + len(m) <= len(w) and b and all(b[ip + k] == w[dp + k] for k, c in enumerate(m) if c == "1"):
                            n = min(len(b), window)
                            first = min(max(ip - (n - 9) // 2, 0), len(b) - n)
                            at = dp - ip + first
                            same = sum(0 <= at + k < len(w) and w[at + k] == b[first + k] for k in range(n))
                            if same >= share * n and (n >= 9 or same == n):
                                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark, make_docs):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([60, 40, 24, 16, 10, 9, 5, 1, 30])] + [(90, None), (91, ""), (92, "!!")]
    docs = []
    for i, text in items:
        w = (text or "").split()
        for changed in (0, 2, 5, 12):
            v = list(w)
            for _ in range(min(changed, len(v))):
                v[rng.randrange(len(v))] = "other"
            docs.append(" ".join(words(50) + v + words(20)))
            docs.append(", ".join(x.upper() for x in v))
        docs.append(" ".join(words(20) + w[: len(w) // 2] + words(9)))
    docs += ["", None, " ".join(words(5000)), " ".join(words(3)), items[0][1], items[0][1]]
    rows = list(enumerate(docs)) + [(0, docs[0]), (None, items[0][1])]
    df = make_docs(rows).selectExpr("*", "1 as item_id", "2 as seed")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, spark.createDataFrame(items, ITEM)).collect()}
    assert got == brute(rows, items) and len(got) > 30


def test_substituted_passages_are_found_and_clean_text_is_not(spark, make_docs):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    items = [(i, " ".join(words(40))) for i in range(30)]
    docs = []
    for i, t in items:
        v = t.split()
        for k in rng.sample(range(40), 4):
            v[k] = "changed"
        docs.append((i, " ".join(words(100) + v + words(100))))
    docs += [(100 + i, " ".join(words(30) + items[i][1].split()[:6] + words(30))) for i in range(30)]
    bench = spark.createDataFrame(items, ITEM)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(make_docs(docs), bench).collect()} == {(i, i) for i in range(30)}
    kept = decontam.decontaminate(make_docs(docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(100, 130)) and kept.columns == make_docs(docs).columns


def test_shuffled_windows_give_the_same(spark, make_docs, monkeypatch):
    items = [(1, "a b c d e f g h i j k l"), (2, "q r s")]
    docs = make_docs([(1, "x A b c d e f g h i j k l"), (2, "q r s"), (3, "q r t")])
    want = decontam.leaks(docs, spark.createDataFrame(items, ITEM)).collect()
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert sorted(decontam.leaks(docs, spark.createDataFrame(items, ITEM)).collect()) == sorted(want)
    assert sorted((r.doc_id, r.item_id) for r in want) == [(1, 1), (2, 2)]


def test_empty_tables(spark, make_docs):
    docs, none = make_docs([(1, "a b c")]), spark.createDataFrame([], ITEM)
    assert decontam.leaks(docs, none).count() == 0
    assert decontam.decontaminate(docs, none).count() == 1
    assert decontam.leaks(docs.filter("false"), spark.createDataFrame([(1, "a b c d e f g h i j")], ITEM)).count() == 0


def test_all_that_agrees_in_three_quarters_is_found(spark, make_docs):
    """Against every window of every shift, without masks."""
    rng = random.Random(8)
    items, docs, want = [], [], set()
    for i in range(120):
        n = rng.choice([9, 12, 14, 16, 20, 24, 40])
        item = [f"i{i}x{k}" for k in range(n)]
        v = list(item)
        if i % 6 == 0:
            v[3::4] = ["other"] * len(v[3::4])
        else:
            for k in rng.sample(range(n), rng.choice([n // 4, n // 4 + 1])):
                v[k] = "other"
        w = min(n, 24)
        if any(sum(a == b for a, b in zip(item[f : f + w], v[f : f + w])) >= 0.75 * w for f in range(n - w + 1)):
            want.add((i, i))
        items.append((i, " ".join(item)))
        docs.append((i, " ".join([f"d{k}" for k in range(i % 50)] + v + ["end"] * (i % 7))))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(make_docs(docs), spark.createDataFrame(items, ITEM)).collect()}
    assert got == want and 40 < len(want) < 120


def test_columns_of_any_name_are_kept(spark, make_docs):
    item = "one two three four five six seven eight nine ten eleven twelve"
    df = make_docs([(1, "clean text"), (2, "so " + item), (None, item)]).selectExpr("*", "doc_id * 2 as _doc", "doc_id * 3 as `a.b`", "doc_id * 5 as _row", "7 as item_id")
    out = decontam.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    rows = out.collect()
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in rows) == ["1", "None"]
    assert all(r.doc_id is None or (r._doc, r["a.b"], r._row, r.item_id) == (2, 3, 5, 7) for r in rows)
