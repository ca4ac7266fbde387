import random
import zlib

import numpy as np
import pyarrow as pa
from headway.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioustnrl") for _ in range(rng.randrange(3, 9))) for _ in range(800)]
    bad = ["blockhead", "nitwit", "dunderhead"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        toxic = int(rng.random() < 0.3)
        for _ in range(toxic * rng.randrange(4, 9)):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return docs, labels, vocab


def test_held_out_rows_and_misspellings(spark, make_docs):
    docs, labels, vocab = corpus(900)
    df, lab = make_docs(docs), spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1), (99999, 1, 1)], LABELS)
    model = toxicity.train(df, lab)
    out = {r.doc_id: r for r in toxicity.score(df.selectExpr("*", "1 as score"), model).collect()}
    truth = {i: t for i, _, t in labels}
    fold = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in out.items() if r.held_out} == set(fold)
    assert sum(out[i].predicted == truth[i] for i in fold) >= 0.9 * len(fold)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in out.values())
    rng, s = random.Random(4), toxicity.Scorer(model)
    clean = " ".join(rng.choice(vocab) for _ in range(40))
    toxic, same = s.score(pa.array([clean + " blokhead dunderheaad nitwitt", clean]))
    assert toxic > 0.7 > same
    # a short passage in a long text is not averaged away, wherever its words stood before
    long = " ".join(rng.choice(vocab) for _ in range(30_000))
    assert s.score(pa.array([long + " blockhead nitwit dunderhead " + long]))[0] > 0.7
    assert s.score(pa.array([" blockhead ".join(long.split()[:40]) + " nitwit dunderhead " + long]))[0] > 0.7


def plain_score(model, text):
    """The same model, word by word and stretch by stretch."""
    import re

    seq = re.findall(r"[^\W_]+", (text or "").lower())
    each, bias = model.log_odds()
    value = [float(np.mean(each[toxicity.subwords(pa.array([w]))[0]])) for w in seq]
    n = toxicity.STRETCH
    most = [sum(value[k : k + n]) / n for k in range(max(len(seq) - n, 0) + 1)]
    return 1 / (1 + np.exp(-(bias + (max(most) if seq else 0.0))))


def test_what_stands_around_a_phrase_changes_nothing(spark, make_docs):
    docs, labels, vocab = corpus(600)
    model = toxicity.train(make_docs(docs), spark.createDataFrame(labels, LABELS))
    s, rng = toxicity.Scorer(model), random.Random(9)
    texts = [t for _, t in docs[:200]]
    base = s.score(pa.array(texts))
    for change in (lambda t: "zzqqy " + t, lambda t: t + " zzqqy", lambda t: " ".join(rng.choice(vocab) for _ in range(7)) + " " + t, lambda t: t + " " + t):
        again = s.score(pa.array([change(t) for t in texts]))
        assert (again >= base - 1e-9).all()  # all stretches of the text are still there
        assert ((again >= 0.7) == (base >= 0.7)).mean() >= 0.99
    assert ((s.score(pa.array(["zzqqy " + t for t in texts])) >= 0.7) == (base >= 0.7)).all()


def test_scores_equal_a_plain_scorer(spark, make_docs):
    docs, labels, _ = corpus(200)
    model = toxicity.train(make_docs(docs), spark.createDataFrame(labels, LABELS))
    rows = docs[:40] + [(900, "One"), (901, "one two three"), (902, "one two, three_four. one"), (903, None), (904, "??"), (905, "Über ÜBER straße 12")]
    got = {r.doc_id: r.score for r in toxicity.score(make_docs(rows), model).collect()}
    assert all(abs(got[i] - plain_score(model, t)) < 1e-6 for i, t in rows)


def test_one_row_of_a_document_is_taken(spark, make_docs):
    docs, labels, _ = corpus(60)
    lab = spark.createDataFrame(labels, LABELS)
    once = [r.text for r in toxicity.training_rows(make_docs(docs), lab, max_rows=10).collect()]
    again = [r.text for r in toxicity.training_rows(make_docs(docs * 30), lab, max_rows=10).collect()]
    assert once == again and len(once) == 10


def test_training_never_sees_the_held_out_fold(spark, make_docs):
    docs, labels, _ = corpus(300)
    df = make_docs(docs)
    rows = toxicity.training_rows(df, spark.createDataFrame(labels, LABELS), max_rows=50).collect()
    assert len(rows) == 50
    texts = {t: i for i, t in docs}
    assert all(zlib.crc32(str(texts[r.text]).encode()) % 3 != 1 for r in rows)
    few = toxicity.training_rows(df, spark.createDataFrame(labels, LABELS), max_chars=2000).collect()
    assert 0 < sum(len(r.text) for r in few) <= 2000


def test_edges(spark, make_docs):
    docs, labels, _ = corpus(60)
    lab = spark.createDataFrame(labels, LABELS)
    a, b = (toxicity.train(make_docs(docs).repartition(n), lab) for n in (1, 3))
    assert np.array_equal(a.embeddings, b.embeddings)  # reruns agree
    rows = [(1, None), (2, ""), (3, "!!! ..."), (3, "!!! ..."), (None, "x" * 300_000)]
    out = toxicity.score(make_docs(rows), a).collect()
    assert len(out) == 5 and len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(make_docs(rows).filter("false"), a).count() == 0
    empty = toxicity.train(make_docs(docs), lab.filter("false"))
    assert all(r.score == 0.5 for r in toxicity.score(make_docs(rows), empty).collect())


def test_a_huge_row_does_not_end_the_sample(spark, make_docs):
    docs, labels, _ = corpus(300)
    lab = spark.createDataFrame(labels, LABELS)
    ids = {t: i for i, t in docs}
    before = [ids[r.text] for r in toxicity.training_rows(make_docs(docs), lab).collect()]
    huge = {before[0]: " ".join(f"w{k}" for k in range(20_000)), before[1]: "nitwit Nitwit of " * 20_000}
    changed = make_docs([(i, huge.get(i, t)) for i, t in docs])
    got = [r.text for r in toxicity.training_rows(changed, lab, max_chars=100_000).collect()]
    assert got[0] == "nitwit of" and [ids[t] for t in got[1:]] == before[2:]
