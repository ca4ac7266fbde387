import time

import pytest
import regex
from headway.llm import secrets
from pyspark.sql import functions as F

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
WORDS = ["the", "and", "nation", "there", "enter", "house", "reading", "station", "mention", "alpha"]


@pytest.fixture(scope="module")
def forest(spark):
    found = secrets.labelled_findings(spark)
    return secrets.train(found.filter("crc32(value) % 3 <> 1"), WORDS)


def test_held_out_findings(spark, forest):
    rows = secrets.cut(secrets.labelled_findings(spark).filter("crc32(value) % 3 = 1"))
    rows = secrets.with_features(rows, forest.dictionary, forest.neighbours).withColumn("score", forest.chance)
    found = F.col("score") >= 0.5
    n, true, hit, said = rows.select(F.count("*"), F.sum("label"), F.sum((found & (F.col("label") == 1)).cast("int")), F.sum(found.cast("int"))).first()
    assert n > 1000 and hit >= 0.96 * true and hit >= 0.96 * said


def brute(texts):
    return {(i, m.start() + 1, m[0]) for i, t in enumerate(texts) for m in regex.finditer(secrets.CANDIDATE, t or "")}


def test_candidates_keep_their_places(spark, make_docs):
    texts = [f'x token = "{HEX}" y {HEX} {HEX}', "no", "", None, "ñé " * 50 + HEX, "a" * 16, "a" * 15 + " " + "b" * 17, "z/" * 60_000, 'password = "Xy7#qL9!vT2"', f"SECRET_KEY={HEX}", f"AWS_SECRET_ACCESS_KEY={HEX}==", "pwd: short", "token: <x>", " ".join(f"tok{k}-{'q' * (10 + k % 9)}" for k in range(3000))]
    got = {(r.doc_id, r.start, r.candidate) for r in secrets.candidates(make_docs(list(enumerate(texts)))).collect()}
    assert got == brute(texts) and (8, 13, "Xy7#qL9!vT2") in got and (9, 12, HEX) in got
    rows = {r.start: r for r in secrets.candidates(make_docs([(0, texts[0])])).collect()}
    assert rows[12].context == texts[0][:11] and rows[12].after == '" y '


def test_very_many_candidates_in_one_text(spark, make_docs):
    text = " ".join(f"identifier_number_{k}" for k in range(100_000))
    t = time.time()
    got = {(r.start, r.candidate) for r in secrets.candidates(make_docs([(0, text)])).collect()}
    assert got == {x[1:] for x in brute([text])} and len(got) == 100_000 and time.time() - t < 90


def test_scan(spark, make_docs, forest):
    text = f'The key: api_key = "{HEX}" and commit {HEX[::-1]} of /usr/lib/python/example.py'
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, f"password='{HEX}'"), (4, "plain_words_and_identifiers everywhere_in_this_text"), (5, f"SECRET_KEY={HEX}")]
    got = sorted((str(r.doc_id), r.candidate) for r in secrets.scan(make_docs(rows).selectExpr("*", "1 as start", "2 as candidate", "3 as length"), forest).collect())
    assert got == [("1", HEX), ("1", HEX), ("5", HEX), ("None", HEX)]
    assert secrets.scan(make_docs(rows).filter("false"), forest).count() == 0


def test_planted_secrets_of_the_driver_table(spark, forest):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r.doc_id, m.start(1) + 1) for r in docs.collect() for m in regex.finditer(r'token = "([0-9a-f]{40})"', r.text or "")}
    got = {(r.doc_id, r.start) for r in secrets.scan(docs, forest).collect()}
    assert want and got >= want and len(got) <= 1.05 * len(want) + 2


def test_dictionary_counts_all_texts(spark, make_docs):
    docs = make_docs([(1, "The cat and the dog"), (2, "the CAT ran. an it"), (3, None), (3, "")])
    assert secrets.dictionary(docs, size=3) == ["the", "cat", "and"]


def test_training_is_bounded_and_repeatable(spark, make_docs):
    found = secrets.labelled_findings(spark, 400)
    a, b = (secrets.scan(make_docs([(1, f"token: {HEX}")]), secrets.train(f, WORDS, max_rows=200, trees=3)).collect() for f in (found, found.repartition(3)))
    assert a == b
