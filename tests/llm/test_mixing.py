import collections
import re

from headway.llm import mixing


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_w = sum(w[s] for s in names if s not in full)
        t = {s: 2.0 * sizes[s] if s in full else left * w[s] / open_w for s in names}
        more = {s for s in names if s not in full and t[s] > 2 * sizes[s]}
        if not more:
            return t
        full |= more


def check(df, rows):
    out = [r.asDict() for r in mixing.mix(df)[0].drop("begun").collect()]
    assert len(out) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[2]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(size) if any(size.values()) else {s: 0.0 for s in size}
    got = collections.Counter()
    for r in out:
        assert r["source_size"] == size[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        got[r["source"]] += r["taken"]
    for s in size:
        assert abs(got[s] - want[s]) <= max(2, 0.02 * want[s]), (s, got[s], want[s])
    return sorted(map(str, out))


def test_targets_are_met_and_runs_agree(spark, make_docs):
    rows = [(i, "w " * (i % 97), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(600)]
    rows += [(1000, None, None), (1001, "", "empty"), (1002, "a b c " * 3000, None), (7, "w " * 7, "s0"), (7, "w " * 7, "s0"), (None, "x y", "s1")]
    df = make_docs(rows)
    assert check(df, rows) == check(df.repartition(7), rows)


def test_empty_table(spark, make_docs):
    assert mixing.mix(make_docs([(1, "a", "s")]).filter("false"))[0].count() == 0


def test_only_empty_texts(spark, make_docs):
    rows = [(1, "", "a"), (2, None, None)]
    check(make_docs(rows), rows)


def test_small_sources_of_skewed_tables_reach_their_targets(spark, make_docs):
    rows = [(i, "w " * 20_000, "hot") for i in range(60)]
    rows += [(1000 + i, "a b c d e", "tiny") for i in range(8)] + [(2000 + i, "x " * 70, "small") for i in range(10)] + [(3000, "y z", None), (3001, "q", "one")]
    rows += [(4000 + 100 * k + i, "v " * 13, f"t{k}") for k in range(9) for i in range(7)]
    check(make_docs(rows), rows)
    many = mixing.source_targets(spark.createDataFrame([("hot", 80_000_000), ("a", 100), ("b", 1500), ("c", 70_000)], "source string, source_size long"))
    t = mixing.blocked(many, 662)
    plays = mixing.schedule(t, t.agg({"slots": "sum"}).first()[0]).groupBy("source").agg({"cut": "sum"}).collect()
    assert dict(plays) == {r.source: int(r.target) for r in many.collect()}


def test_columns_of_any_name_are_kept(spark, make_docs):
    df = make_docs([(i, "a b c " * (i + 1), f"s{i % 2}") for i in range(12)]).selectExpr("*", "doc_id * 2 as _begun", "doc_id * 3 as _id", "doc_id * 5 as _copy", "doc_id * 7 as `a.b`", "doc_id * 11 as _row")
    out = mixing.mixed_rows(df)
    rows = out.collect()
    assert out.columns == df.columns and rows
    assert all(r._begun == 2 * r.doc_id and r._id == 3 * r.doc_id and r._copy == 5 * r.doc_id and r["a.b"] == 7 * r.doc_id and r._row == 11 * r.doc_id for r in rows)
