import hashlib

from headway.llm import sharding


def brute(rows, limit):
    keys = [(i, len((t or "").encode()), f"{int(hashlib.md5(('' if i is None else str(i)).encode()).hexdigest()[:15], 16):060b}") for i, t in rows]
    out = []
    for i, n, bits in keys:
        for d in range(61):
            mates = [k for k in keys if k[2].startswith(bits[:d])]
            if sum(k[1] for k in mates) <= limit or len(mates) == 1 or d == 60:
                out.append((i, n, bits[:d], d, sum(k[1] for k in mates), len(mates)))
                break
    return out


def rows_of(df, limit):
    return [tuple(r) for r in sharding.shard(df, limit).collect()]


def test_splits_like_brute_force(spark, make_docs):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(300)] + [(None, None), (900, "y" * 5000), (901, ""), (5, "x" * 300), (5, "x" * 300)]
    by = lambda r: (r[2], str(r[0]), r[1])
    for limit in (1500, 100_000_000):
        got = rows_of(make_docs(rows).selectExpr("*", "1 as h", "2 as shard", "3 as own", "4 as _root"), limit)
        assert sorted(got, key=by) == sorted(brute(rows, limit), key=by)


def test_rows_of_one_key_are_split(spark, make_docs):
    rows = [(7, f"{i % 5}" * 100) for i in range(60)] + [(None, "y" * 300)] * 20 + [(i, "x" * 90) for i in range(100, 140)] + [(8, "z" * 5000)] * 3
    for out in (sharding.shard(make_docs(rows), 1000), sharding.sharded_rows(make_docs(rows), 1000)):
        got = out.collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
        shards = {}
        for r in got:
            shards.setdefault(r.shard, []).append(r)
        size = (lambda r: r.n_bytes) if "n_bytes" in out.columns else lambda r: len(r.text)
        for name, members in shards.items():
            total = sum(map(size, members))
            assert all(r.shard_bytes == total and r.shard_docs == len(members) and r.depth == len(name) for r in members)
            assert total <= 1000 or len(members) == 1
        # no shard's bits begin another's
        names = sorted(shards)
        assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
        # rows with other keys are where they would be without the hot ones
        plain = {r[0]: r[2] for r in brute([r for r in rows if r[0] not in (7, 8, None)], 1000)}
        assert all(shards_of.startswith(plain[r.doc_id]) for r in got if r.doc_id in plain for shards_of in [r.shard])


def test_deep_splits_take_further_rounds(spark, make_docs, monkeypatch):
    rows = [(i, "x" * 100) for i in range(64)]
    real = sharding.directory
    monkeypatch.setattr(sharding, "directory", lambda r, limit: real(r, limit, step=1))
    by = lambda r: (r[2], str(r[0]), r[1])
    assert sorted(rows_of(make_docs(rows), 100), key=by) == sorted(brute(rows, 100), key=by)


def test_a_large_directory_is_not_broadcast(spark, make_docs, monkeypatch):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(100)]
    monkeypatch.setattr(sharding, "BROADCAST_BYTES", 0)
    out = sharding.shard(make_docs(rows), 1500)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == sorted(brute(rows, 1500))


def test_empty_table(spark, make_docs):
    assert rows_of(make_docs([(1, "a")]).filter("false"), 10) == []


def test_columns_with_clashing_names_keep_their_values(spark, make_docs):
    df = make_docs([(i, "x" * i) for i in range(20)] + [(None, None)]).selectExpr("*", "doc_id * 2 as h", "7 as _cell", "'mine' as shard", "8 as cell_depth", "9 as _row", "10 as own", "11 as `a.b`")
    out = sharding.sharded_rows(df, 50)
    rows = out.collect()
    assert len(rows) == 21 and out.columns.count("shard") == 1
    assert all(r.h == (None if r.doc_id is None else r.doc_id * 2) and r._cell == 7 and r.cell_depth == 8 and r._row == 9 and r.shard != "mine" for r in rows)
