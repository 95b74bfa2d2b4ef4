import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from keyloom.operators import hashes as H
from keyloom.operators import lists as L
from keyloom.operators import sets as S
from keyloom.operators import zsets as Z


def of(spark, values, key="k"):
    return spark.createDataFrame([(key, i, v, len(values)) for i, v in enumerate(values)], "key string, pos long, value string, n long")


def items(df):
    return [v for _, _, v in rows(df, "key", "pos", "value")]


@pytest.mark.parametrize(("count", "want"), [(2, "bca"), (-2, "abc"), (0, "bc")])
def test_lrem(spark, count, want):
    assert items(L.lrem(of(spark, "abaca"), count, "a")) == list(want)


def test_linsert_lpos(spark):
    abc = of(spark, "abc")
    assert items(L.linsert(abc, "b", "x")) == list("axbc")
    assert items(L.linsert(abc, "b", "x", before=False)) == list("abxc")
    assert items(L.linsert(abc, "z", "x")) == list("abc")
    df = of(spark, "abcbdb")
    assert rows(L.lpos(df, "b", count=0)) == [("k", 1), ("k", 3), ("k", 5)]
    assert rows(L.lpos(df, "b")) == [("k", 1)]
    assert rows(L.lpos(df, "b", rank=-1)) == [("k", 5)]
    with pytest.raises(ValueError):
        L.lpos(df, "b", rank=0)


@pytest.mark.parametrize(("start", "stop"), [(0, -1), (1, 2), (-2, -1), (0, -100), (5, 9), (3, 1), (-100, 1)])
def test_lrange_model(spark, start, stop):
    v = list("abcd")
    low, high = (max(0, len(v) + x) if x < 0 else x for x in (start, stop))
    assert items(L.lrange(of(spark, v), start, stop)) == v[low : min(high, 3) + 1]
    assert items(L.ltrim(of(spark, v), start, stop)) == v[low : min(high, 3) + 1]


def test_push_pop_move(spark):
    log = spark.createDataFrame([(1, "k", "x"), (2, "k", "y"), (1, "new", "z")], "seq int, key string, value string")
    df = of(spark, "ab")
    assert items(L.push(df, log.where("key = 'k'"), left=True)) == list("yxab")
    assert items(L.push(df, log.where("key = 'k'"))) == list("abxy")
    gone, kept = L.pop(of(spark, "abcd"), 3, left=False)
    assert [r[2] for r in rows(gone)] == list("dcb") and items(kept) == ["a"]
    two = of(spark, "ab").unionByName(of(spark, "z", "j"))
    moved = L.lmove(two, spark.createDataFrame([("k", "j")], "src string, dst string"), False, True)
    assert rows(moved) == [("j", 0, "b"), ("j", 1, "z"), ("k", 0, "a")]
    asks = spark.createDataFrame([(1, 0, "none"), (1, 1, "j"), (1, 2, "k"), (2, 0, "none")], "req int, arg int, key string")
    assert rows(L.first_of(two, asks)) == [(1, "j", "z")]
    assert rows(L.lindex(df, -1)) == [("k", "b")] and rows(L.lindex(df, 5)) == []


def test_hashes(spark):
    old = spark.createDataFrame([("h", "a", "1"), ("h", "b", "2")], "key string, field string, value string")
    log = spark.createDataFrame([(1, "h", "a", "up"), (2, "h", "c", "3")], "seq int, key string, field string, value string")
    assert rows(H.hset(old, log)) == [("h", "a", "up", False), ("h", "b", "2", False), ("h", "c", "3", True)]
    assert rows(H.hsetnx(old, log)) == [("h", "c", "3")]
    by = spark.createDataFrame([("h", "a", 5, 0.5), ("h", "t", 1, 1.5), ("h", "x", 7, 7.0)], "key string, field string, n long, x double")
    held = old.unionByName(spark.createDataFrame([("h", "t", "text")], old.schema))
    assert rows(H.hincrby(held, by)) == [("h", "a", 6, "ok"), ("h", "t", None, "not_int"), ("h", "x", 7, "ok")]
    top = spark.createDataFrame([("h", "a", str((1 << 63) - 1))], old.schema)
    assert rows(H.hincrby(top, by.where("field = 'a'"))) == [("h", "a", None, "overflow")]
    rest, gone = H.hdel(old, spark.createDataFrame([("h", "a"), ("h", "a"), ("h", "q")], "key string, field string"))
    assert rows(rest) == [("h", "b", "2")] and gone.count() == 1


def members(spark, **sets):
    return spark.createDataFrame([(k, str(m)) for k, v in sets.items() for m in v], "key string, member string")


def asked(spark, *keys):
    return spark.createDataFrame([("r", i, k, 1.0) for i, k in enumerate(keys)], "req string, arg int, key string, weight double")


def test_set_algebra(spark):
    df = members(spark, a=[1, 2, 3], b=[2, 3, 4], c=[9])
    get = lambda f, *k: {r[1] for r in rows(f(df, asked(spark, *k)))}
    assert get(S.union, "a", "b") == {"1", "2", "3", "4"}
    assert get(S.intersect, "a", "b") == {"2", "3"} and get(S.intersect, "a", "c") == set() and get(S.intersect, "a", "none") == set()
    assert get(S.difference, "a", "b") == {"1"} and get(S.difference, "none", "b") == set()
    assert rows(S.intersection_size(df, asked(spark, "a", "b"), 1)) == [("r", 1)]
    assert rows(S.intersection_size(df, asked(spark, "a", "c"))) == [("r", 0)]
    u, i, a, b = (len(get(f, *k)) for f, k in ((S.union, "ab"), (S.intersect, "ab"), (S.union, "a"), (S.union, "b")))
    assert u == a + b - i


def test_set_members(spark):
    df = members(spark, s=[1, 2, -3, "01"])
    asks = spark.createDataFrame([(1, "s", "1"), (2, "s", "01"), (3, "s", "+1")], "req int, key string, member string")
    assert [r[3] for r in rows(S.is_member(df, asks))] == [1, 1, 0]
    assert {r[1] for r in rows(S.first_members(df, 2))} == {"-3", "1"}
    moves = spark.createDataFrame([("s", "t", "1"), ("s", "t", "77")], "src string, dst string, member string")
    assert ("t", "1") in rows(S.move(df, moves)) and S.move(df, moves).count() == 4


def scores(spark, key="z", **values):
    return spark.createDataFrame([(key, m, float(s)) for m, s in values.items()], "key string, member string, score double")


@pytest.mark.parametrize(("mode", "want"), [("", {"a": 1.0, "b": 9.0, "c": 5.0}), ("nx", {"a": 3.0, "b": 4.0, "c": 5.0}), ("xx", {"a": 1.0, "b": 9.0}), ("gt", {"a": 3.0, "b": 9.0, "c": 5.0}), ("lt", {"a": 1.0, "b": 4.0, "c": 5.0})])
def test_zadd(spark, mode, want):
    log = spark.createDataFrame([(1, "z", "a", 1.0), (2, "z", "b", 9.0), (3, "z", "c", 5.0)], "seq int, key string, member string, score double")
    assert {r.member: r.score for r in Z.add(scores(spark, a=3, b=4), log, mode).collect()} == want


def test_zset_ranges(spark):
    df = scores(spark, a=1, b=2, c=3, d=4)
    names = lambda x: [r[2] for r in rows(x)]
    s = F.col("score")
    assert names(Z.by_range(df, Z.between(s, 2, 3))) == ["b", "c"]
    assert names(Z.by_range(df, Z.between(s, 1, 4), offset=1, count=2)) == ["b", "c"]
    assert rows(Z.count(df, Z.between(s, 2, 3))) == [("z", 2)]
    assert names(Z.by_rank(df, 0, 1)) == ["a", "b"] and names(Z.by_rank(df, -2, -1)) == ["c", "d"]
    assert names(Z.by_rank(df, 9, 12)) == ["d"] and names(Z.by_rank(df, 0, 1, True)) == ["d", "c"]
    assert [r[2] for r in rows(Z.rank(df))] == [0, 1, 2, 3] and [r[2] for r in rows(Z.rank(df, True))] == [3, 2, 1, 0]
    assert names(Z.pop(df, 2, True)) == ["d", "c"]


def test_zset_merges(spark):
    df = scores(spark, "a", x=1, y=2, z=3).unionByName(scores(spark, "b", y=10, z=20, w=4))
    ask = asked(spark, "a", "b")
    assert {r[1]: r[2] for r in rows(Z.union(df, ask))} == {"x": 1, "y": 12, "z": 23, "w": 4}
    assert {r[1]: r[2] for r in rows(Z.intersect(df, ask))} == {"y": 12, "z": 23}
    heavy = ask.withColumn("weight", F.when(F.col("arg") == 0, 2.0).otherwise(3.0))
    assert {r[1]: r[2] for r in rows(Z.intersect(df, heavy, "max"))} == {"y": 30, "z": 60}
    assert {r[1]: r[2] for r in rows(Z.intersect(df, heavy, "min"))} == {"y": 4, "z": 6}
    assert {r[1]: r[2] for r in rows(Z.difference(df, ask))} == {"x": 1}


def test_random_set_model(spark):
    rng = random.Random(4)
    held = {k: {str(rng.randint(0, 30)) for _ in range(15)} for k in "abcdef"}
    df = members(spark, **held)
    ask = spark.createDataFrame([(f"{x}{y}", i, k, 1.0) for x in held for y in held if x != y for i, k in enumerate((x, y))], "req string, arg int, key string, weight double")
    for f, model in ((S.union, set.union), (S.intersect, set.intersection), (S.difference, set.difference)):
        got = {}
        for req, member in rows(f(df, ask)):
            got.setdefault(req, set()).add(member)
        for x in held:
            for y in held:
                if x != y:
                    assert got.get(x + y, set()) == model(held[x], held[y])
