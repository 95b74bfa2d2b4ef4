import pytest
from helpers import rows
from pyspark.sql import functions as F

from keyloom.functions.ranges import glob, integer
from keyloom.functions.udfs import _float_text, _lcs, _lcs_length, float_text
from keyloom.operators import keys as K
from keyloom.operators import strings as S

NOW = 1000


def text(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


@pytest.mark.parametrize(("value", "start", "stop", "want"), [("hello world", 0, 4, "hello"), ("hello world", 6, 10, "world"), ("hello", -3, -1, "llo"), ("hi", 0, 100, "hi"), ("", 0, 5, ""), ("hello", 3, 1, ""), ("hello", 0, -100, "h"), ("aéz", 2, 2, "é"), ("a漢😀z", 3, 4, "漢😀"), ("a漢😀z", 2, 2, "漢"), ("😀", 0, 0, "😀"), ("😀😀", 3, 3, "😀"), ("é" * 5000, 4001, 4001, "é")])
def test_getrange(spark, value, start, stop, want):
    assert text(spark, value).select(S.getrange(F.col("v"), start, stop)).first()[0] == want


def test_setrange(spark):
    get = lambda v, at, new: bytes(text(spark, v).select(S.setrange(F.col("v"), at, F.lit(new))).first()[0])
    assert get("hello world", 6, "Spark") == b"hello Spark"
    assert get("", 3, "hi") == b"\0\0\0hi"


def test_get_lives(spark):
    held = spark.createDataFrame([("a", "1", 0), ("b", "2", 999), ("c", "3", 1001)], "key string, v string, expires_ms long")
    asks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "x"), (5, "a")], "req int, key string")
    assert rows(S.get(held, asks, NOW)) == [(1, "a", "1"), (2, "b", None), (3, "c", "3"), (4, "x", None), (5, "a", "1")]


def test_counters(spark):
    log = spark.createDataFrame([(1, "k", 1), (2, "k", (1 << 63) - 1), (3, "k", -5), (1, "j", 4)], "seq int, key string, n long")
    want = [(1, "j", 4, "ok"), (1, "k", 1, "ok"), (2, "k", None, "overflow"), (3, "k", -4, "ok")]
    for chunk in (1, 2, 1000):
        assert rows(S.increments(log, chunk=chunk)) == want
    start = spark.createDataFrame([("j", "10"), ("k", "one")], "key string, v string")
    assert rows(S.increments(log, start)) == [(1, "j", 14, "ok"), *((i, "k", None, "not_int") for i in (1, 2, 3))]
    near = spark.createDataFrame([(1, "m", 5), (2, "m", -10), (3, "m", 9)], "seq int, key string, n long")
    high = spark.createDataFrame([("m", str((1 << 63) - 2))], "key string, v string")
    assert [tuple(r)[2:] for r in rows(S.increments(near, high))] == [(None, "overflow"), ((1 << 63) - 12, "ok"), ((1 << 63) - 3, "ok")]
    assert rows(S.totals(log)) == [("j", 4), ("k", (1 << 63) - 5)] and rows(S.totals(log.unionByName(log))) == [("j", 8), ("k", None)]


def test_floats_on_text(spark):
    held = spark.createDataFrame([("a", "10.5"), ("b", "x"), ("c", "5e3"), ("d", "1 "), ("f", "-.5")], "key string, v string")
    by = spark.createDataFrame([(k, 0.1) for k in "abcdef"], "key string, x double")
    assert rows(S.add_to_float(held, by)) == [("a", "10.59999999999999964", "ok"), ("b", None, "not_float"), ("c", "5000.1000000000003638", "ok"), ("d", None, "not_float"), ("e", "0.10000000000000001", "ok"), ("f", "-0.40000000000000002", "ok")]


def test_set_with_options(spark):
    held = spark.createDataFrame([("a", "1", 0), ("b", "2", 999)], "key string, v string, expires_ms long")
    asked = spark.createDataFrame([(1, "a", "x", None), (2, "b", "y", 50), (3, "c", "z", 0)], "req int, key string, v string, ttl_ms long")
    after, replies = S.set_options(held, asked, NOW)
    assert rows(after) == [("a", "x", 0), ("b", "y", 1050)] and rows(replies) == [(1, "a", True, "1"), (2, "b", True, None), (3, "c", False, None)]
    assert rows(S.set_options(held, asked, NOW, only_absent=True)[0]) == [("a", "1", 0), ("b", "y", 1050)]
    assert rows(S.set_options(held, asked, NOW, only_present=True)[0]) == [("a", "x", 0), ("b", "2", 999)]
    with pytest.raises(ValueError):
        S.set_options(held, asked, NOW, True, True)


def test_add_to_text(spark):
    held = spark.createDataFrame([("a", "5"), ("b", " 5"), ("c", "9223372036854775807"), ("d", "+7"), ("e", "x")], "key string, v string")
    assert rows(S.add_to_text(held, F.lit(1).cast("bigint"))) == [("a", 6, "ok"), ("b", None, "not_int"), ("c", None, "overflow"), ("d", 8, "ok"), ("e", None, "not_int")]


def test_writes(spark):
    log = spark.createDataFrame([(2, "a", "x"), (1, "a", "y"), (3, "b", "z")], "seq int, key string, v string")
    assert rows(S.last_write(log)) == [("a", "x"), ("b", "z")]
    assert rows(S.first_write(log)) == [("a", "y"), ("b", "z")]
    assert rows(S.swap(log)) == [(1, "a", "y", None), (2, "a", "x", "y"), (3, "b", "z", None)]
    assert rows(S.append(log)) == [("a", "yx", 2), ("b", "z", 1)]
    held = spark.createDataFrame([("b", "old", 0)], "key string, v string, expires_ms long")
    assert rows(S.insert_absent(log, held, NOW)) == [("a", "y")]
    pairs = log.select("key", "v").where("seq > 1")
    assert S.set_all_absent(pairs, held).count() == 0
    assert S.set_all_absent(pairs, held.where("false")).count() == 2


def test_lcs(spark):
    df = spark.createDataFrame([("ohmytext", "mynewtext"), ("", "a"), (None, "a")], "a string, b string")
    assert [tuple(r) for r in df.select(S.lcs(F.col("a"), F.col("b")), S.lcs_length(F.col("a"), F.col("b"))).collect()] == [("mytext", 6), ("", 0), (None, None)]


def test_lcs_by_table():
    """Against the whole table of common lengths, its ties broken in favour of the second text's end."""
    import random

    rng = random.Random(2)
    for _ in range(400):
        a, b = (bytes(rng.choices(b"abcd", k=rng.randint(0, 40))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = table[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(table[i - 1][j], table[i][j - 1])
        out, i, j = b"", len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                out, i, j = a[i - 1 : i] + out, i - 1, j - 1
            elif table[i - 1][j] > table[i][j - 1]:
                i -= 1
            else:
                j -= 1
        assert _lcs(a, b) == out and _lcs_length(a, b) == len(out)
    long = bytes(rng.choices(b"abcdefgh", k=4000))
    assert _lcs(long, long) == long and _lcs_length(long, long[::2]) == 2000


def test_float_text(spark):
    assert _float_text(0.1) == "0.10000000000000001" and _float_text(100.0) == "100"
    assert spark.createDataFrame([(0.1,), (None,)], "x double").select(float_text("x")).collect()[0][0] == "0.10000000000000001"


def test_globs(spark):
    df = text(spark, "user:1", "user:2", "post:1", "key1", "key2", "key10", "a.b")
    pick = lambda p: [r[0] for r in df.where(glob(F.col("v"), p)).orderBy("i").select("v").collect()]
    assert pick("user:*") == ["user:1", "user:2"]
    assert pick("key?") == ["key1", "key2"]
    assert pick("") == [] and text(spark, "").where(glob(F.col("v"), "")).count() == 1 and text(spark, "").where(glob(F.col("v"), "*")).count() == 1
    assert len(pick("*")) == 7 and pick("a.b") == ["a.b"] and pick("?.?") == ["a.b"] and pick("a?b*") == ["a.b"]
    assert [r[0] for r in text(spark, "1", " 1", "+2", "1.0", "99999999999999999999").select(integer(F.col("v"))).collect()] == [1, None, 2, None, None]


def keyspace(spark):
    return spark.createDataFrame([("a", "string", 0), ("b", "hash", 5000), ("c", "list", 1000)], "key string, type string, expires_ms long")


def asks(spark):
    return spark.createDataFrame([(i, k) for i, k in enumerate("abcda")], "req int, key string")


def test_deadlines(spark):
    ks = keyspace(spark)
    assert [r[2] for r in rows(K.remaining(ks, asks(spark), NOW))] == [-1, 4, -2, -2, -1]
    assert [r[2] for r in rows(K.remaining(ks, asks(spark), NOW, 1))] == [-1, 4000, -2, -2, -1]
    assert [r[2] for r in rows(K.deadline(ks, asks(spark), NOW))] == [-1, 5, -2, -2, -1]
    assert rows(K.expire(ks, NOW, F.lit(9000))) == [("a", "string", 9000, 1), ("b", "hash", 9000, 0)]
    assert rows(K.persist(ks, NOW)) == [("a", "string", 0, 0), ("b", "hash", 0, 1)]
    assert K.sweep(ks, NOW).count() == 2


def test_presence(spark):
    ks = keyspace(spark)
    assert K.exists(ks, asks(spark), NOW).first()[0] == 3
    assert [r[2] for r in rows(K.type_of(ks, asks(spark), NOW))] == ["string", "hash", "none", "none", "string"]
    rest, gone = K.delete(ks, asks(spark))
    assert rest.count() == 0 and gone.count() == 3
    assert K.random_key(ks, NOW).first()[0] in "ab"


def test_moves(spark):
    ks = keyspace(spark)
    moves = spark.createDataFrame([("a", "b")], "old string, new string")
    assert rows(K.rename(ks, moves, NOW)) == [("b", "string", 0), ("c", "list", 1000)]
    assert rows(K.rename(ks, moves, NOW, only_absent=True)) == rows(ks)
    assert rows(K.copy(ks, moves, NOW, replace=True)) == [("a", "string", 0), ("b", "string", 0), ("c", "list", 1000)]
    assert rows(K.copy(ks, moves, NOW)) == rows(ks)
    onto = spark.createDataFrame([("a", "c"), ("x", "y")], "old string, new string")  # c is past its deadline
    assert rows(K.copy(ks, onto, NOW)) == [("a", "string", 0), ("b", "hash", 5000), ("c", "string", 0)]
    assert rows(K.copy_replies(ks, onto.unionByName(moves), NOW)) == [("a", "b", 0), ("a", "c", 1), ("x", "y", 0)]
    assert rows(K.rename_replies(ks, onto.unionByName(moves), NOW)) == [("a", "b", 0), ("a", "c", 0), ("x", "y", None)]


def test_sweep_by_slots(spark):
    ks = spark.createDataFrame([(f"k{i}", "string", 999 if i % 2 else 0) for i in range(40)], "key string, type string, expires_ms long")
    one = K.sweep_slice(ks, NOW, 0, 3)
    assert 20 < one.count() < 40
    assert rows(K.sweep_slice(K.sweep_slice(one, NOW, 1, 3), NOW, 2, 3)) == rows(K.sweep(ks, NOW))


def test_scan_pages(spark):
    ks = spark.createDataFrame([(f"k{i:02d}", "string", 0) for i in range(10)], "key string, type string, expires_ms long")
    seen, after = [], ""
    while page := [r[0] for r in K.scan_page(ks, NOW, after, "*", 3).collect()]:
        seen += page
        after = page[-1]
    assert seen == [f"k{i:02d}" for i in range(10)]


def test_sort(spark):
    df = spark.createDataFrame([(0, "10"), (1, "x"), (2, "-1"), (3, "y"), (4, "2")], "pos int, value string")
    assert [r[1] for r in K.sort_values(df).collect()] == ["-1", "x", "y", "2", "10"]
    assert [r[1] for r in K.sort_values(df, descending=True).collect()] == ["10", "2", "y", "x", "-1"]
    assert [r[1] for r in K.sort_values(df, alpha=True, offset=1, count=2).collect()] == ["10", "2"]
