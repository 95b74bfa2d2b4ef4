import random
import re
from datetime import datetime, timedelta

from helpers import DATA, rows
from pyspark.sql import functions as F

from keyloom.operators import streams as X
from keyloom.operators.pubsub import _globs, lookups, publish
from keyloom.plans import live as plans
from keyloom.streaming import live


def run(df, mode="append"):
    query = df.writeStream.format("memory").queryName(name := f"t{random.randrange(1 << 40)}").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, tmp_path, df):
    df.coalesce(1).write.parquet(path := str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(path)


def test_fold_model(spark, tmp_path):
    rng = random.Random(5)
    ops = ["set", "get", "getset", "incrby", "append", "strlen", "rpush", "lpush", "rpop", "lpop", "llen", "del"]
    log = [(f"k{rng.randrange(4)}", i, rng.choice(ops), str(rng.randrange(20))) for i in range(300)]
    held, want = {}, []
    for key, seq, op, arg in log:
        v = held.get(key)
        if op == "del":
            reply = str(int(held.pop(key, None) is not None))
        elif op == "set":
            held[key], reply = arg, "OK"
        elif op == "getset":
            held[key], reply = arg, v if isinstance(v, str) else None
        elif op in ("rpush", "lpush", "rpop", "lpop", "llen"):
            if isinstance(v, str):
                reply = "WRONGTYPE"
            elif op.endswith("push"):
                held[key] = (v or []) + [arg] if op == "rpush" else [arg] + (v or [])
                reply = str(len(held[key]))
            elif op == "llen":
                reply = str(len(v or []))
            else:
                reply = v.pop(-1 if op == "rpop" else 0) if v else None
        elif isinstance(v, list):
            reply = None if op == "get" else "WRONGTYPE"
        elif op == "get":
            reply = v
        elif op == "strlen":
            reply = str(len(v or ""))
        elif op == "append":
            held[key] = (v or "") + arg
            reply = str(len(held[key]))
        else:
            held[key] = reply = str(int(v or 0) + int(arg))
        want.append((key, seq, reply))
    df = spark.createDataFrame(log, "key string, seq long, op string, arg string")
    got = rows(run(live.fold(source(spark, tmp_path, df))))
    assert sorted(got, key=lambda r: r[1]) == want


def test_fold_survives_malformed_requests(spark, tmp_path):
    most = str((1 << 63) - 1)
    log = [("a", "incrby", "x"), ("a", "incrby", "\u00b2"), ("a", "incrby", "+-5"), ("a", "incrby", None), ("a", "set", None), ("a", "nosuch", "1"), ("a", "set", most), ("a", "incrby", "1"), ("a", "incrby", "-7"),
           ("a", "set", "9" * 5000), ("a", "incrby", "1"), ("a", "get", None), ("a", "set", "+4"), ("a", "incrby", "1")]
    df = spark.createDataFrame([(k, i, op, arg) for i, (k, op, arg) in enumerate(log)], "key string, seq long, op string, arg string")
    got = [r[2] for r in sorted(rows(run(live.fold(source(spark, tmp_path, df)))), key=lambda r: r[1])]
    assert got == ["NOTINT", "NOTINT", "NOTINT", "NOTINT", "ERR", "ERR", "OK", "OVERFLOW", str((1 << 63) - 8), "OK", "NOTINT", "9" * 5000, "OK", "5"]


def test_route_and_counters(spark, tmp_path):
    subs = spark.createDataFrame([("a", "exact", "ch"), ("a", "glob", "c*")], "subscriber string, kind string, pattern string")
    msgs = spark.createDataFrame([(1, "ch", "x"), (2, "cx", "y"), (3, "z", "z")], "msg long, channel string, payload string")
    got = run(live.route(source(spark, tmp_path, msgs), subs))
    assert [(r[0], r[4]) for r in rows(got)] == [(1, "exact"), (1, "glob"), (2, "glob")]
    log = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "key string, n long")
    assert rows(run(live.counters(source(spark, tmp_path / "c", log)), "complete")) == [("a", 3), ("b", 5)]


def test_route_looks_up_no_more_parts_than_globs_have(spark, tmp_path):
    patterns = ["ab*", "abc?z", "*yz", "?b*yz", "*", "?", "x?", "", "long" + "g" * 3000 + "*"]
    subs = spark.createDataFrame([("s", "glob", p) for p in patterns], "subscriber string, kind string, pattern string")
    channels = ["abcyz", "abcdyz", "ab", "b", "", "xy", "yz", None, "\u00e9byz", "long" + "g" * 5000]
    msgs = spark.createDataFrame(list(enumerate(channels)), "msg long, channel string").withColumn("payload", F.lit("p"))
    globs = [re.compile("".join({"*": ".*", "?": "."}.get(c, c) for c in p)) for p in patterns]
    want = sorted((i, p) for i, c in enumerate(channels) if c is not None for p, g in zip(patterns, globs, strict=True) if g.fullmatch(c))
    assert rows(run(live.route(source(spark, tmp_path, msgs), subs)), "msg", "pattern") == want == rows(publish(msgs, subs), "msg", "pattern")
    found = run(lookups(source(spark, tmp_path / "l", msgs), _globs(subs)).groupBy("msg").agg(F.count("*").alias("n")), "complete")
    assert max(r.n for r in found.collect()) == 6  # not one for each of the 5004 characters, twice


def test_publish_never_broadcasts_the_messages(spark, monkeypatch):
    monkeypatch.setattr(plans, "finished", lambda rows, name: rows)
    monkeypatch.setattr(plans, "_events", lambda spark, d: spark.read.parquet(f"{d}/events.parquet"))  # plans of a stream can't be asked for
    plan = plans.PLANS["live_publish"].run(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == plan.count("rightHint=(strategy=broadcast)") == 3 and "leftHint" not in plan


def test_log_and_retention(spark, tmp_path):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", i % 6, 0, t + timedelta(seconds=i)) for i in range(8)], "key string, ms long, seq long, ts timestamp")
    stream = source(spark, tmp_path, df)
    assert run(live.distinct_entries(stream, "ts", "1 minute", "key", "ms", "seq")).count() == 6
    out = str(tmp_path / "kept")
    stream.drop("ts").writeStream.foreachBatch(live.retain(out, 3)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.read.parquet(f"{out}/0").count() == 3 == X.trim(df.drop("ts"), 3).count()
    sink = live.retain(out, 3)
    for number in (1, 2, 3):
        sink(spark.createDataFrame([("s", 100 + number, 0)], "key string, ms long, seq long"), number)
    assert sorted(p.name for p in (tmp_path / "kept").iterdir() if p.is_dir()) == ["2", "3"]
    assert [r.ms for r in spark.read.parquet(f"{out}/3").orderBy("ms").collect()] == [101, 102, 103]
