import json
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from keyloom.operators import bitmaps as B
from keyloom.operators import control
from keyloom.operators import geo as G
from keyloom.operators import hll as P
from keyloom.operators import json_docs as J
from keyloom.operators import pubsub as M
from keyloom.operators import streams as X
from keyloom.sources import oplog, snapshot


def docs(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) or v is None else json.dumps(v, separators=(",", ":")),) for v in values], "doc string")


def one(spark, value, column):
    return docs(spark, value).select(column(F.col("doc"))).first()[0]


def test_json_paths(spark):
    assert one(spark, {"a": {"b": 1}}, lambda d: J.set_path(d, "$.a.b", "42")) == '{"a":{"b":42}}'
    many = one(spark, {"tea": 3, "milk": "oat", "pot": [0]}, lambda d: J.get_many(d, ["$.pot", "milk", "$.no"]))
    assert json.loads(many) == {"$.pot": [0], "milk": "oat", "$.no": None}
    assert one(spark, {"l": [{"x": 7}]}, lambda d: J.get(d, "$.l.[0].x")) == "7"
    assert one(spark, {"l[0]": 3}, lambda d: J.get(d, "$.l[0]")) == "3"
    assert one(spark, "not json", lambda d: J.get(d, "$.a")) is None
    assert one(spark, "not json", lambda d: J.set_path(d, "$.a", "1")) is None
    assert one(spark, None, lambda d: J.delete_path(d, "$.a")) is None
    assert one(spark, {"b": 1, "a": 2}, lambda d: J.set_path(d, "$.c", '"z"')) == '{"b":1,"a":2,"c":"z"}'


@pytest.mark.parametrize(("edit", "want"), [
    (lambda d: J.array_insert(d, "$", 2, 0), [7, 8, 0]), (lambda d: J.array_append(d, "$", [9]), [7, 8, [9]]),
    (lambda d: J.array_pop(d, "$", -1), [7]), (lambda d: J.array_pop(d, "$", -99), [8]), (lambda d: J.clear(d, "$"), []),
    (lambda d: J.array_trim(d, "$", 1, 9), [8]), (lambda d: J.array_trim(d, "$", 5, 9), []),
])
def test_json_arrays(spark, edit, want):
    assert json.loads(one(spark, [7, 8], edit)) == want


def test_json_reads(spark):
    assert one(spark, [4, 6, 4, 6, 6], lambda d: J.arrindex(d, "$", 6)) == 1
    assert one(spark, [4, 6, 4, 6, 6], lambda d: J.arrindex(d, "$", 6, 2)) == 3
    assert one(spark, [4, 6], lambda d: J.arrindex(d, "$", 5)) == -1
    assert one(spark, [[], [0], {}], lambda d: J.arrlen(d, "$")) == 3
    assert one(spark, {"n": 2.5}, lambda d: J.number(d, "$.n")) == 2.5
    assert one(spark, {"n": "2.5"}, lambda d: J.number(d, "$.n")) is None
    assert one(spark, {"s": "é"}, lambda d: J.strlen(d, "$.s")) == 2
    assert one(spark, {"t": None}, lambda d: J.type_of(d, "$.t")) == "null"
    assert json.loads(one(spark, {"t": True, "n": 1}, lambda d: J.toggle(d, "$.t"))) == {"t": False, "n": 1}
    assert one(spark, {"n": 1}, lambda d: J.toggle(d, "$.n")) is None
    assert json.loads(one(spark, {"n": 1.5}, lambda d: J.multiply(d, "$.n", 2))) == {"n": 3}
    assert json.loads(one(spark, {"s": "a"}, lambda d: J.append_text(d, "$.s", '"b"'))) == {"s": "ab"}


def bits(spark, **sets):
    return spark.createDataFrame([(k, o) for k, v in sets.items() for o in v], "key string, off long")


def test_bitcount(spark):
    df = bits(spark, a=[3, 5], b=range(4, 19), c=[11, 12, 30])
    n = lambda *args: dict(rows(B.bitcount(df, *args)))
    assert n() == {"a": 2, "b": 15, "c": 3}
    assert n(0, 0)["b"] == 4 and n(1, 1)["b"] == 8 and n(-1, -1)["b"] == 3
    assert n(11, 29, "bit")["c"] == 2 and n(-2, -1, "bit")["c"] == 1


def test_bitop(spark):
    df = bits(spark, a=[2, 5], b=[5, 14])
    ask = spark.createDataFrame([("r", "a"), ("r", "b")], "req string, key string")
    got = lambda op: [r[1] for r in rows(B.bitop(df, ask, op))]
    assert got("or") == [2, 5, 14] and got("and") == [5] and got("xor") == [2, 14]
    assert rows(B.bitnot(bits(spark, k=[3, 9]))) == [("k", i) for i in range(16) if i not in (3, 9)]
    assert dict(rows(B.bitpos(bits(spark, a=[0, 1, 3], b=range(8), c=[5]), 0))) == {"a": 2, "b": 8, "c": 0}
    assert {k: bytes(v) for k, v in rows(B.to_binary(df))} == {"a": b"\x24", "b": b"\x04\x02"}


def test_bitfield(spark):
    df = bits(spark, k=[0, 1, 2, 3])
    assert rows(B.field(df, 4, 0)) == [("k", 15)] and rows(B.field(df, 4, 0, signed=True)) == [("k", -1)]
    up = lambda how: rows(B.field(B.set_field(df, 4, 0, F.coalesce(B.fit(F.col("value") + 3, 4, False, how), F.col("value"))).unionByName(bits(spark, k=[20])), 4, 0))
    assert up("wrap") == [("k", 2)] and up("sat") == [("k", 15)] and up("fail") == [("k", 15)]
    after, replies = B.fields(df, [("set", 4, B.indexed(1, 4), True, -3), ("get", 8, 0, False), ("incrby", 4, 4, True, -6, "wrap"), ("incrby", 4, 4, True, 100, "fail"), ("set", 8, 0, False, 0), ("get", 3, 1, False)])
    assert [r[2] for r in rows(replies)] == [0, 0xFD, 7, None, 0xF7, 0] and after.count() == 0
    with pytest.raises(ValueError):
        B.fields(df, [("get", 63, 0, False)])


def test_hll(spark):
    many = spark.range(20_000).select(F.lit("k").alias("key"), F.concat("id", F.lit("@mail")).alias("member"))
    assert abs(P.count(P.sketches(many)).first().estimate - 20_000) < 800
    two = spark.createDataFrame([(k, m) for k, v in (("a", "pqrs"), ("b", "rstu"), ("a", [None])) for m in v], "key string, member string")
    ask = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "none")], "req string, key string")
    held = P.sketches(two)
    assert rows(P.count(held)) == [("a", 4), ("b", 4)] and rows(P.count(P.merge(held, ask))) == [("u", 6)]
    more = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "x")], "key string, member string")
    after = P.add(held, more)
    assert rows(after.select("key", "changed")) == [("a", False), ("b", True), ("c", True)] and rows(P.count(after)) == [("a", 4), ("b", 5), ("c", 1)]


@pytest.mark.parametrize("many", [20, 1536, 1537, 5000, 40_000])
def test_hll_add_again(spark, many):
    """Members that are there change nothing, whether a sketch was made in one piece or of several."""
    ids = lambda a, b: spark.range(a, b).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("member"))
    for n, m in ((1, 1), (1, 3), (3, 1), (3, 3)):
        held, again = P.sketches(ids(0, many).repartition(n)), ids(0, many).repartition(m)
        for rows_, changed in ((again, False), (ids(many // 2, many), False), (ids(many // 2, many + 1 + many // 10), True)):
            after = P.add(held, rows_)
            assert rows(after.select("key", "changed")) == [("k", changed)]
            assert rows(P.add(after, again).select("key", "changed")) == [("k", False)]


PLACES = [("it", "Palermo", 13.361389, 38.115556), ("it", "Catania", 15.087269, 37.502669), ("it", "Paris", 2.349014, 48.864716)]


def test_geo(spark):
    df = spark.createDataFrame(PLACES, "key string, member string, lon double, lat double")
    geo = G.add(df)
    for key, member, _, lon, lat in rows(G.positions(geo)):
        want = next(p for p in PLACES if p[1] == member)
        assert abs(lon - want[2]) < 1e-5 and abs(lat - want[3]) < 1e-5 and key == "it"
    assert [r.member for r in G.search(geo, 15, 37, 200, unit="km").orderBy("rank").collect()] == ["Catania", "Palermo"]
    assert [r.member for r in G.search(geo, 15, 37, box=(400, 400), unit="km", count=1).collect()] == ["Catania"]
    pairs = spark.createDataFrame([(1, "it", "Palermo", "Catania"), (2, "it", "Palermo", "Rome")], "req int, key string, a string, b string")
    got = rows(G.distance(geo, pairs))
    assert abs(got[0][4] - 166274) < 50 and got[1][4] is None
    assert G.add(spark.createDataFrame([("k", "pole", 0.0, 89.0)], df.schema)).count() == 0
    twice = spark.createDataFrame([("k", "m", 10.0, 10.0, 2), ("k", "m", 20.0, 20.0, 1)], "key string, member string, lon double, lat double, seq int")
    for n in (1, 5):
        assert abs(G.positions(G.add(twice.repartition(n), "seq")).first().lon - 20) < 1e-5
    moved = spark.createDataFrame([("it", "Paris", 0.0, 0.0), ("it", "Rome", 12.5, 41.9)], df.schema)
    assert {r.member: (r.added, r.changed) for r in G.add_to(geo, moved).collect()} == {"Palermo": (False, False), "Catania": (False, False), "Paris": (False, True), "Rome": (True, False)}
    assert {r.member: r.changed for r in G.add_to(geo, moved, "nx").collect()} == dict.fromkeys(["Palermo", "Catania", "Paris", "Rome"], False)
    assert "Rome" not in {r.member for r in G.add_to(geo, moved, "xx").collect()}
    asked = spark.createDataFrame([(1, "it", "Palermo"), (2, "it", "Nowhere")], "req int, key string, member string")
    assert {r.near for r in G.search_members(geo, asked, 200, "km").collect()} == {"Palermo", "Catania"}


def test_cells_cover_circles():
    """Every place within the distance lies in the ranges, at poles and the date line too."""
    import math
    import random

    rng = random.Random(3)
    spread = lambda v: sum((v >> i & 1) << 2 * i for i in range(26))
    cell = lambda v, bound: min(G.CELLS - 1, max(0, int((v + bound) / (2 * bound) * G.CELLS)))
    for _ in range(300):
        lon, lat = rng.choice((-180.0, 179.99, 0.0, rng.uniform(-180, 180))), rng.choice((-85.0, 85.0, 0.0, rng.uniform(-85, 85)))
        reach = 10 ** rng.uniform(0, 7.4)
        ranges = G.cover(lon, lat, *G._reach(lat, reach, reach, True))
        assert len(ranges) <= 49 or reach > 5e6
        for _ in range(40):
            far, turn = reach / G.RADIUS * rng.random(), rng.uniform(0, 2 * math.pi)
            a = math.radians(lat)
            y = math.asin(max(-1, min(1, math.sin(a) * math.cos(far) + math.cos(a) * math.sin(far) * math.cos(turn))))
            x = math.radians(lon) + math.atan2(math.sin(turn) * math.sin(far) * math.cos(a), math.cos(far) - math.sin(a) * math.sin(y))
            x = (math.degrees(x) + 180) % 360 - 180
            if abs(math.degrees(y)) <= G.LATITUDE:
                h = spread(cell(x, 180.0)) << 1 | spread(cell(math.degrees(y), G.LATITUDE))
                assert any(low <= h <= high for low, high in ranges), (lon, lat, reach, x, math.degrees(y))


def stream(spark, *ids, key="s"):
    return spark.createDataFrame([(key, m, s) for m, s in ids], "key string, ms long, seq long")


def test_streams(spark):
    df = stream(spark, *((i, 0) for i in range(1, 6)))
    ids = lambda x: [r.ms for r in x.orderBy("rank").collect()]
    assert ids(X.between(df)) == [1, 2, 3, 4, 5] and ids(X.between(df, count=2)) == [1, 2]
    assert ids(X.between(df, "2-0", "4-0")) == [2, 3, 4] and ids(X.between(df, newest_first=True)) == [5, 4, 3, 2, 1]
    assert ids(X.between(df, "4", "2")) == [] and ids(X.between(df, "2", "3")) == [2, 3]
    assert X.trim(df, 3).count() == 3 and X.trim(df).count() == 0
    at = spark.createDataFrame([("s", 3, 0)], "key string, last_ms long, last_seq long")
    assert ids(X.read(df, at)) == [3, 4, 5]
    assert X.delete(df, stream(spark, (2, 0), (9, 9))).count() == 4
    assert rows(X.create_groups(df, "g")) == [("s", "g", 5, 0)]


def test_pubsub(spark):
    subs = spark.createDataFrame([("a", "exact", "ch"), ("a", "glob", "c*"), ("b", "glob", "log.*"), ("c", "glob", "n[w")], "subscriber string, kind string, pattern string")
    msgs = spark.createDataFrame([(1, "ch", "x"), (2, "log.error", "y"), (3, "logXinfo", "z"), (4, "n[w", "q")], "msg int, channel string, payload string")
    assert [r[2] for r in rows(M.receivers(msgs, subs))] == [2, 1, 0, 1]
    ends = spark.createDataFrame([("d", "glob", "*.error"), ("e", "glob", "?og.*r"), ("f", "glob", "*og*"), ("g", "glob", "*"), ("h", "glob", "?h"), ("i", "glob", "*error.")], subs.schema)
    got = sorted((r.msg, r.subscriber) for r in M.publish(msgs, ends).collect())
    assert got == [(1, "g"), (1, "h"), (2, "d"), (2, "e"), (2, "f"), (2, "g"), (3, "f"), (3, "g"), (4, "g")]
    assert M.publish(msgs.withColumn("channel", F.lit("")), ends).select("subscriber").distinct().collect() == [("g",)]
    assert rows(M.channels(subs)) == [("ch",)] and M.patterns(subs).first()[0] == 3
    every = spark.createDataFrame([("a", "glob", None)], subs.schema)
    assert M.unsubscribe(subs, every).count() == 3


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("a", "ü", 0), ("b", "x", 500), ("c", "y", 100_000)], "key string, v string, expires_ms long")
    path = f"file://{tmp_path}/held"
    with pytest.raises(FileNotFoundError):
        snapshot.load(spark, path, "str", 1000)
    assert snapshot.last_saved(spark, path).first()[0] is None
    snapshot.save({"str": df}, path)
    assert rows(snapshot.load(spark, path, "str", 1000)) == [("a", "ü", 0), ("c", "y", 100_000)]
    # a save that fails half way leaves the last version, and the next one takes its place
    with pytest.raises(Exception):  # noqa: B017
        snapshot.save({"str": df.where("key = 'c'"), "bad": df.select(F.raise_error(F.lit("no")).alias("x"))}, path)
    assert snapshot.load(spark, path, "str", 1000).count() == 2
    for key in "ac":
        snapshot.save({"str": df.where(F.col("key") == key)}, path)
    assert rows(snapshot.load(spark, path, "str", 1000)) == [("c", "y", 100_000)] and list(snapshot.versions(spark, path)) == [2, 3]
    assert snapshot.last_saved(spark, path).first()[0] > 1_600_000_000
    sink = snapshot.periodic(lambda batch: {"str": batch}, path, every=2)
    for number in range(4):
        sink(df.where(F.col("key") == "abcd"[number]), number)
    assert list(snapshot.versions(spark, path)) == [4, 5] and snapshot.load(spark, path, "str", 1000).count() == 0
    assert snapshot.flush(df).count() == 0 and snapshot.size(df).first()[0] == 3


def test_request_logs(spark, tmp_path):
    (tmp_path / "inline.txt").write_text("set a \"x \\\"y\\\" z\"\n\nGET a\nset 'b c' d e\nping\n")
    got = oplog.inline(spark, f"file://{tmp_path}/inline.txt").orderBy("seq").select("op", "key", "args").collect()
    assert [tuple(r) for r in got] == [("SET", "a", ['x "y" z']), ("GET", "a", []), ("SET", "b c", ["d", "e"]), ("PING", None, [])]
    (tmp_path / "framed").write_bytes(b"*3\r\n$3\r\nset\r\n$1\r\na\r\n$4\r\n1\r\n2\r\n*1\r\n$4\r\nPING\r\n*2\r\n$3\r\nGET\r\n$99\r\na\r\n")
    got = oplog.framed(spark, f"file://{tmp_path}/framed").orderBy("seq").select("op", "key", "args").collect()
    assert [tuple(r) for r in got] == [("SET", "a", ["1\r\n2"]), ("PING", None, []), ("ERROR", None, [])]


def test_explicit_entry_ids(spark):
    held = spark.createDataFrame([("s", 5, 0, "old"), ("s", 7, 0, "kept")], "key string, ms long, seq long, v string")
    new = spark.createDataFrame([("s", 5, 0, "over", 1), ("s", 2, 3, "early", 2), ("s", 2, 3, "last", 3)], "key string, ms long, seq long, v string, at int")
    assert rows(X.add_at(held, new, "at")) == [("s", 2, 3, "last"), ("s", 5, 0, "over"), ("s", 7, 0, "kept")]
    waiting = spark.createDataFrame([("s", "g", 5, 0)], "key string, grp string, ms long, seq long")
    assert rows(X.group_info(X.create_groups(held, "g").unionByName(X.create_groups(held, "h")), waiting)) == [("s", "g", 1, "7-0"), ("s", "h", 0, "7-0")]


def _model(log):
    """(seq, batch, at) of each row that takes effect, by going through the log."""
    out, queued, opened = [], {}, {}
    for seq, session, verb in sorted(log, key=lambda r: r[0]):
        if verb == "MULTI":
            opened[session] = seq
        elif verb in ("EXEC", "DISCARD"):
            out += [(s, b, seq) for s, b in queued.pop(session, []) if verb == "EXEC"]
            opened.pop(session, None)
        elif session in opened:
            queued.setdefault(session, []).append((seq, opened[session]))
        else:
            out.append((seq, None, seq))
    return sorted(out)


def test_exec_by_ranges(spark):
    """What is queued meets its EXEC across ranges of the log, and no window is gone through again for each row."""
    rng = random.Random(7)
    log = [(i, rng.choice(["a", "b", None]), rng.choice(["MULTI", "EXEC", "DISCARD", *["SET"] * 6])) for i in range(-40, 400)]
    log += [(400 + i, "long", "MULTI" if i == 1 else "EXEC" if i == 80 else "SET") for i in range(90)]
    log += [(500 + i, "open", "MULTI" if i == 5 else "SET") for i in range(50)]
    want = _model(log)
    df = spark.createDataFrame(log, "seq long, session string, verb string").repartition(3)
    for chunk in (1, 7, 1 << 16):
        found = control.executed(df, chunk)
        assert rows(found, "seq", "batch", "at") == want
        assert rows(control.transactions(df, chunk), "seq", "batch") == [r[:2] for r in want]
    assert "unboundedfollowing" not in control.executed(df)._jdf.queryExecution().toString().lower()
    named = df.withColumn("seq", F.struct(F.lit("file").alias("path"), F.col("seq").alias("n")))
    assert rows(control.executed(named).select("seq.n", "batch.n", "at.n").toDF("seq", "batch", "at")) == want
