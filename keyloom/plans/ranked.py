"""Queries of sorted sets, bitmaps, distinct-count sketches and geo sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bitmaps as B
from ..operators import geo as G
from ..operators import hll as P
from ..operators import zsets as Z
from ..sources import collections as C
from ..sources.collections import sql
from .base import Plan

# ---- sorted sets

UP, DOWN = "PARTITION BY key ORDER BY score, member", "PARTITION BY key ORDER BY score DESC, member DESC"


def _zlog(spark, d):
    """Every event sets its user's score in the first day's set of its type, in cents."""
    e = C.table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat_ws(":", "event_type", F.lit("01")).alias("key"), F.col("user_id").cast("string").alias("member"), F.round(F.col("value") * 100).cast("bigint").cast("double").alias("score"))


_ZLOG = ", l AS (SELECT event_id AS seq, event_type || ':01' AS key, CAST(user_id AS VARCHAR) AS member, CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS score FROM events)"


def _added(mode):
    pick = {"": "arg_max(score, seq)", "xx": "arg_max(score, seq)", "nx": "arg_min(score, seq)", "gt": "max(score)", "lt": "min(score)"}[mode]
    moved = {"": "s <> z.score", "xx": "s <> z.score", "nx": "false", "gt": "s > z.score", "lt": "s < z.score"}[mode]
    only = " WHERE NOT added" if mode == "xx" else ""
    return Plan(lambda s, d: Z.add(C.zsets(s, d), _zlog(s, d), mode), sql(f"""{_ZLOG}, n AS (SELECT key, member, {pick} AS s FROM l GROUP BY key, member),
j AS (SELECT coalesce(z.key, n.key) AS key, coalesce(z.member, n.member) AS member,
 CASE WHEN z.key IS NULL THEN s WHEN s IS NOT NULL AND {moved} THEN s ELSE z.score END AS score, z.key IS NULL AS added, z.key IS NOT NULL AND s IS NOT NULL AND {moved} AS changed
 FROM zset z FULL JOIN n ON z.key = n.key AND z.member = n.member)
SELECT * FROM j{only}""", "zset"))


def _asks(spark, d):
    return C.table(spark, d, "events").select(F.col("event_id").alias("req"), F.concat_ws(":", "event_type", F.lit("02")).alias("key"), F.col("user_id").cast("string").alias("member"))


_ZSCORE = sql(""", q AS (SELECT event_id AS req, event_type || ':02' AS key, CAST(user_id AS VARCHAR) AS member FROM events)
SELECT req, q.key, q.member, score FROM q LEFT JOIN zset z ON q.key = z.key AND q.member = z.member""", "zset")


def _ranked(order, desc):
    return Plan(lambda s, d: Z.rank(C.zsets(s, d), desc), sql(f"SELECT key, member, row_number() OVER ({order}) - 1 AS rank FROM zset", "zset"))


def _by_rank(start, stop, desc=False):
    order = DOWN if desc else UP
    low, high = (f"greatest({x} + CASE WHEN {x} < 0 THEN n ELSE 0 END, 0)" for x in (start, stop))
    return Plan(lambda s, d: Z.by_rank(C.zsets(s, d), start, stop, desc), sql(f""", r AS (SELECT *, row_number() OVER ({order}) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM zset)
SELECT key, rank, member, score FROM r WHERE rank BETWEEN least({low}, n - 1) AND CASE WHEN {low} >= n THEN n - 1 ELSE least({high}, n - 1) END""", "zset"))


def _by_range(inside, where, desc=False, offset=0, count=0):
    last = f" AND rn <= {offset + count}" if count else ""
    return Plan(lambda s, d: Z.by_range(C.zsets(s, d), inside(), desc, offset, count), sql(f""", r AS (SELECT *, row_number() OVER ({DOWN if desc else UP}) AS rn FROM zset WHERE {where})
SELECT key, rn - {offset + 1} AS rank, member, score FROM r WHERE rn > {offset}{last}""", "zset"))


def _popped(desc):
    return Plan(lambda s, d: Z.pop(C.zsets(s, d), 3, desc), sql(f"SELECT key, rn - 1 AS rank, member, score FROM (SELECT *, row_number() OVER ({DOWN if desc else UP}) AS rn FROM zset) x WHERE rn <= 3", "zset"))


def _first(desc):
    return Plan(lambda s, d: Z.first_of(C.zsets(s, d), C.pairs(s, d).withColumn("arg", 1 - F.col("arg")), desc), sql(f""", t AS (SELECT key, member, score FROM (SELECT *, row_number() OVER ({DOWN if desc else UP}) AS rn FROM zset) x WHERE rn = 1),
j AS (SELECT req, t.*, row_number() OVER (PARTITION BY req ORDER BY arg DESC) AS rn FROM pairs p JOIN t ON p.key = t.key)
SELECT req, key, member, score FROM j WHERE rn = 1""", "pairs", "zset"))


def _merged(f, how, having, stored=False):
    text = f"SELECT req, member, {how}(score * weight) AS score FROM pairs p JOIN zset z ON p.key = z.key GROUP BY req, member{having}"
    if stored:
        return Plan(lambda s, d: Z.stored(f(C.zsets(s, d), C.pairs(s, d), how), "out:"), sql(f", x AS ({text}) SELECT 'out:' || req AS key, member, score FROM x", "pairs", "zset"))
    return Plan(lambda s, d: f(C.zsets(s, d), C.pairs(s, d), how), sql(text, "pairs", "zset"))


_BOTH = " HAVING count(*) = 2"
_ZDIFF = "SELECT req, member, max(score) AS score FROM pairs p JOIN zset z ON p.key = z.key GROUP BY req, member HAVING max(arg) = 0"
_LOW, _HIGH = 2000.0, 30000.0

# ---- bitmaps

_BYTES = ", z AS (SELECT key, max(off) // 8 + 1 AS bytes FROM bits GROUP BY key)"


def _bit_log(spark, d):
    e = C.table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("key"), F.col("user_id").alias("off"), (F.col("event_id") % 2).alias("bit"))


_BIT_LOG = "WITH l AS (SELECT event_id AS seq, event_type AS key, user_id AS off, event_id % 2 AS bit FROM events) "


def _counted(start, stop, unit):
    size, at = ("bytes", "off // 8") if unit == "byte" else ("bytes * 8", "off")
    low, high = (f"greatest({x} + CASE WHEN {x} < 0 THEN {size} ELSE 0 END, 0)" for x in (start, stop))
    return Plan(lambda s, d: B.bitcount(C.bits(s, d), start, stop, unit), sql(f"{_BYTES} SELECT b.key, count(*) FILTER ({at} BETWEEN {low} AND least({high}, {size} - 1)) AS n FROM bits b JOIN z ON b.key = z.key GROUP BY b.key", "bits"))


def _bit_asks(spark, d):
    return C.table(spark, d, "events").select(F.col("event_id").alias("req"), F.concat_ws(":", "event_type", F.lit("05")).alias("key"), F.col("user_id").alias("off"))


def _bitop(op, having):
    return Plan(lambda s, d: B.bitop(C.bits(s, d), C.pairs(s, d), op), sql(f"SELECT req, off FROM pairs p JOIN bits b ON p.key = b.key GROUP BY req, off{having}", "pairs", "bits"))


_FIELD = "SELECT key, CAST(coalesce(sum(CASE WHEN off BETWEEN 3 AND 14 THEN 1 << CAST(14 - off AS INT) END), 0) AS BIGINT) AS value FROM bits GROUP BY key"


def _field_set(spark, d, overflow):
    return B.set_field(C.bits(spark, d), 12, 3, F.coalesce(B.fit(F.col("value") + 3000, 12, False, overflow), F.col("value")))


def _field_sql(new):
    return sql(f""", f AS ({_FIELD}), n AS (SELECT key, CAST({new} AS BIGINT) AS value FROM f), m AS (SELECT key, value, unnest(range(0, 12)) AS i FROM n)
SELECT key, off FROM bits WHERE off NOT BETWEEN 3 AND 14 UNION ALL SELECT key, i + 3 FROM m WHERE (value >> CAST(11 - i AS INT)) & 1 = 1""", "bits")


# ---- sketches

def _close(estimate, exact):
    return (F.abs(estimate - exact) / exact <= 0.03).alias("close")


def _distinct(spark, d):
    return C.table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").cast("string").alias("member"))


def _pfcount(spark, d):
    rows = _distinct(spark, d)
    exact = rows.groupBy("key").agg(F.countDistinct("member").alias("exact"))
    return P.count(P.sketches(rows)).join(exact, "key").select("key", "exact", _close(F.col("estimate"), F.col("exact")))


_PF = "SELECT o_orderpriority AS key, count(DISTINCT o_custkey) AS exact, true AS close FROM orders GROUP BY 1"


def _all(rows):
    return rows.select(F.lit("all").alias("req"), "key").distinct()


def _pfmerge(spark, d):
    rows = _distinct(spark, d)
    exact = rows.groupBy(F.lit("all").alias("key")).agg(F.countDistinct("member").alias("exact"))
    return P.count(P.merge(P.sketches(rows), _all(rows))).join(exact, "key").select("key", "exact", _close(F.col("estimate"), F.col("exact")))


def _pf_sketch(spark, d):
    rows = _distinct(spark, d)
    exact = rows.groupBy(F.lit("all").alias("req")).agg(F.countDistinct("member").alias("exact"))
    found = P.count(P.merge(P.sketches(rows), _all(rows))).withColumnRenamed("key", "req")
    return found.join(exact, "req").select("req", "exact", _close(F.col("estimate"), F.col("exact")))


def _pfadd(spark, d):
    """Half of the keys are there already, and of those half get only members that they have."""
    rows = _distinct(spark, d)
    number = F.substring("key", 1, 1).cast("int")
    held = P.sketches(rows.where(number <= 3))
    return P.add(held, rows.where(number != 1)).select("key", "changed")


# ---- geo

GRID = f"""
r AS (SELECT key, member, lon, lat FROM geo WHERE lat BETWEEN -{G.LATITUDE} AND {G.LATITUDE}),
c AS (SELECT key, member, CAST(floor((lon + 180.0) / 360.0 * 67108864) AS BIGINT) AS x, CAST(floor((lat + {G.LATITUDE}) / {2 * G.LATITUDE} * 67108864) AS BIGINT) AS y FROM r),
p AS (SELECT key, member, x, y, (x + 0.5) / 67108864 * 360.0 - 180.0 AS lon, (y + 0.5) / 67108864 * {2 * G.LATITUDE} - {G.LATITUDE} AS lat FROM c),
h AS (SELECT key, member, lon, lat, CAST(list_sum(list_transform(range(0, 26), lambda i: (((x >> CAST(i AS INT)) & 1) << CAST(2 * i + 1 AS INT)) + (((y >> CAST(i AS INT)) & 1) << CAST(2 * i AS INT)))) AS BIGINT) AS h FROM p)"""


def _hav(lon1, lat1, lon2, lat2):
    return f"(2 * {G.RADIUS} * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"


def _geo(spark, d):
    return G.add(C.places(spark, d))


def _near(spark, d):
    k = F.col("c_custkey")
    pairs = C.table(spark, d, "customer").select(k.alias("req"), F.col("c_mktsegment").alias("key"), F.concat(F.lit("c"), k).alias("a"), F.concat(F.lit("c"), F.floor(k / 2)).alias("b"))
    return G.distance(_geo(spark, d), pairs, "km").select("req", "key", "a", "b", F.round("dist", 3).alias("dist"))


_NEAR = sql(f""", {GRID.strip()}, q AS (SELECT c_custkey AS req, c_mktsegment AS key, 'c' || c_custkey AS a, 'c' || (c_custkey // 2) AS b FROM customer)
SELECT req, q.key, q.a, q.b, round({_hav('u.lon', 'u.lat', 'v.lon', 'v.lat')} / 1000, 3) AS dist FROM q LEFT JOIN h u ON u.key = q.key AND u.member = q.a LEFT JOIN h v ON v.key = q.key AND v.member = q.b""", "geo")


def _searched(where, order="ASC", count=0, lon=15.0, lat=37.0, **how):
    cut = f" WHERE rn <= {count}" if count else ""
    text = sql(f""", {GRID.strip()}, s AS (SELECT key, member, {_hav(lon, lat, 'lon', 'lat')} AS m, lon, lat FROM h), w AS (SELECT * FROM s WHERE {where(lon, lat)}),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY m {order}, member) AS rn FROM w)
SELECT key, rn - 1 AS rank, member, round(m / 1000, 3) AS dist FROM k{cut}""", "geo")
    return Plan(lambda s, d: G.search(_geo(s, d), lon, lat, unit="km", count=count, descending=order == "DESC", **how).select("key", "rank", "member", F.round("dist", 3).alias("dist")), text)


def _boxed(lon, lat):
    return f"{_hav(lon, lat, 'lon', lat)} <= 2000000 AND {_hav(lon, lat, lon, 'lat')} <= 1500000"


def _from_members(spark, d):
    geo = _geo(spark, d)
    asked = geo.where("CAST(substring(member, 2) AS INT) % 11 = 0").select(F.col("member").alias("req"), "key", "member")
    return G.search_members(geo, asked, 700.0, "km").select("req", "key", "near", F.round("dist", 3).alias("dist"))


def _geo_again(spark, d):
    """Every third member, moved, and new members."""
    n = F.col("n")
    rows = C.places(spark, d).withColumn("n", F.substring("member", 2, 20).cast("int"))
    return rows.where(n % 3 == 0).select("key", F.when(n % 2 == 0, F.col("member")).otherwise(F.concat(F.lit("x"), "member")).alias("member"), F.when(n % 4 == 0, F.col("lon")).otherwise(-F.col("lon")).alias("lon"), "lat", "n")


_AGAIN = f"""a AS (SELECT key, CASE WHEN CAST(substring(member, 2) AS INT) % 2 = 0 THEN member ELSE 'x' || member END AS member, CASE WHEN CAST(substring(member, 2) AS INT) % 4 = 0 THEN lon ELSE -lon END AS lon, lat FROM geo WHERE CAST(substring(member, 2) AS INT) % 3 = 0 AND lat BETWEEN -{G.LATITUDE} AND {G.LATITUDE}),
ac AS (SELECT key, member, CAST(least(greatest(floor((lon + 180.0) / 360.0 * 67108864), 0), 67108863) AS BIGINT) AS x, CAST(floor((lat + {G.LATITUDE}) / {2 * G.LATITUDE} * 67108864) AS BIGINT) AS y FROM a),
ah AS (SELECT key, member, CAST(list_sum(list_transform(range(0, 26), lambda i: (((x >> CAST(i AS INT)) & 1) << CAST(2 * i + 1 AS INT)) + (((y >> CAST(i AS INT)) & 1) << CAST(2 * i AS INT)))) AS BIGINT) AS h FROM ac),
b AS (SELECT coalesce(h.key, ah.key) AS key, coalesce(h.member, ah.member) AS member, h.h AS old, ah.h AS new FROM h FULL JOIN ah ON h.key = ah.key AND h.member = ah.member)"""


def _geo_added(mode, cell, where="true"):
    return Plan(lambda s, d: G.add_to(_geo(s, d), _geo_again(s, d), mode, "n"), sql(f", {GRID.strip()}, {_AGAIN} SELECT key, member, {cell} AS h, old IS NULL AS added, old IS NOT NULL AND {cell} <> old AS changed FROM b WHERE {where}", "geo"))


_OPS = [("get", 12, 3, False), ("set", 8, 8, True, 77), ("incrby", 5, B.indexed(2, 5), False, 29, "sat"), ("incrby", 8, 8, True, 60, "fail"), ("get", 8, 8, True)]


def _bitfield_ops(which):
    get = lambda w, o, src="bits": f"(SELECT key, CAST(coalesce(sum(CASE WHEN off BETWEEN {o} AND {o + w - 1} THEN 1 << CAST({o + w - 1} - off AS INT) END), 0) AS BIGINT) AS v FROM {src} GROUP BY key)"
    signed = "CASE WHEN v >= 128 THEN v - 256 ELSE v END"
    body = f""", g AS {get(12, 3)}, o AS {get(8, 8)},
k AS (SELECT DISTINCT key FROM bits),
b1 AS (SELECT key, off FROM bits WHERE off NOT BETWEEN 8 AND 15 UNION ALL SELECT key, unnest([9, 12, 13, 15]) AS off FROM k),
f AS {get(5, 10, 'b1')}, n AS (SELECT key, least(v + 29, 31) AS v FROM f),
b2 AS (SELECT key, off FROM b1 WHERE off NOT BETWEEN 10 AND 14 UNION ALL SELECT key, 10 + i FROM (SELECT key, v, unnest(range(0, 5)) AS i FROM n) m WHERE (v >> CAST(4 - i AS INT)) & 1 = 1),
s AS {get(8, 8, 'b2')}, t AS (SELECT key, {signed} AS v FROM s)"""
    replies = f"SELECT key, 0 AS i, v AS value FROM g UNION ALL SELECT key, 1, {signed} FROM o UNION ALL SELECT key, 2, v FROM n UNION ALL SELECT key, 3, CASE WHEN v + 60 <= 127 THEN v + 60 END FROM t UNION ALL SELECT key, 4, CASE WHEN v + 60 <= 127 THEN v + 60 ELSE v END FROM t"
    return Plan(lambda s, d: B.fields(C.bits(s, d), _OPS)[which], sql(f"{body} {replies}", "bits"))


_LETTERS = "".join(f" || substring('{G.ALPHABET}', CAST(({f'h >> {47 - 5 * i}' if i < 10 else 'h << 3'}) & 31 AS INT) + 1, 1)" for i in range(11))

PLANS = {
    "zrange_withscores": Plan(lambda s, d: Z.by_rank(C.zsets(s, d), 0, 2, True), sql(f"SELECT key, rn - 1 AS rank, member, score FROM (SELECT *, row_number() OVER ({DOWN}) AS rn FROM zset) x WHERE rn <= 3", "zset")),
    "zadd": _added(""), "zadd_nx": _added("nx"), "zadd_xx": _added("xx"), "zadd_gt": _added("gt"), "zadd_lt": _added("lt"),
    "zrem": Plan(lambda s, d: Z.remove(C.zsets(s, d), _zlog(s, d)), sql(f"{_ZLOG} SELECT key, member, score FROM zset WHERE (key, member) NOT IN (SELECT (key, member) FROM l)", "zset")),
    "zscore": Plan(lambda s, d: Z.score(C.zsets(s, d), _asks(s, d)), _ZSCORE),
    "zmscore": Plan(lambda s, d: Z.score(C.zsets(s, d), _asks(s, d)).orderBy("req"), _ZSCORE),
    "zrank": _ranked(UP, False), "zrevrank": _ranked(DOWN, True),
    "zcard": Plan(lambda s, d: Z.cardinality(C.zsets(s, d)), sql("SELECT key, count(*) AS n FROM zset GROUP BY key", "zset")),
    "zcount": Plan(lambda s, d: Z.count(C.zsets(s, d), Z.between(F.col("score"), _LOW, _HIGH, open_low=True)), sql(f"SELECT key, count(*) FILTER (score > {_LOW} AND score <= {_HIGH}) AS n FROM zset GROUP BY key", "zset")),
    "zlexcount": Plan(lambda s, d: Z.count(C.zsets(s, d), Z.between(F.col("member"), "10", "7", open_high=True)), sql("SELECT key, count(*) FILTER (member >= '10' AND member < '7') AS n FROM zset GROUP BY key", "zset")),
    "zincrby": Plan(lambda s, d: Z.increase(C.zsets(s, d), _zlog(s, d).withColumnRenamed("score", "by")), sql(f"{_ZLOG}, b AS (SELECT key, member, sum(score) AS s FROM l GROUP BY 1, 2) SELECT b.key, b.member, coalesce(score, 0) + s AS score FROM b LEFT JOIN zset z ON b.key = z.key AND b.member = z.member", "zset")),
    "zrange": _by_rank(1, 4), "zrange_tail": _by_rank(-3, -1), "zrange_beyond": _by_rank(60, 90), "zrevrange": _by_rank(0, 4, True),
    "zrangebyscore": _by_range(lambda: Z.between(F.col("score"), _LOW, _HIGH), f"score BETWEEN {_LOW} AND {_HIGH}"),
    "zrangebyscore_limit": _by_range(lambda: Z.between(F.col("score"), _LOW), f"score >= {_LOW}", False, 1, 5),
    "zrevrangebyscore": _by_range(lambda: Z.between(F.col("score"), None, _HIGH), f"score <= {_HIGH}", True, 0, 4),
    "zrangebylex": _by_range(lambda: Z.between(F.col("member"), "10", "3"), "member >= '10' AND member <= '3'", False, 0, 6),
    "zrangestore": Plan(lambda s, d: Z.by_rank(C.zsets(s, d), 0, 1).select(F.concat(F.lit("top:"), "key").alias("key"), "member", "score"), sql(f"SELECT 'top:' || key AS key, member, score FROM (SELECT *, row_number() OVER ({UP}) AS rn FROM zset) x WHERE rn <= 2", "zset")),
    "zpopmin": _popped(False), "zpopmax": _popped(True), "bzpopmin": _first(False), "bzpopmax": _first(True),
    "zunion": _merged(Z.union, "sum", ""), "zunion_min": _merged(Z.union, "min", ""), "zunion_max": _merged(Z.union, "max", ""),
    "zinter": _merged(Z.intersect, "sum", _BOTH), "zinter_max": _merged(Z.intersect, "max", _BOTH),
    "zdiff": Plan(lambda s, d: Z.difference(C.zsets(s, d), C.pairs(s, d)), sql(_ZDIFF, "pairs", "zset")),
    "zunionstore": _merged(Z.union, "sum", "", True), "zinterstore": _merged(Z.intersect, "sum", _BOTH, True),
    "zdiffstore": Plan(lambda s, d: Z.stored(Z.difference(C.zsets(s, d), C.pairs(s, d)), "out:"), sql(f", x AS ({_ZDIFF}) SELECT 'out:' || req AS key, member, score FROM x", "pairs", "zset")),
    "zrandmember": Plan(lambda s, d: Z.random_members(C.zsets(s, d), 2).groupBy("key").agg(F.count("*").alias("n")), sql("SELECT key, least(count(*), 2) AS n FROM zset GROUP BY key", "zset")),
    "zscan": Plan(lambda s, d: Z.scan(C.zsets(s, d), "?1"), sql("SELECT key, member, score FROM zset WHERE member GLOB '?1'", "zset")),
    "zremrangebyrank": Plan(lambda s, d: Z.remove_by_rank(C.zsets(s, d), 2, -4), sql(f"SELECT key, member, score FROM (SELECT *, row_number() OVER ({UP}) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM zset) x WHERE NOT (pos BETWEEN 2 AND greatest(n - 4, 0))", "zset")),
    "zremrangebylex": Plan(lambda s, d: Z.remove_range(C.zsets(s, d), Z.between(F.col("member"), "10", "3")), sql("SELECT key, member, score FROM zset WHERE NOT (member >= '10' AND member <= '3')", "zset")),
    "zadd_replies": Plan(lambda s, d: Z.add_replies(Z.add(C.zsets(s, d), _zlog(s, d))), sql(f"{_ZLOG}, n AS (SELECT key, member, arg_max(score, seq) AS new FROM l GROUP BY 1, 2), b AS (SELECT coalesce(z.key, n.key) AS key, z.score AS old, new FROM zset z FULL JOIN n ON z.key = n.key AND z.member = n.member) SELECT key, count(*) FILTER (old IS NULL) AS added, count(*) FILTER (old IS NULL OR new IS NOT NULL AND abs(new - old) > {Z.EPSILON}) AS touched FROM b GROUP BY key", "zset")),
    "zremrangebyscore": Plan(lambda s, d: Z.remove_range(C.zsets(s, d), Z.between(F.col("score"), _LOW, _HIGH)), sql(f"SELECT key, member, score FROM zset WHERE NOT score BETWEEN {_LOW} AND {_HIGH}", "zset")),
    "setbit": Plan(lambda s, d: B.setbit(_bit_log(s, d)), _BIT_LOG + "SELECT key, off FROM l GROUP BY key, off HAVING arg_max(bit, seq) = 1"),
    "setbit_replies": Plan(lambda s, d: B.setbit_replies(_bit_log(s, d)), _BIT_LOG + "SELECT seq, key, off, lag(bit, 1, 0) OVER (PARTITION BY key, off ORDER BY seq) AS old FROM l"),
    "getbit": Plan(lambda s, d: B.getbit(C.bits(s, d), _bit_asks(s, d)), sql(", q AS (SELECT event_id AS req, event_type || ':05' AS key, user_id AS off FROM events) SELECT req, q.key, q.off, CAST(b.off IS NOT NULL AS BIGINT) AS bit FROM q LEFT JOIN bits b ON q.key = b.key AND q.off = b.off", "bits")),
    "bitcount": _counted(0, -1, "byte"), "bitcount_bytes": _counted(1, 3, "byte"), "bitcount_bits": _counted(-40, -5, "bit"),
    "bitpos": Plan(lambda s, d: B.bitpos(C.bits(s, d), 1), sql("SELECT key, min(off) AS pos FROM bits GROUP BY key", "bits")),
    "bitpos_clear": Plan(lambda s, d: B.bitpos(C.bits(s, d), 0), sql(", n AS (SELECT key, off, row_number() OVER (PARTITION BY key ORDER BY off) - 1 AS run FROM bits) SELECT key, coalesce(max(off) FILTER (off = run) + 1, 0) AS pos FROM n GROUP BY key", "bits")),
    "bitop_and": _bitop("and", _BOTH), "bitop_or": _bitop("or", ""), "bitop_xor": _bitop("xor", " HAVING count(*) % 2 = 1"),
    "bitop_not": Plan(lambda s, d: B.bitnot(C.bits(s, d)), sql(f"{_BYTES}, e AS (SELECT key, unnest(range(0, bytes * 8)) AS off FROM z) SELECT key, off FROM e EXCEPT SELECT key, off FROM bits", "bits")),
    "bitfield_get": Plan(lambda s, d: B.field(C.bits(s, d), 12, 3), sql(_FIELD, "bits")),
    "bitfield_get_signed": Plan(lambda s, d: B.field(C.bits(s, d), 12, 3, True), sql(f", f AS ({_FIELD}) SELECT key, CASE WHEN value >= 2048 THEN value - 4096 ELSE value END AS value FROM f", "bits")),
    "bitfield_ops": _bitfield_ops(1),
    "bitfield_incrby_wrap": Plan(lambda s, d: _field_set(s, d, "wrap"), _field_sql("(value + 3000) % 4096")),
    "bitfield_incrby_sat": Plan(lambda s, d: _field_set(s, d, "sat"), _field_sql("least(value + 3000, 4095)")),
    "bitfield_incrby_fail": Plan(lambda s, d: _field_set(s, d, "fail"), _field_sql("CASE WHEN value + 3000 > 4095 THEN value ELSE value + 3000 END")),
    "pfadd": Plan(_pfadd, "SELECT DISTINCT o_orderpriority AS key, CAST(substring(o_orderpriority, 1, 1) AS INT) > 3 AS changed FROM orders"),
    "pfcount": Plan(_pfcount, _PF),
    "pfmerge": Plan(_pfmerge, "SELECT 'all' AS key, count(DISTINCT o_custkey) AS exact, true AS close FROM orders"),
    "pfcount_union": Plan(_pf_sketch, "SELECT 'all' AS req, count(DISTINCT o_custkey) AS exact, true AS close FROM orders"),
    "geoadd": Plan(lambda s, d: _geo(s, d), sql(f", {GRID.strip()} SELECT key, member, h FROM h", "geo")),
    "geopos": Plan(lambda s, d: G.positions(_geo(s, d)).select("key", "member", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat")), sql(f", {GRID.strip()} SELECT key, member, round(lon, 7) AS lon, round(lat, 7) AS lat FROM h", "geo")),
    "geodist": Plan(_near, _NEAR),
    "geohash": Plan(lambda s, d: _geo(s, d).select("key", "member", G.geohash(F.col("h")).alias("hash")), sql(f", {GRID.strip()} SELECT key, member, ''{_LETTERS} AS hash FROM h", "geo")),
    "geosearch": _searched(lambda lon, lat: "m <= 2500000", radius=2500.0),
    "geosearch_antimeridian": _searched(lambda lon, lat: "m <= 1900000", lon=179.0, lat=60.0, radius=1900.0),
    "geosearch_pole": _searched(lambda lon, lat: "m <= 800000", lon=10.0, lat=84.0, radius=800.0),
    "geosearch_members": Plan(_from_members, sql(f", {GRID.strip()} SELECT a.member AS req, a.key, b.member AS near, round({_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} / 1000, 3) AS dist FROM h a JOIN h b ON a.key = b.key AND {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 700000 WHERE CAST(substring(a.member, 2) AS INT) % 11 = 0", "geo")),
    "geoadd_again": _geo_added("", "coalesce(new, old)"), "geoadd_nx": _geo_added("nx", "coalesce(old, new)"), "geoadd_xx": _geo_added("xx", "coalesce(new, old)", "old IS NOT NULL"),
    "geosearch_box": _searched(_boxed, box=(4000.0, 3000.0)),
    "geosearch_count": _searched(lambda lon, lat: "m <= 9000000", "DESC", 5, radius=9000.0),
    "geosearchstore": Plan(lambda s, d: G.stored(G.search(_geo(s, d), 15.0, 37.0, 2500.0, unit="km"), "near"), sql(f", {GRID.strip()} SELECT 'near' AS key, member, h FROM h WHERE {_hav(15.0, 37.0, 'lon', 'lat')} <= 2500000", "geo")),
}
