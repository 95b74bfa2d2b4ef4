"""Secret scan by corpus-wide ownership frequency, in DataFrame operations only.

Each text is searched for credentials of three kinds: assignments to a name like
``password``, access key ids, and long lowercase hex runs. The value of every
match is hashed, and the hashes are aggregated over the whole corpus by distinct
repositories and distinct owners. A value that WIDE_OWNERS owners hold, or two owners
in WIDE_REPOS repositories, has been copied around (documentation, samples,
fixtures) and is an ``example``. Any other value that can be a credential is ``live``:
an owner's own, in however many repositories, or shared by two in a few. Assigned
placeholders, whoever holds them, are ``weak``.
The scan keeps every match and adds one span over the value of each live or
example credential (once, where two kinds match the same value), so readers get both the match and the verdict.

Positions come without UDFs: splitting a text at a pattern gives the gaps
between the matches, so running sums of gap and match lengths (in code points)
are the starts and ends, taken in a window over one document's matches.

Scale: texts are read once and never shuffled; only matches are. Counting goes
by (value, owner, repository), then (value, owner), then value, each with
map-side partial sums, so a value that a third of all rows share costs a few
rows per task; verdicts return by a sort-merge join of written tables, which AQE
splits where one value is hot.

Defined results: a null text is empty and has no match. A null owner or
repository counts as one owner or repository of its own. Repeated rows are rows
of their own (the same owner again, so they don't raise a frequency). Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import Scratch, read


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int  # of the value, which ends where the match ends
    least: int  # characters of the value
    need: str  # a cheaper pattern that any text with a match has


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: In the order in which spans of one start are listed.
KINDS = (
    Kind("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, rf"""({_NAMES})["']?\x20*[:=]"""),
    Kind("access", "AKIA[A-Z0-9]{12,}", 0, 16, "AKIA[A-Z0-9]{12}"),
    Kind("hex", "[0-9a-f]{32,}", 0, 32, "[0-9a-f]{32}"),
)
VERDICTS = ("live", "example")
#: A value of at least so many owners is an example, and so is one of two owners in so many repositories.
WIDE_OWNERS, WIDE_REPOS = 3, 6
#: Assigned values that stand for a credential, in lower case; so do runs of one character.
PLACEHOLDERS = r"^(?:changeme|change[_-]me|change[_-]?this|(?:your|my|the|some|new|old|insert)[_-]?(?:password|passwd|secret|token|api[_-]?key|key)(?:[_-]?here)?|password|placeholder|redacted|undefined|required|optional)$"


def _found(text: Column, order: int, kind: Kind) -> Column:
    """The matches of one kind: (kind, i, gap before it, its length, its value)."""
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)) if kind.group else values
    rows = F.transform(
        F.arrays_zip(F.transform(F.split(text, kind.pattern, -1), lambda x: F.length(x)).alias("gap"), F.transform(matches, lambda x: F.length(x)).alias("len"), values.alias("value")),
        lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("i"), x["gap"].cast("long").alias("gap"), x["len"].cast("long").alias("len"), x["value"].alias("value")),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:bigint,len:bigint,value:string>>")
    # the last gap has no match after it
    return F.when(text.rlike(kind.need), F.filter(rows, lambda x: x["len"].isNotNull())).otherwise(none)


def scan(docs: DataFrame, scratch: Scratch, text_col: str = "text", owner: Column | None = None, repo: Column | None = None, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows, matches): rows has ``rid`` and the kept columns of every document; matches has
    rid, kind, start, end, value_start, value_hash, likely and the owner and repository."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*(_found(text, k, kind) for k, kind in enumerate(KINDS)))
    rows = docs.select(
        *(F.col(c) for c in keep),
        F.coalesce(F.lit("") if owner is None else owner, F.lit("")).alias("_owner"),
        F.coalesce(F.lit("") if repo is None else repo, F.lit("")).alias("_repo"),
        found.alias("_found"),
    ).withColumn("rid", F.monotonically_increasing_id())
    rows = scratch.cut(rows, "rows")
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = rows.where(F.size("_found") > 0).select("rid", "_owner", "_repo", F.inline("_found"))
    least = F.element_at(F.array(*(F.lit(k.least) for k in KINDS)), F.col("kind") + 1)
    matches = (
        each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
        .where(F.length("value") >= least)
        .select(
            "rid", "_owner", "_repo", "kind", (F.col("end") - F.col("len")).alias("start"), "end",
            (F.col("end") - F.length("value")).alias("value_start"),
            F.sha2("value", 256).alias("value_hash"),
            # an access id or hex run is live-looking as such
            ((F.col("kind") > 0) | ~(F.lower("value").rlike(PLACEHOLDERS) | (F.replace("value", F.substring("value", 1, 1), F.lit("")) == ""))).alias("likely"),
        )
    )
    return rows, scratch.cut(matches, "matches")


def ownership(matches: DataFrame) -> DataFrame:
    """value_hash, owners, repos, uses: the distinct owners and repositories of each value, and its matches."""
    by_repo = matches.groupBy("value_hash", "_owner", "_repo").agg(F.count("*").alias("uses"))
    by_owner = by_repo.groupBy("value_hash", "_owner").agg(F.count("*").alias("repos"), F.sum("uses").alias("uses"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("uses").alias("uses"))


def judged(matches: DataFrame, scratch: Scratch, wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """The matches with owners, repos, uses and verdict (live, example or weak).

    Repositories alone make no example: a single owner may use a key of its own in many.
    """
    held = scratch.cut(ownership(matches), "ownership")
    copied = (F.col("owners") >= wide_owners) | (F.col("owners") > 1) & (F.col("repos") >= wide_repos)
    verdict = F.when(copied, "example").when(F.col("likely"), "live").otherwise("weak")
    return matches.join(held, "value_hash").withColumn("verdict", verdict)


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS), *(F.lit(v) for v in VERDICTS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, scratch: Scratch, text_col: str = "text", owner: Column | None = None, repo: Column | None = None, keep: tuple[str, ...] = ("doc_id",), wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """Per input row: the kept columns, ``base`` and ``spans``, arrays of (start, kind, end) by start, then kind,
    and for the report ``most_owners`` and ``most_repos`` of any of its values (0 without one).

    Kinds 0 to 2 are KINDS; those from 3 are VERDICTS, spans over a value.
    """
    rows, matches = scan(docs, scratch, text_col, owner, repo, keep)
    at = judged(matches, scratch, wide_owners, wide_repos)
    order = F.when(F.col("verdict") == "live", len(KINDS)).when(F.col("verdict") == "example", len(KINDS) + 1)
    per_row = at.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("base"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.filter(
            F.array(F.struct("start", "kind", "end"), F.struct(F.col("value_start").alias("start"), order.alias("kind"), F.col("end"))),
            lambda s: s["kind"].isNotNull(),
        ))))).alias("spans"),
        F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.select("rid", *keep).join(per_row, "rid", "left").select(
        *keep, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("most_owners", "most_repos"))
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its owner; a source's documents in one language are a repository."""
    docs = read(spark, sf_dir, "documents")
    found = secret_scan(docs, Scratch(spark, "op7"), owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), "most_owners", "most_repos",
    )


def redacted(docs: DataFrame, scratch: Scratch, owner: Column, repo: Column, mask: str = "[credential removed]", text_col: str = "text") -> DataFrame:
    """The documents with every live credential's value replaced by ``mask``; other texts and columns pass unchanged.

    Texts without any match go straight through. The rest are joined to their spans
    by a row id that is written with them, and rebuilt from the parts between the spans.
    A row travels as one struct, so its columns may have any names.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), owner.alias("owner"), repo.alias("repo"))
    hit = F.col("text").rlike(KINDS[0].need) | F.col("text").rlike(KINDS[1].need) | F.col("text").rlike(KINDS[2].need)
    suspects = scratch.cut(rows.where(hit).withColumn("row", F.monotonically_increasing_id()), "suspects")
    spans = secret_scan(suspects, scratch, "text", F.col("owner"), F.col("repo"), keep=("row",))
    live = spans.select("row", F.filter("spans", lambda s: s["kind"] == len(KINDS)).alias("live")).where(F.size("live") > 0)
    # overlapping spans: a span that starts inside what is already masked only extends it
    merged = F.aggregate(
        "live",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("gaps")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("a"), s["start"].alias("b"))))).otherwise(acc["gaps"]).alias("gaps"),
        ),
    )
    parts = live.select("row", merged.alias("m"))
    body = F.concat(
        F.array_join(F.transform("m.gaps", lambda g: F.col("text").substr((g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))), mask),
        F.lit(mask), F.col("text").substr((F.col("m.at") + 1).cast("int"), F.length("text")),
    )
    rebuilt = suspects.join(parts, "row", "left").select(F.col("doc").withField(text_col, F.when(F.col("m").isNotNull(), body).otherwise(F.col("text"))).alias("doc"))
    return rows.where(~hit).select("doc").unionByName(rebuilt).select("doc.*")


_SQL_ASSIGN = KINDS[0].pattern.replace("'", "''")
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
p AS (
  SELECT doc_id, owner, repo, 0 AS kind, regexp_split_to_array(t, '{_SQL_ASSIGN}') AS gaps, regexp_extract_all(t, '{_SQL_ASSIGN}') AS hits, regexp_extract_all(t, '{_SQL_ASSIGN}', 2) AS vals FROM d
  UNION ALL
  SELECT doc_id, owner, repo, 1, regexp_split_to_array(t, '{KINDS[1].pattern}'), regexp_extract_all(t, '{KINDS[1].pattern}'), regexp_extract_all(t, '{KINDS[1].pattern}') FROM d
  UNION ALL
  SELECT doc_id, owner, repo, 2, regexp_split_to_array(t, '{KINDS[2].pattern}'), regexp_extract_all(t, '{KINDS[2].pattern}'), regexp_extract_all(t, '{KINDS[2].pattern}') FROM d
),
e AS (SELECT doc_id, owner, repo, kind, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM p),
m AS (
  SELECT doc_id, owner, repo, kind, vals[i] AS value,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i], lambda x: length(x))), 0) AS e,
         length(hits[i]) AS n
  FROM e WHERE length(vals[i]) >= CASE kind WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END
),
f AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM m GROUP BY value),
j AS (
  SELECT m.*, owners, repos, CASE WHEN owners >= {WIDE_OWNERS} OR owners = 2 AND repos >= {WIDE_REPOS} THEN 4
                   WHEN kind > 0 OR NOT (regexp_matches(lower(value), '{PLACEHOLDERS}') OR replace(value, value[1], '') = '') THEN 3 END AS verdict
  FROM m JOIN f USING (value)
),
r AS (SELECT doc_id, max(owners) AS most_owners, max(repos) AS most_repos FROM j GROUP BY doc_id),
s AS (
  SELECT doc_id, kind, CAST(e - n AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM j
  UNION SELECT doc_id, verdict, CAST(e - length(value) AS BIGINT), CAST(e AS BIGINT) FROM j WHERE verdict IS NOT NULL
),
w AS (SELECT doc_id, kind, b, e, ['assign', 'access', 'hex', 'live', 'example'][kind + 1] || ':' || b || ':' || e AS span FROM s),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(span, ',' ORDER BY b, kind, e) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY b, kind, e) AS spans
  FROM w GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN r ON d.doc_id = r.doc_id
"""
