import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from keyloom.llm import exact_dedup as E
from keyloom.llm import jaccard_join as J
from keyloom.llm.components import components


def pairs(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


@pytest.mark.parametrize("how", [{}, {"block_chars": 7}, {"block_chars": 50, "block_hash": lambda c: F.pmod(F.xxhash64(c), F.lit(3))}])
def test_exact_dedup(documents, scratch, how):
    groups = collections.defaultdict(list)
    for i, t in pairs(documents):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            kept = i == keep and not seen
            seen |= kept
            want[i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = collections.Counter(tuple(r) for r in E.exact_dedup(documents, scratch, **how).collect())
    assert got == want


def test_exact_dedup_of_nothing(none, scratch):
    assert E.exact_dedup(none, scratch).collect() == []


def shingles(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} if len(found) >= words else {tuple(found)} if found else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(docs)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(docs):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return collections.Counter((i, len(sets[x]), least.get(find(x)) if sets[x] else i) for x, (i, _) in enumerate(docs))


@pytest.mark.parametrize("limits", [{}, {"region_sets": 2}, {"region_shingles": 50}])
def test_jaccard_join(documents, scratch, limits):
    assert collections.Counter(tuple(r) for r in J.near_components(documents, scratch, **limits).collect()) == brute(pairs(documents))


def test_jaccard_join_of_nothing(none, scratch):
    assert J.near_components(none, scratch).collect() == []


def test_jaccard_join_of_a_cluster(spark, scratch):
    """A base and many variants, of which some link only through others."""
    import random

    rng = random.Random(3)
    docs = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(60)]
        for i in range(25):
            words = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
                words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
            docs.append((len(docs), " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    for limits in ({}, {"region_sets": 4}):
        assert collections.Counter(tuple(r) for r in J.near_components(df, scratch, **limits).collect()) == want


def clusters(rng, groups, per_group, words, changes):
    docs = []
    for group in range(groups):
        base = [f"g{group}w{i}" for i in range(words)]
        for _ in range(per_group):
            own = list(base)
            for at in rng.sample(range(words), rng.choice(changes)):
                own[at] = f"x{rng.randrange(10_000)}"
            docs.append((len(docs), " ".join(own)))
    return docs


def links(sets, rule):
    return {(x, y) for x in range(len(sets)) for y in range(x) if rule.den * len(a := sets[x] & sets[y]) >= rule.num * (len(sets[x]) + len(sets[y]) - len(a))}


def partition(n, edges):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
        root = [root[r] for r in root]
        if root == before:
            return root
    return root


@pytest.mark.parametrize("rule", [J.Rule(), J.Rule(words=5, num=80)])
def test_regions_join_recursively(spark, scratch, rule):
    """One region of several clusters and of sets between them, divided over more than one level, against all pairs."""
    import random

    rng = random.Random(11)
    sets = []
    for group in range(4):
        base = rng.sample(range(10_000 * group, 10_000 * (group + 1)), 120)
        sets += [set(base[k:]) | set(rng.sample(range(10**6), c)) for k in range(0, 60, 2) for c in (0, 3, 9)]
    region = [(7, x, sorted(s)) for x, s in enumerate(sets)] + [(8, len(sets), [1]), (9, len(sets) + 1, [1, 2])]
    df = scratch.cut(spark.createDataFrame(region, "region long, node long, shingles array<long>"), "one-region")
    before = scratch.written
    found = {tuple(sorted(r, reverse=True)) for r in J.region_links(df, rule, scratch, region_sets=6).collect()}
    names = [scratch.path(t).rsplit("-", 2)[1:] for t in scratch._tables[before:] if id(t) in scratch._paths]
    assert sum(n[-1] == "measured" for n in names) >= 2
    want = links(sets, rule)
    assert found <= want and partition(len(sets), found) == partition(len(sets), want)


def test_region_that_distance_does_not_divide(spark, scratch):
    """Many sets, all alike far from each other but for a few pairs: copies stay those of the blocks."""
    import random

    rng, n = random.Random(4), 5000
    sets = [set(rng.sample(range(200), 160)) | set(range(1000 * (x + 1), 1000 * (x + 1) + 10)) for x in range(n)]
    for x in range(0, n, 500):
        sets[x + 1] = (sets[x] - {min(sets[x])}) | {10**7 + x}
    df = scratch.cut(spark.createDataFrame([(1, x, sorted(s)) for x, s in enumerate(sets)], "region long, node long, shingles array<long>"), "equidistant")
    found = {tuple(sorted(r)) for r in J.region_links(df, J.Rule(), scratch).collect()}
    assert found >= {(x, x + 1) for x in range(0, n, 500)}
    assert all(100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y]) for x, y in found)


def test_region_of_a_shared_passage(spark, scratch):
    """Unrelated sets with one passage in common, and a few near copies among them: divided by rare shingles, not joined in blocks."""
    import random

    rng, n = random.Random(6), 600
    passage = set(range(40))
    sets = [passage | set(rng.sample(range(1000, 10**7), 150)) for _ in range(n)]
    for x in range(0, n, 60):
        sets[x + 1] = set(sorted(sets[x])[3:]) | set(rng.sample(range(10**7, 2 * 10**7), 5))
    df = scratch.cut(spark.createDataFrame([(1, x, sorted(s)) for x, s in enumerate(sets)], "region long, node long, shingles array<long>"), "passage")
    for rule in (J.Rule(), J.Rule(words=5, num=80)):
        before = scratch.written
        found = {tuple(sorted(r)) for r in J.region_links(df, rule, scratch, region_sets=40).collect()}
        assert found == {(x, x + 1) for x in range(0, n, 60)} == {(y, x) for x, y in links(sets, rule)}
        kept = [t for t in scratch._tables[before:] if id(t) in scratch._paths and "members" in scratch.path(t)]
        assert kept[0].count() <= 40


def test_signatures_bound_differences():
    import random

    import numpy as np

    rng = random.Random(7)
    for _ in range(200):
        a = set(rng.sample(range(1 << 40), rng.randint(0, 600)))
        b = set(rng.sample(sorted(a), len(a) // 2)) | set(rng.sample(range(1 << 40), rng.randint(0, 300)))
        one, two = (np.frombuffer(J.signature(np.array(sorted(x), np.uint64)), np.uint8) for x in (a, b))
        assert np.bitwise_count(one ^ two).sum() <= len(a ^ b)


@pytest.mark.parametrize(("phases", "sift", "local"), [(1, False, 32), (3, False, 32), (1, True, 32), (2, True, 3)])
def test_phases(spark, scratch, phases, sift, local, monkeypatch):
    import random

    docs = clusters(random.Random(3), 5, 12, 60, (0, 1, 2, 4, 9))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rule = J.Rule(words=5, num=80, growth=1.1, spare=64, phases=phases, sift=sift)
    monkeypatch.setattr(J, "LOCAL", local)
    sets = [shingles(t, 5) for _, t in docs]
    want = partition(len(docs), links(sets, rule))
    assert {r.doc_id: r.component_id for r in J.near_components(df, scratch, rule).collect()} == dict(enumerate(want))


def test_words_made_to_collide(spark, scratch):
    """A Thue-Morse word and its complement have equal hashes under any polynomial modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    docs = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in J.near_components(df, scratch).collect()} == {1: 1, 2: 2, 3: 1}


def test_only_what_is_read_stays(spark, scratch):
    import os

    before = scratch.written
    df = J.near_components(spark.createDataFrame(clusters(__import__("random").Random(2), 2, 6, 50, (0, 1, 2)), "doc_id long, text string"), scratch)
    held = [scratch._paths[id(t)] for t in scratch._tables[before:] if id(t) in scratch._paths]
    assert [p.rsplit("/", 1)[1][4:] for p in held] == ["features", "placed"] and df.count() == 12
    assert all(os.path.isdir(p.removeprefix("file://")) for p in held)


@pytest.mark.parametrize("last_edges", [0, 20])
def test_components_in_rounds(spark, scratch, last_edges):
    """A long sorted path, a star and single pairs, without and with a last task."""
    edges = [(i, i + 1) for i in range(1000, 1100)] + [(1, i) for i in range(2, 200)] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(30)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), scratch, "r", last_edges).collect())
    groups = collections.defaultdict(set)
    for node, c in got.items():
        groups[c].add(node)
    assert sorted(map(sorted, groups.values())) == sorted([list(range(1000, 1101)), list(range(1, 200)), *([5000 + 2 * i, 5001 + 2 * i] for i in range(30))])


def test_set_identity_and_words():
    import numpy as np

    one, two = J.shingle_sets([b"A b  C d", b"a B\tc\nD"], 3)
    assert (one == two).all() and len(one) == 2 and J.set_identity(one) == J.set_identity(two)
    assert J.set_identity(one) != J.set_identity(one[:1])
    hashes, start = J.word_hashes(b" ab ba ab aab b")
    assert len(set(hashes.tolist())) == 4 and hashes[0] == hashes[2] and start.tolist() == [1, 4, 7, 10, 14]
    assert [len(s) for s in J.shingle_sets([b"", b" ", b"x", b"x y", b"x y z"], 3)] == [0, 0, 1, 1, 1]
    assert isinstance(one, np.ndarray)


def test_components(spark, scratch):
    import random

    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 30)] + [(5, 5)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(tuple(r) for r in components(df, scratch, "t").collect())
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[find(a)] = find(b)
    assert set(got) == set(root)
    by_found, by_want = collections.defaultdict(set), collections.defaultdict(set)
    for x, c in got.items():
        by_found[c].add(x)
        by_want[find(x)].add(x)
    assert sorted(map(sorted, by_found.values())) == sorted(map(sorted, by_want.values()))


def test_block_names_do_not_depend_on_partitions(documents, scratch, spark):
    """The same names whatever the partitions: places in one order of all distinct blocks and pairs."""
    def names(df, parts, **how):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            return collections.Counter((r.doc_id, bytes(r.sha), r.level, r.name) for r in E.identities(df.repartition(parts), scratch, block_chars=40, **how).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    some = documents.where("length(text) < 1000 OR text IS NULL")
    one = names(some, 1)
    assert one == names(some, 5)
    shared = {"block_hash": lambda c: F.pmod(F.xxhash64(c), F.lit(3))}
    assert names(some, 1, **shared) == names(some, 3, **shared)
    level0 = sorted({n for _, _, level, n in one if level == 0})
    assert level0 and level0[0] >= 0 and level0[-1] < sum(-(-max(1, len(t or "")) // 40) for _, t in pairs(some))
