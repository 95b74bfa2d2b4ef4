import random

from test_dedup import shingles

import corpus_pipeline


def test_near_copies_by_five_words(spark):
    """Survivors equal brute force on five words and 0.8, with pairs that only that rule or only three words and 0.9 links."""
    rng = random.Random(5)
    docs = []
    for group in range(8):
        base = [f"g{group}w{i}" for i in range(100)]
        docs.append((len(docs), " ".join(base)))
        for changes in (0, 1, 2, 3):
            words = list(base)
            for at in rng.sample(range(10, 90), changes):
                words[at] = f"x{rng.randrange(10_000)}"
            docs.append((len(docs), " ".join(words)))
        docs.append((len(docs), " ".join([*base, *(f"more{group}x{i}" for i in range(15))])))
        docs.append((len(docs), " ".join(base[:70])))
    sets = [shingles(t, 5) for _, t in docs]
    threes = [shingles(t, 3) for _, t in docs]
    like = lambda a, b: len(a & b) / len(a | b)
    near = [(x, y) for x in range(len(docs)) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    assert any(like(threes[x], threes[y]) < 0.9 for x, y in near)
    least = list(range(len(docs)))
    for _ in docs:
        for x, y in near:
            least[x] = least[y] = min(least[x], least[y])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").select("doc_id").collect()}
    assert got == {x for x in range(len(docs)) if least[x] == x}
