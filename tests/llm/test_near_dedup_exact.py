"""Near dedup links by the exact similarity of distinct five-word shingles, at exactly 0.8 and just below it."""

import random

import pytest

from runlens.llm.simhash import drop_near_copies, similar_components

from .helpers import awkward
from .test_pipeline import jaccard, shingles


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklm", k=7)) for _ in range(n)]


def at_and_below(rng, n):
    """A text of 4n shingles, one of 5n that holds them all (exactly 0.8), and one with a shingle more (below 0.8)."""
    base = words(rng, 4 * n + 4)
    return " ".join(base), " ".join(base + words(rng, n)), " ".join(base + words(rng, n + 1))


def brute(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return dict(enumerate(root))


@pytest.mark.parametrize("blocks", [{}, {"common": 0, "block_shingles": 300, "tile_rows": 7}, {"common": 0, "block_shingles": 300, "tile_rows": 7, "many": 0}])
def test_exactly_the_similarity_links_and_less_does_not(spark, blocks):
    rng = random.Random(3)
    texts, expected = [], {}
    for n in (1, 2, 5, 20, 100, 300):
        for _ in range(8):
            base, equal, _ = at_and_below(rng, n)
            other, _, below = at_and_below(rng, n)
            assert jaccard(shingles(base), shingles(equal)) == 0.8 > jaccard(shingles(other), shingles(below))
            i = len(texts)
            texts += [base, equal, other, below]
            expected |= {i: i, i + 1: i, i + 2: i + 2, i + 3: i + 3}
    got = {r.doc_id: r.component_id for r in similar_components(awkward(spark, texts), **blocks).collect()}
    assert got == expected
    kept = sorted(r.doc_id for r in drop_near_copies(awkward(spark, texts)).collect())
    assert kept == sorted(set(expected.values()))


@pytest.mark.parametrize("blocks", [{}, {"common": 5}, {"common": 0, "block_shingles": 500, "tile_rows": 7}, {"common": 0, "block_shingles": 500, "tile_rows": 7, "many": 0}])
def test_groups_of_texts_between_alike_and_unlike(spark, blocks, monkeypatch):
    monkeypatch.setattr("runlens.llm.simhash.LARGE", 6)
    rng = random.Random(4)
    texts = []
    for _ in range(4):
        base = words(rng, 120)
        for _ in range(20):  # similarities from about 0.4 to 1
            edited = list(base)
            for at in rng.sample(range(len(base)), rng.randrange(0, 7)):
                edited[at] = words(rng, 1)[0]
            texts.append(" ".join(edited))
    texts += ["", None, "one two", texts[5]]
    got = {r.doc_id: r.component_id for r in similar_components(awkward(spark, texts), **blocks).collect()}
    assert got == brute(texts)


def test_repeated_and_null_ids_are_judged_by_their_text(spark):
    rng = random.Random(5)
    base, other = (" ".join(words(rng, 60)) for _ in range(2))
    rows = [(1, base), (2, base + " more"), (2, other), (None, base), (None, "alone without partner here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in drop_near_copies(df).collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
    assert drop_near_copies(df.limit(0)).count() == 0


def test_a_line_in_all_texts_does_not_hide_copies(spark):
    rng = random.Random(6)
    line, texts = " ".join(words(rng, 40)), []
    for _ in range(40):
        own = words(rng, 60)
        texts += [line + " " + " ".join(own), line + " " + " ".join([*own[:-1], "changed"])]
    got = {r.doc_id: r.component_id for r in similar_components(awkward(spark, texts), common=10, tile_rows=8).collect()}
    assert got == brute(texts)
