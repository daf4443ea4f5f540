import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm.common import Scratch
from runlens.llm.graph import components
from runlens.llm.simhash import drop_near_copies, fingerprint, neighbour_offsets, simhash_components, similar_components

from .helpers import SF, awkward, empty


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def near_texts(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for _ in range(n // 3):
        base = [word() for _ in range(400)]
        texts.append(" ".join(base))
        for _ in range(2):
            edited = list(base)
            edited[rng.randrange(400)] = word()
            texts.append(" ".join(edited))
    return texts


def test_components_match_brute_force(spark):
    texts = near_texts() + [None, "", " \n", "one", "One", "a b", "A  b", "x" * 100_000, "é ß É"]
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    roots = brute_roots(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = simhash_components(awkward(spark, texts)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}
    chunked = simhash_components(awkward(spark, texts), tile_rows=1).collect()
    assert sorted(chunked) == sorted(got)
    assert len(set(roots.values())) < len(roots) - 5


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    roots = brute_roots(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash_components(docs).collect()}
    assert got == {i: (prints[i], roots[i]) for i in prints}


def test_awkward_tables(spark):
    assert simhash_components(empty(spark)).count() == 0
    assert similar_components(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (4, "a"), (4, "a"), (None, "q")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash_components(odd).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None)], key=str)


def test_tiles_meet_for_all_pairs_within_radius():
    steps = set(neighbour_offsets(2))
    assert len(steps) == 73
    rng = np.random.default_rng(5)
    shift = 4 * np.arange(8)
    tile = lambda x: int((np.bitwise_count(np.array([x], dtype=np.uint64).view(np.uint8)).astype(np.int64) + 2 << shift).sum())
    for _ in range(2000):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.integers(0, 64, rng.integers(0, 3)):
            b ^= 1 << int(bit)
        assert (tile(b) - tile(a) in steps) or (tile(a) - tile(b) in steps)


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=60))
def test_fingerprint_words(text):
    raw = text.encode("utf-8", "ignore")
    assert int(fingerprint(raw, 3, 1, False)[0][0]) == brute_print(raw.decode())


def test_similar_components_find_near_copies_only(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    texts, near = [], []
    for i in range(30):
        base = [word() for _ in range(rng.randrange(200, 400))]
        texts.append(" ".join(base))
        edited = list(base)
        for at in rng.sample(range(len(base)), max(1, len(base) // 60)):
            edited[at] = word()
        texts.append(" ".join(edited))
        near.append((2 * i, 2 * i + 1))
    for tile_rows in (8192, 7):
        got = {r.doc_id: r.component_id for r in similar_components(awkward(spark, texts), tile_rows=tile_rows).collect()}
        assert got == {i: i - i % 2 for i in range(60)}
    out = drop_near_copies(awkward(spark, texts))
    assert out.columns == awkward(spark, texts).columns and sorted(r.doc_id for r in out.collect()) == list(range(0, 60, 2))


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (None, 3), (300, 299)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    for bound in (1_000_000, 0):  # in one task, and by rounds
        got = {r.node: r.root for r in components(df, Scratch(spark, "test"), max_local_links=bound).collect()}
        assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)} | {300: 299}


def test_crowded_tiles_dealt_in_chunks_find_the_same(spark):
    """Near copies of one fingerprint in few tiles, each of many chunks."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base, texts = [word() for _ in range(2000)], []
    for _ in range(60):
        edited = list(base)
        for at in rng.sample(range(2000), 4):
            edited[at] = word()
        texts.append(" ".join(edited))
    prints = [brute_print(t) for t in texts]
    roots = brute_roots(range(60), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for rows in (1, 3, 20_000):
        got = {r.doc_id: r.component_id for r in simhash_components(awkward(spark, texts), tile_rows=rows).collect()}
        assert got == roots
    assert len(set(prints)) > 20 and len(set(roots.values())) < 40
