import hashlib
import random
import re

from runlens.llm.decontamination import contamination, drop_contaminated

from .helpers import SF, awkward, empty


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items):
    windows = {}
    for item, t in items:
        w = words(t)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("null" if item is None else str(item))
    out = {}
    for d, t in texts.items():
        w, hit, owners = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    owners |= windows[tuple(w[i : i + k])]
        out[d] = (len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit))
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def cases():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ÉA", "x9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(11, 40)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "--- !!"), (23, "short ITEM"), (24, "single1"), (None, " ".join(f"n{i}" for i in range(12))), (0, "a second text of item zero that has more than ten words in it")]
    texts = [None, "", "short, item", "SINGLE1? single1", "z" * 50_000, "no hit at all here"]
    for i in range(80):
        w = rng.choices(vocabulary, k=rng.randrange(5, 60))
        if i % 2:
            source = rng.choice([t for _, t in items if t]).split()
            n = rng.randrange(1, len(source) + 1)
            at = rng.randrange(len(source) - n + 1)
            w[3:3] = source[at : at + n]
        texts.append(rng.choice([" ", ", ", "-"]).join(w))
    return texts, items


def test_against_brute_force(spark):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(dict(enumerate(texts)), items)
    assert rows(contamination(awkward(spark, texts), bench)) == want
    assert rows(contamination(awkward(spark, texts), bench, max_seeds=0)) == want
    assert 10 < sum(v[4] for v in want.values()) < len(texts) - 5


def test_empty_sides(spark):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(empty(spark), bench).count() == 0
    assert not any(v[4] for v in rows(contamination(awkward(spark, texts), bench.limit(0))).values())


def test_table(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute({r.doc_id: r.text for r in docs.collect()}, [(r.item_id, r.text) for r in bench.collect()])
    assert rows(contamination(docs, bench)) == want


def test_repeated_and_null_ids_are_judged_by_their_text(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows_ = [(1, "clean text"), (1, "has " + passage), (None, passage), (None, None), (2, passage), (2, passage)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_hit) for r in contamination(docs, bench).collect()), key=str)
    assert got == sorted([(1, 0), (1, 12), (None, 12), (None, 0), (2, 12), (2, 12)], key=str)
    assert sorted(((r.doc_id, r.text) for r in drop_contaminated(docs, bench).collect()), key=str) == sorted([rows_[0], rows_[3]], key=str)
    assert drop_contaminated(docs.limit(0), bench).count() == 0
    assert drop_contaminated(docs, bench.limit(0)).count() == 6
