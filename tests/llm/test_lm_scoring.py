import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from runlens.llm.lm_scoring import score

from .helpers import SF, awkward, empty


class Brute:
    """The model in words: a dictionary of contexts, escapes by method C, exclusion by sets."""

    def __init__(self, texts, order):
        self.order, self.trie = order, defaultdict(Counter)
        self.words = Counter()
        for t in texts:
            self.words.update([*(t or "").encode().lower().split(), None])
            for context, symbol in self.symbols(t):
                for k in range(order + 1):
                    self.trie[context[order - k :]][symbol] += 1

    def symbols(self, text):
        words = (text or "").encode().lower().split()
        run = b"\n" * self.order + b"".join(w + b" " for w in words) + b"\n"
        return [(run[i - self.order : i], run[i]) for i in range(self.order, len(run))]

    def log10(self, context, symbol):
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = self.trie.get(context[self.order - k :])
            if not seen:
                continue
            rest = {s: n for s, n in seen.items() if s not in excluded}
            total = sum(rest.values()) + len(rest)
            if symbol in rest:
                return out + math.log10(rest[symbol] / total)
            if rest:
                out += math.log10(len(rest) / total)
            excluded = set(seen)
        return out - math.log10(256 - len(excluded))

    def model(self, text):
        return sum(self.log10(c, s) for c, s in self.symbols(text))


def check(df, texts, order=5, **options):
    train = [t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    brute = Brute(train, order)
    n, v = sum(brute.words.values()), len(brute.words)
    rows = score(df, order=order, **options).collect()
    assert len(rows) == len(texts)
    for r in rows:
        tokens = [*(texts[r.doc_id] or "").encode().lower().split(), None]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.train_tokens) == (len(tokens), n)
        assert r.n_known == sum(brute.words[t] > 0 for t in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((brute.words[t] + 1) / (n + v + 1)) for t in tokens), rel=1e-9)
        assert r.score == pytest.approx(brute.model(texts[r.doc_id]), rel=1e-9)
    return rows


TEXTS = [None, "", "the cat sat on the mat", "The CAT\tsat", "é ß the\x0bthé", "x" * 3000, "a new word: zzyzx", " \n ", "the the the", "cats and mats", "on \x1c on", "日本 the"]


def test_against_brute_force(spark):
    texts = dict(enumerate(TEXTS * 2))
    for order in (0, 1, 2, 5):
        check(awkward(spark, list(texts.values())), texts, order)


def test_slices_and_parts_give_the_same(spark):
    texts = dict(enumerate(TEXTS * 2))
    docs = awkward(spark, list(texts.values()))
    check(docs, texts, 5, slice_rows=60)
    check(docs, texts, 5, slice_rows=60, max_words=9)
    check(docs.repartition(5), texts, 3, max_codes=9)
    check(docs.repartition(5), texts, 1, max_codes=0, slice_rows=1)


def test_table_prefers_its_own_language_to_noise(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = check(docs, {r.doc_id: r.text for r in docs.collect()})
    shuffled = docs.select("doc_id", F.array_join(F.shuffle(F.split("text", "")), "").alias("text"))
    noise = {r.doc_id: r.score for r in score(shuffled.unionByName(docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))).where("doc_id < 1000000").collect()}
    held = [r for r in rows if r.held_out and r.n_tokens > 20]
    assert len(held) > 10 and all(r.score > noise[r.doc_id] for r in held)


def test_empty_and_odd_tables(spark):
    assert score(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (2, "a b"), (2, "a b")], "doc_id long, text string")
    for options in ({}, {"max_words": 1, "slice_rows": 3}):
        assert sorted((str(r.doc_id), r.n_tokens) for r in score(odd, **options).collect()) == [("2", 3), ("2", 3), ("None", 2)]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    alone = score(spark.createDataFrame([(held[0], "ab")], "doc_id long, text string")).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and alone.score == pytest.approx(4 * -math.log10(256))
