import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from runlens.llm.line_dedup import line_dedup

from .helpers import SF, awkward, empty

WS = " \t\n\r\x0b\x0c"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(texts):
    holders = defaultdict(set)
    for d, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 40:
                holders[key_of(line)].add(d)
    out = {}
    for d, t in texts.items():
        lines = (t or "").split("\n")
        keep = [not (len(holders.get(key_of(x), ())) >= 5 and max(holders[key_of(x)]) != d) for x in lines]
        kept = "\n".join(x for x, k in zip(lines, keep, strict=True) if k)
        out[d] = (len(lines), len(lines) - sum(keep), hashlib.sha256(kept.encode()).hexdigest(), keep)
    return out


def check(df, texts, **options):
    rows = line_dedup(df, **options).collect()
    want = brute(texts)
    assert len(rows) == len(want)
    for r in rows:
        keep = np.unpackbits(np.frombuffer(zlib.decompress(r.keep_bitmap), dtype=np.uint8), count=r.n_lines).astype(bool).tolist()
        assert (r.n_lines, r.n_dropped, r.kept_sha256, keep) == want[r.doc_id]
    return sum(r.n_dropped for r in rows)


def test_awkward_lines(spark):
    rng = random.Random(2)
    common = ["The licence of this line is the licence of all lines", "  " + "é" * 40 + "\t", "x" * 39, "Y" * 40]
    texts = [None, "", "\n\n", "x" * 60_000]
    for i in range(200):
        texts.append("\n".join(rng.choices(common + [f"only document {i} has this line of text, surely"], k=rng.randrange(6)) + [common[0].upper()] * (i % 3)))
    frame = awkward(spark, texts).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # many small ranges, so that the common lines cross their borders
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert check(frame, dict(enumerate(texts))) > 100
        check(frame, dict(enumerate(texts)), max_broadcast_rows=0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_table_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs, {r.doc_id: r.text for r in docs.collect()})
    assert line_dedup(empty(spark)).count() == 0


def test_repeated_and_null_ids(spark):
    line = "a line that is long enough to count, here and there"
    rows = [(None, line), (1, line), (1, line + "\nx"), (2, line), (3, line), (4, line)]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 1, 1), ("1", 2, 1), ("2", 1, 1), ("3", 1, 1), ("4", 1, 0), ("None", 1, 1)]
