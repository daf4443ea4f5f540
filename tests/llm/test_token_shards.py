import io
import zlib

import numpy as np
import pytest

from runlens.llm.token_shards import ShardReader, ShardWriter, open_shard, read_shards, write_shards

from .helpers import SF, awkward, empty
from .test_packing import ids_of


def brute(texts):
    start, out = 0, {}
    for d in sorted(texts):
        ids = ids_of(texts[d], 1)
        out[d] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    return out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    texts = {r.doc_id: r.text for r in docs.collect()}
    manifest = write_shards(docs)
    rows = read_shards(manifest).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == brute(texts)
    assert {r.found for r in rows if r.doc_id % 100 == 0} == {True} and {r.found for r in rows if r.doc_id % 100} == {None}
    shards = [open_shard(r.path) for r in manifest.collect()]
    for d in list(texts)[:20]:
        found = [s.get(d) for s in shards]
        assert [f for f in found if f is not None] == [np.array(ids_of(texts[d], 1), dtype="<u4").tobytes()]
    assert all(s.get(10**9) is None for s in shards)


def test_awkward_rows(spark):
    texts = [None, "", "a b", "many words " * 20_000, "a b"]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_shards(write_shards(awkward(spark, texts))).collect()}
    assert got == brute(dict(enumerate(texts)))
    assert read_shards(write_shards(empty(spark))).count() == 0
    odd = spark.createDataFrame([(None, "b"), (-5, "a"), (3, "c"), (3, "c")], "doc_id long, text string")
    rows = sorted((r.start, r.doc_id) for r in read_shards(write_shards(odd)).collect())
    assert rows == [(0, None), (2, -5), (4, 3), (6, 3)]


def test_file_format():
    sink = io.BytesIO()
    w = ShardWriter(sink, width=4, block_bytes=200)
    rows = [(None, b""), (-7, b"\1\0\0\0")] + [(i * 3, np.arange(i % 9 + 70_000, i % 9 + 70_000 + i % 5, dtype="<u4").tobytes()) for i in range(500)]
    for d, ids in rows:
        w.add(d, ids)
    with pytest.raises(ValueError):
        w.add(5, b"")
    w.close()
    data = sink.getvalue()
    r = ShardReader(io.BytesIO(data), len(data))
    assert list(r.scan()) == rows and len(r.blocks) > 10
    assert all(r.get(d) == ids for d, ids in rows) and r.get(4) is None
    with pytest.raises(ValueError):
        ShardReader(io.BytesIO(data[:-40] + b"\7" * 4 + data[-36:]), len(data))
