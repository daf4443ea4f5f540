"""Language-model scores by prediction by partial matching over a byte-context trie, pretrained on the corpus.

A text is its words in lower case, each with a space behind it, and then an end. The model predicts byte after byte
from the ORDER bytes before it (ends, where the text begins). The trie holds for each context how often each byte
followed. A byte that followed the longest known context gets its share; otherwise the model escapes to the next
shorter context (method C: the number of different bytes seen is the escape's count), where all bytes of the longer
one are excluded, down to equal shares of all bytes. What followed a context is counted over the whole training
corpus; counts of shorter contexts are sums of those of longer ones.

The trie is worked on in slices that share their contexts of two or more bytes, each by one task, which gives the log
share of every different (context, symbol) of the corpus. Texts are then scored by looking these shares up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches, filesystem, ids_and_texts, worker_cache

#: Bytes of context; one more byte must fit into 64 bits.
ORDER = 5
#: Different (context, symbol) codes and words whose shares and counts each Python worker may hold (16 and 12 bytes
#: each). With more, the documents are written in parts, and each part gets the codes and words that it has.
MAX_CODES, MAX_WORDS = 6_000_000, 5_000_000
#: Rows of the trie that one task works on.
SLICE_ROWS = 300_000
#: Different words or byte strings that a counting task gathers before it passes them on, and bytes worked on at once.
MAX_COUNTED, MAX_GRAMS, BLOCK_BYTES = 300_000, 1_500_000, 500_000
#: What stands behind a word and at the end of a text (no word has these bytes); the number of symbols.
SPACE, END, SYMBOLS = b" ", b"\n", 256

COUNTS = "word binary, c long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"


def is_held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    """Whether crc32 of the identifier as text (nothing for null) falls into the held-out fold."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _count(folds: int, fold: int) -> Any:
    """Words of training documents with their counts."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        from collections import Counter

        import pyarrow as pa

        schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])
        counts: Counter[bytes] = Counter()
        for batch in source:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not is_held_out(doc_id, folds, fold):
                    counts.update(raw.lower().split())
                if len(counts) >= MAX_COUNTED:
                    yield from batches(schema, [list(counts), list(counts.values())], 50_000)
                    counts = Counter()
        if counts:
            yield from batches(schema, [list(counts), list(counts.values())], 50_000)

    return run


def symbols(words: list[bytes], order: int) -> bytes:
    """The context in which a text begins, its words and its end."""
    return END * order + b"".join([w + SPACE for w in words]) + END


def gram_codes(texts: list[bytes], order: int) -> tuple[Any, Any]:
    """(context and symbol of every predicted byte packed in 64 bits, the number of them in each text)."""
    import numpy as np

    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    run = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64)
    n = len(run) - order
    out = run[order:].copy()
    for j in range(1, order + 1):
        out |= run[order - j : order - j + n] << np.uint64(8 * j)
    if order:
        predicted = np.ones(n, dtype=bool)
        starts = np.cumsum(sizes)[:-1] - order  # where the next text's opening context would be predicted
        for j in range(order):
            predicted[starts + j] = False
        out = out[predicted]
    return out, sizes - order


def _text_blocks(raws: list[bytes], order: int) -> Iterator[tuple[int, int, list[list[bytes]], list[bytes]]]:
    """(from, to, words, symbols) of neighbouring texts of about BLOCK_BYTES together."""
    at = 0
    while at < len(raws):
        start, size, words = at, 0, []
        while at < len(raws) and size < BLOCK_BYTES:
            words.append(raws[at].lower().split())
            size += len(raws[at])
            at += 1
        yield start, at, words, [symbols(w, order) for w in words]


def _counted(codes: Any, counts: Any) -> tuple[Any, Any]:
    """Different codes in order, with the sums of their counts."""
    import numpy as np

    sort = np.argsort(codes)
    codes, counts = codes[sort], counts[sort]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else sort
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _grams(order: int, folds: int, fold: int) -> Any:
    """Partial counts of (context, symbol) over training documents; those of held-out documents count nothing."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        held: list[tuple[Any, Any]] = []

        def merged() -> tuple[Any, Any]:
            return _counted(*(np.concatenate([x[i] for x in held]) for i in range(2)))

        def out(codes: Any, counts: Any) -> Iterator[Any]:
            for i in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], names=["code", "c"])

        for batch in source:
            rows = list(zip(map(lambda i: is_held_out(i, folds, fold), batch.column(0).to_pylist()), batch.column(1).cast(pa.binary()).to_pylist(), strict=True))
            for kind in (False, True):
                for _, _, _, texts in _text_blocks([raw for held_out, raw in rows if held_out == kind], order):
                    codes = np.sort(gram_codes(texts, order)[0])
                    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                    held.append((codes[first], np.diff(np.r_[first, len(codes)]) * (not kind)))
                    if sum(len(c) for c, _ in held) > MAX_GRAMS:
                        held = [merged()]
                        if len(held[0][0]) > MAX_GRAMS // 2:
                            yield from out(*held.pop())
        if held:
            yield from out(*merged())

    return run


def _part_needs(order: int) -> Any:
    """(part, code) and (part, word) of every document, each once a batch: a null word beside a code and vice versa."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        def out(part: int, codes: Any, words: list[bytes]) -> Iterator[Any]:
            for i in range(0, len(codes), 50_000):
                own = pa.array(codes[i : i + 50_000].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), type=pa.int32()), own, pa.nulls(len(own), pa.binary())], names=["part", "code", "word"])
            for i in range(0, len(words), 50_000):
                own = pa.array(words[i : i + 50_000], type=pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), type=pa.int32()), pa.nulls(len(own), pa.int64()), own], names=["part", "code", "word"])

        now, codes, words = None, np.zeros(0, dtype=np.uint64), set()
        for batch in source:
            raws, parts = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else []
            for start, end in zip(starts, [*starts[1:], len(parts)], strict=True):
                if now is not None and (parts[start] != now or len(codes) > MAX_GRAMS or len(words) > MAX_COUNTED):
                    yield from out(now, codes, list(words))
                    codes, words = codes[:0], set()
                now = int(parts[start])
                for _, _, found, texts in _text_blocks(raws[start:end], order):
                    codes = np.union1d(codes, gram_codes(texts, order)[0])
                    words.update(w for own in found for w in own)
        if now is not None:
            yield from out(now, codes, list(words))

    return run


class Trie:
    """Per order the sorted (context, symbol) codes with log shares, and per context its totals.

    codes and counts are those of the full order in one slice; `short` gives (codes, counts) of order 1 over all slices.
    """

    def __init__(self, order: int, codes: Any, counts: Any, short: tuple[Any, Any] | None = None):
        import numpy as np

        def levelled(codes: Any, counts: Any, k: int) -> tuple[Any, Any]:
            return _counted(codes & np.uint64((1 << 8 * (k + 1)) - 1), counts)

        self.order, tables = order, []
        counts = counts.astype(np.float64)
        for k in range(order, -1, -1):
            if k == 1 and short is not None:
                codes, counts = short[0], short[1].astype(np.float64)
            codes, counts = levelled(codes, counts, k)
            tables.append((codes, counts))
        self.levels: list[tuple] = []
        for k, (codes, counts) in enumerate(reversed(tables)):
            of = codes >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, dtype=np.int64)
            total = np.add.reduceat(counts, first) if len(first) else counts
            kinds = np.diff(np.r_[first, len(codes)]).astype(np.float64)
            below = np.zeros(len(first))
            if k and len(codes):  # what these symbols count in the next shorter context
                lower = tables[order - k + 1]
                below = np.add.reduceat(lower[1][np.searchsorted(lower[0], codes & np.uint64((1 << 8 * k) - 1))], first)
            narrow = [x.astype(np.float32) if len(x) and x.max() < 1 << 24 else x for x in (counts, total, kinds, below)]  # whole numbers stay exact
            self.levels.append((codes, narrow[0], of[first], *narrow[1:]))

    def log10(self, codes: Any) -> Any:
        """log10 of the probability of each symbol after its context."""
        import numpy as np

        out, left = np.zeros(len(codes)), np.arange(len(codes))
        minus_total, minus_kinds = np.zeros(len(codes)), np.zeros(len(codes))
        for level in range(self.order, -1, -1):
            table, counts, contexts, total, kinds, below = self.levels[level]
            if not len(left) or not len(contexts):
                continue
            code = codes[left] & np.uint64((1 << 8 * (level + 1)) - 1)
            entry = np.minimum(np.searchsorted(table, code), len(table) - 1)
            hit = table[entry] == code
            at = np.minimum(np.searchsorted(contexts, code >> np.uint64(8)), len(contexts) - 1)
            known = contexts[at] == code >> np.uint64(8)
            n, d = total[at].astype(np.float64) - minus_total[left], kinds[at].astype(np.float64) - minus_kinds[left]
            out[left[hit]] += np.log10(counts[entry[hit]].astype(np.float64) / (n[hit] + d[hit]))
            escapes = known & ~hit & (d > 0)
            out[left[escapes]] += np.log10(d[escapes] / (n[escapes] + d[escapes]))
            miss = known & ~hit
            minus_total[left[miss]], minus_kinds[left[miss]] = below[at[miss]], kinds[at[miss]]
            left = left[~hit]
        out[left] -= np.log10(SYMBOLS - minus_kinds[left])
        return out


def _read_table(folder: str, columns: list[str]) -> Any:
    """A written table (or one folder of it) as Arrow, read by the worker from the shared folder."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, base = filesystem(folder)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    parts = [pq.read_table(fs.open_input_file(f.path), columns=columns) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet") and f.size]
    return pa.concat_tables(parts) if parts else None


def _read_sorted(folder: str, key: str, value: str) -> tuple[Any, Any]:
    """Two number columns of a written table in order of the first, read file by file into their places."""
    import numpy as np
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, base = filesystem(folder)
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".parquet") and f.size)
    sizes = [pq.ParquetFile(fs.open_input_file(p)).metadata.num_rows for p in found]
    keys, values, at = np.zeros(sum(sizes), dtype=np.int64), None, 0
    for path, n in zip(found, sizes, strict=True):
        part = pq.read_table(fs.open_input_file(path), columns=[key, value])
        own = part[value].to_numpy()
        values = np.zeros(len(keys), dtype=own.dtype) if values is None else values
        keys[at : at + n], values[at : at + n] = part[key].to_numpy(), own
        at += n
    values = np.zeros(0) if values is None else values
    if (keys[1:] < keys[:-1]).any():  # of several slices
        sort = np.argsort(keys, kind="stable")
        keys, values = keys[sort], values[sort]
    return keys, values


def _held_one(name: str, key: str, make: Any) -> Any:
    """A worker's only object of this kind: another key replaces it."""
    held = worker_cache("lm-tables", dict, large=True).setdefault(name, {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def _log_shares(order: int, short: list[tuple[int, int]] | None) -> Any:
    """All codes of one slice with their counts: the log share of each."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in source if b.num_rows]
        if not got:
            return
        codes, counts = (np.concatenate([x[i] for x in got]) for i in range(2))
        codes = codes.view(np.uint64)
        seen = counts > 0
        whole = None if short is None else np.array(short, dtype=np.int64).reshape(-1, 2)
        trie = Trie(order, codes[seen], counts[seen], None if whole is None else (whole[:, 0].copy().view(np.uint64), whole[:, 1]))
        for i in range(0, len(codes), 200_000):
            part = np.sort(codes[i : i + 200_000])
            yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(trie.log10(part))], names=["code", "share"])

    return run


class ShareTable:
    """Log shares by code."""

    def __init__(self, folder: str):
        import numpy as np

        code, self.share = _read_sorted(folder, "code", "share")
        self.code = code.view(np.uint64)
        if len(code) and code[0] < 0:  # codes of eight bytes that a signed order puts first
            sort = np.argsort(self.code)
            self.code, self.share = self.code[sort], self.share[sort]

    def of(self, codes: Any) -> Any:
        import numpy as np

        return self.share[np.searchsorted(self.code, codes)]


class WordTable:
    """Training counts of words by hash; words that share a hash are told apart."""

    def __init__(self, folder: str):
        import numpy as np

        self.h, c = _read_sorted(folder, "h", "c")
        self.c = c.astype(np.int32 if not len(c) or c.max() < 1 << 31 else np.int64)
        self.shared: dict[bytes, int] = {}
        twice = np.unique(self.h[1:][self.h[1:] == self.h[:-1]])
        if len(twice):
            whole = _read_table(folder, ["word", "h", "c"])
            rows = np.flatnonzero(np.isin(whole["h"].to_numpy(), twice))
            self.shared = {r["word"]: r["c"] for r in whole.take(rows).to_pylist()}

    def counts(self, words: list[bytes], hashes: Any) -> Any:
        import numpy as np

        if not len(self.h):
            return np.zeros(len(words), dtype=np.int64)
        unique, inverse = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.h, unique), len(self.h) - 1)
        c = np.where(self.h[at] == unique, self.c[at], 0)[inverse]
        if self.shared:
            for i, w in enumerate(words):
                if w in self.shared:
                    c[i] = self.shared[w]
        return c


def _hashes() -> Any:
    import xxhash

    class Hashes(dict):
        """Spark's xxhash64 of words."""

        def __missing__(self, word: bytes) -> int:
            h = xxhash.xxh64_intdigest(word, 42)
            h -= (h >> 63) << 64
            if len(self) < 100_000:
                self[word] = h
            return h

    return worker_cache("signed-hashes", Hashes)


def _score_docs(codes: str, words_folder: str, stats: tuple[int, int, int], order: int, folds: int, fold: int) -> Any:
    """The sums of each document, by the tables in the folders or, where a third column names the document's part, in
    their folders of that part."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        total, kinds, ends = stats
        known, share = _hashes(), np.log10(total + kinds + 1)
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])

        def scored(ids: list[Any], raws: list[bytes], of: str) -> Iterator[Any]:
            for start, stop, words, texts in _text_blocks(raws, order):
                n = stop - start
                held = [is_held_out(i, folds, fold) for i in ids[start:stop]]
                table = _held_one("words", words_folder + of, lambda: WordTable(words_folder + of))
                flat = [w for own in words for w in own]
                doc = np.repeat(np.arange(n), [len(w) for w in words])
                c = table.counts(flat, np.fromiter(map(known.__getitem__, flat), dtype=np.int64, count=len(flat)))
                tokens = np.bincount(doc, minlength=n) + 1
                hit = np.bincount(doc, weights=c > 0, minlength=n).astype(np.int64) + (ends > 0)
                base = np.bincount(doc, weights=np.log10(c + 1.0) - share, minlength=n) + np.log10(ends + 1.0) - share
                found, sizes = gram_codes(texts, order)
                unique, inverse = np.unique(found, return_inverse=True)
                shares = _held_one("shares", codes + of, lambda: ShareTable(codes + of)).of(unique)
                model = np.bincount(np.repeat(np.arange(n), sizes), weights=shares[inverse], minlength=n)
                yield from batches(schema, [ids[start:stop], held, tokens.tolist(), hit.tolist(), base.tolist(), model.tolist()])

        for batch in source:
            if not batch.num_rows:
                continue
            ids, raws = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            if batch.num_columns < 3:
                yield from scored(ids, raws, "")
                continue
            parts = batch.column(2).to_numpy()
            starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]).tolist()
            for start, end in zip(starts, [*starts[1:], len(parts)], strict=True):
                yield from scored(ids[start:end], raws[start:end], f"/part={parts[start]}")

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, folds: int = 7, fold: int = 2, max_codes: int = MAX_CODES, max_words: int = MAX_WORDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Documents outside the held-out fold train; all are scored, on whole texts. Tokens are the words (A-Z in lower
    case, split at ASCII white space) and one end. base_score is the sum of log10((c+1)/(N+V+1)). score is the
    trie model's log10 probability of the normalised text: its tokens, written with single spaces.

    Word counts and the trie's counts are gathered by grouped aggregations over the whole corpus. The trie's rows go
    to tasks in slices of about slice_rows rows that share their contexts of two bytes and more (those of one byte or
    none, at most 65,536 rows, go to all), and each gives the log shares of its codes. Up to max_codes and max_words
    workers read shares and counts whole, from the shared folder. Beyond, the documents are written as they are read,
    one part per task; the different codes and words of each part are joined with shares and counts, and a worker
    reads those of the part at hand. Either way texts are read a fixed number of times, however large the trie.

    Null text is the empty one, which has the end alone. A null id belongs to no held-out fold. Rows that repeat
    an id and a text are scored each. An empty table gives an empty result; without training documents every
    symbol has an equal share. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "lm")
    docs = ids_and_texts(df, id_col, text_col)
    counted = docs.mapInArrow(_count(folds, fold), COUNTS).groupBy("word").agg(F.sum("c").alias("c")).where("c > 0").withColumn("h", F.xxhash64("word"))
    words = scratch.write(counted, "words")
    n_words, total = words.agg(F.count(F.lit(1)), F.sum("c")).first()
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
    ends = docs.select("doc_id").where(~held).count()
    stats = ((total or 0) + ends, n_words + (ends > 0), ends)

    grams = scratch.write(docs.mapInArrow(_grams(order, folds, fold), "code long, c long").groupBy("code").agg(F.sum("c").alias("c")), "trie")
    n_codes = grams.count()
    slices = max(1, -(-n_codes // slice_rows)) if order > 1 else 1
    short = None
    if slices > 1:  # at most 65,536 rows
        short = [(r.code, r.c) for r in grams.where("c > 0").groupBy(F.col("code").bitwiseAND(0xFFFF).alias("code")).agg(F.sum("c").alias("c")).collect()]
    last_two = F.shiftright("code", 8).bitwiseAND(0xFFFF).cast("int")
    dealt = grams.repartitionById(slices, F.pmod(F.hash(last_two), F.lit(slices)).cast("int")) if slices > 1 else grams.repartition(1)
    shares = scratch.write(dealt.mapInArrow(_log_shares(order, short), "code long, share double"), "shares")

    if n_codes <= max_codes and n_words <= max_words:
        out = docs.mapInArrow(_score_docs(f"{scratch.path}/shares", f"{scratch.path}/words", stats, order, folds, fold), RESULT)
    else:
        docs.withColumn("part", F.spark_partition_id()).write.partitionBy("part").option("compression", "zstd").parquet(f"{scratch.path}/docs")
        parted = df.sparkSession.read.schema("doc_id long, text string, part int").parquet(f"{scratch.path}/docs")
        needs = scratch.write(parted.select("text", "part").mapInArrow(_part_needs(order), "part int, code long, word binary"), "needs")
        own_codes = needs.where("code IS NOT NULL").select("part", "code").distinct().join(shares, "code")
        own_codes.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(f"{scratch.path}/part-shares")
        own_words = needs.where("word IS NOT NULL").select("part", "word").distinct().join(words, "word")
        own_words.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(f"{scratch.path}/part-words")
        scratch.drop("needs")
        out = parted.mapInArrow(_score_docs(f"{scratch.path}/part-shares", f"{scratch.path}/part-words", stats, order, folds, fold), RESULT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(stats[0]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
