"""SimHash near-deduplication by tiled exact comparison of fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast, drop_rows, free_large_caches, ids_and_texts
from .graph import components, forest, pairs_out

#: Comparisons made at a time, and found pairs kept before they are reduced to a forest.
BLOCK_PAIRS, KEPT_PAIRS = 1_000_000, 300_000
#: Fingerprints at home in a tile of which one task takes care, and tiles with more of which the tasks know (16 bytes
#: each); of a corpus with more such tiles only the larger ones are dealt out.
HOME_ROWS, MAX_HEAVY_TILES = 20_000, 500_000
#: Rows of a tile of wide fingerprints, and comparisons and pairs of tiles that one task makes.
TILE_ROWS, TASK_COMPARISONS, TASK_TILE_PAIRS = 8192, 20_000_000, 256
#: Shingles of the texts that are verified against each other at a time; larger groups are cut into blocks.
BLOCK_SHINGLES = 2_000_000
#: Smallest hashes of a set by which texts meet, texts of a band beyond which its hash says nothing, and the bands with
#: fewer texts that a text must have to do without tiles. Bands up to whose number their table is broadcast.
SKETCH, COMMON, NEEDED, MAX_BROADCAST_BANDS = 24, 1000, 12, 200_000
#: Pairs of tiles or blocks beyond which each is first compared by itself, the rows that make a component large then, and
#: the component of rows that are in none.
MANY_PAIRS, LARGE, NO_COMP = 256, 1000, -1


def shingle_hashes(raw: bytes, shingle: int, distinct: bool) -> Any:
    """The XXH64 hashes with seed 42 of a text's shingles; the distinct ones are sorted."""
    import numpy as np
    import xxhash

    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    size, joined = min(shingle, n), b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)
    return np.unique(h) if distinct else h


def set_key(h: Any) -> int:
    """A 64-bit name of a set of hashes: their sum, as a signed number."""
    import numpy as np

    return int(h.sum(dtype=np.uint64).astype(np.int64))


def fingerprint(raw: bytes, shingle: int, words64: int, distinct: bool) -> tuple[Any, int]:
    """(the fingerprint as 64-bit words, the number of shingles) of a text in UTF-8.

    Each shingle's hash is XXH64 with seed 42; further words mix that hash again. A bit is 1 if it is set in over
    half of the hashes.
    """
    h = shingle_hashes(raw, shingle, distinct)
    return _bits(h, words64), len(h)


def _bits(h: Any, words64: int) -> Any:
    """The fingerprint of hashes as 64-bit words."""
    import numpy as np

    out = np.zeros(words64, dtype=np.uint64)
    for w in range(words64):
        x = h
        if w:
            x = h + np.uint64((0x9E3779B97F4A7C15 * w) & (2**64 - 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(x), 65_536):
            part = np.ascontiguousarray(x[at : at + 65_536])
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(counts * 2 > len(x), bitorder="little").view("<u8")[0]
    return out


def _fingerprints(shingle: int, words64: int, distinct: bool, sketch: int) -> Any:
    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        free_large_caches()
        names = ["doc_id", "shingles", *(["sign", "key", "low"] if distinct else []), *(f"f{w}" for w in range(words64))]
        schema = pa.schema([(n, pa.list_(pa.int64()) if n == "low" else pa.int64()) for n in names])
        for batch in source:
            if not batch.num_rows:
                continue
            counts, keys, lows, found = [], [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                h = shingle_hashes(raw, shingle, distinct)
                counts.append(len(h))
                found.append(_bits(h, words64))
                if distinct:
                    keys.append(set_key(h))
                    lows.append(h[:sketch].view(np.int64))
            bits = np.stack(found).view(np.int64)
            own = [batch.column(2), pa.array(keys, type=pa.int64()), pa.array(lows, type=pa.list_(pa.int64()))] if distinct else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64()), *own, *(pa.array(bits[:, w]) for w in range(words64))], schema=schema)

    return run


def _fingerprint_table(df: DataFrame, id_col: str, text_col: str, scratch: Scratch, shingle: int, words64: int, distinct: bool, sketch: int = 0) -> DataFrame:
    """doc_id, shingles, the words f0.. of the fingerprint; of distinct shingles also the text's sign, the key of
    their set and its `sketch` smallest hashes, low."""
    rows = ids_and_texts(df, id_col, text_col)
    if distinct:
        rows = rows.withColumn("sign", F.xxhash64("text"))
    schema = f"doc_id long, shingles long, {'sign long, key long, low array<long>, ' if distinct else ''}" + ", ".join(f"f{w} long" for w in range(words64))
    return scratch.write(rows.mapInArrow(_fingerprints(shingle, words64, distinct, sketch), schema), "fingerprints")


class _Links:
    """Found pairs, reduced to a forest whenever there are many."""

    def __init__(self) -> None:
        self.a: list[Any] = []
        self.b: list[Any] = []
        self.n = 0

    def add(self, a: Any, b: Any) -> None:
        self.a.append(a)
        self.b.append(b)
        self.n += len(a)
        if self.n > KEPT_PAIRS:
            self._reduce()

    def _reduce(self) -> None:
        import numpy as np

        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.n = [a], [b], len(a)

    def out(self) -> Iterator[Any]:
        if self.n:
            self._reduce()
            yield from pairs_out(self.a[0], self.b[0], "a", "b")


def neighbour_offsets(radius: int, parts: int = 8) -> list[int]:
    """Half of the steps between tiles whose byte population counts differ by at most `radius` in all.

    A tile is the population counts of a fingerprint's bytes, four bits each; the step 0 comes first, and of a
    step and its negative only one is listed, so that each pair of tiles meets once.
    """
    steps: list[tuple[int, ...]] = [()]
    for _ in range(parts):
        steps = [(*s, d) for s in steps for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    half = [s for s in steps if next((d for d in s if d), 0) >= 0]
    return [sum(d * 16**i for i, d in enumerate(s)) for s in sorted(half, key=lambda s: sum(map(abs, s)))]


def _tiles_of(prints: Any, radius: int) -> Any:
    """The tile of each fingerprint; the added radius keeps steps from borrowing."""
    import numpy as np

    counts = np.bitwise_count(prints.view(np.uint8)).reshape(-1, 8).astype(np.int64)
    return ((counts + radius) << (4 * np.arange(8))).sum(axis=1)


def _tile_sizes(radius: int) -> Any:
    """How many fingerprints of each batch are at home in a tile."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        for batch in source:
            tiles, n = np.unique(_tiles_of(np.ascontiguousarray(batch.column(0).to_numpy()), radius), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tiles), pa.array(n)], names=["tile", "n"])

    return run


def _deal(radius: int, heavy: Any) -> Any:
    """Each fingerprint at home in its own tile and as a visitor in the tiles that it could have a partner in.

    A heavy tile (tile, chunks) is many: its fingerprints are at home in one chunk each and visit those before it,
    and visitors of the tile visit all. A place is tile * 2**24 + chunk.
    """

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        steps = np.array(neighbour_offsets(radius), dtype=np.int64)
        crowded, chunks = heavy.value
        for batch in source:
            prints, ids = np.ascontiguousarray(batch.column(0).to_numpy()), batch.column(1).to_numpy()
            tiles = _tiles_of(prints, radius)
            mixed = (prints.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            for at in range(0, len(prints), 2048):
                part = slice(at, at + 2048)
                n = len(prints[part])
                to, row, visits = (tiles[part, None] + steps).ravel(), np.repeat(np.arange(at, at + n), len(steps)), np.tile(np.arange(len(steps)) > 0, n)
                chunk = np.zeros(len(to), dtype=np.int64)
                if len(crowded):
                    found = np.minimum(np.searchsorted(crowded, to), len(crowded) - 1)
                    parts = np.where(crowded[found] == to, chunks[found], 1)
                    own = (mixed[row] % parts.astype(np.uint64)).astype(np.int64)
                    copies = np.where(visits, parts, own + 1)  # a visitor goes to all chunks, a home row to its own and those before
                    to, row, visits, own = (np.repeat(x, copies) for x in (to, row, visits, own))
                    chunk = np.arange(len(to)) - np.repeat(np.cumsum(copies) - copies, copies)
                    visits |= chunk != own
                yield pa.RecordBatch.from_arrays([pa.array((to << 24) + chunk), pa.array(visits), pa.array(prints[row]), pa.array(ids[row])], names=["tile", "visits", "f0", "rep"])

    return run


def _compare(radius: int) -> Any:
    """Rows sorted by tile, those at home first: every row against the earlier ones at home in its tile."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np

        links, held = _Links(), None
        for batch in source:
            if not batch.num_rows:
                continue
            tile, visits, prints, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            old = 0
            if held is not None and held[0][0] == tile[0]:
                old = len(held[0])
                tile, visits, prints, ids = (np.concatenate([h, x]) for h, x in zip(held, (tile, visits, prints, ids), strict=True))
            n = len(tile)
            starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
            of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
            homes = np.bincount(of, weights=~visits, minlength=len(starts)).astype(np.int64)
            against = np.where(visits, homes[of], np.arange(n) - starts[of])
            against[:old] = 0
            ends = np.cumsum(against)
            at = 0
            while at < n:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_PAIRS, side="right")))
                c = against[at:stop]
                total = int(c.sum())
                if total:
                    row = np.repeat(np.arange(at, stop), c)
                    home = starts[of[row]] + np.arange(total) - np.repeat(np.cumsum(c) - c, c)
                    near = np.bitwise_count((prints[row] ^ prints[home]).view(np.uint64)) <= radius  # unsigned: of a signed number the magnitude counts
                    if near.any():
                        links.add(ids[row[near]], ids[home[near]])
                at = stop
            last = slice(starts[-1], starts[-1] + homes[-1])
            held = tuple(x[last] for x in (tile, visits, prints, ids))
            if not len(held[0]):
                held = None
        yield from links.out()

    return run


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, tile_rows: int = HOME_ROWS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of 64 bits over all word shingles, repeats included, link at `radius` or fewer differing bits;
    component_id is the smallest doc_id reachable over links. Equal fingerprints are first made one, however many
    documents have them. The others are laid in tiles by the population counts of their eight bytes. Two
    fingerprints within the radius lie in tiles whose counts differ by at most the radius in all; only such tiles
    meet, and inside them every pair is compared by exclusive-or and bit counts. A tile with more than tile_rows
    fingerprints is dealt out in chunks to several tasks, each with the visitors of the tile. Each task returns a
    forest of what it found, never all pairs.

    Null and empty texts, and texts of white space, have the fingerprint zero and link like others. A text of fewer
    words than a shingle is one shingle. Null ids give rows, whose component is that of rows with ids and equal or
    near fingerprints (null if a fingerprint has null ids only). Repeated rows give repeated results. An empty
    table gives an empty result. Other columns are not read.
    """
    import numpy as np

    scratch = Scratch(df.sparkSession, "simhash")
    prints = _fingerprint_table(df, id_col, text_col, scratch, shingle, 1, False)
    reps = scratch.write(prints.groupBy("f0").agg(F.min("doc_id").alias("rep")), "reps")
    named = reps.where("rep IS NOT NULL")
    sizes = named.mapInArrow(_tile_sizes(radius), "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n"))
    sizes = scratch.write(sizes, "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bound = max(tile_rows, total // MAX_HEAVY_TILES)  # so there are no more heavy tiles than that
    found = sorted((r.tile, -(-r.n // bound)) for r in sizes.where(F.col("n") > bound).collect())
    heavy = df.sparkSession.sparkContext.broadcast(tuple(np.array([x[i] for x in found], dtype=np.int64) for i in range(2)))
    dealt = named.mapInArrow(_deal(radius, heavy), "tile long, visits boolean, f0 long, rep long")
    tiles = dealt.repartition("tile").sortWithinPartitions("tile", "visits")
    links = scratch.write(tiles.mapInArrow(_compare(radius), "a long, b long"), "links")
    roots = components(links, scratch)
    named = scratch.write(reps.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("f0").alias("f"), F.coalesce("root", "rep").alias("component_id")), "named")
    return prints.join(named, F.col("f0") == F.col("f")).select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def _tile(words64: int, rows: int) -> Any:
    """Fingerprints sorted by component to tiles of one component each: their ranges of shingle and population counts,
    and their rows as bytes."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("tile", pa.int64()), *((c, pa.int64()) for c in ("lo", "hi", "lo_bits", "hi_bits", "n", "comp")), ("data", pa.binary())])
        base, made, held, comp = TaskContext.get().partitionId() << 32, 0, [], None

        def cut(table: Any) -> Any:
            nonlocal made
            made += 1
            bits = np.bitwise_count(table[:, 2:].view(np.uint64)).sum(axis=1, dtype=np.int64)
            row = {"tile": base + made, "lo": int(table[:, 1].min()), "hi": int(table[:, 1].max()), "lo_bits": int(bits.min()), "hi_bits": int(bits.max()), "n": len(table), "comp": comp, "data": table.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        def full(last: bool) -> Iterator[Any]:
            nonlocal held
            table = np.concatenate(held) if held else np.zeros((0, 2 + words64), dtype=np.int64)
            for at in range(0, len(table) if last else len(table) - rows + 1, rows):
                yield cut(np.ascontiguousarray(table[at : at + rows]))
            held = [] if last else [table[len(table) // rows * rows :]]

        for batch in source:
            if not batch.num_rows:
                continue
            *columns, comps = (c.to_numpy() for c in batch.columns)
            table = np.column_stack(columns)
            starts = np.flatnonzero(np.r_[True, comps[1:] != comps[:-1]]).tolist()
            for start, end in zip(starts, [*starts[1:], len(comps)], strict=True):
                if comp != int(comps[start]):
                    yield from full(True)
                    comp = int(comps[start])
                held.append(table[start:end])
                if sum(map(len, held)) >= rows:
                    yield from full(False)
        yield from full(True)

    return run


def _sizes_fit(a: Any, b: Any, ratio: float) -> Any:
    """Whether different sets of these sizes can have the similarity."""
    import numpy as np

    low = np.minimum(a, b)
    shared = low - (a == b)  # at most
    return (shared > 0) & (shared / np.maximum(a + b - shared, 1) >= ratio)


def _compare_tiles(words64: int, radius: int, ratio: float) -> Any:
    """Pairs of tiles: rows within the radius whose shingle counts allow the similarity of different sets."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np

        links = _Links()

        def pair(left: Any, right: Any, same: bool) -> None:
            step = max(1, BLOCK_PAIRS // max(1, len(right)))
            lp, rp = (np.ascontiguousarray(x[:, 2:].view(np.uint64).T) for x in (left, right))
            for at in range(0, len(left), step):
                block = left[at : at + step]
                lo = np.searchsorted(right[:, 1], block[0, 1] * ratio, side="left")
                hi = np.searchsorted(right[:, 1], block[-1, 1] / ratio, side="right")
                if same:
                    lo = max(lo, at)
                if lo >= hi:
                    continue
                near = np.zeros((len(block), hi - lo), dtype=np.uint16)
                for w in range(words64):
                    near += np.bitwise_count(lp[w, at : at + step, None] ^ rp[w, None, lo:hi])
                i, j = np.nonzero(near <= radius)
                i, j = i + at, j + lo
                fits = _sizes_fit(left[i, 1], right[j, 1], ratio)
                if same:
                    fits &= i < j
                if fits.any():
                    links.add(left[i[fits], 0], right[j[fits], 0])

        for batch in source:
            for mine, theirs, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                left, right = (np.frombuffer(x.as_buffer(), dtype=np.int64).reshape(-1, 2 + words64) for x in (mine, theirs))
                pair(left, right, same)
        yield from links.out()

    return run


def candidate_radius(bits: int, similarity: float) -> int:
    """Differing bits that texts of the similarity stay within: the mean and seven standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + 7 * math.sqrt(bits * share * (1 - share)))


class _Group:
    """Texts of one group in one or two blocks, and the links between them that the exact similarity makes."""

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.ids: list[int] = []
        self.sides: list[bool] = []
        self.sets: list[Any] = []

    def add(self, uid: int, side: bool, hashes: Any) -> None:
        self.ids.append(uid)
        self.sides.append(side)
        self.sets.append(hashes)

    def links(self, two: bool) -> tuple[list[int], list[int]]:
        """Links that connect what all pairs of similar texts connect; with two blocks, only pairs across them.

        Each text in turn meets the later ones it isn't connected with yet, all at once.
        """
        import numpy as np

        n, a, b = len(self.ids), [], []
        ids, sides, sizes = np.array(self.ids, dtype=np.int64), np.array(self.sides), np.array([len(h) for h in self.sets])
        ends = np.cumsum(sizes)
        values, codes = np.unique(np.concatenate(self.sets), return_inverse=True)
        holders = np.repeat(np.arange(n, dtype=np.int32), sizes)[np.argsort(codes, kind="stable")]  # the texts of each shingle in turn
        held = np.bincount(codes, minlength=len(values))
        first = np.cumsum(held) - held
        label = np.arange(n)
        for p in range(n - 1):
            later = label[p + 1 :] != label[p]
            if two:
                later &= sides[p + 1 :] != sides[p]
            if not later.any():
                continue
            own = codes[ends[p] - sizes[p] : ends[p]]
            some = held[own]
            at = np.repeat(first[own] - (np.cumsum(some) - some), some) + np.arange(some.sum())
            shared = np.bincount(holders[at], minlength=n)[p + 1 :]
            links = p + 1 + np.flatnonzero(later & (shared > 0) & (shared / np.maximum(sizes[p] + sizes[p + 1 :] - shared, 1) >= self.similarity))
            if len(links):
                label[np.isin(label, label[links])] = label[p]
                a += [int(ids[p])] * len(links)
                b += ids[links].tolist()
        return a, b


def _verify(shingle: int, similarity: float) -> Any:
    """Rows sorted by group and pair of blocks: links between texts whose distinct shingles have the similarity."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        free_large_caches()
        links, now, group, seen = _Links(), None, _Group(similarity), set()

        def close() -> None:
            if len(group.ids) > 1:
                a, b = group.links(now[1] != now[2])
                if a:
                    links.add(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))

        for batch in source:
            rest = [batch.column(i).to_pylist() for i in range(6)]
            for *at, block, uid, key, raw in zip(*rest, batch.column(6).cast(pa.binary()).to_pylist(), strict=True):
                if at != now:
                    close()
                    now, group, seen = at, _Group(similarity), set()
                if uid in seen:
                    continue
                hashes = shingle_hashes(raw, shingle, True)
                if set_key(hashes) == key:  # an id may be repeated with another text
                    seen.add(uid)
                    group.add(uid, block != at[1], hashes)
        close()
        yield from links.out()

    return run


def _labelled(rows: DataFrame, links: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """rows with comp: the component of the links that a row lies in if it has at least `least` rows, else NO_COMP."""
    roots = components(links, scratch)
    nodes = scratch.write(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "label-nodes")
    large = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    known = scratch.write(nodes.join(large.select("root"), "root", "left_semi").select(F.col("node").alias("uid"), F.col("root").alias("own_")), "labels")
    return scratch.write(rows.drop("comp").join(known, "uid", "left").withColumn("comp", F.coalesce("own_", F.lit(NO_COMP))).drop("own_"), "labelled")


def _verified(df: DataFrame, id_col: str, text_col: str, reps: DataFrame, candidates: DataFrame, scratch: Scratch, shingle: int, similarity: float, block_shingles: int, many: int) -> DataFrame:
    """Links (a, b) inside the groups that the candidates connect, by the exact similarity of distinct shingles.

    A group of at most block_shingles shingles is one block. The members of a larger one are dealt by size class and
    hash into blocks of about so many; each pair of blocks whose counts allow the similarity is the work of one task at
    a time. With more than `many` such pairs, blocks are first verified by themselves, in two different dealings; texts
    that this connects in large components are not compared with others of their component any more, so that a very
    large group of near copies takes linear work.
    """
    roots = components(candidates, scratch)
    nodes = scratch.write(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "nodes")
    members = reps.join(nodes, F.col("uid") == F.col("node")).select("root", "uid", "rep", "key", "shingles", F.lit(NO_COMP).alias("comp"))
    members = scratch.write(members, "members")

    def dealt(rows: DataFrame, step: float, salt: str, name: str) -> DataFrame:
        """rows with their block: comp, size class, and as many parts by hash as the class's shingles need."""
        sized = rows.withColumn("class", F.floor(F.log(F.col("shingles").cast("double")) / math.log(step)) if step else F.lit(0).cast("long"))
        parts = scratch.write(sized.groupBy("root", "comp", "class").agg(F.ceil(F.sum("shingles") / F.lit(float(block_shingles))).alias("parts")), f"parts-{name}")
        part = F.pmod(F.xxhash64("uid", F.lit(salt)), F.col("parts"))
        block = F.concat_ws(":", *[c.cast("string") for c in (F.col("comp"), F.col("class"), part)])
        return scratch.write(sized.join(parts, ["root", "comp", "class"]).withColumn("block", block).drop("class", "parts"), f"blocks-{name}")

    def linked(blocks: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
        rows = blocks.join(sides, ["root", "block"]).select("root", "i", "j", "block", "uid", "rep", "key")
        texts = rows.join(ids_and_texts(df, id_col, text_col), F.col("rep") == F.col("doc_id")).select("root", "i", "j", "block", "uid", "key", "text")
        ready = texts.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
        return scratch.write(ready.mapInArrow(_verify(shingle, similarity), "a long, b long"), name)

    def meeting(blocks: DataFrame) -> DataFrame:
        ranges = blocks.groupBy("root", "block", "comp").agg(F.min("shingles").alias("lo"), F.max("shingles").alias("hi"))
        left, right = (ranges.select("root", F.col("block").alias(n), F.col("lo").alias(f"lo_{n}"), F.col("hi").alias(f"hi_{n}"), F.col("comp").alias(f"comp_{n}")) for n in ("i", "j"))
        fits = (F.col("lo_i") * similarity <= F.col("hi_j")) & (F.col("lo_j") * similarity <= F.col("hi_i"))
        apart = (F.col("comp_i") != F.col("comp_j")) | (F.col("comp_i") == NO_COMP)
        return left.join(right, "root").where((F.col("i") <= F.col("j")) & fits & apart).select("root", "i", "j")

    alone = lambda blocks: blocks.select("root", F.col("block").alias("i"), F.col("block").alias("j")).distinct()
    large = scratch.write(members.groupBy("root").agg(F.sum("shingles").alias("total")).where(F.col("total") > block_shingles).select("root"), "large")
    if large.isEmpty():
        whole = members.withColumn("block", F.lit("all"))
        return linked(whole, alone(whole), "verified")
    known = bounded_broadcast(large, MAX_BROADCAST_BANDS)
    whole = members.join(known, "root", "left_anti").withColumn("block", F.lit("all"))
    found = linked(whole, alone(whole), "verified")
    members = scratch.write(members.join(known, "root", "left_semi"), "large-members")
    blocks = dealt(members, 1 / similarity, "size", "size")
    pairs = scratch.write(meeting(blocks), "pairs")
    if pairs.count() - alone(blocks).count() <= many:
        return found.unionByName(linked(blocks, pairs, "verified-large"))
    mixed = dealt(members, 0, "mixed", "mixed")
    first = linked(blocks, alone(blocks), "verified-size").unionByName(linked(mixed, alone(mixed), "verified-mixed"))
    blocks = dealt(_labelled(members, first, Scratch(df.sparkSession, "similar-labels"), LARGE), 1 / similarity, "size", "rest")
    return found.unionByName(first).unionByName(linked(blocks, scratch.write(meeting(blocks), "pairs-rest"), "verified-rest"))


def _compare_bands(words64: int, radius: int, ratio: float) -> Any:
    """Rows sorted by band: every row against the earlier ones of its band, as _compare_tiles decides."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np

        links, held = _Links(), None
        for batch in source:
            if not batch.num_rows:
                continue
            table = np.column_stack([c.to_numpy() for c in batch.columns])  # band, uid, shingles, f0..
            old = 0
            if held is not None and held[0, 0] == table[0, 0]:
                old, table = len(held), np.concatenate([held, table])
            n = len(table)
            starts = np.flatnonzero(np.r_[True, table[1:, 0] != table[:-1, 0]])
            against = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
            first = np.arange(n) - against
            against[:old] = 0
            prints, ends, at = np.ascontiguousarray(table[:, 3:].T).view(np.uint64), np.cumsum(against), 0
            while at < n:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_PAIRS, side="right")))
                c = against[at:stop]
                total = int(c.sum())
                if total:
                    row = np.repeat(np.arange(at, stop), c)
                    other = first[row] + np.arange(total) - np.repeat(np.cumsum(c) - c, c)
                    fits = _sizes_fit(table[row, 2], table[other, 2], ratio)
                    row, other = row[fits], other[fits]
                    far = np.zeros(len(row), dtype=np.uint16)
                    for w in range(words64):
                        far += np.bitwise_count(prints[w, row] ^ prints[w, other])
                    near = far <= radius
                    if near.any():
                        links.add(table[row[near], 1], table[other[near], 1])
                at = stop
            held = table[starts[-1] :]
        yield from links.out()

    return run


def _banded(reps: DataFrame, scratch: Scratch, words64: int, radius: int, similarity: float, sketch: int, needed: int, common: int) -> tuple[DataFrame, DataFrame]:
    """(links inside bands; the reps that have to be compared by tiles as well)."""
    names = [f"f{w}" for w in range(words64)]
    keys = reps.select("uid", F.explode("low").alias("band"))
    bands = scratch.write(keys.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    shared = scratch.write(keys.join(bounded_broadcast(bands, MAX_BROADCAST_BANDS), "band"), "shared")
    often = shared.where(F.col("n") > common).groupBy("uid").agg(F.count(F.lit(1)).alias("often"))
    often = scratch.write(often, "often")
    poor = scratch.write(reps.join(often, "uid").where(F.size("low") - F.col("often") < needed).drop("often"), "poor")
    inside = shared.where(F.col("n") <= common).select("uid", "band").join(reps.select("uid", "shingles", *names), "uid").select("band", "uid", "shingles", *names)
    dealt = inside.repartition("band").sortWithinPartitions("band")
    return scratch.write(dealt.mapInArrow(_compare_bands(words64, radius, similarity), "a long, b long"), "band-links"), poor


def _tiled(rows: DataFrame, scratch: Scratch, words64: int, radius: int, similarity: float, tile_rows: int, many: int) -> DataFrame:
    """Links among rows by tiles: sorted by their counts of shingles and cut; tiles whose ranges of shingle counts and
    of population counts can hold partners meet. Which tiles meet is an equality join on steps of the size.

    With more than `many` pairs of tiles, tiles are first compared by themselves, sorted and in random order, as in
    _verified.
    """
    names = [f"f{w}" for w in range(words64)]
    schema = "tile long, lo long, hi long, lo_bits long, hi_bits long, n long, comp long, data binary"
    step = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1)).cast("double")) / math.log(1 / similarity))

    def cut(rows: DataFrame, order: list[Any], name: str) -> DataFrame:
        ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("uid", "shingles", *names, "comp")
        return scratch.write(ordered.mapInArrow(_tile(words64, tile_rows), schema), f"tiles-{name}")

    def meeting(tiles: DataFrame) -> DataFrame:
        meta = tiles.drop("data")
        mine = meta.select(*(F.col(c).alias(f"a_{c}") for c in meta.columns), F.explode(F.sequence(step("lo") - 1, step("hi") + 2)).alias("step"))
        theirs = meta.select(*(F.col(c).alias(f"b_{c}") for c in meta.columns), step("lo").alias("step"))
        ordered_pair = (F.col("a_lo") < F.col("b_lo")) | ((F.col("a_lo") == F.col("b_lo")) & (F.col("a_tile") <= F.col("b_tile")))
        apart = (F.col("a_comp") != F.col("b_comp")) | (F.col("a_comp") == NO_COMP)
        can = (F.col("b_lo") * similarity <= F.col("a_hi")) & (F.col("a_lo_bits") - F.col("b_hi_bits") <= radius) & (F.col("b_lo_bits") - F.col("a_hi_bits") <= radius)
        return mine.join(theirs, "step").where(ordered_pair & can & apart).select("a_tile", "b_tile", (F.col("a_n") * F.col("b_n")).alias("work"))

    def linked(tiles: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        work, n = pairs.agg(F.sum("work"), F.count(F.lit(1))).first()
        both = pairs.join(tiles.select(F.col("tile").alias("a_tile"), F.col("data").alias("mine")), "a_tile").join(tiles.select(F.col("tile").alias("b_tile"), F.col("data").alias("theirs")), "b_tile")
        dealt = both.select("mine", "theirs", (F.col("a_tile") == F.col("b_tile")).alias("same")).repartition(max(1, min(n, (work or 0) // TASK_COMPARISONS + n // TASK_TILE_PAIRS + 1, 200_000)))
        return scratch.write(dealt.mapInArrow(_compare_tiles(words64, radius, similarity), "a long, b long"), name)

    alone = lambda tiles: tiles.select(F.col("tile").alias("a_tile"), F.col("tile").alias("b_tile"), (F.col("n") * F.col("n")).alias("work"))
    rows = rows.withColumn("comp", F.lit(NO_COMP))
    tiles = cut(rows, ["comp", "shingles", "f0"], "size")
    pairs = scratch.write(meeting(tiles), "tile-pairs")
    if pairs.count() - tiles.count() <= many:
        return linked(tiles, pairs, "tile-links")
    mixed = cut(rows.withColumn("shuffled", F.xxhash64("uid", F.lit("mixed"))), ["comp", "shuffled"], "mixed")
    first = linked(tiles, alone(tiles), "links-size").unionByName(linked(mixed, alone(mixed), "links-mixed"))
    tiles = cut(_labelled(rows, first, Scratch(rows.sparkSession, "similar-tiles"), LARGE), ["comp", "shingles", "f0"], "rest")
    return first.unionByName(linked(tiles, scratch.write(meeting(tiles), "tile-pairs-rest"), "links-rest"))


def _similar(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, words64: int, tile_rows: int, block_shingles: int, sketch: int, needed: int, common: int, many: int) -> DataFrame:
    """doc_id, sign, component_id of similar_components."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "similar")
    radius = candidate_radius(64 * words64, similarity)
    prints = _fingerprint_table(df, id_col, text_col, scratch, shingle, words64, True, sketch)
    names = [f"f{w}" for w in range(words64)]
    same = ["shingles", "key", "low"]
    reps = scratch.write(prints.groupBy(*same, *names).agg(F.min("doc_id").alias("rep")).withColumn("uid", F.xxhash64(*same)), "reps")
    known = reps.where("rep IS NOT NULL AND shingles > 0")
    links, poor = _banded(known, scratch, words64, radius, similarity, sketch, needed, common)
    if not poor.isEmpty():
        links = links.unionByName(_tiled(poor, scratch, words64, radius, similarity, tile_rows, many))
    links = _verified(df, id_col, text_col, known, links, scratch, shingle, similarity, block_shingles, many)
    roots = components(links, Scratch(spark, "similar-verified"))
    rooted = scratch.write(reps.join(roots, F.col("uid") == F.col("node"), "left").select(*same, "rep", F.coalesce("root", "uid").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = scratch.write(rooted.join(scratch.write(first, "first"), "root").select(*same, "component_id"), "named")
    return prints.join(named, same).select("doc_id", "sign", "component_id")


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words64: int = 4, tile_rows: int = TILE_ROWS, block_shingles: int = BLOCK_SHINGLES, sketch: int = SKETCH, needed: int = NEEDED, common: int = COMMON, many: int = MANY_PAIRS) -> DataFrame:
    """One row per input row: doc_id, component_id, for near copies by word shingles.

    Two texts link if the Jaccard similarity of their sets of distinct shingles is `similarity` or more. Equal sets
    are first made one. The fingerprint has 64 * words64 bits over the set, and only finds candidates: its radius is
    seven standard deviations above the number of bits in which texts of exactly that similarity differ (with 256
    bits and 0.8, 38.8 on average, radius 78; unrelated texts differ in about 128). A pair at 0.8 is missed with a
    chance of about one in ten million at worst, which is for texts of four against five shingles. Candidates link
    only after their sets are compared, as 64-bit hashes of the shingles.

    Which fingerprints meet: a text lies in one band for each of the `sketch` smallest hashes of its set, and in a
    band every pair is compared by exclusive-or and bit counts. Each of the smallest hashes of a pair at 0.8 is
    shared with a chance of 0.8, so that a pair without a common band has one of 0.2 ** 24. Bands of more than
    `common` texts (shingles of licenses and the like) are not compared, which leaves a text with `needed` others a
    chance of 0.4 ** 12 (one in 60,000) to miss a pair at worst, where half of its shingles are so common and all
    differences lie in the other half. A text left with fewer than `needed` other bands is compared by tiles with all
    texts of its kind instead: these are sorted by their counts of shingles and cut into tiles; a tile meets the tiles
    whose ranges of shingle counts and population counts can hold partners, and compares every pair there. What the
    candidates connect is then verified in groups, large ones in pairs of blocks. Both compare a very large group of
    near copies within tiles (blocks) first, sorted and in random order, and then only what this has not connected. So
    the work follows the number of texts, except among unlike texts that consist of very common shingles, where it
    follows the square.

    Rows that repeat an id have the component of their own text. Sets that only null ids have are components of their
    own (null). Nulls, empty texts and tables and other columns as in simhash_components.
    """
    return _similar(df, id_col, text_col, shingle, similarity, words64, tile_rows, block_shingles, sketch, needed, common, many).drop("sign")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that have the smallest id of their near-copy group, with the columns of docs.

    Rows that repeat an id are judged by their own text each. A row with a null id goes if a row with an id has the
    same shingles; sets that only null ids have are not compared and stay. Null and empty texts are one group. An
    empty table gives an empty one.
    """
    found = _similar(docs, id_col, text_col, 5, 0.8, 4, TILE_ROWS, BLOCK_SHINGLES, SKETCH, NEEDED, COMMON, MANY_PAIRS)
    copies = found.where("component_id IS NOT NULL").where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "sign")
    return drop_rows(docs, id_col, text_col, Scratch(docs.sparkSession, "similar-gone").write(copies, "removed"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
