"""Near duplicates among embeddings by a subspace pigeonhole join.

Vectors are scaled to length one, so that cosine >= c means a squared distance of at most 2 - 2 c, and turned by a fixed
random rotation, which spreads the variance evenly. Cut into blocks of coordinates, two vectors that close must agree in at
least one block within its share of that squared distance (in proportion to its width). So each block is range-joined by
itself, in two steps:

1. A block is cut into cells by the signs of its first coordinates. A vector goes to its own cell and to those cells of
   smaller number that its range reaches, with no more than its coordinates in the block as 16-bit numbers and a sketch of 8-bit
   numbers of the others; cells with many vectors are dealt out in tiles, each pair of tiles being one task's work. There a vector
   is compared with the others of its cell and with the visitors from cells that its own range reaches. Rounding only widens the
   ranges. What comes back is which vectors have met a candidate, where.
2. These vectors, in full, meet again there, and their candidates are verified by the cosine in double precision. A pair counts
   in the first block where it is within the share, so it counts once. Tasks return counts and a spanning forest, never pairs.

Equal vectors are compared as one, with their number. Only vectors of one width are compared with each other.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.components import components
from mailsift.session import write_and_read

COSINE = 0.95
WIDTH = 8
#: Vectors of a tile. It bounds what a task holds: two tiles.
TILE = 4096
#: Vectors that a cell holds on average, until its block has no more coordinates to be cut at.
CELL = 800
#: Coordinates of a sketch.
SKETCH = 32
#: Slack for rounding in doubles, by which squared distances may be wrong.
SLACK = 1e-9
#: Vectors that a task of the first step deals out at a time.
DEALT = 8192
KEYS = ["width", "block", "cell", "tiles"]


@functools.lru_cache(maxsize=16)
def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random rotation, the same on every run."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one in double precision. Scaling by the largest component first keeps squares in range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def shares(dim: int, limit: float) -> list[float]:
    """What each block may take of the squared distance."""
    return [limit * min(WIDTH, dim - a) / dim for a in range(0, dim, WIDTH)]


def widened(budget: float, width: int) -> float:
    """A block's share in the numbers of the first step: 16-bit steps on both sides, and single precision."""
    return (np.sqrt(budget) + np.sqrt(width) / 32767 + 1e-5) ** 2 + 2e-6


def by_width(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """vec_id and vectors of one width, some `rows` at a time."""

    def parts(held: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        whole = pa.Table.from_batches(held).combine_chunks()
        column, ids = whole["embedding"].combine_chunks(), whole["vec_id"].to_numpy()
        width = column.value_lengths().to_numpy()
        for dim in np.unique(width).tolist():
            at = np.flatnonzero(width == dim)
            values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            yield ids[at], values.astype(np.float64).reshape(-1, dim)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield from parts(held)
            held, n = [], 0
    if n:
        yield from parts(held)


def reached(block: np.ndarray, signs: int, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cells, own cells) of the cells of no larger number than its own that each row's range reaches; own ones first."""
    near = block[:, :signs]
    own = (near > 0) @ (1 << np.arange(signs))
    for mask in range(1 << signs):
        flipped = [k for k in range(signs) if mask >> k & 1]
        inside = np.flatnonzero((near[:, flipped] ** 2).sum(axis=1) <= budget + SLACK)
        cells = own[inside] ^ mask
        inside, cells = inside[cells <= own[inside]], cells[cells <= own[inside]]
        yield inside, cells, own[inside]


def sketched(turned: np.ndarray) -> np.ndarray:
    """Some coordinates as 8-bit numbers. Cutting off large ones brings vectors nearer only."""
    dim = turned.shape[1]
    at = np.unique(np.linspace(0, dim - 1, min(dim, SKETCH)).astype(int))
    return np.rint(np.clip(turned[:, at] * np.sqrt(dim) / 4, -1, 1) * 127).astype(np.int8)


def cell_sizes(signs: int, limit: float):
    """For a task: how many vectors it sends to each cell of each block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int], int] = {}
        for _, raw in by_width(batches, DEALT):
            dim = raw.shape[1]
            turned = unit(raw) @ rotation(dim)
            for b, budget in enumerate(shares(dim, limit)):
                block = turned[:, b * WIDTH : (b + 1) * WIDTH]
                for _, cells, _ in reached(block, min(signs, block.shape[1]), budget):
                    for cell, n in zip(*np.unique(cells, return_counts=True), strict=True):
                        totals[dim, b, int(cell)] = totals.get((dim, b, int(cell)), 0) + int(n)
        keys = list(zip(*totals, strict=True)) if totals else [(), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), pa.array(totals.values(), pa.int64())], ["width", "block", "cell", "n"])

    return count


def tile_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n


def dealt(signs: int, limit: float, tiles: dict[tuple[int, int, int], int]):
    """For a task: what its vectors show of themselves in each cell and pair of tiles, as columns of bytes for many vectors."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw in by_width(batches, DEALT):
            dim = raw.shape[1]
            turned = unit(raw) @ rotation(dim)
            sketch = sketched(turned)
            for b, budget in enumerate(shares(dim, limit)):
                block = turned[:, b * WIDTH : (b + 1) * WIDTH]
                coded = np.rint(block * 32767).astype("<i2")
                rows, cells, own = (np.concatenate(x) for x in zip(*reached(block, min(signs, block.shape[1]), budget), strict=True))
                order = np.argsort(cells, kind="stable")
                rows, cells, own = rows[order], cells[order], own[order]
                cuts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])).tolist()
                out: list[tuple] = []
                for x, y in zip(cuts, [*cuts[1:], len(cells)], strict=True):
                    cell, n = int(cells[x]), tiles.get((dim, b, int(cells[x])), 1)
                    tile = tile_of(ids[rows[x:y]], n)
                    for pair in range(n * (n + 1) // 2) if n > 1 else [0]:
                        first, second = pair_of(pair, n)
                        at = x + np.flatnonzero((tile == first) | (tile == second)) if n > 1 else np.arange(x, y)
                        if len(at):
                            here = rows[at]
                            out.append((dim, b, cell, pair, ids[here].astype("<i8").tobytes(), own[at].astype("<i4").tobytes(), coded[here].tobytes(), sketch[here].tobytes()))
                for a in range(0, len(out), 64):
                    columns = zip(*out[a : a + 64], strict=True)
                    kinds = [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*KEYS, "ids", "own", "coded", "sketch"])

    return deal


def pair_of(pair: int, n: int) -> tuple[int, int]:
    """The tiles of a pair, numbered row by row: (0, 0), (0, 1), ..., (1, 1), ..."""
    first = 0
    while pair >= n - first:
        pair -= n - first
        first += 1
    return first, first + pair


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Rows that share the KEYS, which the batches are sorted by."""
    key, held = None, []
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in KEYS]
        cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist() if len(batch) else []
        for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if a == b:
                continue
            this = tuple(int(c[a]) for c in columns)
            if key is not None and this != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = this
            held.append(batch.slice(a, b - a))
    if key is not None:
        yield key, pa.Table.from_batches(held)


def met(limit: float, tiles: dict[tuple[int, int, int], int]):
    """For a task: which of its vectors have met a candidate in which cell and pair of tiles."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, b, cell, pair), rows in groups(batches):
            ids, own = (np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in (("ids", "<i8"), ("own", "<i4")))
            block = np.frombuffer(b"".join(rows["coded"].to_pylist()), "<i2").reshape(len(ids), -1).astype(np.float32) / np.float32(32767)
            sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.int8).reshape(len(ids), -1)
            n = tiles.get((dim, b, cell), 1)
            # slack: half a step of each number on both sides, and some more for single precision
            most = (np.sqrt(limit) + np.sqrt(sketch.shape[1]) * 4 / 127 / np.sqrt(dim)) * 127 * np.sqrt(dim) / 4
            hit = candidates(block, own, cell, sketch.astype(np.float32), shares(dim, limit)[b], float(most**2) * 1.001, tile_of(ids, n) if n > 1 else None, *pair_of(pair, n))
            at = np.flatnonzero(hit)
            keys = [pa.array(np.full(len(at), k), t) for k, t in zip((dim, b, cell, pair), [pa.int32()] * 3 + [pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(own[at]), pa.array(ids[at])], [*KEYS, "own", "vec_id"])

    return meet


def candidates(block: np.ndarray, own: np.ndarray, cell: int, sketch: np.ndarray, budget: float, most: float, tile: np.ndarray | None, first: int, second: int) -> np.ndarray:
    """Marks vectors that are within the block's share of another one, with sketches near enough as well."""
    hit = np.zeros(len(block), bool)
    norms, outer = (block * block).sum(axis=1), (sketch * sketch).sum(axis=1)
    budget = widened(budget, block.shape[1])
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1])).tolist()
    home = np.flatnonzero(own == cell)
    for x, y in zip(cuts, [*cuts[1:], len(order)], strict=True):
        there = order[x:y]
        flipped = [k for k in range(block.shape[1]) if (int(own[there[0]]) ^ cell) >> k & 1]
        # only vectors of this cell whose own range reaches the visitors' cell
        here = home[(block[home][:, flipped] ** 2).sum(axis=1) <= budget]
        for side in [(None, None)] if tile is None or first == second else [(first, second), (second, first)]:
            left = here if side[0] is None else here[tile[here] == side[0]]
            right = there if side[1] is None else there[tile[there] == side[1]]
            for a in range(0, len(left), 256):
                rows = left[a : a + 256]
                near = norms[rows, None] + norms[None, right] - 2 * block[rows] @ block[right].T <= budget
                for k in range(0, len(rows), 16):  # few rows at a time: whom they mark need not be looked at again
                    few = rows[k : k + 16]
                    i, j = np.nonzero(near[k : k + 16] & ~(hit[few][:, None] & hit[right][None, :]))
                    i, j = few[i], right[j]
                    i, j = i[i != j], j[i != j]
                    for c in range(0, len(i), 1 << 15):
                        p, q = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
                        gap = outer[p] + outer[q] - 2 * np.einsum("ij,ij->i", sketch[p], sketch[q])
                        p, q = p[gap <= most], q[gap <= most]
                        hit[p] = hit[q] = True
    return hit


def verified(cosine: float, limit: float, tiles: dict[tuple[int, int, int], int]):
    """For a task with candidates in full: their links, as (vec_id, root, n): n other vectors counted here, root the smallest reached."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, b, cell, pair), rows in groups(batches):
            ids, copies, own = (rows[c].to_numpy() for c in ("vec_id", "copies", "own"))
            vectors = unit(rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
            order = np.argsort(ids, kind="stable")
            ids, copies, own, vectors = ids[order], copies[order], own[order], vectors[order]
            turned, budgets = vectors @ rotation(dim), [x + SLACK for x in shares(dim, limit)]
            n = tiles.get((dim, b, cell), 1)
            tile = tile_of(ids, n)
            cross = n > 1 and len(set(pair_of(pair, n))) > 1
            home = np.flatnonzero(own == cell)
            # of a pair of this cell's vectors only the one with the smaller id looks at the other
            good, first = np.zeros((len(home), len(ids)), bool), np.zeros((len(home), len(ids)), bool)
            for a in range(0, len(home), 512):
                left = home[a : a + 512]
                pairs = (own[None, :] != cell) | (left[:, None] < np.arange(len(ids))[None, :])
                if cross:  # pairs within a tile belong to that tile's own group
                    pairs &= tile[left][:, None] != tile[None, :]
                good[a : a + 512] = pairs & (vectors[left] @ vectors.T >= cosine)
                for k in range(b + 1):
                    part = turned[:, k * WIDTH : (k + 1) * WIDTH]
                    norms = (part * part).sum(axis=1)
                    within = norms[left, None] + norms[None, :] - 2 * part[left] @ part.T <= budgets[k]
                    if k == b:
                        first[a : a + 512] = within & ~first[a : a + 512] & good[a : a + 512]
                    else:
                        first[a : a + 512] |= within
            counts = copies @ first.T.astype(np.float64) if len(home) else np.zeros(0)
            n_links = copies[home] @ first.astype(np.float64) if len(home) else np.zeros(len(ids))
            n_links[home] += counts
            linked = good.any(axis=0)
            linked[home] |= good.any(axis=1)
            at = np.flatnonzero(linked)
            if len(at):
                roots = ids[forest(good, home, len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(roots[at]), pa.array(np.rint(n_links[at]).astype(np.int64))], ["vec_id", "root", "n"])

    return verify


def forest(good: np.ndarray, home: np.ndarray, n: int) -> np.ndarray:
    """For each of n vectors the first one that links reach; good[i, j] links home[i] with j. Labels sink and are doubled."""
    label = np.arange(n)
    while True:
        new = label.copy()
        for a in range(0, len(home), 256):
            part, rows = good[a : a + 256], home[a : a + 256]
            new[rows] = np.minimum(new[rows], np.where(part, label[None, :], n).min(axis=1, initial=n))
            new = np.minimum(new, np.where(part, label[rows][:, None], n).min(axis=0, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def usable(embedding: Column) -> Column:
    """Whether a vector can link: not null or empty, all components finite, one of them not zero."""
    value = lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))
    finite = F.forall(embedding, lambda x: F.abs(value(x)) < float("inf"))  # NaN is greater than any number in Spark
    return F.coalesce(finite & F.exists(embedding, lambda x: value(x) != 0), F.lit(False))


def near_vectors(rows: DataFrame, cosine: float = COSINE, tile: int = TILE, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `rows` (vec_id, embedding).

    Links are pairs of rows with cosine >= `cosine` and equal width. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Rows that repeat an id and a vector are one vector; if ids repeat with other
    vectors, the first by value counts. A null id links with nothing. Other columns are not read.
    """
    given = rows.select("vec_id", "embedding").where("vec_id IS NOT NULL")
    # equal vectors are one class: told apart by two hashes of 64 bits
    each = given.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).where(usable(F.col("embedding")))
    each = each.withColumn("h", F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(7), "embedding").alias("b")))
    each = write_and_read(each, "vectors")
    classes = each.groupBy("h").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min("embedding").alias("embedding"))
    classes = write_and_read(classes.select("h", F.col("first").cast("long").alias("vec_id"), "copies", "embedding"), "vector-classes")
    n = classes.count()
    limit = 2 - 2 * cosine
    signs = int(min(WIDTH, max(0, np.ceil(np.log2(max(1, n) / cell)))))
    vectors = classes.select("vec_id", "embedding")
    sizes = vectors.mapInArrow(cell_sizes(signs, limit), "width int, block int, cell int, n long").groupBy("width", "block", "cell").agg(F.sum("n").alias("n"))
    # only crowded cells: no more of them than vectors sent by the size of a tile
    tiles = {(r["width"], r["block"], r["cell"]): -(-r["n"] // tile) for r in sizes.where(F.col("n") > 2 * tile).collect()}
    keys = "width int, block int, cell int, tiles long"
    sent = vectors.mapInArrow(dealt(signs, limit, tiles), f"{keys}, ids binary, own binary, coded binary, sketch binary")
    sent = sent.repartition(*KEYS).sortWithinPartitions(*KEYS)
    wanted = write_and_read(sent.mapInArrow(met(limit, tiles), f"{keys}, own int, vec_id long"), "vector-candidates")
    full = wanted.join(classes.drop("h"), "vec_id").repartition(*KEYS).sortWithinPartitions(*KEYS)
    full = full.select(*KEYS, "own", "vec_id", "copies", "embedding")
    found = write_and_read(full.mapInArrow(verified(cosine, limit, tiles), "vec_id long, root long, n long"), "vector-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), "vectors")
    of_class = classes.select("h", "vec_id", "copies").join(counts, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    of_class = of_class.select("h", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component"))
    linked = each.select("vec_id", "h").join(of_class, "h").select("vec_id", "n_links", "component")
    out = rows.select("vec_id").distinct().join(linked, "vec_id", "left")
    component = F.coalesce("component", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
