"""Near-duplicates by shingle similarity: bit-sliced SimHash comparison within min-hash bands, then exact shingle sets.

Sets. A text's A-Z are lowered and every run of `shingle` words is hashed; equal sets are one class, so copies never meet.

Blocks. ROWS of the BANDS * ROWS least hashes make a band's key; at a similarity of 0.8 two texts share none of the bands in one
of 100,000 cases. Keys of one class only go no further.

First links. In a block of up to SMALL classes every pair within RADIUS of 64-bit SimHash fingerprints is a candidate; in a larger
one, neighbours in four orders of the fingerprints. Candidates' exact sets are joined and count from `similarity` (common
shingles over all); their components follow.

Comparison. Larger blocks that still hold several components are compared whole: the fingerprints of all rows but the largest
component's are queried against the block as bit planes with carry-save counters (`simhash.within`); what lies within RADIUS, in
different components, is decided on the exact sets, which came with the rows, and only links that join components leave the task. So
every candidate counts, a group of thousands of near copies sends a few pairs for each of them, and no pairs are listed. At a
similarity of 0.8 fingerprints differ in 9.7 bits on average, standard deviation 2.9, so RADIUS lies over four of these above. A
block is one task's: that of a group of near copies holds each distinct text's shingles once a band.

Defined cases: null, empty and blank texts have the empty set and are one class; fewer words than a shingle: the whole sequence
is the one shingle; very long texts are read whole; ties in distance go to the earlier fingerprint; rows with a null id link others
but name no component; repeated rows stay as rows; a table without rows gives none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagequarry.llm._common import bounded_batches, materialised, only, slices
from pagequarry.llm.simhash import BYTE_BITS, components, planes_of, within

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 3
RADIUS, SMALL = 22, 8
#: Queries of a block at a time; hashes in their sets up to which sets are compared as matrices.
QUERIES, DENSE = 128, 1 << 17

_RANDOM = np.random.default_rng(5)
_FLIPS = _RANDOM.integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    size = min(size, len(words))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))), dtype=np.uint64))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    return np.array([((hashes ^ flip) * factor).min() for flip, factor in zip(_FLIPS, _FACTORS, strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes, as a signed number."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.stack([np.bincount(columns[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits((counts * 2 > len(hashes)).reshape(-1)).tobytes(), "big", signed=True)


def printed(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """From (id, text): (id, fp, bands, sim, words)."""
    import xxhash

    only("near")
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            fp, bands, sim, words = [], [], [], []
            for text in batch.column(1).slice(lo, hi - lo).to_pylist():
                hashes = shingles(text, shingle)
                fp.append(xxhash.xxh64_intdigest(hashes.tobytes()) if len(hashes) else 0)
                least = least_hashes(hashes) if len(hashes) else np.empty(0, dtype=np.uint64)
                bands.append(b"".join(xxhash.xxh64_digest(least[k : k + ROWS].tobytes()) for k in range(0, len(least), ROWS)))
                sim.append(fingerprint(hashes))
                words.append(np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(bands, pa.binary()), pa.array(sim, pa.int64()), pa.array(words, pa.binary())], names=["id", "fp", "bands", "sim", "words"])


def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (key, fp, sim) for every band."""
    for batch in batches:
        fp, bands, sim = (c.to_pylist() for c in batch.columns)
        rows = [(k, f, s) for f, b, s in zip(fp, bands, sim, strict=True) if b for k in (np.frombuffer(b, dtype="<i8") ^ np.arange(BANDS)).tolist()]
        for lo in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + 20_000], strict=True)], names=["key", "fp", "sim"])


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key comes twice or more."""
    held, known = None, False  # the last row, and whether the one before it has its key
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        key = rows.column(0).to_numpy(zero_copy_only=False)
        same = key[1:] == key[:-1]
        keep = np.concatenate([[known], same]) | np.concatenate([same, [False]])
        yield rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1]))
        held, known = rows.slice(rows.num_rows - 1), bool(keep[-1])
    if known:
        yield held


def first_pairs(sim: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(row, row) candidates of a block to begin with: all within the radius in small ones, neighbours in rotated orders else."""
    n = len(sim)
    if n <= SMALL:
        q, v = np.triu_indices(n, 1)
    else:
        orders = [np.argsort(sim << np.uint64(turn) | sim >> np.uint64(64 - turn) if turn else sim) for turn in (0, 16, 32, 48)]
        q, v = np.concatenate([o[1:] for o in orders]), np.concatenate([o[:-1] for o in orders])
    near = np.bitwise_count(sim[q] ^ sim[v]) <= radius
    return q[near], v[near]


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks, from rows sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != key[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def candidates_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, fp, sim) sorted by key: first candidates (a, b, null), a > b, and the keys of larger blocks (null, null, key)."""
    held: list[np.ndarray] = []
    out: list[np.ndarray] = []
    large: list[int] = []

    def solve() -> None:
        fp, sim = (np.concatenate(x) for x in zip(*(h[1:] for h in held), strict=True))
        if len(fp) > SMALL:
            large.append(int(held[0][0][0]))
        q, v = first_pairs(sim.view(np.uint64))
        out.append(np.stack([np.maximum(fp[q], fp[v]), np.minimum(fp[q], fp[v])]))
        held.clear()

    def packed() -> pa.RecordBatch:
        some = np.unique(np.concatenate([np.empty((2, 0), dtype=np.int64), *out], axis=1), axis=1)
        n, m = some.shape[1], len(large)
        columns = [pa.array([*some[0].tolist(), *[None] * m], pa.int64()), pa.array([*some[1].tolist(), *[None] * m], pa.int64()), pa.array([*[None] * n, *large], pa.int64())]
        out.clear()
        large.clear()
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key = columns[0]
        cuts = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[0][0][0] != key[lo]:
                solve()
            held.append([c[lo:hi] for c in columns])
        if len(out) >= 20_000:
            yield packed()
    if held:
        solve()
    if out or large:
        yield packed()


def counts(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def matrix(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """A row for each set, a column for each hash of the vocabulary."""
    out = np.zeros((len(sets), len(vocabulary)), dtype=np.float32)
    every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = np.minimum(np.searchsorted(vocabulary, every), len(vocabulary) - 1)
    known = vocabulary[at] == every
    out[row[known], at[known]] = 1
    return out


def joined(sim: np.ndarray, root: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(row, row) links that join components of a block; they connect what all its links of the similarity connect."""
    label = np.unique(root, return_inverse=True)[1]
    most = np.bincount(label).argmax()
    asked = np.nonzero(label != most)[0]
    planes, bits, out = planes_of(sim, range(64)), list(range(64)), []
    size = np.array([len(x) for x in sets], dtype=np.float64)

    def join(i: int, j: int) -> None:
        if label[i] != label[j]:
            out.append((i, j))
            label[label == max(label[i], label[j])] = min(label[i], label[j])

    for lo in range(0, len(asked), QUERIES):
        rows = asked[lo : lo + QUERIES]
        q, v = within(planes, sim[rows], bits, radius)
        q, v = q[v < len(sim)], v[v < len(sim)]
        apart = label[rows[q]] != label[v]
        q, v = q[apart], v[apart]
        if not len(q):
            continue
        if size[rows].sum() > DENSE or len(q) < 2 * QUERIES:
            for i, j in zip(rows[q].tolist(), v.tolist(), strict=True):
                if label[i] != label[j] and counts(sets[i], sets[j], similarity):
                    join(i, j)
            continue
        vocabulary = np.unique(np.concatenate([sets[i] for i in rows.tolist()]))
        left, others = matrix([sets[i] for i in rows.tolist()], vocabulary), np.unique(v)
        for at in range(0, len(others), 1024):
            some = others[at : at + 1024]
            both = left @ matrix([sets[j] for j in some.tolist()], vocabulary).T
            here = (v >= some[0]) & (v <= some[-1])
            k = np.searchsorted(some, v[here])
            same = both[q[here], k]
            good = same >= similarity * (size[rows[q[here]]] + size[v[here]] - same) - 1e-9
            for i, j in zip(rows[q[here][good]].tolist(), v[here][good].tolist(), strict=True):
                join(i, j)
    return out


def links_in_blocks(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b) links that join components, from rows (key, fp, sim, root, words) sorted by key."""
    for block in blocks_in(batches):
        fp, sim, root = (block.column(i).to_numpy() for i in (1, 2, 3))
        if (root == root[0]).all():
            continue
        found = joined(sim.view(np.uint64), root, [np.frombuffer(x, dtype="<u4") for x in block.column(4).to_pylist()], similarity)
        if found:
            i, j = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(fp[i], fp[j])), pa.array(np.minimum(fp[i], fp[j]))], names=["a", "b"])


def similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of (a, b, x, y) the links whose sets x and y count."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep.append(counts(np.frombuffer(x, dtype="<u4"), np.frombuffer(y, dtype="<u4"), similarity))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id) rows: df's rows with the least id of their component."""
    bounded_batches(df.sparkSession)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = materialised(texts.mapInArrow(lambda batches: printed(batches, shingle), "id long, fp long, bands binary, sim long, words binary"), "prints")
    n = prints.count()
    classes = materialised(prints.groupBy("fp").agg(F.min("id").alias("first_id"), F.min("bands").alias("bands"), F.min("sim").alias("sim")), "classes", n)
    keys = classes.select("fp", "bands", "sim").mapInArrow(banded, "key long, fp long, sim long")
    blocks = materialised(keys.repartition("key").sortWithinPartitions("key").mapInArrow(shared, "key long, fp long, sim long"), "blocks", n)
    first = prints.join(classes.select("fp", "first_id"), "fp").where(F.col("id").eqNullSafe(F.col("first_id")))
    sets = materialised(first.join(blocks.select("fp").distinct(), "fp", "left_semi").select("fp", "words").dropDuplicates(["fp"]), "sets", n)
    x, y = sets.select(F.col("fp").alias("a"), F.col("words").alias("x")), sets.select(F.col("fp").alias("b"), F.col("words").alias("y"))
    found = materialised(blocks.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(candidates_of, "a long, b long, key long"), "candidates", n)
    pairs = found.where("a IS NOT NULL").select("a", "b").distinct().join(x, "a").join(y, "b").select("a", "b", "x", "y")
    links = materialised(pairs.mapInArrow(partial(similar, similarity=similarity), "a long, b long"), "near", n)
    large = found.where("key IS NOT NULL").select("key").distinct()
    roots = materialised(components(links, n), "roots", n).withColumnRenamed("node", "fp")
    rows = blocks.join(large, "key", "left_semi").join(roots, "fp", "left").select("key", "fp", "sim", F.coalesce("root", "fp").alias("root")).join(sets, "fp")
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rows = rows.join(mixed, "key", "left_semi").select("key", "fp", "sim", "root", "words").repartition("key").sortWithinPartitions("key", "fp")
    more = materialised(rows.mapInArrow(partial(links_in_blocks, similarity=similarity), "a long, b long"), "near", n)
    roots = components(links.union(more), n).withColumnRenamed("node", "fp")
    rooted = materialised(classes.select("fp", "first_id").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted", n)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.select("id", "fp").join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "component_id")
