"""SimHash near-duplicates: bit-sliced comparison inside blocks, then components over fingerprints.

Fingerprints. A text's A-Z are lowered, its words joined by single spaces, and every run of `shingle` words hashed by XXH64;
a bit is set if it is set in over half the hashes. Bits are counted by byte histograms, not by loops over bits.

Candidates. Only distinct fingerprints are compared, so exact copies never meet. 64 bits are cut into radius + 4 parts; two
fingerprints at most `radius` apart agree on all but `radius` of the parts, so one row for every choice of the agreeing
parts finds every link. The parts left open have at most 22 bits, so even a hot block holds at most 2^22 distinct
fingerprints (32 MB): that bound is a property of the key, no row is dropped to keep it.

Comparison. Blocks arrive sorted. Their open bits are stored vertically, one word row for each bit; for a run of rows the
distances to a block's 64-row words are counted by carry-save adders in bitwise form, saturating above the radius, and words
whose 64 rows all exceed it are abandoned. A block of over SPLIT rows is cut into sub-blocks by the same argument, so its work
grows with its rows (65,536 rows of 22 open bits take about a second). Inside a block links only lower a label, so a block of m
rows gives at most m - 1 links, never its pairs.

Components. Links between fingerprints are contracted by alternating large-star and small-star steps with a checkpoint each;
hubs are pre-aggregated, and only joins touch them, which adaptive execution can split.

Defined cases: null, empty and blank texts have no word and fingerprint 0, linked like any other; fewer words than a shingle:
the whole sequence is the one shingle; very long texts are hashed in runs of words; a bit set in exactly half the hashes (a tie)
is 0; rows with a null id link others but name no component; repeated rows stay as rows; a
table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagequarry.llm._common import bounded_batches, materialised, table, with_columns

SEED = 42
BITS = 64
#: Words of a text hashed in one go.
RUN_WORDS = 1 << 16
#: The eight bits of every byte value.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


# fingerprints -----------------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    n = len(words) - size + 1
    counts = np.zeros((8, 8), dtype=np.int64)
    digest = xxhash.xxh64_digest
    for lo in range(0, n, RUN_WORDS):
        part = words[lo : min(n, lo + RUN_WORDS) + size - 1]
        hashes = b"".join([digest(s, SEED) for s in map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False))])
        columns = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[k] += np.bincount(columns[:, k], minlength=256) @ BYTE_BITS
    return int.from_bytes(np.packbits((counts * 2 > n).reshape(-1)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """df with a long column: the fingerprint's bits."""

    def make():
        return lambda texts: [[signed(fingerprint(t, shingle)) for t in texts]]

    return with_columns(df, text_col, [(out, T.LongType(), pa.int64())], make)


# links ------------------------------------------------------------------------------------------------------------------


def parts(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each part of a fingerprint."""
    n = radius + 4
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(radius: int) -> list[int]:
    """For each choice of agreeing parts: the mask of its bits."""
    found = []
    for some in combinations(parts(radius), len(parts(radius)) - radius):
        found.append(sum(((1 << width) - 1) << low for low, width in some))
    return found


def keyed(distinct: DataFrame, radius: int) -> DataFrame:
    """One row (choice, key, fp) for every choice of agreeing parts."""
    rows = F.array(*[F.struct(F.lit(i).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks(radius))])
    return distinct.select(F.explode(rows).alias("k"), "fp").select("k.choice", "k.key", "fp")


def planes_of(values: np.ndarray, open_bits: list[int]) -> np.ndarray:
    """values' open bits stored vertically: row b holds bit b of 64 values in each word."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype=np.uint64)
    padded[: len(values)] = values
    out = np.empty((len(open_bits), len(padded) // 64), dtype=np.uint64)
    for row, bit in enumerate(open_bits):
        out[row] = np.packbits((padded >> np.uint64(bit) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def within(planes: np.ndarray, query: np.ndarray, open_bits: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, value row) of all pairs at most radius apart.

    counters[j] has a bit for every (query, value) whose distance so far has bit j set; over marks those beyond the radius.
    """
    full, words = np.uint64(0xFFFFFFFFFFFFFFFF), planes.shape[1]
    q, w = np.divmod(np.arange(len(query) * words), words)
    n_counters = (radius + 1).bit_length()
    counters = [np.zeros(len(q), dtype=np.uint64) for _ in range(n_counters)]
    over = np.zeros(len(q), dtype=np.uint64)
    for row, bit in enumerate(open_bits):
        differs = planes[row][w] ^ np.where(query[q] >> np.uint64(bit) & np.uint64(1), full, np.uint64(0))
        carry = differs
        for j in range(n_counters):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        above = carry  # those whose counter is now over the radius
        reached = np.full(len(q), full)
        for j in range(n_counters):
            reached &= counters[j] if (radius + 1) >> j & 1 else ~counters[j]
        over |= above | reached
        if row % 4 == 3 and row + 1 < len(open_bits):
            live = over != full
            if not live.all():  # abandon words whose 64 rows all exceed the radius
                q, w, over = q[live], w[live], over[live]
                counters = [c[live] for c in counters]
            if not len(q):
                break
    hits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pair, lane = np.nonzero(hits)
    return q[pair], w[pair] * 64 + lane


def spread(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lowers the labels of linked rows to a common one, until nothing changes."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        differ = labels[a] != labels[b]
        if not differ.any():
            return
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while True:
            nearer = labels[labels]
            if (nearer == labels).all():
                break
            labels[:] = nearer


#: A block's rows are queried so many (query, word) pairs at a time.
PAIR_WORDS = 1 << 17
#: Rows of small blocks are compared together, at most so many rows at a time.
GATHER_ROWS = 1 << 15
#: Rows of a block beyond which it is cut up once more.
SPLIT = 4096


def small_blocks(values: np.ndarray, block: np.ndarray, open_bits: list[int], radius: int) -> np.ndarray:
    """Labels for rows of many blocks of up to 64 rows: rows at one offset are compared together, 64 pairs in a word."""
    labels = np.arange(len(values))
    for offset in range(1, 64):
        left = np.nonzero(block[:-offset] == block[offset:])[0] if offset < len(block) else np.empty(0, dtype=np.int64)
        if not len(left):
            break
        left = left[labels[left] != labels[left + offset]]
        if not len(left):
            continue
        xor = values[left] ^ values[left + offset]
        planes = planes_of(xor, open_bits)
        _, hit = within(planes, np.zeros(1, dtype=np.uint64), open_bits, radius)
        hit = hit[hit < len(left)]
        spread(labels, left[hit], left[hit] + offset)
    return labels


def compared(labels: np.ndarray, rows: np.ndarray, values: np.ndarray, open_bits: list[int], radius: int) -> None:
    """Lowers the labels of linked rows among `rows`, whose values agree on all but the open bits."""
    some = values[rows]
    planes = planes_of(some, open_bits)
    step = max(1, PAIR_WORDS // planes.shape[1])
    for lo in range(0, len(some), step):
        q, v = within(planes, some[lo : lo + step], open_bits, radius)
        keep = v < len(some)
        spread(labels, rows[q[keep] + lo], rows[v[keep]])


def large_block(values: np.ndarray, open_bits: list[int], radius: int) -> np.ndarray:
    """Labels for the rows of one block.

    More than SPLIT rows are cut up once more: of radius + 4 parts of the open bits, linked rows agree on all but `radius`, so for
    each choice of four there are sub-blocks of 2^8 rows at most. Work grows with the rows, not their square.
    """
    labels = np.arange(len(values))
    if len(values) <= SPLIT:
        compared(labels, labels.copy(), values, open_bits, radius)
        return labels
    n = radius + 4
    cuts = [len(open_bits) * i // n for i in range(n + 1)]
    for some in combinations(range(n), n - radius):
        fixed = [b for i in some for b in open_bits[cuts[i] : cuts[i + 1]]]
        rest = [b for b in open_bits if b not in fixed]
        key = values & np.uint64(sum(1 << b for b in fixed))
        order = np.argsort(key, kind="stable")
        starts = np.nonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))[0]
        sizes = np.diff(np.append(starts, len(order)))
        ends, at = np.cumsum(np.where((sizes > 1) & (sizes <= 64), sizes, 0)), 0
        small = order[np.repeat((sizes > 1) & (sizes <= 64), sizes)]
        block = np.repeat(np.arange(len(sizes)), sizes)[np.repeat((sizes > 1) & (sizes <= 64), sizes)]
        while at < len(small):
            stop = int(ends[np.searchsorted(ends, at + GATHER_ROWS, side="left")]) if at + GATHER_ROWS < len(small) else len(small)
            rows = small[at:stop]
            found = small_blocks(values[rows], block[at:stop], rest, radius)
            spread(labels, rows, rows[found])
            at = stop
        for k in np.nonzero(sizes > 64)[0].tolist():
            compared(labels, order[starts[k] : starts[k] + sizes[k]], values, rest, radius)
    return labels


def links_of(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(a, b) links from rows sorted by (choice, key); a > b as signed numbers."""
    all_masks = masks(radius)
    open_by = [[b for b in range(BITS) if not m >> b & 1] for m in all_masks]

    def found(values: np.ndarray, labels: np.ndarray) -> pa.RecordBatch | None:
        moved = np.nonzero(labels != np.arange(len(labels)))[0]
        if not len(moved):
            return None
        x, y = values[moved].view(np.int64), values[labels[moved]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    def solve(choice: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole blocks."""
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (choice[1:] != choice[:-1])])
        starts = np.nonzero(new)[0]
        sizes = np.diff(np.append(starts, len(key)))
        block = np.repeat(np.arange(len(starts)), sizes)
        of_row = sizes[block]
        for c in np.unique(choice):
            rows = np.nonzero((choice == c) & (of_row > 1) & (of_row <= 64))[0]
            for lo in range(0, len(rows), GATHER_ROWS):  # a block cut here is caught below
                if lo and block[rows[lo - 1]] == block[rows[lo]]:
                    lo = int(np.searchsorted(block[rows], block[rows[lo]]))
                some = rows[lo : lo + GATHER_ROWS + 64]
                if (out := found(fp[some], small_blocks(fp[some], block[some], open_by[c], radius))) is not None:
                    yield out
        for k in np.nonzero(sizes > 64)[0]:
            rows = slice(starts[k], starts[k] + sizes[k])
            if (out := found(fp[rows], large_block(fp[rows], open_by[choice[starts[k]]], radius))) is not None:
                yield out

    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        choice, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = fp.view(np.uint64)
        last = np.nonzero((key != key[-1]) | (choice != choice[-1]))[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        if held and (cut or held[-1][1][-1] != key[0] or held[-1][0][-1] != choice[0]):
            if held[-1][1][-1] != key[0] or held[-1][0][-1] != choice[0]:
                yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
        if cut:
            yield from solve(*(np.concatenate([*(h[i] for h in held), x[:cut]]) for i, x in enumerate((choice, key, fp))))
            held = []
        held.append((choice[cut:], key[cut:], fp[cut:]))
    if held:
        yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs at most radius apart; distinct: one row (fp) each."""
    bounded_batches(distinct.sparkSession)
    blocks = keyed(distinct, radius).repartition("choice", "key").sortWithinPartitions("choice", "key")
    return blocks.mapInArrow(lambda batches: links_of(batches, radius), "a long, b long").distinct()


# components -------------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): the least node of its component, for every node of edges (a > b); rows: about so many rows they were found among."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = materialised(edges, "links", rows)
    before = state(current)
    while before[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        current = materialised(small.where("a > b").distinct(), "links", before[0])
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(roots.select("root", "root").distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id, n_links_class) rows: df's rows with fingerprint and the least id of their component."""
    prints = materialised(fingerprints(df.select(F.col(id_col).cast("long").alias(id_col), text_col), text_col, "fp", shingle).drop(text_col), "prints")
    n = prints.count()
    classes = materialised(prints.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")), "classes", n)
    found = components(links(classes.select("fp"), radius), n)
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialised(rooted, "rooted", n)
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(id_col, "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
