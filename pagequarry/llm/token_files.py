"""Token-id files: a static range asymmetric numeral system with shared frequencies and interleaved, independent blocks.

Tokens. Words between ASCII white space never share a token in the vocabulary's pre-tokenizer, so every distinct word goes to the
tokenizers library once per Python worker while it is remembered, and texts' ids are gathered from flat arrays. Texts with a
special token's marker go whole.

Frequencies. The ids of the whole corpus are counted (partial counts by task, then summed), scaled to 2^SCALE_BITS, and shared
by all blocks. The table has a row for each id, so its bound is the vocabulary.

Files. Documents are range-partitioned by id; each partition is one file, written to a name of its own and renamed. A file
holds a header, the document index, and blocks of up to BLOCK_TOKENS ids. A block codes LANES interleaved states and has a
checkpoint (states and stream offset) every CHECKPOINT steps, and a checksum of the payload and of the ids after each checkpoint.

Reading. Segments between checkpoints are dealt to tasks, several tasks to a file; a task reads the documents that start in its
segments and follows the last one into later segments. Starts are running sums over the list of files, one entry each.

Defined cases: null and empty texts have only the end id; a very long text is looked up by itself, may span blocks and is one row
again when read; documents with null ids come first; ties and repeated rows (equal ids) are ordered by content; without
rows there are no files; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagequarry.llm._common import bounded_batches, materialised, open_filesystem, publish, shared_dir, table, tokenizer_path, with_columns

END_ID = 2
SCALE_BITS = 20
LANES, BLOCK_TOKENS, CHECKPOINT = 2048, 1 << 20, 128
LOW = np.uint64(1 << 31)
MAGIC = b"TOKIDS02"
#: Ids from one checkpoint to the next, and bytes of a checkpoint.
SEGMENT, RECORD = CHECKPOINT * LANES, 8 + 8 * LANES
#: Segments that one task reads at a time, and most tasks that they are dealt to.
TASK_SEGMENTS, MOST_TASKS = 16, 50_000
#: Words that a Python worker remembers before rare ones go; bytes of texts whose distinct words are looked up together.
KEEP_WORDS, LOOKUP_BYTES = 600_000, 8 << 20


# tokens -----------------------------------------------------------------------------------------------------------------


class WordIds:
    """Ids of words from the tokenizers library, kept in flat arrays per Python worker: word n has size[n] ids from start[n] on."""

    #: Texts with this, which begins a special token, go to the library whole.
    SPECIAL = "<|"
    #: Fixed value: the vocabulary's pre-tokens, for words in lower case of printable ASCII and precomposed Latin letters.
    PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
    SIMPLE = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
    #: The commonest forms: letters, one pre-token; letters and closing signs, two.
    LETTERS, CLOSED = "^[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+$", "^[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+[!-/:-@\\[-`{-~]+$"
    GROUP = 500

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.code = {2: "H", 4: "I"}[self.kind.itemsize]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.words = pa.array([], pa.large_string())
        self.start, self.size, self.used, self.flat = (np.zeros(0, dtype=kind) for kind in (np.int64, np.int32, np.int32, self.kind))

    def pack(self, ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}{self.code}", *ids)

    def learn(self, fresh: pa.Array) -> None:
        """Words of known pre-tokens go to the library many to a text and past its normaliser: how many each has tells where it ends."""
        sizes, parts, order = np.zeros(len(fresh), dtype=np.int32), [], []
        closed = pc.match_substring_regex(fresh, self.CLOSED).to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(fresh, self.LETTERS).to_numpy(zero_copy_only=False) | closed
        at, counts = np.nonzero(plain)[0], 1 + closed[plain].astype(np.int64)
        lowered, rest = pc.utf8_lower(fresh.filter(pa.array(plain))), []
        others = np.nonzero(~plain)[0]
        simple: list[tuple[int, int, str]] = []
        for k, word in zip(others.tolist(), fresh.take(pa.array(others)).to_pylist(), strict=True):
            if self.SIMPLE.fullmatch(word):
                simple.append((k, len(self.PRE.findall(word.lower())), word.lower()))
            else:
                rest.append(k)
        if simple:
            k, n, names = zip(*simple, strict=True)
            at, counts, lowered = np.concatenate([at, k]), np.concatenate([counts, n]), pa.concat_arrays([lowered, pa.array(names, pa.large_string())])
        bounds = [*range(0, len(at), self.GROUP), len(at)]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lowered), pa.scalar(" ", pa.large_string())).to_pylist()
        for lo, hi, found in zip(bounds, bounds[1:], self.bare.encode_batch_fast(texts, add_special_tokens=False), strict=False):
            ids, last = np.array(found.ids, dtype=self.kind), np.cumsum(counts[lo:hi])
            ends = np.nonzero(self.ends[ids])[0] + 1
            if len(ends) != last[-1]:  # not the pre-tokens expected
                rest += at[lo:hi].tolist()
                continue
            sizes[at[lo:hi]] = np.diff(ends[last - 1], prepend=0)
            parts.append(ids)
            order.append(at[lo:hi])
        for k, found in zip(rest, self.tokenizer.encode_batch_fast(fresh.take(pa.array(rest, pa.int64())).to_pylist(), add_special_tokens=False), strict=True):
            sizes[k] = len(found.ids)
            parts.append(np.array(found.ids, dtype=self.kind))
            order.append(np.array([k]))
        start = np.zeros(len(fresh), dtype=np.int64)
        if order:
            order = np.concatenate(order)
            start[order] = len(self.flat) + np.cumsum(sizes[order]) - sizes[order]
        self.words = pa.concat_arrays([self.words, fresh])
        self.start, self.size, self.flat = np.concatenate([self.start, start]), np.concatenate([self.size, sizes]), np.concatenate([self.flat, *parts])
        self.used = np.concatenate([self.used, np.zeros(len(fresh), dtype=np.int32)])

    def gathered(self, n: np.ndarray) -> np.ndarray:
        sizes = self.size[n]
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.flat[np.repeat(self.start[n] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def age(self) -> None:
        """A full table keeps the half of its words that was met most often."""
        if len(self.words) > KEEP_WORDS:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: KEEP_WORDS // 2])
            self.flat, self.words, self.size, self.used = self.gathered(keep), self.words.take(pa.array(keep)), self.size[keep], self.used[keep] // 2
            self.start = np.cumsum(self.size, dtype=np.int64) - self.size

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, packed."""
        self.age()
        column = pa.array(texts, pa.large_string())
        whole = np.nonzero(pc.fill_null(pc.match_substring(column, self.SPECIAL), False).to_numpy(zero_copy_only=False))[0].tolist()
        if whole:
            column = pa.array([None if t and self.SPECIAL in t else t for t in texts], pa.large_string())
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        coded = pc.dictionary_encode(lists.flatten())
        n = pc.index_in(coded.dictionary, value_set=self.words)
        new = n.is_null().to_numpy(zero_copy_only=False)
        n = n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n[new] = len(self.words) + np.arange(new.sum())
        if new.any():
            self.learn(coded.dictionary.filter(pa.array(new)))
        at = coded.indices.to_numpy(zero_copy_only=False)
        self.used[n] += np.bincount(at, minlength=len(n)).astype(np.int32)
        at = n[at]
        ids, ends = self.gathered(at), np.concatenate([[0], np.cumsum(self.size[at], dtype=np.int64)])
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        out = [ids[lo:hi].tobytes() for lo, hi in zip(bounds, bounds[1:], strict=False)]
        for k in whole:
            out[k] = self.pack(self.tokenizer.encode(texts[k], add_special_tokens=False).ids)
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenised(df: DataFrame, vocabulary: str, text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """df without the text, with `ids` (little-endian, 2 bytes for vocabularies up to 65,536, else 4), the end id last."""

    def make():
        words = word_ids(tokenizer_path(vocabulary))
        end = words.pack([end_id])
        return lambda texts: [[ids + end for ids in words.encode(texts)]]

    return with_columns(df, text_col, [("ids", T.BinaryType(), pa.binary())], make, keep_text=False, slice_bytes=LOOKUP_BYTES)


def counted(tokens: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs in the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=f"<u{width}"))
            if len(n) > len(total):
                total = np.concatenate([total, np.zeros(len(n) - len(total), dtype=np.int64)])
            total[: len(n)] += n
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=-1) + 1, dtype=np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2^bits; an id that occurs has at least 1."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), dtype=np.uint32)
    exact = counts / total * size
    freq = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
    rest = size - int(freq.sum())
    order = np.argsort(-counts, kind="stable")
    if rest >= 0:
        freq[order[0]] += rest
    at = 0
    while rest < 0:  # rare ids took more than their share: the frequent ones give it back
        give = min(-rest, int(freq[order[at]]) // 2)
        freq[order[at]] -= give
        rest += give
        at = (at + 1) % len(order)
    return freq.astype(np.uint32)


# blocks -----------------------------------------------------------------------------------------------------------------


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq, dtype=np.uint64)])[:-1].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.checksum = crc32(freq.astype("<u4").tobytes())

    def encode(self, ids: np.ndarray) -> tuple[bytes, int]:
        """(payload, number of checkpoints): the checkpoint records, then the stream of 32-bit words."""
        steps = -(-len(ids) // LANES)
        x = np.full(LANES, LOW, dtype=np.uint64)
        room = np.uint64(63) - self.bits
        words: list[np.ndarray] = [None] * steps
        states: dict[int, np.ndarray] = {}
        for step in range(steps - 1, -1, -1):
            s = ids[step * LANES : (step + 1) * LANES]
            f, now = self.freq[s], x[: len(s)]
            full = now >= f << room
            words[step] = now[full].astype(np.uint32)
            now = np.where(full, now >> np.uint64(32), now)
            q = now // f
            x[: len(s)] = (q << self.bits) + self.start[s] + (now - q * f)
            if step % CHECKPOINT == 0:
                states[step] = x.copy()
        sizes = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.uint64)
        points = b"".join(np.uint64(sizes[step]).astype("<u8").tobytes() + states[step].astype("<u8").tobytes() for step in sorted(states))
        return points + (np.concatenate(words).astype("<u4").tobytes() if steps else b""), len(states)

    def decode(self, payload: bytes, n: int, points: int, first_point: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids of a whole payload from checkpoint first_point's on, to the id before stop."""
        at, states = self.record(payload[first_point * RECORD : (first_point + 1) * RECORD])
        lo = first_point * CHECKPOINT * LANES
        return self.steps(states, np.frombuffer(payload, dtype="<u4", offset=points * RECORD + 4 * at), n - lo, (n if stop is None else min(n, stop)) - lo)

    @staticmethod
    def record(data: bytes) -> tuple[int, np.ndarray]:
        """(place in the stream, states) of a checkpoint."""
        return (int(np.frombuffer(data, "<u8", 1)[0]), np.frombuffer(data, "<u8", LANES, 8).astype(np.uint64)) if data else (0, np.empty(0, dtype=np.uint64))

    def steps(self, x: np.ndarray, stream: np.ndarray, left: int, wanted: int) -> np.ndarray:
        """The next `wanted` ids from the states x, of `left` that the block still has."""
        out = np.empty(max(0, wanted), dtype=np.uint32)
        inside, at = np.uint64((1 << int(self.bits)) - 1), 0
        for lo in range(0, wanted, LANES):
            now = x[: min(LANES, left - lo)]
            slot = now & inside
            s = self.symbol[slot]
            now = self.freq[s] * (now >> self.bits) + slot - self.start[s]
            low = np.nonzero(now < LOW)[0]
            now[low] = now[low] << np.uint64(32) | stream[at : at + len(low)]
            at += len(low)
            x[: len(now)] = now
            out[lo : lo + LANES] = s[: wanted - lo]
        return out


# files ------------------------------------------------------------------------------------------------------------------


def write_file(out, coder: Coder, docs: Iterator[tuple[int | None, np.ndarray]]) -> tuple[int, int]:
    """Writes blocks as ids come, then the index and a trailer with its place; gives (documents, ids)."""
    out.write(MAGIC)
    at, held, n_held, blocks, names, sizes = len(MAGIC), [], 0, [], [], []

    def flush(some: np.ndarray) -> None:
        nonlocal at
        payload, points = coder.encode(some)
        out.write(payload)
        sums = [crc32(some[lo : lo + SEGMENT].astype("<u4").tobytes()) for lo in range(0, len(some), SEGMENT)]
        blocks.append([at, len(payload), len(some), points, crc32(payload), sums])
        at += len(payload)

    for name, ids in docs:
        names.append(name)
        sizes.append(len(ids))
        held.append(ids)
        n_held += len(ids)
        if n_held >= BLOCK_TOKENS:
            some = np.concatenate(held)
            while len(some) >= BLOCK_TOKENS:
                flush(some[:BLOCK_TOKENS])
                some = some[BLOCK_TOKENS:]
            held, n_held = [some], len(some)
    if n_held:
        flush(np.concatenate(held))
    known = np.array([x is not None for x in names], dtype=np.uint8)
    index = np.array([x or 0 for x in names], dtype="<i8").tobytes() + known.tobytes() + np.array(sizes, dtype="<u8").tobytes()
    head = json.dumps({"docs": len(names), "blocks": blocks, "lanes": LANES, "bits": int(coder.bits), "table": coder.checksum, "index": crc32(index)}).encode()
    out.write(index + head + np.array([at, len(index), len(head)], dtype="<u8").tobytes() + MAGIC)
    return len(names), sum(sizes)


class TokenFile:
    """A written file, opened for random access."""

    def __init__(self, filesystem, path: str, coder: Coder):
        self.file, self.coder = filesystem.open_input_file(path), coder
        size = self.file.size()
        tail = self.read(size - 32, 32)
        if tail[24:] != MAGIC:
            raise ValueError(f"{path}: no token file")
        at, n_index, n_head = map(int, np.frombuffer(tail[:24], dtype="<u8"))
        index, self.head = self.read(at, n_index), json.loads(self.read(at + n_index, n_head))
        if self.head["table"] != coder.checksum or self.head["index"] != crc32(index):
            raise ValueError(f"{path}: checksum of index or frequencies")
        n = self.head["docs"]
        known = np.frombuffer(index, np.uint8, n, 8 * n)
        self.names = [int(x) if k else None for x, k in zip(np.frombuffer(index, "<i8", n), known, strict=True)]
        self.sizes = np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64)

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def check(self) -> None:
        """Reads all payloads against their checksums."""
        for k, (at, size, *_, payload_sum, _) in enumerate(self.head["blocks"]):
            if crc32(self.read(at, size)) != payload_sum:
                raise ValueError(f"block {k}: checksum of payload")

    def segment(self, k: int, stop: int | None = None) -> np.ndarray:
        """Ids of the file's k-th segment, to the id before stop, from its checkpoint and its part of the stream alone."""
        block, point = divmod(k, BLOCK_TOKENS // SEGMENT)
        at, size, n, points, _, sums = self.head["blocks"][block]
        here, states = self.coder.record(self.read(at + point * RECORD, RECORD))
        end = int(np.frombuffer(self.read(at + (point + 1) * RECORD, 8), "<u8")[0]) if point + 1 < points else (size - points * RECORD) // 4
        stream = np.frombuffer(self.read(at + points * RECORD + 4 * here, 4 * (end - here)), dtype="<u4")
        left = n - point * SEGMENT
        whole = min(left, SEGMENT)
        wanted = whole if stop is None else min(whole, stop)
        ids = self.coder.steps(states, stream, left, wanted)
        if wanted == whole and crc32(ids.astype("<u4").tobytes()) != sums[point]:
            raise ValueError(f"segment {k}: checksum of ids")
        return ids

    def documents(self, first: int, last: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, ids before it in this file, its ids) of the documents that start in the segments from first up to but not last.

        The last of them may end in later segments, which are decoded as far as it goes.
        """
        starts = np.cumsum(self.sizes) - self.sizes
        lo, hi = np.searchsorted(starts, [first * SEGMENT, last * SEGMENT])
        held, base = np.empty(0, dtype=np.uint32), first * SEGMENT
        for i in range(int(lo), int(hi)):
            start, end = int(starts[i]), int(starts[i] + self.sizes[i])
            parts, have = [held], base + len(held)
            while have < end:
                k = have // SEGMENT
                parts.append(self.segment(k, end - k * SEGMENT if k >= last else None))
                have += len(parts[-1])
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield self.names[i], start, held[start - base : end - base]
            held, base = held[end - base :], end


def write_corpus(docs: DataFrame, directory: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, int]], np.ndarray]:
    """Writes docs' token files below directory; gives ((path, ids) of each file in order of ids, frequencies)."""
    tokens = tokenised(docs.select(F.col(id_col).cast("long").alias("name"), F.col(text_col).alias("text")), vocabulary)
    tokens = materialised(tokens, "tokens")
    width = int(WordIds(tokenizer_path(vocabulary)).kind.itemsize)
    freq = scaled(counted(tokens, width))
    bounded_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = ((name, np.frombuffer(ids, dtype=f"<u{width}").astype(np.uint32)) for batch in batches for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        first = next(rows, None)
        if first is None:
            return
        part, made = TaskContext.get().partitionId(), []
        filesystem, root = open_filesystem(directory)
        path = f"{root}/part-{part:08d}.tokids"

        def chained():
            yield first
            yield from rows

        publish(filesystem, path, lambda out: made.append(write_file(out, Coder(freq), chained())))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"part-{part:08d}.tokids"]), pa.array([made[0][1]], pa.int64())], names=["part", "file", "n_ids"])

    ordered = tokens.withColumn("_h", F.xxhash64("ids")).repartitionByRange("name", "_h").sortWithinPartitions("name", "_h", "ids").select("name", "ids")
    files = materialised(ordered.mapInArrow(write, "part long, file string, n_ids long"), "files")
    filesystem, root = open_filesystem(directory)
    publish(filesystem, f"{root}/frequencies.bin", lambda out: out.write(freq.astype("<u4").tobytes()))
    return [(r["file"], r["n_ids"]) for r in files.orderBy("part").collect()], freq


def read_corpus(spark: SparkSession, directory: str, files: list[tuple[str, int]], freq: np.ndarray) -> DataFrame:
    """(name, start, n_tokens, ids) of every document in the files; ids are little-endian unsigned 32-bit integers.

    Segments are dealt to tasks, TASK_SEGMENTS to each; a file of any size is decoded by as many tasks as it has runs of segments.
    """
    starts = np.concatenate([[0], np.cumsum([n for _, n in files], dtype=np.int64)]).tolist()
    runs = np.cumsum([0, *(-(-n // (SEGMENT * TASK_SEGMENTS)) for _, n in files)])
    names = ["name", "start", "n_tokens", "ids"]

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for run in batch.column(0).to_pylist():
                coder = coder or Coder(freq)
                filesystem, root = open_filesystem(directory)
                k = int(np.searchsorted(runs, run, side="right")) - 1
                first = (run - int(runs[k])) * TASK_SEGMENTS
                rows, held = [], 0
                for name, before, ids in TokenFile(filesystem, f"{root}/{files[k][0]}", coder).documents(first, first + TASK_SEGMENTS):
                    rows.append((name, starts[k] + before, len(ids), ids.astype("<u4").tobytes()))
                    held += len(ids)
                    if held >= 1 << 18:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    n = int(runs[-1])
    return spark.range(0, n, 1, min(max(1, n), MOST_TASKS)).mapInArrow(read, "name long, start long, n_tokens long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, as read back from the files."""
    directory = shared_dir(spark, "token-files")
    files, freq = write_corpus(table(spark, sf_dir, "documents"), directory, "word_bpe_49k.json")
    found = read_corpus(spark, directory, files, freq)
    return found.select(F.col("name").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
