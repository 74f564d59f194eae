"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every neighbouring pair whose joined bytes have a rank waits in that rank's
bucket (a heap of list positions). A bitmap marks the ranks with a filled bucket and a bitmap above it the blocks of ranks
with any, so two find-first-set steps give the lowest rank whatever the length of the pre-token. An entry whose position has since been merged or re-ranked is stale and is skipped when it comes up. A pre-token of n bytes costs
O(n log n), so very long pre-tokens (base64, runs of one character) need no separate path.

Every distinct short pre-token is merged once per task; a bounded table keeps its ids.

Defined cases: null and empty texts give no ids; very long texts are read whole, one at a time; of pairs that tie in rank the leftmost
is merged first; repeated rows are encoded alike; a table without rows gives none; other
columns pass through, and a column with an output's name is replaced.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagequarry.llm._common import only, table, tokenizer_path, with_columns

#: Letters, numbers and white space among the code points below U+0250.
LOW_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
LOW_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
LOW_SPACES = r"\t-\r \x85\xa0"
#: Fixed value: white space of any code point, which the standard pattern means by \s.
ALL_SPACES = r"\t-\r \x85\xa0  -     　"

#: Pre-tokens up to so many characters are remembered, so many of them at a time.
KEEP_CHARS, KEEP_ENTRIES = 64, 1_200_000
#: Up to so many bytes of a pre-token, a bucket's positions are one integer's bits, not a heap.
SHORT_BYTES = 256
#: Longer texts are split piecewise, not into one list.
LONG_TEXT = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class RankQueue:
    """Buckets of positions by merge rank, and two bitmaps: filled ranks by block, filled blocks."""

    def __init__(self, n_ranks: int):
        #: ranks in a block; about as many as blocks, so both find-first-set steps look at few words
        self.shift = max(1, (n_ranks.bit_length() + 1) // 2)
        self.filled = [0] * ((n_ranks >> self.shift) + 1)
        self.blocks = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        block = rank >> self.shift
        self.filled[block] |= 1 << (rank - (block << self.shift))
        self.blocks |= 1 << block

    def pop(self) -> tuple[int, int]:
        """(lowest rank, its leftmost position); the queue must hold something: blocks is not 0."""
        blocks = self.blocks
        block = (blocks & -blocks).bit_length() - 1
        bits = self.filled[block]
        rank = (block << self.shift) + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.filled[block] = bits = bits & (bits - 1)
        if not bits:
            self.blocks = blocks & (blocks - 1)
        return rank, bucket[0]


class Encoder(dict):
    """Token ids of pre-tokens, as little-endian unsigned 32-bit integers; remembers short ones."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.longest = max(map(len, ranks), default=0)

    def __missing__(self, pretoken: str) -> bytes:
        piece = pretoken.encode()
        merged = self.merge_short(piece) if len(piece) <= SHORT_BYTES else self.merge(piece)
        ids = pack(f"<{len(merged)}I", *merged)
        if len(pretoken) <= KEEP_CHARS:
            if len(self) >= KEEP_ENTRIES:
                self.clear()
            self[pretoken] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n, queue, longest = len(piece), self.queue, self.longest
        push, pop = queue.push, queue.pop
        after, before = list(range(1, n + 2)), list(range(-1, n))
        waits = [rank_of(piece[i : i + 2]) for i in range(n)]  # the rank under which the pair that starts here waits
        waits[-1] = None
        for start, rank in enumerate(waits):
            if rank is not None:
                push(rank, start)
        while queue.blocks:
            rank, start = pop()
            if waits[start] != rank:
                continue
            gone = after[start]
            after[start] = stop = after[gone]
            waits[gone] = None
            if stop < n:
                before[stop] = start
                end = after[stop]
                waits[start] = new = rank_of(piece[start:end]) if end - start <= longest else None
                if new is not None:
                    push(new, start)
            else:
                waits[start] = None
            left = before[start]
            if left >= 0:
                waits[left] = new = rank_of(piece[left:stop]) if stop - left <= longest else None
                if new is not None:
                    push(new, left)
        ids, start = [], 0
        while start < n:
            stop = after[start]
            ids.append(rank_of(piece[start:stop]))
            start = stop
        return ids


    def merge_short(self, piece: bytes) -> list[int]:
        """As merge, in one loop without calls: a bucket's positions are the bits of one integer."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n, shift, filled, buckets, blocks = len(piece), self.queue.shift, self.queue.filled, {}, 0
        inside = (1 << shift) - 1
        after, before = list(range(1, n + 2)), list(range(-1, n))
        waits = [rank_of(piece[i : i + 2]) for i in range(n)]
        waits[-1] = None
        fresh = [(rank, start) for start, rank in enumerate(waits) if rank is not None]
        while True:
            for rank, start in fresh:
                held = buckets.get(rank)
                if held is None:
                    buckets[rank] = 1 << start
                    block = rank >> shift
                    filled[block] |= 1 << (rank & inside)
                    blocks |= 1 << block
                else:
                    buckets[rank] = held | 1 << start
            if not blocks:
                break
            fresh = []
            block = (blocks & -blocks).bit_length() - 1
            bits = filled[block]
            rank = (block << shift) + (bits & -bits).bit_length() - 1
            held = buckets[rank]
            first = held & -held
            start = first.bit_length() - 1
            if held == first:
                del buckets[rank]
                filled[block] = bits = bits & (bits - 1)
                if not bits:
                    blocks &= blocks - 1
            else:
                buckets[rank] = held ^ first
            if waits[start] != rank:
                continue
            gone = after[start]
            after[start] = stop = after[gone]
            waits[gone] = None
            if stop < n:
                before[stop] = start
                waits[start] = new = rank_of(piece[start : after[stop]])
                if new is not None:
                    fresh.append((new, start))
            else:
                waits[start] = None
            left = before[start]
            if left >= 0:
                waits[left] = new = rank_of(piece[left:stop])
                if new is not None:
                    fresh.append((new, left))
        ids, start = [], 0
        while start < n:
            stop = after[start]
            ids.append(rank_of(piece[start:stop]))
            start = stop
        return ids


class Splitter:
    """Pre-tokens of a text by the tokenizer's pattern. Texts of low code points take an equal pattern of plain classes, which Python's own engine runs faster."""

    def __init__(self, pattern: str):
        import public_tokenizers
        import regex

        self.full = regex.compile(pattern.replace(r"[^\s", rf"[^{ALL_SPACES}").replace(r"(?!\S)", rf"(?![^{ALL_SPACES}])").replace(r"\s", rf"[{ALL_SPACES}]"))
        self.high = self.low = None
        if pattern == public_tokenizers.PATTERN:
            self.high = re.compile(r"[^\x00-ɏ]")
            self.low = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LOW_LETTERS}]+| ?[{LOW_NUMBERS}]+| ?[^{LOW_SPACES}{LOW_LETTERS}{LOW_NUMBERS}]+|[{LOW_SPACES}]+(?![^{LOW_SPACES}])|[{LOW_SPACES}]+")

    def __call__(self, text: str):
        use = self.low if self.low is not None and not self.high.search(text) else self.full
        return use.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in use.finditer(text))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> tuple[Encoder, Splitter, list[bytes]]:
    """One per Python worker: encoder, splitter and the tokens by id."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Encoder(ranks), Splitter(pattern), tokens


def encode_text(text: str | None, encoder: Encoder, split: Splitter) -> bytes:
    if not text:
        return b""
    found = split(text)
    if isinstance(found, list):
        return b"".join(map(encoder.__getitem__, found))
    out = bytearray()
    while some := list(islice(found, 100_000)):
        out += b"".join(map(encoder.__getitem__, some))
    return bytes(out)


def decode_ids(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def decoded(ids: list[bytes], tokens: pa.LargeBinaryArray) -> list[bytes]:
    """As decode_ids, of many texts at once."""
    joined = tokens.take(pa.array(np.frombuffer(b"".join(ids), dtype="<u4")))
    ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :][ends].tolist() if len(joined) else [0] * len(ends)
    data = memoryview(joined.buffers()[2] or b"")
    return [bytes(data[lo:hi]) for lo, hi in zip(offsets, offsets[1:], strict=False)]


def standard_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(df: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str | None = None, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """df with the ids of every whole text, as a binary column of little-endian unsigned 32-bit integers.

    With decoded_col, the ids are also decoded again in the same pass, into a binary column.
    """
    pattern = pattern or standard_pattern()
    fields = [(ids_col, T.BinaryType(), pa.binary())] + [(decoded_col, T.BinaryType(), pa.binary())] * bool(decoded_col)

    def make():
        only("bpe", coder.cache_clear)
        encoder, split, tokens = coder(tokenizer_path(vocabulary), pattern)
        by_id = pa.array(tokens, pa.large_binary())

        def work(texts: list) -> list:
            ids = [encode_text(t, encoder, split) for t in texts]
            return [ids, decoded(ids, by_id)] if decoded_col else [ids]

        return work

    return with_columns(df, text_col, fields, make)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every document: ids and decoded bytes, as counts and digests."""
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded_col="decoded")
    return coded.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
