"""BPE, token files and archives against the libraries and brute force."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from pagequarry.llm import bpe, token_files, warc
from pagequarry.llm._common import shared_dir

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    encoder, split, tokens = bpe.coder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    return encoder, split, tokens, library


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(st.characters(max_codepoint=0x24F)), st.text(st.sampled_from("ab '\n\t\x1c\x85\xa0st0²½_é中")), st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]))))
def test_bpe_equals_the_library(text):
    encoder, split, tokens = bpe.coder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    ids = bpe.encode_text(text, encoder, split)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert bpe.decode_ids(ids, tokens) == text.encode()


def test_long_pretokens(coder):
    encoder, split, _, library = coder
    r = random.Random(1)
    for text in ("a" * 50_000, "".join(r.choices("ab", k=20_000)), base64.b64encode(r.randbytes(20_000)).decode()):
        assert np.frombuffer(bpe.encode_text(text, encoder, split), "<u4").tolist() == library.encode_ordinary(text)
    piece = "".join(r.choices("abcdeth ", k=200)).replace(" ", "").encode()
    assert encoder.merge(piece) == encoder.merge_short(piece)


def test_rank_queue_gives_lowest_rank_then_leftmost():
    queue, r = bpe.RankQueue(50_256), random.Random(2)
    entries = [(r.choice([3, 4, 255, 256, 50_255]), i) for i in range(200)]
    r.shuffle(entries)
    for e in entries:
        queue.push(*e)
    assert [queue.pop() for _ in entries] == sorted(entries) and not queue.blocks


def test_bpe_query(spark, coder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in bpe.op2_byte_bpe(spark, SF).collect():
        ids = np.array(coder[3].encode_ordinary(docs[row.doc_id]), dtype="<u4").tobytes()
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(docs[row.doc_id].encode()).hexdigest())


def test_bpe_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (1, "", "x")], "doc_id long, text string, Token_IDs string")
    rows = bpe.encode(df).collect()
    assert [bytes(r.token_ids) for r in rows] == [b""] * 3 and bpe.encode(df.limit(0)).count() == 0


def test_word_ids_equal_the_library():
    words, library = token_files.word_ids(WORDS), Tokenizer.from_file(WORDS)
    r = random.Random(3)
    pools = ["abcABC.,  éÉß'st1İΣ̇́", "ab '\n\t\x1c\x85\xa0st0²½_Σ<|>̈e.", "".join(map(chr, range(0x250)))]
    texts = ["".join(r.choices(r.choice(pools), k=r.randrange(40))) for _ in range(1500)] + ["<|endoftext|> it's A.B., fine..."]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, words.kind).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 1_500_000])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 300).astype(np.uint32)
    coder = token_files.Coder(token_files.scaled(np.bincount(ids, minlength=300)))
    payload, points = coder.encode(ids)
    assert (coder.decode(payload, n, points) == ids).all()
    step = token_files.CHECKPOINT * token_files.LANES
    for k in range(points):
        assert (coder.decode(payload, n, points, k, k * step + 777) == ids[k * step : k * step + 777]).all()


def test_scaled_frequencies():
    counts = np.ones(49_408, dtype=np.int64)
    counts[7] = 10**12
    freq = token_files.scaled(counts)
    assert freq.sum() == 1 << token_files.SCALE_BITS and freq.min() == 1 and token_files.scaled(np.zeros(3, dtype=int)).sum() == 0


def written(docs, coder):
    out = io.BytesIO()
    token_files.write_file(out, coder, iter(docs))
    return bytearray(out.getvalue())


def test_damaged_files_are_noticed(tmp_path):
    ids = np.arange(5000, dtype=np.uint32) % 50
    coder = token_files.Coder(token_files.scaled(np.bincount(ids)))
    data = written([(1, ids), (None, ids[:0])], coder)
    (tmp_path / "a").write_bytes(data)
    file = token_files.TokenFile(fs.LocalFileSystem(), str(tmp_path / "a"), coder)
    file.check()
    got = list(file.documents(0, 1))
    assert got[0][0] == 1 and (got[0][2] == ids).all() and got[1][:2] == (None, 5000)
    data[50] ^= 1
    (tmp_path / "a").write_bytes(data)
    file = token_files.TokenFile(fs.LocalFileSystem(), str(tmp_path / "a"), coder)
    with pytest.raises(ValueError):
        list(file.documents(0, 1))
    with pytest.raises(ValueError):
        file.check()


def test_documents_that_span_blocks_are_read_by_segments(tmp_path):
    r = np.random.default_rng(5)
    sizes = [3, token_files.SEGMENT - 3, 1, token_files.BLOCK_TOKENS * 2 + 77, 5, token_files.SEGMENT * 2, 1, 400_000]
    docs = [(i, (r.zipf(1.4, n) % 900).astype(np.uint32)) for i, n in enumerate(sizes)]
    coder = token_files.Coder(token_files.scaled(np.bincount(np.concatenate([x for _, x in docs]), minlength=900)))
    (tmp_path / "a").write_bytes(written(docs, coder))
    file = token_files.TokenFile(fs.LocalFileSystem(), str(tmp_path / "a"), coder)
    n = -(-sum(sizes) // token_files.SEGMENT)
    for step in (1, 3, n):
        got = [x for lo in range(0, n, step) for x in file.documents(lo, lo + step)]
        assert [x[0] for x in got] == list(range(len(docs))) and [x[1] for x in got] == np.cumsum([0, *sizes[:-1]]).tolist()
        assert all((x[2] == ids).all() for x, (_, ids) in zip(got, docs, strict=True))


def test_a_document_longer_than_a_block_in_a_corpus(spark):
    library = Tokenizer.from_file(WORDS)
    text = "one two, three " * 400_000
    d = shared_dir(spark, "t")
    df = spark.createDataFrame([(1, "a"), (2, text), (3, "b c")], "doc_id long, text string")
    rows = token_files.read_corpus(spark, d, *token_files.write_corpus(df, d, "word_bpe_49k.json")).orderBy("name").collect()
    one = library.encode("one two, three ", add_special_tokens=False).ids
    assert len(one) * 400_000 > token_files.BLOCK_TOKENS
    assert np.frombuffer(rows[1].ids, "<u4").tolist() == one * 400_000 + [2] and rows[2].start == rows[1].start + rows[1].n_tokens


def test_word_tables_age(monkeypatch):
    monkeypatch.setattr(token_files, "KEEP_WORDS", 200)
    words, library, r = token_files.WordIds(WORDS), Tokenizer.from_file(WORDS), random.Random(8)
    for _ in range(30):
        texts = [" ".join(f"{r.choice('abcdé')}{r.choice(['x', 'yz', '1', 'İ', 's'])}{r.randrange(90)}{r.choice(['', '.', ',!', '%%'])}" for _ in range(60)) for _ in range(3)]
        for text, ids in zip(texts, words.encode(texts), strict=True):
            assert np.frombuffer(ids, words.kind).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(words.words) < 500


def test_token_file_query(spark):
    library = Tokenizer.from_file(WORDS)
    at = 0
    rows = {r.doc_id: r for r in token_files.op9_token_files(spark, SF).collect()}
    for doc in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*library.encode(doc.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        r = rows[doc.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, "a", 1), (3, None, 1), (3, "b c", 1), (3, "b c", 1), (-1, "", 1)], "doc_id long, text string, ids long")
    d = shared_dir(spark, "t")
    got = token_files.read_corpus(spark, d, *token_files.write_corpus(odd, d, "word_bpe_49k.json")).orderBy("start").collect()
    assert [r.name for r in got] == [None, -1, 3, 3, 3] and got[-1].start + got[-1].n_tokens == sum(r.n_tokens for r in got)
    d = shared_dir(spark, "t")
    assert token_files.read_corpus(spark, d, *token_files.write_corpus(odd.limit(0), d, "word_bpe_49k.json")).count() == 0


def archive_rows(rows, least=0):
    groups, out = {}, []
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    for h, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x))
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        for k, i in enumerate(ids):
            first = k == 0 or len(h) < least
            out.append((i, len(h), digest, "response" if first else "revisit", None if first else ids[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "chunk", "size"), [(0, 1 << 18, 1 << 30), (10, 1000, 2000), (0, 64, 500)])
def test_archives(spark, least, chunk, size):
    r = random.Random(4)
    rows = [(i if r.random() < 0.95 else None, r.choice(["http://a", "h b\r\n", None]), r.choice(["", None, "x", "äö" * 50, "z" * 3000, str(i) * 20])) for i in range(150)]
    rows += rows[:15] + rows[:5]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, payload int").repartition(5)
    d = shared_dir(spark, "w")
    files = warc.write_archives(df, d, least_bytes=least, chunk_bytes=chunk, file_bytes=size)
    assert sorted((tuple(x) for x in warc.read_archives(spark, d, files).collect()), key=repr) == archive_rows(rows, least)


def test_archive_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(x) for x in warc.op3_warc(spark, SF).collect()), key=repr) == archive_rows(pages)
    d = shared_dir(spark, "w")
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, d, warc.write_archives(empty, d)).count() == 0


def test_many_texts_are_decoded_at_once():
    import pyarrow as pa
    from pagequarry.llm import bpe

    encoder, split, tokens = bpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["", "two  words\n", None, "中ć 12's", ""]
    ids = [bpe.encode_text(t, encoder, split) for t in texts]
    by_id = pa.array(tokens, pa.large_binary())
    assert bpe.decoded(ids, by_id) == [(t or "").encode() for t in texts]
    assert bpe.decoded([], by_id) == [] and bpe.decoded([b""], by_id) == [b""]
