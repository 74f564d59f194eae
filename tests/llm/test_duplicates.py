"""SimHash, passages and neighbours against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pagequarry.llm import _common, ann, bpe, near, passages, simhash

SF = "/root/testdata/sf0.001"


def fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, radius=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    p = np.array(prints, dtype=np.uint64)
    for i in range(len(p)):
        for j in np.nonzero(np.bitwise_count(p ^ p[i]) <= radius)[0]:
            parent[find(i)] = find(int(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprints():
    r = random.Random(1)
    for text in [None, "", " \t", "a", "a b", "A É b c", "x " * 70_000, " ".join(r.choices("abcdef", k=300))]:
        assert simhash.fingerprint(text) == fingerprint(text)


def test_links_of_dense_blocks(spark):
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(12)]
    prints = {0, (1 << 64) - 1, *centres}
    for c in centres[:4]:
        for _ in range(150):
            x = c
            for _ in range(r.randrange(1, 5)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints |= {centres[5] ^ i << 3 for i in range(256)}
    prints = list(prints)
    found = {row.node: row.root for row in simhash.components(simhash.links(spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long"))).collect()}
    ids = [simhash.signed(x) for x in prints]
    assert [found.get(i, i) for i in ids] == components(ids, prints)


def test_large_blocks_in_time_linear_in_their_rows():
    import time

    r = np.random.default_rng(4)
    bits = [1, 2, 3, *range(20, 31), *range(40, 48)]
    spread_bits = lambda x: sum(((x >> np.uint64(i) & np.uint64(1)) << np.uint64(b) for i, b in enumerate(bits)), np.zeros(len(x), dtype=np.uint64))
    for n in (5000, 20_000):  # sparse and dense: components against a plain search
        x = spread_bits(r.choice(1 << 22, n, replace=False).astype(np.uint64))
        labels = simhash.large_block(x, bits, 2)
        plain = np.arange(n)
        simhash.compared(plain, np.arange(n), x, bits, 2)
        same = lambda a: np.unique(a, return_inverse=True)[1]
        assert len(np.unique(labels)) == len(np.unique(plain)) == len(set(zip(same(labels).tolist(), same(plain).tolist(), strict=True)))
    took = []
    for n in (1 << 16, 1 << 18):
        x = spread_bits(r.choice(1 << 22, n, replace=False).astype(np.uint64))
        began = time.process_time()
        simhash.large_block(x, bits, 2)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1  # the square would be 16 times


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [fingerprint(d.text) for d in docs]
    expected = {d.doc_id: (f"{p:016x}", c) for d, p, c in zip(docs, prints, components([d.doc_id for d in docs], prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash(spark, SF).collect()} == expected


def test_simhash_of_odd_tables(spark):
    rows = [(None, None, 1), (5, "", 1), (4, " ", 1), (9, "q", 1), (9, "q", 1), (None, "lone words here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(repr((r.doc_id, r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == sorted(map(repr, [(None, 4), (5, 4), (4, 4), (9, 9), (9, 9), (None, None)]))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicate_stage_finds_copies_from_similarity_08(spark):
    import corpus_pipeline

    r = random.Random(12)
    some = lambda n: [f"w{r.randrange(10**5)}" for _ in range(n)]
    docs = [some(r.randrange(100, 400)) for _ in range(60)]
    for i in range(60):
        copy = list(docs[i])
        for j in r.sample(range(len(copy)), r.randrange(1, max(2, len(copy) // 38))):
            copy[j] = "changed"
        docs.append(copy)
    hot = some(300)
    docs += [[*hot[:k], "other", *hot[k + 1 :]] for k in range(0, 300, 2)]
    sets = [set(near.shingles(" ".join(d)).tolist()) for d in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    low = 0
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low += both < 0.95 * (len(sets[i]) + len(sets[j]) - both)
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert low > 30
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert kept == {i for i in range(len(docs)) if find(i) == i}


def test_large_blocks_are_joined_as_all_their_pairs_would(monkeypatch):
    r = np.random.default_rng(9)
    for dense in (near.DENSE, 0):
        monkeypatch.setattr(near, "DENSE", dense)
        sets = []
        for _ in range(6):
            base = r.choice(1 << 32, 60, replace=False).astype(np.uint32)
            for _ in range(60):
                some = base.copy()
                k = r.integers(0, 16)
                some[r.choice(60, k, replace=False)] = r.choice(1 << 32, k, replace=False)
                sets.append(np.unique(some))
        sim = np.array([near.fingerprint(np.array([hash((int(x), 1)) & (1 << 64) - 1 for x in s], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets]).view(np.uint64)
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if near.counts(sets[i], sets[j], 0.8) and np.bitwise_count(sim[i] ^ sim[j]) <= near.RADIUS]

        def labels(links):
            label = list(range(len(sets)))
            for i, j in links:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
            return label

        q, v = near.first_pairs(sim)
        first = [(i, j) for i, j in zip(q.tolist(), v.tolist(), strict=True) if near.counts(sets[i], sets[j], 0.8)]
        for start in ([], first):
            found = near.joined(sim, np.array(labels(start)), sets, 0.8)
            assert labels([*start, *found]) == labels([*start, *pairs]) and len(found) < len(sets)


def test_keys_of_one_class_go_no_further():
    import pyarrow as pa

    keys = [1, 2, 2, 3, 4, 4, 4, 5, 6, 6]
    rows = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(range(10), pa.int64()), pa.array(range(10), pa.int64())], names=["key", "fp", "sim"])
    for cuts in ([0, 10], [0, 2, 10], [0, 1, 2, 3, 5, 6, 9, 10], [0, 4, 4, 5, 10]):
        got = [k for b in near.shared(rows.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])) for k in b.column(0).to_pylist()]
        assert got == [2, 2, 4, 4, 4, 6, 6]


# passages ---------------------------------------------------------------------------------------------------------------


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randrange(2, 8))) for _ in range(3000)]
    some = lambda n: r.choices(vocabulary, k=n)
    docs = [some(r.randrange(60, 300)) for _ in range(80)]

    def put(i, passage):
        at = r.randrange(len(docs[i]))
        docs[i][at:at] = passage

    exact, fuzzy, short, common = some(60), some(120), some(45), some(55)
    for i in (3, 20, 21):
        put(i, exact)
    edited = [f"changed{j}" if j % 13 == 0 else w for j, w in enumerate(fuzzy)]
    del edited[70]
    put(7, fuzzy)
    put(18, edited)
    for i in (9, 10):
        put(i, short)
    for i in range(40, 70):
        put(i, common)
    docs += [docs[30], docs[30][:30]]
    return docs, {3, 20, 21, 7, 18, 30, 80} | set(range(40, 70))


def test_shared_passages(spark):
    docs, expected = corpus()
    rows = [(i, " ".join(d), "x") for i, d in enumerate(docs)] + [(900, None, "x"), (901, "", "x"), (None, "x", "x"), (3, " ".join(docs[3]), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, seq string").repartition(4)
    found = passages.shared_passages(df).collect()
    assert {x for r in found for x in (r.doc_id, r.other_id)} == expected
    for r in found:
        a, b = docs[r.doc_id][r.start_word : r.end_word], docs[r.other_id][r.other_start : r.other_end]
        assert min(len(a), len(b)) >= 50 and len(set(a) & set(b)) >= 0.7 * len(set(a))
        if r.similarity == 1:
            assert a == b
    assert passages.shared_passages(df.limit(0)).count() == 0


def test_texts_of_one_phrase_meet_along_one_chain(spark):
    a, b = ("one two three " * 400).strip(), ("zero " + "one two three " * 300).strip()
    found = passages.shared_passages(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).collect()
    assert len(found) <= 4 and {x for r in found for x in (r.doc_id, r.other_id)} == {1, 2, 3}
    assert max(r.n_words for r in found) >= 850


def test_chains_equal_the_quadratic_recurrence():
    r = random.Random(6)
    for _ in range(200):
        runs = sorted({(r.randrange(80), r.randrange(80), r.randrange(8, 14)) for _ in range(r.randrange(2, 12))})
        score = []
        for p, o, n in runs:
            best = 0.0
            for (q, u, m), s in zip(runs, score, strict=False):
                if q + m <= p and u + m <= o:
                    best = max(best, s - passages.GAP_COST * (p - q - m + o - u - m))
            score.append(n + best)
        chain = passages.chains_of(runs)[0]
        got = sum(n for *_, n in chain) - passages.GAP_COST * sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(chain, chain[1:], strict=False))
        assert abs(got - max(score)) < 1e-9


def test_chains_take_the_best_predecessor_within_reach():
    assert passages.chains_of([(0, 0, 500), (600, 600, 28), (628, 629, 28)]) == [[(0, 0, 500)], [(600, 600, 28), (628, 629, 28)]]
    r = random.Random(7)
    for _ in range(300):
        runs = sorted({(r.randrange(500), r.randrange(500), r.randrange(8, 60)) for _ in range(r.randrange(2, 30))})
        order = sorted(range(len(runs)), key=lambda i: runs[i][0])
        score = [0.0] * len(runs)
        for i in order:
            p, o, n = runs[i]
            gaps = [(s, p - q - m, o - u - m) for (q, u, m), s in zip(runs, score, strict=True) if s and q + m <= p and u + m <= o]
            score[i] = n + max([0.0, *(s - passages.GAP_COST * (x + y) for s, x, y in gaps if max(x, y) <= passages.MOST_GAP)])
        chain = passages.chains_of(runs)[0]
        steps = [(b[0] - a[0] - a[2], b[1] - a[1] - a[2]) for a, b in zip(chain, chain[1:], strict=False)]
        assert all(0 <= min(s) and max(s) <= passages.MOST_GAP for s in steps)
        assert abs(sum(n for *_, n in chain) - passages.GAP_COST * sum(map(sum, steps)) - max(score)) < 1e-9


def test_failing_chains_give_their_parts(spark):
    r = random.Random(11)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, expected = [], set()
    for i, (own, other) in enumerate([(31, 31), (40, 40), (40, 0), (80, 80), (79, 31)]):
        first, second = some(60), some(60)
        rows += [(2 * i, " ".join(some(30) + first + some(own) + second + some(30))), (2 * i + 1, " ".join(some(9) + first + some(other) + second + some(9)))]
        expected |= {(2 * i, 30, 90), (2 * i, 90 + own, 150 + own), (2 * i + 1, 9, 69), (2 * i + 1, 69 + other, 129 + other)}
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {x for r in got for x in ((r.doc_id, r.start_word, r.end_word), (r.other_id, r.other_start, r.other_end))}
    assert all(r.similarity >= 0.8 for r in got)
    assert all(any(d == i and s <= a and b <= e for d, s, e in spans) for i, a, b in expected)


def test_passages_of_50_words_are_found_from_similarity_08(spark):
    r = random.Random(13)
    some = lambda n: [f"w{r.randrange(10**5)}" for _ in range(n)]
    rows, every = [], []
    for i in range(150):
        passage, similarity = some(50), (0.8, 0.85, 0.9)[i % 3]
        at = r.sample(range(50), round(50 * (1 - similarity)))
        copy = [f"new{i}x{j}" if j in at else w for j, w in enumerate(passage)]
        rows += [(2 * i, " ".join(some(40) + passage + some(40))), (2 * i + 1, " ".join(some(40) + copy + some(40)))]
        if 0 not in at and 49 not in at:  # else the passage between its exact ends is shorter than 50 words
            every.append((2 * i, 2 * i + 1))
    got = {tuple(sorted((x.doc_id, x.other_id))) for x in passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(every) > 50 and set(every) <= got and all(b == a + 1 and a % 2 == 0 for a, b in got)


def test_every_copy_of_a_passage_has_a_span(spark):
    r = random.Random(14)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    p, q = some(60), some(60)
    texts = [some(20) + p + some(90) + p + some(95) + p + some(20), some(30) + p + some(30), some(10) + q[:30] + some(70) + q[30:] + some(80) + q + some(5), some(30) + q + some(30), some(9) + q + some(9)]
    wanted = [(0, 20), (0, 170), (0, 325), (1, 30), (2, 220), (3, 30), (4, 9)]
    for ids in (range(5), range(7, 12), range(20, 15, -1)):  # other hashes, so other first documents
        rows = [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]
        got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        spans = {x for g in got for x in ((g.doc_id, g.start_word, g.end_word), (g.other_id, g.other_start, g.other_end))}
        assert all(any(d == ids[k] and s <= a and a + 60 <= e for d, s, e in spans) for k, a in wanted)


def test_a_passage_of_frequent_lines_links_its_holders(spark):
    r = random.Random(15)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(20):
        first, second = some(30), some(30)
        texts += [some(30) + first + second + some(30), some(50) + first + second + some(20)]
        texts += [some(30) + line + some(30) for line in (first, second) for _ in range(12)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = passages.shared_passages(df.repartition(8)).collect()
    assert {frozenset((x.doc_id, x.other_id)) for x in got} == {frozenset((26 * k, 26 * k + 1)) for k in range(20)}


def test_up_to_three_holders_of_a_seed_all_meet():
    h, doc, context = np.array([1, 1, 1, 2, 2, 2, 2], dtype=np.uint64), np.array([5, 6, 7, 5, 5, 8, 8]), np.array([9, 8, 7, 1, 1, 1, 1], dtype=np.uint32)
    rows, partners, _, holders = passages.linked(h, doc, context)
    assert sorted(zip(rows.tolist(), partners.tolist(), strict=True)) == [(1, 0), (2, 0), (2, 1), (4, 5), (5, 3), (5, 4), (6, 3), (6, 4)]
    assert holders.tolist() == [3, 2]


def test_seeds_are_packed_and_unpacked():
    r = np.random.default_rng(3)
    for most in (50, 90_000):
        doc = np.repeat(np.array([7, -3, 1 << 60]), [5, 1, 900])
        pos = np.concatenate([np.sort(r.choice(most, n, replace=n > most)) for n in (5, 1, 900)]).astype(np.int32)
        h, context = r.integers(0, 1 << 40, len(doc)).astype(np.uint64), r.integers(0, 1 << 24, len(doc)).astype(np.uint32)
        got = passages.unpacked(11, len(doc), passages.packed_seeds(h, doc, pos, context))
        assert (got[0] == (h & np.uint64(0xFFFFFFFF) | np.uint64(11 << 32))).all() and all((x == y).all() for x, y in zip(got[1:], (doc, pos, context), strict=True))


def test_a_passage_is_found_among_many_holders_of_its_parts(spark):
    r = random.Random(21)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    long = some(300)
    texts = [some(20) + long + some(20), some(50) + long + some(9)]
    texts += [some(30) + long[k : k + 40] + some(30) for k in range(0, 261, 9)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for parts in (1, 4, 16):
        got = [x for x in passages.shared_passages(df.repartition(parts)).collect()]
        assert {frozenset((x.doc_id, x.other_id)) for x in got} == {frozenset((0, 1))}
        spans = sorted((x.start_word, x.end_word) if x.doc_id == 0 else (x.other_start, x.other_end) for x in got)
        assert min(spans)[0] <= 20 and max(x[1] for x in spans) >= 320 and sum(e - s for s, e in spans) >= 300


def test_boilerplate_corpus_against_all_pairs(spark):
    """Exact stretches of 50 words that two documents share are covered, whatever the partitions, but for very few of barely 50."""
    r = random.Random(22)
    vocabulary = [f"w{i}" for i in range(400)]
    some = lambda n: r.choices(vocabulary, k=n)
    blocks = [some(r.randrange(20, 90)) for _ in range(25)]
    docs = []
    for _ in range(60):
        words = []
        for _ in range(r.randrange(2, 7)):
            block = r.choice(blocks)
            lo = r.randrange(0, max(1, len(block) - 40))
            words += some(r.randrange(3, 30)) + block[lo : lo + r.randrange(30, 90)]
        docs.append(words)
    holders = {}
    for i, words in enumerate(docs):
        for k in range(len(words) - 49):
            holders.setdefault(tuple(words[k : k + 50]), set()).add((i, k))
    wanted = {(i, k) for at in holders.values() if len({i for i, _ in at}) > 1 for i, k in at}
    assert len(wanted) > 300
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    for parts in (1, 4, 16):
        got = passages.shared_passages(df.repartition(parts)).collect()
        spans = [x for g in got for x in ((g.doc_id, g.start_word, g.end_word), (g.other_id, g.other_start, g.other_end))]
        covered = {(d, k) for d, s, e in spans for k in range(s, e - 49)}
        assert len(wanted - covered) <= 0.005 * len(wanted)


def test_every_two_of_some_holders_are_linked(spark):
    """Edited passages of 14 holders: all 91 pairs, not a path through them."""
    r = random.Random(23)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, texts = some(70), []
    for i in range(14):
        copy = list(passage)
        for at in r.sample(range(1, 69), 5):
            copy[at] = f"new{i}x{at}"
        texts.append(some(r.randrange(20, 60)) + copy + some(r.randrange(20, 60)))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for parts in (1, 8):
        got = {frozenset((x.doc_id, x.other_id)) for x in passages.shared_passages(df.repartition(parts)).collect()}
        assert got == {frozenset((i, j)) for i in range(14) for j in range(i)}


def test_a_passage_of_50_words_is_found_among_many_holders_of_49(spark):
    r = random.Random(24)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = some(50)
    texts = [some(20) + passage[k % 2 : k % 2 + 49] + some(20) for k in range(200)]
    for i in (40, 160):
        texts[i] = some(20) + passage + some(20)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for parts in (1, 4, 16):
        got = passages.shared_passages(df.repartition(parts)).collect()
        assert frozenset((40, 160)) in {frozenset((x.doc_id, x.other_id)) for x in got}  # a few of 49 words have neighbours of one 16-bit hash


def test_gap_alignment():
    assert passages.matched([1, 2, 3, 4], [1, 9, 3, 4]) == 3
    assert passages.matched([], [1]) == 0 and passages.matched([1, 2], [1, 5, 2]) == 2
    a = np.array([1, 2, 3, 4, 5, 6], dtype=np.uint16)
    assert passages.extended(a, np.array([1, 2, 9, 4, 5, 6], dtype=np.uint16)) == (6, 5)
    assert passages.extended(a, a[::-1]) == (0, 0)


def test_passage_query(spark):
    """Every exact stretch of 50 words that two documents share has a span, and every span holds what it says."""
    found = passages.op1_passages(spark, SF)
    assert set(found.columns) == {"doc_id", "other_id", "start_word", "end_word", "other_start", "other_end", "n_words", "similarity"}
    docs = {r.doc_id: (r.text or "").encode().lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = found.collect()
    holders = {}
    for i, words in docs.items():
        for k in range(len(words) - 49):
            holders.setdefault(tuple(words[k : k + 50]), set()).add((i, k))
    wanted = {(i, k) for at in holders.values() if len({i for i, _ in at}) > 1 for i, k in at}
    spans = [x for g in got for x in ((g.doc_id, g.start_word, g.end_word), (g.other_id, g.other_start, g.other_end))]
    covered = {(d, k) for d, s, e in spans for k in range(s, e - 49)}
    assert wanted and len(wanted - covered) <= 0.005 * len(wanted)
    for g in got:
        a, b = docs[g.doc_id][g.start_word : g.end_word], docs[g.other_id][g.other_start : g.other_end]
        assert min(len(a), len(b)) >= 50 and g.similarity >= 0.8 and g.n_words == len(a)
        assert len(set(a) & set(b)) >= 0.5 * min(len(set(a)), len(set(b)))


# neighbours -------------------------------------------------------------------------------------------------------------


def nearest(rows, query, k):
    v = dict(rows)[query]
    return sorted((float(np.sqrt(((np.array(x, float) - np.array(v, float)) ** 2).sum())), i) for i, x in rows if i != query)[:k]


def test_neighbours_recall_and_scores(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.standard_normal(16).astype("f4")]) for i in range(3000)]
    rows += [(3000 + i, rows[0][1]) for i in range(1000)]
    got = {}
    for row in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 100 == 0).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.score, row.vec_id))
    hits = 0
    for q in range(0, 4000, 100):
        found, true = sorted(got[q]), nearest(rows, q, 10)
        assert [x[0] for x in found] == list(range(1, 11)) and [x[1:] for x in found] == sorted(x[1:] for x in found)
        hits += len({x[2] for x in found} & {i for _, i in true})
    assert hits / 400 >= 0.9


def test_neighbours_query_recall_on_its_table(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {}
    for row in ann.op4_neighbours(spark, SF).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    asked = [i for i, _ in rows if i % 100 == 0]
    hits = sum(len(got[q] & {i for _, i in nearest(rows, q, 10)}) for q in asked)
    assert set(got) == set(asked) and hits >= 0.9 * 10 * len(asked)


def test_boundary_copies_of_vectors_in_a_plane():
    r = np.random.default_rng(12)
    x = r.random((6000, 2)) @ r.standard_normal((2, 8))
    lists = ann.Lists(ann.balanced_centroids(x, 30))
    lists.calibrate(x, 10)
    row, of = (np.concatenate(a) for a in zip(*((row + lo, of) for lo in range(0, len(x), 256) for row, of in [lists.assign(x[lo : lo + 256])])))
    member = [set() for _ in x]
    for i, j in zip(row.tolist(), of.tolist()):
        member[i].add(j)
    sizes, hits, met = np.bincount(of, minlength=len(lists.graph.c)), 0, 0
    q = r.choice(len(x), 100, replace=False)
    for k, some in lists.visit(x[q], sizes, 11):
        true = np.argsort(((x - x[q[k]]) ** 2).sum(1), kind="stable")[1:11]
        hits += sum(bool(member[t] & set(some.tolist())) for t in true)
        met += sizes[some].sum()
    assert len(row) > 1.02 * len(x) and hits >= 0.93 * 1000 and met < 0.25 * 100 * len(x)


def test_neighbours_in_blocks_and_turns(spark, monkeypatch):
    r = np.random.default_rng(13)
    rows = [(i, [float(x) for x in r.standard_normal(4)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = sorted(map(tuple, ann.neighbours(df, F.col("id") % 10 == 0).collect()))
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    assert sorted(map(tuple, ann.neighbours(df, F.col("id") % 10 == 0).collect())) == plain and len(plain) == 1200


def test_neighbours_of_odd_vectors(spark):
    one = [1.0] * 4
    rows = [(0, one), (100, one), (200, [1.0, 2.0, 3.0, 4.0]), (1, [0.5] * 4), (1, [0.5] * 4), (300, None), (400, [0.0] * 4), (500, [float("nan")] * 4), (None, one), (600, [None, 1.0, 1.0, 1.0]), (700, [1.0]), (800, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(df, F.col("id") % 100 == 0).collect())
    assert [x[:3] for x in got] == [(0, 1, 100), (0, 2, 1), (0, 3, 200), (100, 1, 0), (100, 2, 1), (100, 3, 200), (200, 1, 0), (200, 2, 100), (200, 3, 1)]
    assert got[0][3] == 0.0 and ann.neighbours(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_graph_search_meets_the_nearest():
    r = np.random.default_rng(8)
    graph = ann.Graph(r.standard_normal((200, 16)))
    x = r.standard_normal((100, 16))
    assert (graph.search(x).argmin(1) == ann.squared(x, graph.c).argmin(1)).mean() > 0.95


def test_few_rows_are_written_by_few_tasks(spark):
    few = _common.materialised(spark.range(0, 1000, 1, 60), "few", 1000)
    assert len(few.inputFiles()) <= _common.FEW_TASKS and few.count() == 1000 and few.agg(F.sum("id")).first()[0] == 499_500
    many = _common.materialised(spark.range(0, 1000, 1, 60), "many", 61 * _common.TASK_ROWS)
    assert len(many.inputFiles()) == 60 and many.count() == 1000


def test_a_worker_remembers_one_operator_at_a_time():
    import pyarrow as pa

    bpe.coder(_common.tokenizer_path("byte_bpe_50k.tiktoken"), bpe.standard_pattern())
    _common.only("bpe", bpe.coder.cache_clear)
    assert bpe.coder.cache_info().currsize == 1
    list(near.printed(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b"])], names=["id", "text"])]), 5))
    assert bpe.coder.cache_info().currsize == 0


def test_links_travel_packed_by_pair(monkeypatch):
    """Every link comes back, with its pair and by place; links of one pair take less than half their 24 bytes."""
    r = np.random.default_rng(5)
    doc, other = (r.integers(-(1 << 63), 1 << 63, 300)[r.integers(0, 300, 40_000)] for _ in range(2))
    other = np.where(r.random(40_000) < 0.5, other, doc // 3)
    pos, other_pos = r.integers(0, 500, 40_000).astype(np.int32), r.integers(0, 1 << 22, 40_000).astype(np.int32)
    other_pos[:20_000] %= 500
    wanted = sorted(zip(doc.tolist(), other.tolist(), passages.places(pos, other_pos).tolist(), strict=True))
    plain = passages.pair_keys
    for limit, buckets, keys in ((passages.SORTED_LINKS, 7, plain), (999, 1, plain), (999, 5, lambda d, o: plain(d, o) >> np.uint64(60) << np.uint64(60))):
        monkeypatch.setattr(passages, "SORTED_LINKS", limit)
        monkeypatch.setattr(passages, "pair_keys", keys)
        got, closed = [], set()
        for batch in passages.by_pair(passages.packed_links(doc, other, pos, other_pos, buckets), buckets):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not got or got[-1][:2] != row[:2]:
                    assert row[:2] not in closed
                    closed.add(row[:2])
                else:
                    assert got[-1][2] <= row[2]
                got.append(row)
        assert sorted(got) == wanted
    many = np.repeat(np.arange(100), 200)
    blobs = [x for b in passages.packed_links(many, many + 1, np.tile(np.arange(200, dtype=np.int32), 100), np.tile(np.arange(200, dtype=np.int32), 100), 1) for x in b.column(2).to_pylist()]
    assert sum(map(len, blobs)) < 12 * len(many)
