"""Quality classifier: gated-attention multiple-instance learning over the passages of a document.

A document is a bag of passages of PASSAGE words. Every word has a row of surface measures and a seeded random projection of
its hash; a passage is the mean of its words' rows with repetition measures added. The net encodes each passage, a gated
attention weighs the passages, and the weighted sum gives the score. Only documents have labels; which passages matter is
learnt. Scoring reads whole texts, long ones in runs of words.

The net is fitted in the driver on a bounded sample: at most `sample` labelled documents, taken by the hash of their id, with all
their passages, which the executors encode (N_INPUTS 4-byte numbers for 64 words, so at most their texts' size). Rows with
crc32(id as text) mod 5 = 0 are held out. Labels, language, source and id are no inputs.

Defined cases: null, empty and blank texts are one passage of zeros and get a score; very long texts are read whole, in runs of
words; ties cannot matter, as a score depends on its own text only; labels that are null or of held-out rows
teach nothing; repeated label rows count as their mean; without any label every score is 0.5; repeated documents score
alike; other columns pass through, and columns named as the outputs are replaced.
"""

from __future__ import annotations

from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pagequarry.llm._common import only, table, with_columns

PASSAGE = 64
#: Most labelled documents that the net is fitted on.
SAMPLE = 4000
THRESHOLD = 0.3
FOLDS = 5

N_SURFACE, N_HASHED = 12, 20
N_EXTRA = 3
N_INPUTS = N_SURFACE + N_HASHED + N_EXTRA
BUCKETS = 4096
#: Words remembered per Python worker, and words turned into rows at once.
KEEP_WORDS, RUN_WORDS = 150_000, PASSAGE * 512


def surface(word: str) -> list[float]:
    n = len(word)
    letters = sum(map(str.isalpha, word))
    digits = sum(map(str.isdigit, word))
    marks = sum(c in ".,;:!?'\"()-" for c in word)
    upper = sum(map(str.isupper, word))
    return [
        min(n, 40) / 10,
        letters / n,
        digits / n,
        (n - letters - digits - marks) / n,
        float(n - letters - digits - marks > 0),
        float(letters == 0),
        float(letters > 1 and upper == letters),
        float(upper > 1 and upper < letters),
        float(word[-1] in ".,;:!?"),
        float("!" in word),
        float(n > 25),
        float(n <= 2),
    ]


class Words(dict):
    """Word -> row number of `rows`, filled as words come up."""

    def __init__(self):
        super().__init__()
        self.projection = np.random.default_rng(8).standard_normal((BUCKETS, N_HASHED)).astype(np.float32)
        self.rows = np.zeros((KEEP_WORDS + RUN_WORDS, N_SURFACE + N_HASHED), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        self.rows[at, :N_SURFACE] = surface(word)
        self.rows[at, N_SURFACE:] = self.projection[crc32(word.encode()) % BUCKETS]
        self[word] = at
        return at

    def passages(self, words: list[str], bounds: np.ndarray) -> np.ndarray:
        """Inputs of the passages that start at bounds; at most RUN_WORDS words."""
        if len(self) > KEEP_WORDS:
            self.clear()
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        sizes = np.diff(np.append(bounds, len(ids)))
        means = np.add.reduceat(self.rows[ids], bounds, axis=0) / sizes[:, None]
        of = np.repeat(np.arange(len(bounds)), sizes)
        keys = np.sort(of << 32 | ids)
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        distinct = np.bincount(keys[fresh] >> 32, minlength=len(bounds)) / sizes
        same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (of[1:] == of[:-1])])
        repeats = np.bincount(of, weights=same, minlength=len(bounds)) / sizes
        return np.column_stack([means, distinct, repeats, sizes / PASSAGE]).astype(np.float32)


def encode_texts(texts: list[str | None], words: Words) -> list[np.ndarray]:
    """One matrix of passages for each text."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    pending: list[str] = []
    starts: list[int] = []
    owners: list[int] = []

    def flush() -> None:
        if pending:
            for owner, row in zip(owners, words.passages(pending, np.array(starts)), strict=True):
                out[owner].append(row)
            pending.clear()
            starts.clear()
            owners.clear()

    for k, text in enumerate(texts):
        found = (text or "").split()
        for lo in range(0, len(found), PASSAGE):
            if len(pending) + PASSAGE > RUN_WORDS:
                flush()
            starts.append(len(pending))
            owners.append(k)
            pending.extend(found[lo : lo + PASSAGE])
    flush()
    blank = np.zeros((1, N_INPUTS), dtype=np.float32)
    return [np.stack(rows) if rows else blank for rows in out]


@lru_cache(maxsize=1)
def known_words() -> Words:
    """One per Python worker."""
    return Words()


# the net ----------------------------------------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """score(bag) = sigmoid(c . sum_i a_i h_i + d), h = tanh(W x), a = softmax(w . (tanh(V h) * sigmoid(U h)))."""

    HIDDEN, GATE = 24, 12

    def __init__(self, seed: int = 8):
        r = np.random.default_rng(seed)
        h, g = self.HIDDEN, self.GATE
        self.mean, self.scale = np.zeros(N_INPUTS), np.ones(N_INPUTS)
        self.p = {"W": r.standard_normal((N_INPUTS, h)) / np.sqrt(N_INPUTS), "b": np.zeros(h), "V": r.standard_normal((h, g)) / np.sqrt(h), "U": r.standard_normal((h, g)) / np.sqrt(h), "w": r.standard_normal(g) / np.sqrt(g), "c": np.zeros(h), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        sizes = np.diff(np.append(starts, len(x)))
        bag = np.repeat(np.arange(len(starts)), sizes)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z, "y": sigmoid(z @ p["c"] + p["d"][0])}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(np.concatenate(bags).astype(np.float64), starts)["y"]

    def gradients(self, f: dict, starts: np.ndarray, target: np.ndarray) -> dict:
        p, bag, h, t, s, a = self.p, f["bag"], f["h"], f["t"], f["s"], f["a"]
        dy = (f["y"] - target) / len(target)
        dz = dy[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ dy, "d": np.array([dy.sum()])}

    def fit(self, bags: list[np.ndarray], target: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 0.01, seed: int = 8) -> GatedAttention:
        every = np.concatenate(bags).astype(np.float64)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        share = (target.sum() + 1) / (len(target) + 2)
        self.p["d"][0] = np.log(share / (1 - share))
        r, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for lo in range(0, len(order), batch):
                some = [bags[i] for i in order[lo : lo + batch]]
                starts = np.cumsum([0, *map(len, some[:-1])])
                f = self.forward(np.concatenate(some).astype(np.float64), starts)
                step += 1
                for k, g in self.gradients(f, starts, target[order[lo : lo + batch]]).items():
                    g = g + 1e-4 * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.p[k] = self.p[k] - rate * (1 - epoch / epochs) * move
        return self


# Spark ------------------------------------------------------------------------------------------------------------------


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Passages and targets of at most `sample` labelled documents that are not held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    picks = known.groupBy(F.col(id_col).alias("_pick")).agg(F.avg(label_col).alias("_target")).orderBy(F.xxhash64("_pick"), "_pick").limit(sample)
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picks), F.col("_id") == F.col("_pick")).select("_id", "_target", "_text")

    def make():
        only("quality_mil", known_words.cache_clear)
        words = known_words()
        return lambda texts: [[b.astype("<f4").tobytes() for b in encode_texts(texts, words)]]

    encoded = with_columns(joined, "_text", [("_bag", T.BinaryType(), pa.binary())], make).drop("_text")
    rows = encoded.orderBy(F.xxhash64("_id"), "_id", "_bag").limit(sample).collect()
    return [np.frombuffer(r["_bag"], dtype="<f4").reshape(-1, N_INPUTS) for r in rows], np.array([float(r["_target"]) for r in rows])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> GatedAttention:
    bags, target = labelled_sample(docs, labels, id_col, text_col, label_col, sample)
    return GatedAttention().fit(bags, target) if bags else GatedAttention()


def score(docs: DataFrame, model: GatedAttention, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of every whole text."""

    def make():
        only("quality_mil", known_words.cache_clear)
        words = known_words()
        return lambda texts: [model.score(encode_texts(texts, words)) if texts else []]

    return with_columns(docs, text_col, [(out, T.DoubleType(), pa.float64())], make)


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
