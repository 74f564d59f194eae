"""Secret scan: fixed patterns, and a character convolutional network over every candidate with its context.

Three fixed kinds of finding are always kept. A candidate is a run of LEAST or more key characters outside them that is no
ordinary word (letters in one case or capitalised, up to 19, or such parts between hyphens or points), and any run of LEAST or
more after a cue such as `key:`; what a fixed finding leaves of a run is a candidate too. A numpy network reads BODY characters of
the run and those around it; a longer run is read whole, by windows of BODY characters every STRIDE. Likely secrets are
added as a fourth kind, neighbouring windows as one span. Fixed findings are scored as well (`score` in `scan`).

The network is trained in the driver on `findings` labelled findings made by a seeded generator (keys, tokens and passwords
in assignments, headers, URLs and plain text against paths, links, names, numbers, versions and ids in like contexts). A
third of them calibrates the score (Platt scaling) and sets the threshold: the highest that still finds RECALL of the held-out
secrets. The number of findings is the bound of the sample; nothing of it depends on the corpus.

Whole texts are scanned. Defined cases: null and empty texts have no finding; very long texts and runs are read whole, windows
BATCH at a time; repeated rows have the same findings; of findings that begin together the fixed kinds come first; offsets
are code points; a table without rows gives none; other columns pass through, and columns named as the outputs are replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagequarry.llm._common import table, with_columns

#: Kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_CUES, ASSIGN_LEAST = (b"passw", b"secret", b"token", b"api"), 8
ACCESS, ACCESS_LEAST = re.compile(r"AKIA[A-Z0-9]+"), 16
HEX = re.compile(r"[0-9a-f]{32,}")

LEAST = 8
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")
#: Runs that are words, or words joined by single hyphens or points, with closing signs.
ORDINARY = re.compile(r"[-.=_/+]*(?:[A-Z]?[a-z]{1,18}|[A-Z]{1,19}|[0-9]{1,8})(?:[-.](?:[A-Z]?[a-z]{1,18}|[A-Z]{1,19}|[0-9]{1,8}))*[-.=_/+]*")
CUE = re.compile(r"""(?:key|token|secret|passw(?:or)?d|passphrase|pwd|auth(?:orization)?|bearer|basic|credentials?|private)["']?\x20*[:=\x20]\x20*["']?$""", re.IGNORECASE | re.ASCII)
BEFORE, BODY, AFTER = 32, 48, 8
WIDTH = BEFORE + BODY + AFTER
#: Places between two windows of a long run; windows that the network reads at once.
STRIDE, BATCH = 16, 4096

#: Labelled findings that the network is trained on.
FINDINGS = 8000
RECALL = 0.98


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds, by start, then kind."""
    found = []
    folded = text.encode().lower()
    if any(cue in folded for cue in ASSIGN_CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the candidates outside the spans taken."""
    out: list[tuple[int, int]] = []
    spans = sorted((s, e) for s, _, e in taken)
    at = reach = 0
    for m in RUN.finditer(text):
        start, end = m.span()
        pieces, here = [], start
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        k = at
        reach = 0
        while k < len(spans) and spans[k][0] < end:
            if spans[k][1] > start:
                pieces.append((here, spans[k][0]))
                here = max(here, spans[k][1])
            k += 1
        pieces.append((here, end))
        for s, e in pieces:
            if e - s >= LEAST and (not ORDINARY.fullmatch(text, s, e) or CUE.search(text, max(0, s - 24), s)):
                out.append((s, e))
    return out


def windows_of(start: int, end: int) -> list[tuple[int, int]]:
    """The run, or windows of BODY characters that cover it."""
    if end - start <= BODY:
        return [(start, end)]
    return [(s, s + BODY) for s in [*range(start, end - BODY, STRIDE), end - BODY]]


# the network ------------------------------------------------------------------------------------------------------------

#: Classes of characters: 0 stands for nothing, then printable ASCII, then any other letter, any other character.
N_CLASSES = 98


@lru_cache(maxsize=1 << 16)
def char_class(c: str) -> int:
    return ord(c) - 31 if " " <= c <= "~" else 96 if c.isalpha() else 97


def window(text: str, start: int, end: int) -> list[int]:
    """Classes of the context before, up to BODY characters, and the context after."""
    before, body, after = text[max(0, start - BEFORE) : start], text[start : min(end, start + BODY)], text[end : end + AFTER]
    return [*[0] * (BEFORE - len(before)), *map(char_class, before), *map(char_class, body), *[0] * (BODY - len(body)), *map(char_class, after), *[0] * (AFTER - len(after))]


class CharNet:
    """Character embedding, one convolution of KERNEL characters, the largest and mean response in each of three regions, a logistic output."""

    DIM, KERNEL, FILTERS = 8, 5, 24

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"E": r.standard_normal((N_CLASSES, self.DIM)) * 0.3, "K": r.standard_normal((self.KERNEL * self.DIM, self.FILTERS)) / np.sqrt(self.KERNEL * self.DIM), "b": np.zeros(self.FILTERS), "o": np.zeros(6 * self.FILTERS), "d": np.zeros(1)}
        n = WIDTH - self.KERNEL + 1
        edges = [0, BEFORE, BEFORE + BODY, n]
        self.regions = [(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray) -> dict:
        p = self.p
        e = p["E"][x]
        u = np.lib.stride_tricks.sliding_window_view(e, self.KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, self.KERNEL * self.DIM)
        r = np.maximum(u @ p["K"] + p["b"], 0)
        top = [r[:, a:b].argmax(1) + a for a, b in self.regions]
        f = np.concatenate([*(np.take_along_axis(r, t[:, None], 1)[:, 0] for t in top), *(r[:, a:b].mean(1) for a, b in self.regions)], axis=1)
        return {"u": u, "r": r, "top": top, "f": f, "logit": f @ p["o"] + p["d"][0]}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        p, s = self.p, self.forward(x)
        dy = (1 / (1 + np.exp(-np.clip(s["logit"], -30, 30))) - y) / len(y)
        df = dy[:, None] * p["o"]
        dr, n = np.zeros_like(s["r"]), self.FILTERS
        for k, ((a, b), top) in enumerate(zip(self.regions, s["top"], strict=True)):
            np.put_along_axis(dr, top[:, None], np.take_along_axis(dr, top[:, None], 1) + df[:, None, k * n : (k + 1) * n], 1)
            dr[:, a:b] += df[:, None, (3 + k) * n : (4 + k) * n] / (b - a)
        dr *= s["r"] > 0
        flat_u, flat_r = s["u"].reshape(-1, s["u"].shape[2]), dr.reshape(-1, n)
        du = (flat_r @ p["K"].T).reshape(len(x), -1, self.KERNEL, self.DIM)
        de = np.zeros((*x.shape, self.DIM))
        for j in range(self.KERNEL):
            de[:, j : j + du.shape[1]] += du[:, :, j]
        grad = np.zeros_like(p["E"])
        np.add.at(grad, x.reshape(-1), de.reshape(-1, self.DIM))
        return {"E": grad, "K": flat_u.T @ flat_r, "b": flat_r.sum(0), "o": s["f"].T @ dy, "d": np.array([dy.sum()])}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> CharNet:
        """Trains on two thirds; the rest calibrates and sets the threshold."""
        r, step = np.random.default_rng(seed), 0
        order = r.permutation(len(x))
        fit, held = order[: len(x) * 2 // 3], order[len(x) * 2 // 3 :]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            r.shuffle(fit)
            for lo in range(0, len(fit), batch):
                some, step = fit[lo : lo + batch], step + 1
                for k, g in self.gradients(x[some], y[some]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (1 - epoch / epochs) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        logit, target = self.logits(x[held]), y[held]
        self.scale, self.shift = platt(logit, target)
        positive = np.sort(self.probability(logit)[target == 1])
        self.threshold = float(positive[int((1 - RECALL) * len(positive))])
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[lo : lo + 256])["logit"] for lo in range(0, len(x), 256)]) if len(x) else np.empty(0)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))

    def scores(self, windows: list[list[int]]) -> np.ndarray:
        return self.probability(self.logits(np.array(windows, dtype=np.int64).reshape(-1, WIDTH)))

    def secret(self, windows: list[list[int]]) -> np.ndarray:
        return self.scores(windows) >= self.threshold


def platt(logit: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Scale and shift of the logits that fit smoothed targets best."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w, g = p * (1 - p) + 1e-6, p - target
        h = np.array([[(w * logit * logit).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(h, np.array([(g * logit).sum() + 1e-3 * (a - 1), g.sum()]))
        a = float(np.clip(a, 0.01, 10))
    return a, float(b)


def labelled_findings(n: int = FINDINGS, seed: int = 7) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """n (text, start, end) candidates, half of them secrets, with 1 for a secret."""
    r = np.random.default_rng(seed)
    pick = lambda some: some[int(r.integers(len(some)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in r.integers(len(alphabet), size=k))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    between = lambda a, b: int(r.integers(a, b + 1))
    onsets, vowels, codas = [*"bcdfghklmnprstvwz", "th", "sh", "ch", "st", "br", "wh", "pf", "sch"], [*"aeiouaeiou", "ea", "io", "ie", "au", "ei"], ["", "", "", "n", "r", "s", "d", "t", "ng", "nd", "st", "tz", "ch"]
    syllable = lambda: pick(onsets) + pick(vowels) + pick(codas)
    word = lambda: "".join(syllable() for _ in range(between(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))
    number = lambda a, b: chars(digit, between(a, b))
    letters = lower + upper
    secret = [
        lambda: chars(letters + digit, between(20, 64)),
        lambda: chars(letters + digit, between(20, 64)),
        lambda: chars(letters + digit + "+/", between(22, 86)) + pick(["", "=", "=="]),
        lambda: chars(upper + digit, between(16, 40)),
        lambda: chars(lower + digit, between(24, 48)),
        lambda: chars(letters, between(24, 64)),
        lambda: chars(pick([lower, upper]), between(32, 64)),
        lambda: pick(["key", "sk", "pk", "tok", "app"]) + pick(["_", "-", "_live_", "_test_"]) + chars(letters + digit, between(20, 40)),
        lambda: ".".join(chars(letters + digit + "_-", between(20, 60)) for _ in range(3)),
    ]
    #: Shorter ones, which only a cue before them tells.
    name = lambda: pick([word(), chars(lower, between(1, 3)), syllable() + number(0, 2)])
    short = [lambda: chars(letters + digit, between(9, 16)), lambda: chars(lower + digit, between(10, 18)), lambda: chars(letters, between(12, 20)), lambda: chars(letters + digit + "_-.", between(10, 18))]
    path = lambda: "".join(pick(["/", "/", ".", "-", "_"]) + word() for _ in range(between(3, 9)))
    innocent = [
        lambda: f"{word()}-{word()}-{word()}-{number(1, 4)}",
        lambda: f"//{pick(['www.', 'blog.', ''])}{word()}{word()}.example.{pick(['com', 'org', 'net'])}/{word()}/{number(1, 6)}",
        lambda: f"/{word()}/{word()}/{word()}{number(1, 3)}.{pick(['html', 'txt', 'png', 'json'])}",
        lambda: f"{word()}.{word()}{number(1, 4)}.{word()}.{word()}",
        lambda: f"{number(4, 4)}-{number(2, 2)}-{number(2, 2)}T{number(2, 2)}",
        lambda: f"{word()}{word()}{word()}{word()}{word()}{number(0, 4)}",
        lambda: f"v{number(1, 2)}.{number(1, 2)}.{number(1, 3)}-{word()}.{number(1, 2)}",
        lambda: f"{word()}_{word()}_{word()}_{number(0, 5)}",
        lambda: f"{number(8, 12)}{pick(['-', '_', '.'])}{word()}{word()}",
        lambda: "-".join(number(3, 5) for _ in range(3)) + pick(["", "x", "ext"]) + number(0, 3),
        lambda: word() + pick(["-", "=", "_", "."]) * between(8, 30) + number(0, 2),
        lambda: "".join(word().capitalize() for _ in range(between(2, 7))) + number(0, 2),
        lambda: word() + word() + word() + word(),
        lambda: f"{word()}{word()}/{word()}{word()}",
        lambda: "".join(word() for _ in range(between(5, 12))),
        lambda: (word() + word() + word()).upper(),
        lambda: number(8, 16) + pick(["", "." + number(2, 4)]),
        path,
        path,
        lambda: path() + path() + path(),
        lambda: f"{word()}{pick(['=', '_', '.'])}{word()}{number(1, 4)}",
        lambda: pick(["", "_"]) + "_".join(name() for _ in range(between(2, 5))),
        lambda: ".".join(name() for _ in range(between(2, 4))) + pick(["", "_" + name(), "." + name().upper()]),
        lambda: "_".join(name() for _ in range(between(2, 4))).upper(),
        lambda: name() + "".join(name().capitalize() for _ in range(between(1, 4))) + pick(["", "=" + name(), "." + name()]),
        lambda: f"{pick(['mail', word()])}{number(0, 2)}.{pick(['example', word()])}.{pick(['com', 'org', 'net'])}",
        lambda: number(12, 19),
    ]
    #: Words after a cue that are no secrets.
    plain_word = [lambda: word() + word() + word(), lambda: f"{word()}{word()}-{word()}", lambda: f"{word()}_{word()}", lambda: f"{word()}{word()}.{word()}()", lambda: word() + word() + word() + "."]
    cues = ["key: ", "auth=", "credential ", "bearer ", "Authorization: Basic ", "signature = \"", "pwd='", "private ", "export KEY=", "access "]
    plain = ["see ", "at ", "page ", "in ", "https:", "file ", "id ", "of ", "(", "ref. ", "v ", "user@", "name.13@", "import ", "= ", "[", "(*", "def "]
    out, y = [], []
    for k in range(n):
        is_secret = k % 2 == 0
        after_cue = r.random() < (0.5 if is_secret else 0.2)
        brief = after_cue and r.random() < 0.4
        run = pick(short if brief else secret)() if is_secret else pick(plain_word if brief else innocent)()
        while len(run) < LEAST:
            run += chars(lower + digit, 4) if is_secret else word()
        lead = pick(cues) if after_cue else pick(plain) if r.random() < 0.4 else ""
        lo, hi = 0, len(run)
        if is_secret and not brief and r.random() < 0.2:  # within a longer run
            head, tail = pick(["", path() + "/", word() + "."]), pick(["", "/" + word(), path()])
            lo, hi, run = len(head), len(head) + len(run), head + run + tail
        before = words(between(0, 8)) + pick([" ", "\n", ". "]) + lead
        after = pick(['"', "'", " ", "\n", ",", ".", ")", "", " " + words(3)])
        spots = windows_of(len(before), len(before) + len(run))
        if is_secret:  # a window that shows enough of the secret
            spots = [(s, e) for s, e in spots if min(e, len(before) + hi) - max(s, len(before) + lo) >= min(hi - lo, 20)] or [(len(before) + lo, len(before) + min(hi, lo + BODY))]
        start, end = pick(spots)
        out.append((before + run + after, start, end))
        y.append(float(is_secret))
    return out, np.array(y)


@lru_cache(maxsize=4)
def trained(findings: int = FINDINGS, seed: int = 7) -> CharNet:
    some, y = labelled_findings(findings, seed)
    x = np.array([window(*f) for f in some], dtype=np.int64)
    return CharNet(seed).fit(x, y)


def scored_spans(texts: list[str | None], net: CharNet, base_scores: bool = False) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, score) of each text's findings, by start, then kind; with base_scores, fixed findings are scored too."""
    base = [base_spans(t or "") for t in texts]
    pending: list[tuple[int, int, int, int]] = []
    out: list[list[tuple[int, int, int, float]]] = [[] if base_scores else [(*f, 1.0) for f in found] for found in base]
    last: dict[int, int] = {}

    def flush() -> None:
        for (k, kind, s, e), p in zip(pending, net.scores([window(texts[k], s, e) for k, _, s, e in pending]).tolist(), strict=True):
            if kind < 3:
                out[k].append((s, kind, e, p))
            elif p >= net.threshold:
                i = last.get(k, -1)
                if i >= 0 and out[k][i][2] >= s:  # windows that overlap are one span
                    before = out[k][i]
                    out[k][i] = (before[0], 3, max(e, before[2]), max(p, before[3]))
                else:
                    last[k] = len(out[k])
                    out[k].append((s, 3, e, p))
        pending.clear()

    for k, (text, found) in enumerate(zip(texts, base, strict=True)):
        if base_scores:
            pending += [(k, kind, s, e) for s, kind, e in found]
        for s, e in candidates(text, found) if text else ():
            for spot in windows_of(s, e):
                pending.append((k, 3, *spot))
                if len(pending) >= BATCH:
                    flush()
    flush()
    return [sorted(found) for found in out]


def spans(texts: list[str | None], net: CharNet) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text's findings, by start, then kind."""
    return [[f[:3] for f in found] for found in scored_spans(texts, net)]


# Spark ------------------------------------------------------------------------------------------------------------------


def scan(df: DataFrame, text_col: str = "text", out: str = "findings", findings: int = FINDINGS) -> DataFrame:
    """df with an array of (kind, start, end, score): the findings of every whole text; score is the network's, for fixed kinds too."""
    net = trained(findings)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    schema = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))

    def make():
        return lambda texts: [[[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in found] for found in scored_spans(texts, net, base_scores=True)]]

    return with_columns(df, text_col, [(out, schema, kind)], make)


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]", findings: int = FINDINGS) -> DataFrame:
    """df, in whose texts every finding, or run of overlapping findings, is replaced by mask."""
    net = trained(findings)

    def clean(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
        if not found:
            return text
        out, at = [], 0
        for start, _, end in found:
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def make():
        return lambda texts: [[clean(t, found) for t, found in zip(texts, spans(texts, net), strict=True)]]

    cleaned = with_columns(df, text_col, [("_redacted", T.StringType(), pa.string())], make)
    return cleaned.select(*[F.col("_redacted").alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in df.columns])


def joined(findings: str, base_only: bool):
    some = F.filter(findings, lambda f: f["kind"] != KINDS[3]) if base_only else F.col(findings)
    return F.array_join(F.transform(some, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, as counts, digest and spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined("findings", True), 256).alias("base_sha256"), joined("findings", False).alias("spans"), count("net"))
