"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad. Its features are shares of character classes, length, word shape and whether it
repeats an earlier line of the text or its own words, and the same of the line before and after. Forward-backward gives each line's
marginal of "good"; weighted by line length they average to the document's quality, and a logistic fit maps that to the
probability of label 1.

Training: the labels are of documents, so each line takes its document's label. At most ``MAX_TRAIN`` labelled rows are
used (the lowest by hash of the id, never a held-out row), and of each at most ``RUNS`` runs of ``TRAIN_LINES`` lines, evenly
spaced: documented bounds, so the fit's data fits on the driver at any corpus size. Features and their sample are made in tasks; the driver
gets numbers, never texts. Scoring is one narrow stage over every whole text, and reads nothing but the text.

Null and empty texts have no line with a character: score 0. Rows that repeat a doc_id are scored one by one, and one of
them is used for the fit; of labels that repeat an id the largest counts. Without labels of both classes (or without
documents) nothing can be learnt: every text with a character scores the share of label 1 among the labels that there are,
and BASE_RATE without any. A very long document is one sequence; its memory is a few numbers a line.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import filter_documents, map_documents
from corpusloom.shipping import ready

#: The bounds on labelled documents and on runs of lines of each that a fit may use, and the lines of a run.
MAX_TRAIN, RUNS, TRAIN_LINES = 4_000, 2, 64
THRESHOLD = 0.7
#: The score of every text with a character where there are no labels at all: nothing is rejected.
BASE_RATE = 1.0

CLASSES = ["lower", "upper", "digit", "symbol", "shout", "stop", "pipe", "space", "high", "other"]
_TABLE = np.full(256, 9, np.uint8)
for _k, _chars in enumerate([range(97, 123), range(65, 91), range(48, 58), b"#*$%&<>@^~=_+{}[]\\", b"!?", b".,;:'\"()-", b"|", b" \t\r\x0b\x0c", range(128, 256)]):
    _TABLE[list(_chars)] = _k
OWN = len(CLASSES) + 6
N_FEATURES = 3 * OWN + 1


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features a line, bytes a line, lines a text) of all lines of the texts, in order."""
    raw = [t.encode() for t in texts]
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(buffer == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    line_of = np.repeat(np.arange(len(ends)), size + 1)
    counts = np.bincount(line_of * 16 + _TABLE[buffer], minlength=16 * len(ends)).reshape(-1, 16)[:, : len(CLASSES)].astype(np.float32)
    counts[:, 9] -= 1  # the newline itself
    per_text = np.array([r.count(b"\n") + 1 for r in raw])
    n = np.maximum(size, 1).astype(np.float32)
    own = np.empty((len(ends), OWN), np.float32)
    own[:, : len(CLASSES)] = counts / n[:, None]
    words = counts[:, 7] + 1
    own[:, -6] = np.log1p(size) / 5
    own[:, -5] = np.minimum((size - counts[:, 7]) / words, 40) / 10
    own[:, -4] = size == 0
    again, fresh, stutter = [], [], []
    for r in raw:
        seen: set[bytes] = set()
        for line in r.split(b"\n"):
            again.append(bool(line) and line in seen)
            seen.add(line)
            ws = line.split()
            fresh.append(len(set(ws)) / len(ws) if ws else 1.0)
            stutter.append(sum(map(eq, ws, ws[1:])) / len(ws) if ws else 0.0)
    own[:, -3], own[:, -2], own[:, -1] = again, fresh, stutter
    first = np.zeros(len(ends), bool)
    first[np.cumsum(per_text) - per_text] = True
    last = np.roll(first, -1)
    before = np.where(first[:, None], 0, np.roll(own, 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(own, -1, axis=0))
    return np.concatenate([own, before, after, np.ones((len(ends), 1), np.float32)], axis=1), size, per_text


def _padded(score: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line scores as (text, position), and which cells hold a line. Texts must be of similar length to save memory."""
    width = int(per_text.max())
    mask = np.arange(width) < per_text[:, None]
    out = np.zeros(mask.shape)
    out[mask] = score
    return out, mask


def marginals(score: np.ndarray, mask: np.ndarray, trans: np.ndarray, begin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of a two-state chain whose good state scores ``score`` and whose bad state scores 0.

    Returns P(good) a cell, the expected transitions summed over the chains (2, 2) and log Z a chain.
    """
    n, width = score.shape
    alpha = np.zeros((width, n, 2))
    alpha[0, :, 1] = score[:, 0] + begin
    for t in range(1, width):
        step = np.logaddexp(alpha[t - 1][:, 0, None] + trans[0], alpha[t - 1][:, 1, None] + trans[1])
        step[:, 1] += score[:, t]
        alpha[t] = np.where(mask[:, t, None], step, alpha[t - 1])
    beta = np.zeros((width, n, 2))
    for t in range(width - 2, -1, -1):
        ahead = beta[t + 1].copy()
        ahead[:, 1] += score[:, t + 1]
        back = np.logaddexp(trans[:, 0] + ahead[:, 0, None], trans[:, 1] + ahead[:, 1, None])
        beta[t] = np.where(mask[:, t + 1, None], back, 0)
    log_z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    good = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - log_z, 0)).T
    pairs = np.zeros((2, 2))
    for t in range(1, width):
        live = mask[:, t]
        ahead = beta[t][live].copy()
        ahead[:, 1] += score[live, t]
        joint = alpha[t - 1][live][:, :, None] + trans[None] + ahead[:, None, :] - log_z[live, None, None]
        pairs += np.exp(np.minimum(joint, 0)).sum(axis=0)
    return good, pairs, log_z


@dataclass
class LineCRF:
    weights: np.ndarray
    trans: np.ndarray
    begin: float
    slope: float = 1.0
    offset: float = 0.0

    def line_marginals(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """P(good) of every line, from the features of the lines and the lines of each text."""
        score = np.concatenate([x[k : k + 65_536].astype(np.float64) @ self.weights for k in range(0, len(x), 65_536)])
        good = np.empty(len(score))
        first = np.cumsum(per_text) - per_text
        order = np.argsort(per_text, kind="stable")
        at = 0
        while at < len(order):  # texts of similar length together, so that padding stays below a factor of two
            most = max(8, 2 * per_text[order[at]])
            upto = at
            while upto < len(order) and per_text[order[upto]] <= most:
                upto += 1
            some = order[at:upto]
            rows = np.concatenate([np.arange(first[i], first[i] + per_text[i]) for i in some])
            padded, mask = _padded(score[rows], per_text[some])
            good[rows] = marginals(padded, mask, self.trans, self.begin)[0][mask]
            at = upto
        return good

    def mean_marginal(self, x: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each text, before calibration; nan for texts without a character."""
        good = self.line_marginals(x, per_text)
        which = np.repeat(np.arange(len(per_text)), per_text)
        total = np.bincount(which, size, len(per_text))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.bincount(which, size * good, len(per_text)) / total

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        q = np.clip(self.mean_marginal(*line_features(texts)), 1e-6, 1 - 1e-6)
        p = 1 / (1 + np.exp(-(self.slope * np.log(q / (1 - q)) + self.offset)))
        return np.where(np.isnan(q), 0.0, p)


@dataclass
class Constant:
    """Stands for a model where nothing can be learnt."""

    share: float

    def score(self, texts: list[str]) -> np.ndarray:
        return np.array([self.share if t.strip("\n") else 0.0 for t in texts])


def fit(texts: list[str], labels: list[int], rounds: int = 150, ridge: float = 1e-3) -> LineCRF:
    """:func:`fit_lines` on whole texts."""
    x, size, per_text = line_features(texts)
    return fit_lines(x, size, per_text, labels, rounds, ridge)


def fit_lines(features: np.ndarray, size: np.ndarray, per_text: np.ndarray, labels: list[int], rounds: int = 150, ridge: float = 1e-3) -> LineCRF:
    """Maximum likelihood by Adam on all training sequences at once, then a logistic calibration."""
    x, y = features, np.repeat(np.array(labels, np.float64), per_text)
    cut = np.concatenate([[min(TRAIN_LINES, n - k) for k in range(0, n, TRAIN_LINES)] for n in per_text]).astype(int)
    order = np.argsort(cut, kind="stable")
    first = np.cumsum(cut) - cut
    rows = np.concatenate([np.arange(first[i], first[i] + cut[i]) for i in order])
    x, y, cut = x[rows].astype(np.float64), y[rows], cut[order]
    bounds = [0, *(int(np.searchsorted(cut, w, "right")) for w in (2, 4, 8, 16, 32, 64))]
    groups = [(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]
    line_at = np.concatenate([[0], np.cumsum(cut)])
    starts = np.zeros(len(y), bool)
    starts[line_at[:-1]] = True
    follow = np.flatnonzero(~starts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[follow - 1].astype(int), y[follow].astype(int)), 1)
    theta = np.zeros(N_FEATURES + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = len(cut)
    for step in range(1, rounds + 1):
        w, trans, begin = theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[-1]
        score, good = x @ w, np.empty(len(y))
        pairs = np.zeros((2, 2))
        for a, b in groups:
            part = slice(line_at[a], line_at[b])
            padded, mask = _padded(score[part], cut[a:b])
            g, p, _ = marginals(padded, mask, trans, begin)
            good[part] = g[mask]
            pairs += p
        grad = np.concatenate([x.T @ (y - good), (seen - pairs).reshape(-1), [(y - good)[starts].sum()]]) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    crf = LineCRF(theta[:N_FEATURES].copy(), theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2).copy(), float(theta[-1]))
    q = crf.mean_marginal(features, size, per_text)
    known = ~np.isnan(q)
    q, target = np.clip(q[known], 1e-6, 1 - 1e-6), np.array(labels, np.float64)[known]
    z = np.log(q / (1 - q))
    scale = max(float(np.std(z)), 1e-6)
    z = z / scale
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((target - p) * z).sum() - 0.1 * a, (target - p).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum()]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -1, 1)
    crf.slope, crf.offset = max(float(a), 0.05) / scale, float(b)
    return crf


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_lines(docs: DataFrame, runs: int = RUNS, text: str = "text") -> DataFrame:
    """doc_id, size (bytes of each sampled line) and features (their numbers in a row) of every text."""

    def rows(ids: list, texts: list[str]) -> dict:
        x, size, per_text = line_features(texts)
        picked = []
        for first, n in zip((np.cumsum(per_text) - per_text).tolist(), per_text.tolist(), strict=True):
            starts = [0] if n <= TRAIN_LINES else np.linspace(0, n - TRAIN_LINES, runs).astype(int)
            inside = np.arange(n) if n <= runs * TRAIN_LINES else np.concatenate([np.arange(s, s + TRAIN_LINES) for s in starts])
            picked.append(first + inside)
        return {"doc_id": ids, "size": [size[p] for p in picked], "features": [x[p].tobytes() for p in picked]}

    return map_documents(docs, rows, "doc_id long, size array<long>, features binary", text)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, text: str = "text") -> LineCRF | Constant:
    """Fit on at most ``max_train`` labelled documents that are not held out; a sample by hash of the id."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # of rows that repeat an id
    rows = sorted(training_lines(one).join(F.broadcast(sample), "doc_id").collect(), key=lambda r: r["doc_id"])
    found = [int(r["label"]) for r in rows]
    if len(set(found)) < 2:
        return Constant(float(np.mean(found)) if found else BASE_RATE)
    x = np.concatenate([np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES) for r in rows])
    return fit_lines(x, np.concatenate([r["size"] for r in rows]).astype(np.int64), np.array([len(r["size"]) for r in rows]), found)


def score_documents(docs: DataFrame, model: LineCRF | Constant, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)

    def rows(ids: list, texts: list[str]) -> dict:
        return {"doc_id": ids, "score": shared.value.score(texts)}

    scored = map_documents(docs, rows, "doc_id long, score double", text)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: LineCRF | Constant, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, all columns kept. The score is taken in place: no join.

    With a :class:`Constant` in place of a model there is no ground to reject any, so all stay.
    """
    if isinstance(model, Constant):
        return docs
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)
    return filter_documents(docs, lambda texts: shared.value.score(texts) >= threshold)
