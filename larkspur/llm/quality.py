"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import decided, fold, labelled_sample, map_rows, table

DIM, NONZERO, REACH = 64, 4, 2
#: Words beyond the sample's whose vectors a worker remembers between batches; more only cost time.
REMEMBERED = 200_000
#: What one dimension of pooled vectors counts for beside a cosine or the length; chosen on halves of the rows that may be learnt from.
GAIN = 0.25
#: Parts of the sample, each left out in turn for the temperature.
FOLDS = 4


class _Kinds(dict):
    """What stands for a character in a word's shape; filled as characters come."""

    def __missing__(self, point: int) -> str:
        ch = chr(point)
        kind = self[point] = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        return kind


_KINDS = _Kinds()
_RUN = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """The kinds of all of a word's characters, runs shortened to one: Aa, 0, and marks as they are."""
    return _RUN.sub(r"\1", word.translate(_KINDS))


def index_vectors(words: list[str]) -> np.ndarray:
    """For each word the sum of sparse ternary vectors seeded by its lower-case form, shape, head and tail; of unit length."""
    if not words:
        return np.zeros((0, DIM), np.float32)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([[digest(f"w{w.lower()}"), digest(f"s{shape(w)}"), digest(f"h{w[:2]}"), digest(f"t{w[-2:]}")] for w in words], np.uint64)
    row = np.arange(len(words))[:, None] * DIM
    out = np.zeros(len(words) * DIM)
    for _ in range(NONZERO):
        at, sign = (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(8) & np.uint64(1), 1.0, -1.0)
        out += np.bincount((row + at).ravel(), sign.ravel(), len(out))
        h = h >> np.uint64(12)
    out = out.reshape(-1, DIM)
    return (out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-6)).astype(np.float32)


class Vectors:
    """Word vectors: the index vector and, for words of the sample, the summed index vectors of their neighbours."""

    def __init__(self, texts: list[str], least: int = 3):
        counts = Counter(w for text in texts for w in text.split())
        words = sorted(counts)
        at = {w: k for k, w in enumerate(words)}
        index = index_vectors(words)
        context = np.zeros_like(index)
        for text in texts:
            ids = np.array([at[w] for w in text.split()], np.int64)
            near = np.zeros((len(ids), DIM), np.float32)
            for d in range(1, REACH + 1):
                near[d:] += index[ids[:-d]]
                near[:-d] += index[ids[d:]]
            if len(ids):
                order = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
                context[ids[order][first]] += np.add.reduceat(near[order], first)
        # What all words' neighbours have in common tells no word from another.
        often = np.array([counts[w] for w in words], np.float32)[:, None]
        context -= often * (context.sum(axis=0) / max(float(often.sum()), 1.0))
        context /= np.maximum(np.sqrt((context**2).sum(axis=1, keepdims=True)), 1e-6)
        kept = [k for k, w in enumerate(words) if counts[w] >= least]
        self.at = {words[k]: j for j, k in enumerate(kept)}
        self.table = index[kept] + context[kept]

    def __getstate__(self) -> dict:
        return {"at": self.at, "table": self.table}

    def rows(self, texts: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Each text's words as rows of a table of vectors. Words beyond the sample's are remembered, up to REMEMBERED of them, for later batches."""
        if not hasattr(self, "fresh") or len(self.fresh) > REMEMBERED:
            self.fresh, self.known = {}, self.table
        at, fresh, n = self.at, self.fresh, len(self.at)
        new: list[str] = []

        def number(word: str) -> int:
            k = fresh.get(word)
            if k is None:
                k = fresh[word] = n + len(fresh)
                new.append(word)
            return k

        ids = [np.array([k if (k := at.get(w)) is not None else number(w) for w in words], np.int64) for words in texts]
        if new:
            self.known = np.concatenate([self.known, index_vectors(new)])
        return ids, self.known

    def pool(self, texts: list[str]) -> np.ndarray:
        """Texts x 2 DIM + REACH + 1: means of word vectors, of their squares, of the cosines of words 1 to REACH apart (high where words are repeated), and the logarithm of the number of words; zeros for no words."""
        out = np.zeros((len(texts), 2 * DIM + REACH + 1), np.float32)
        ids, rows = self.rows([text.split() for text in texts])
        for k, x in enumerate(ids):
            for a in range(0, len(x), 20_000):
                v = rows[x[a : a + 20_000 + REACH]]
                own = v[:20_000]
                out[k, :DIM] += own.sum(axis=0)
                out[k, DIM : 2 * DIM] += np.einsum("ij,ij->j", own, own)
                length = np.sqrt(np.einsum("ij,ij->i", v, v)) + 1e-6
                for d in range(1, min(REACH, len(v) - 1) + 1):
                    n = min(len(own), len(v) - d)
                    out[k, 2 * DIM + d - 1] += (np.einsum("ij,ij->i", v[:n], v[d : d + n]) / (length[:n] * length[d : d + n])).sum()
            out[k, : 2 * DIM + REACH] /= max(len(x), 1)
            out[k, -1] = np.log1p(len(x))
        return out


class Network:
    """Standardised inputs, one layer of rectified units, one logistic output, and a temperature.

    The temperature is fitted to logits that each of FOLDS networks gives the rows it has not seen, whatever the sample's size; then
    one network is fitted to all rows.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, weight: np.ndarray | None = None):
        weight = np.ones(len(y), np.float32) if weight is None else weight
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = self.scale(x)
        setting = (hidden, epochs, rate, decay)
        z = np.zeros(len(y))
        for k in range(FOLDS):
            left = np.arange(len(y)) % FOLDS == k
            if left.any() and not left.all():
                z[left] = self.logit(x[left], self.fit(x[~left], y[~left], weight[~left], *setting))
        loss = lambda t: float((weight * (np.logaddexp(0, z / t) - y * z / t)).sum())
        self.temperature = min(np.geomspace(0.25, 8, 41), key=loss)
        self.p = self.fit(x, y, weight, *setting)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int, epochs: int, rate: float, decay: float) -> list[np.ndarray]:
        rng = np.random.default_rng(7)
        shapes = [(x.shape[1], hidden), (hidden,), (hidden,), ()]
        p = [rng.normal(0, 1 / np.sqrt(shapes[0][0]), shapes[0]), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
        m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        train = np.arange(len(y))
        for _ in range(epochs):
            rng.shuffle(train)
            for a in range(0, len(train), 64):
                b = train[a : a + 64]
                h = np.maximum(x[b] @ p[0] + p[1], 0)
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[b]) * weight[b] / len(b)
                back = np.outer(d, p[2]) * (h > 0)
                grads = [x[b].T @ back + decay * p[0], back.sum(axis=0), h.T @ d + decay * p[2], d.sum()]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return p

    def scale(self, x: np.ndarray) -> np.ndarray:
        """Standardised inputs; those that stand for many dimensions together weigh less each."""
        return np.clip((x - self.mean) / self.std, -8, 8) * np.where(np.arange(x.shape[1]) < 2 * DIM, GAIN, 1.0)

    def logit(self, scaled: np.ndarray, p: list[np.ndarray]) -> np.ndarray:
        return np.maximum(scaled @ p[0] + p[1], 0) @ p[2] + p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.scale(x), self.p) / self.temperature, -30, 30)))


class Classifier:
    """Fitted on labelled texts; without any, or with one class only, it gives the share of label 1 (0.5 without any)."""

    def __init__(self, sample: list[tuple[str, int]], shares: dict[int, float]):
        y = np.array([k for _, k in sample], np.float32)
        self.constant = None if 0 < y.sum() < len(y) else float(y.mean()) if len(y) else 0.5
        if self.constant is None:
            texts = [text for text, _ in sample]
            self.vectors = Vectors(texts)
            weight = np.where(y == 1, 1 / shares[1], 1 / shares[0]).astype(np.float32)  # to the classes' shares among all labels
            self.network = Network(self.vectors.pool(texts), y, weight=weight / weight.mean())

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return self.network.probability(self.vectors.pool(texts))


def learn(docs: DataFrame, labels: DataFrame, rows: int = 1500, of: int = 3, left_out: int = 1) -> Classifier:
    """A classifier from at most ``rows`` labelled documents of each class, outside the fold left out."""
    return Classifier(*labelled_sample(docs, labels, "quality", rows, of, left_out))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) for every row of ``docs`` (doc_id, text) from its whole text; null texts score as empty ones do.

    Repeated rows score alike, null ids stay, an empty table gives no rows, and other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's size
    return map_rows(docs, ["doc_id"], ["text"], "score double", lambda texts: (sent.value.scores([x or "" for x in texts]),))


def keep_good(docs: DataFrame, model: Classifier, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return decided(docs, "score double", lambda texts: (sent.value.scores([x or "" for x in texts]),), lambda x: x >= least)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; learns from labels outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
