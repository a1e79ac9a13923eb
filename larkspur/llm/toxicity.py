"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import decided, fold, labelled_sample, map_rows, table

TOKEN = re.compile(r"[^\W_]+")
#: Tokens in a window, and tokens from one window's start to the next one's.
WINDOW, STRIDE = 64, 48
#: Dimensions of word inputs, character inputs, each direction's state and attention.
WORD, CHAR, HIDDEN, ATTEND = 8, 8, 8, 8
GRAMS, BUCKETS = (3, 5), 1 << 16
#: Numbers of texts that may make a word known, and the parts of the sample by which one is chosen.
LEAST, FOLDS = (2, 3, 4), 4


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words' bytes, their ends marked, and the word that each is of."""
    raw = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(x) for x in raw], np.int64)
    text, word = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32), np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [], []
    for n in GRAMS:
        if len(text) >= n:
            h = np.full(len(text) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ text[k : len(text) - n + 1 + k]) * np.uint32(0x01000193)
            inside = word[: len(h)] == word[n - 1 :]
            h = (h ^ (h >> np.uint32(15)))[inside]
            buckets.append((h % BUCKETS).astype(np.int64))
            owners.append(word[: len(inside)][inside])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.zeros(0, np.int64),) * 2


def lexicon(texts: list[list[str]]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """All tokens as numbers, the distinct words by number, and each text's number of tokens."""
    distinct: dict[str, int] = {}
    ids = np.array([distinct.setdefault(w, len(distinct)) for words in texts for w in words], np.int64)
    return ids, list(distinct), np.array([len(x) for x in texts], np.int64)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many tokens, one after another: each window's text, first token and length. A text without tokens has one empty window."""
    n = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = nth * STRIDE
    return owner, (np.cumsum(sizes) - sizes)[owner] + start, np.minimum(WINDOW, sizes[owner] - start)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and passes of the network; windows are columns, longest first, so that those still running are a prefix."""

    def __init__(self, rng: np.random.Generator):
        d, f32 = WORD + CHAR, np.float32
        glorot = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(f32)
        self.p = {}
        for side in "fb":
            self.p |= {f"wx{side}": glorot(d, 3 * HIDDEN), f"wh{side}": glorot(HIDDEN, 3 * HIDDEN), f"b{side}": np.zeros(3 * HIDDEN, f32)}
        self.p |= {"wa": glorot(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, f32), "va": glorot(ATTEND), "w": glorot(2 * HIDDEN), "w0": np.zeros((), f32)}

    def inputs(self, x: np.ndarray) -> list[np.ndarray]:
        """Gate inputs of both directions for each row of x, once for each distinct word."""
        return [x @ self.p[f"wx{s}"] + self.p[f"b{s}"] for s in "fb"]

    def run(self, gates: list[np.ndarray], ids: np.ndarray, lengths: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Logits of windows: ids is WINDOW x windows; kept gets what a backward pass needs."""
        p, h = self.p, HIDDEN
        most, count = int(lengths.max(initial=0)), len(lengths)
        states = np.zeros((max(most, 1), count, 2 * h), np.float32)
        active = np.searchsorted(-lengths, -np.arange(most), side="left")
        for side, at in (("f", 0), ("b", 1)):
            s = np.zeros((count, h), np.float32)
            wh, g = p[f"wh{side}"], gates[at]
            for t in range(most) if at == 0 else range(most - 1, -1, -1):
                a = active[t]
                x, prev = g[ids[t, :a]], s[:a]
                y = prev @ wh
                rz = 1 / (1 + np.exp(-(x[:, : 2 * h] + y[:, : 2 * h])))
                n = np.tanh(x[:, 2 * h :] + rz[:, :h] * y[:, 2 * h :])
                new = n + rz[:, h:] * (prev - n)
                if kept is not None:
                    kept[side, t] = (prev.copy(), y[:, 2 * h :], rz, n)
                s[:a] = new
                states[t, :a, at * h : at * h + h] = new
        u = np.tanh(states @ p["wa"] + p["ba"])
        e = u @ p["va"]
        e = np.where(np.arange(max(most, 1))[:, None] < np.maximum(lengths, 1), e, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        c = np.einsum("tb,tbd->bd", a, states)
        if kept is not None:
            kept |= {"states": states, "u": u, "a": a, "c": c, "active": active, "most": most}
        return c @ p["w"] + p["w0"]

    def back(self, dlogit: np.ndarray, ids: np.ndarray, x: np.ndarray, kept: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the rows of x."""
        p, h = self.p, HIDDEN
        states, u, a, c = kept["states"], kept["u"], kept["a"], kept["c"]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["w"], g["w0"] = c.T @ dlogit, dlogit.sum()
        dc = dlogit[:, None] * p["w"]
        da = np.einsum("bd,tbd->tb", dc, states)
        de = a * (da - (a * da).sum(axis=0))
        du = de[..., None] * p["va"] * (1 - u**2)
        g["va"], g["ba"] = np.einsum("tb,tbk->k", de, u), du.sum(axis=(0, 1))
        g["wa"] = np.einsum("tbd,tbk->dk", states, du)
        ds = a[..., None] * dc + du @ p["wa"].T
        dx = np.zeros_like(x)
        for side, at in (("f", 0), ("b", 1)):
            wh, wx = p[f"wh{side}"], p[f"wx{side}"]
            dh = np.zeros((len(dlogit), h), np.float32)
            pre, rows = [], []
            for t in range(kept["most"] - 1, -1, -1) if at == 0 else range(kept["most"]):
                k = kept["active"][t]
                prev, yn, rz, n = kept[side, t]
                d = dh[:k] + ds[t, :k, at * h : at * h + h]
                z, r = rz[:, h:], rz[:, :h]
                dn = d * (1 - z) * (1 - n**2)
                dz = d * (prev - n) * z * (1 - z)
                dr = dn * yn * r * (1 - r)
                dy = np.concatenate([dr, dz, dn * r], axis=1)
                g[f"wh{side}"] += prev.T @ dy
                dh[:k] = d * z + dy @ wh.T
                pre.append(np.concatenate([dr, dz, dn], axis=1))
                rows.append(ids[t, :k])
            if pre:
                all_pre, all_rows = np.concatenate(pre), np.concatenate(rows)
                order = np.argsort(all_rows, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(all_rows[order]) > 0])
                summed, at_rows = np.add.reduceat(all_pre[order], first), all_rows[order][first]
                g[f"b{side}"] = summed.sum(axis=0)
                g[f"wx{side}"] = x[at_rows].T @ summed
                dx[at_rows] += summed @ wx.T
        return g, dx


class Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.m, self.v = rate, 0, {}, {}

    def move(self, params: dict, grads: dict) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            params[k] = (params[k] - self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-7)).astype(np.float32)


def log_odds(a: np.ndarray, b: np.ndarray, n1: float, n0: float, least: int) -> np.ndarray:
    """Log-odds of the label for what ``a`` of n1 texts with it and ``b`` of n0 without it have; 0 for what fewer than ``least`` texts have.

    Each is taken to be in some more texts of both labels, the more the more texts are asked for.
    """
    prior = least**2 / 8
    odds = np.log((a + prior) / (n1 + 2 * prior)) - np.log((b + prior) / (n0 + 2 * prior))
    return np.where(a + b >= least, odds, 0.0)


def fewest(texts: list[list[str]], y: np.ndarray) -> int:
    """How many texts make a word known: of LEAST, the (smallest) one whose log-odds best tell apart texts left out, in FOLDS parts.

    A text counts as its window with the largest sum of log-odds above a half; what is compared is the chance that one with the label
    is above one without.
    """
    ids, words, sizes = lexicon(texts)
    of = np.repeat(np.arange(len(texts)), sizes)
    pair = np.unique(of * max(len(words), 1) + ids)
    text, word = np.divmod(pair, max(len(words), 1))
    owner, start, length = windows(sizes)
class Network:
    """Parameters and passes of the network; windows are columns, longest first, so that those still running are a prefix."""

    def __init__(self, rng: np.random.Generator):
        d, f32 = WORD + CHAR, np.float32
        glorot = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(f32)
        self.p = {}
        for side in "fb":
            self.p |= {f"wx{side}": glorot(d, 3 * HIDDEN), f"wh{side}": glorot(HIDDEN, 3 * HIDDEN), f"b{side}": np.zeros(3 * HIDDEN, f32)}
        self.p |= {"wa": glorot(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, f32), "va": glorot(ATTEND), "w": glorot(2 * HIDDEN), "w0": np.zeros((), f32)}

    def inputs(self, x: np.ndarray) -> list[np.ndarray]:
        """Gate inputs of both directions for each row of x, once for each distinct word."""
        return [x @ self.p[f"wx{s}"] + self.p[f"b{s}"] for s in "fb"]

    def run(self, gates: list[np.ndarray], ids: np.ndarray, lengths: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Logits of windows: ids is WINDOW x windows; kept gets what a backward pass needs."""
        p, h = self.p, HIDDEN
        most, count = int(lengths.max(initial=0)), len(lengths)
        states = np.zeros((max(most, 1), count, 2 * h), np.float32)
        active = np.searchsorted(-lengths, -np.arange(most), side="left")
        for side, at in (("f", 0), ("b", 1)):
            s = np.zeros((count, h), np.float32)
            wh, g = p[f"wh{side}"], gates[at]
            for t in range(most) if at == 0 else range(most - 1, -1, -1):
                a = active[t]
                x, prev = g[ids[t, :a]], s[:a]
                y = prev @ wh
                rz = 1 / (1 + np.exp(-(x[:, : 2 * h] + y[:, : 2 * h])))
                n = np.tanh(x[:, 2 * h :] + rz[:, :h] * y[:, 2 * h :])
                new = n + rz[:, h:] * (prev - n)
                if kept is not None:
                    kept[side, t] = (prev.copy(), y[:, 2 * h :], rz, n)
                s[:a] = new
                states[t, :a, at * h : at * h + h] = new
        u = np.tanh(states @ p["wa"] + p["ba"])
        e = u @ p["va"]
        e = np.where(np.arange(max(most, 1))[:, None] < np.maximum(lengths, 1), e, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        c = np.einsum("tb,tbd->bd", a, states)
        if kept is not None:
            kept |= {"states": states, "u": u, "a": a, "c": c, "active": active, "most": most}
        return c @ p["w"] + p["w0"]

    def back(self, dlogit: np.ndarray, ids: np.ndarray, x: np.ndarray, kept: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the rows of x."""
        p, h = self.p, HIDDEN
        states, u, a, c = kept["states"], kept["u"], kept["a"], kept["c"]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["w"], g["w0"] = c.T @ dlogit, dlogit.sum()
        dc = dlogit[:, None] * p["w"]
        da = np.einsum("bd,tbd->tb", dc, states)
        de = a * (da - (a * da).sum(axis=0))
        du = de[..., None] * p["va"] * (1 - u**2)
        g["va"], g["ba"] = np.einsum("tb,tbk->k", de, u), du.sum(axis=(0, 1))
        g["wa"] = np.einsum("tbd,tbk->dk", states, du)
        ds = a[..., None] * dc + du @ p["wa"].T
        dx = np.zeros_like(x)
        for side, at in (("f", 0), ("b", 1)):
            wh, wx = p[f"wh{side}"], p[f"wx{side}"]
            dh = np.zeros((len(dlogit), h), np.float32)
            pre, rows = [], []
            for t in range(kept["most"] - 1, -1, -1) if at == 0 else range(kept["most"]):
                k = kept["active"][t]
                prev, yn, rz, n = kept[side, t]
                d = dh[:k] + ds[t, :k, at * h : at * h + h]
                z, r = rz[:, h:], rz[:, :h]
                dn = d * (1 - z) * (1 - n**2)
                dz = d * (prev - n) * z * (1 - z)
                dr = dn * yn * r * (1 - r)
                dy = np.concatenate([dr, dz, dn * r], axis=1)
                g[f"wh{side}"] += prev.T @ dy
                dh[:k] = d * z + dy @ wh.T
                pre.append(np.concatenate([dr, dz, dn], axis=1))
                rows.append(ids[t, :k])
            if pre:
                all_pre, all_rows = np.concatenate(pre), np.concatenate(rows)
                order = np.argsort(all_rows, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(all_rows[order]) > 0])
                summed, at_rows = np.add.reduceat(all_pre[order], first), all_rows[order][first]
                g[f"b{side}"] = summed.sum(axis=0)
                g[f"wx{side}"] = x[at_rows].T @ summed
                dx[at_rows] += summed @ wx.T
        return g, dx


class Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.m, self.v = rate, 0, {}, {}

    def move(self, params: dict, grads: dict) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            params[k] = (params[k] - self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-7)).astype(np.float32)


def log_odds(a: np.ndarray, b: np.ndarray, n1: float, n0: float, least: int) -> np.ndarray:
    """Log-odds of the label for what ``a`` of n1 texts with it and ``b`` of n0 without it have; 0 for what fewer than ``least`` texts have.

    Each is taken to be in some more texts of both labels, the more the more texts are asked for.
    """
    prior = least**2 / 8
    odds = np.log((a + prior) / (n1 + 2 * prior)) - np.log((b + prior) / (n0 + 2 * prior))
    return np.where(a + b >= least, odds, 0.0)


def fewest(texts: list[list[str]], y: np.ndarray) -> int:
    """How many texts make a word known: of LEAST, the (smallest) one whose log-odds best tell apart texts left out, in FOLDS parts.

    A text counts as its window with the largest sum of log-odds above a half; what is compared is the chance that one with the label
    is above one without.
    """
    ids, words, sizes = lexicon(texts)
    of = np.repeat(np.arange(len(texts)), sizes)
    pair = np.unique(of * max(len(words), 1) + ids)
    text, word = np.divmod(pair, max(len(words), 1))
    owner, start, length = windows(sizes)
    best = (-1.0, LEAST[0])
    for least in LEAST:
        top = np.zeros(len(texts))
        for k in range(FOLDS):
            left = np.arange(len(texts)) % FOLDS == k
            known = ~left[text]
            a, b = (np.bincount(word[known & (y[text] == x)], minlength=len(words)) for x in (1, 0))
            odds = log_odds(a, b, float(y[~left].sum()), float((1 - y[~left]).sum()), least)
            x = np.concatenate([[0.0], np.cumsum(np.maximum(odds - 0.5, 0)[ids])]) if len(ids) else np.zeros(1)
            here = left[owner]
            np.maximum.at(top, owner[here], (x[start + length] - x[start])[here])
        ones, zeros = np.sort(top[y == 1]), np.sort(top[y == 0])
        above = (np.searchsorted(zeros, ones, "left") + np.searchsorted(zeros, ones, "right")).sum() / (2 * len(ones) * len(zeros))
        best = max(best, (float(above), -least), key=lambda z: (z[0], z[1])) if best[0] >= 0 else (float(above), -least)
    return -best[1]


class Model:
    """Word vectors for words that enough sample texts have (see ``fewest``), vectors for character n-grams, the network, and a calibration.

    A text's score is that of its highest window. Training repeats: score all windows of the sample, then fit the highest
    window of each text, and one more of each clean text, to the text's label.
    """

    def __init__(self, sample: list[tuple[str, int]], shares: dict[int, float], epochs: int = 6, rate: float = 1e-2):
        y = np.array([k for _, k in sample], np.float32)
        self.constant = None if 0 < y.sum() < len(y) else float(y.mean()) if len(y) else 0.0
        if self.constant is not None:
            return
        texts = [tokens(text) for text, _ in sample]
        # A first network, without every fifth text of each label, serves the calibration on these; the one that scores learns from all.
        nth = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
        left = nth % 5 == 0
        everything = np.ones(len(y), bool)
        for fit, rows in ((~left, left), (everything, everything)):
            if fit is everything or 0 < y[left].sum() < left.sum():
                rng = np.random.default_rng(11)
                self.start(texts, y, fit, rng)
                self.train(texts, y, fit, rng, epochs, rate)
                if not hasattr(self, "slope"):
                    self.calibrate(self.highest(texts), y, shares, rows)

    def start(self, texts: list[list[str]], y: np.ndarray, fit: np.ndarray, rng: np.random.Generator) -> None:
        """Vocabulary and vectors; the first dimension begins as the log-odds of the label among fitted texts that have the word or n-gram."""
        seen = (Counter(), Counter())
        of_gram = np.zeros((2, BUCKETS))
        for k, words in enumerate(texts):
            if fit[k]:
                own = list(set(words))
                seen[int(y[k])].update(own)
                of_gram[int(y[k]), np.unique(grams(own)[0])] += 1
        n1, n0 = float(y[fit].sum()), float((1 - y[fit]).sum())
        chosen = np.flatnonzero(fit)
        least = fewest([texts[k] for k in chosen], y[chosen])
        odds = lambda a, b: log_odds(np.asarray(a, float), np.asarray(b, float), n1, n0, least)
        vocabulary = sorted(w for w in {*seen[0], *seen[1]} if seen[0][w] + seen[1][w] >= least)
        self.at = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.words = rng.normal(0, 0.1, (len(vocabulary) + 1, WORD)).astype(np.float32)
        self.words[:, 0] = [0.0, *(odds([seen[1][w] for w in vocabulary], [seen[0][w] for w in vocabulary]) / 2)]
        self.chars = rng.normal(0, 0.1, (BUCKETS, CHAR)).astype(np.float32)
        self.chars[:, 0] = odds(of_gram[1], of_gram[0]) / 2
        self.net = Network(rng)

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of distinct words, and for the backward pass their vocabulary rows, the n-grams' buckets and owners."""
        rows = np.array([self.at.get(w, 0) for w in words], np.int64)
        flat, owner = grams(words)
        count = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        mean = np.stack([np.bincount(owner, self.chars[flat, d], len(words)) / count for d in range(CHAR)], axis=1) if words else np.zeros((0, CHAR))
        return np.concatenate([self.words[rows], mean], axis=1).astype(np.float32), rows, flat, owner

    def lay(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of windows by length, and their ids as WINDOW x windows."""
        order = np.argsort(-length, kind="stable")
        grid = start[order] + np.minimum(np.arange(WINDOW)[:, None], np.maximum(length[order] - 1, 0))
        return order, ids[np.minimum(grid, max(len(ids) - 1, 0))] if len(ids) else np.zeros(grid.shape, np.int64)

    def logits(self, ids: np.ndarray, words: list[str], sizes: np.ndarray, part: int = 2000) -> tuple[np.ndarray, ...]:
        """Logit, text, start and length of every window."""
        gates = self.net.inputs(self.table(words)[0]) if words else [np.zeros((1, 3 * HIDDEN), np.float32)] * 2
        owner, start, length = windows(sizes)
        out = np.zeros(len(owner), np.float32)
        by_length = np.argsort(-length, kind="stable")
        for a in range(0, len(owner), part):
            k = by_length[a : a + part]
            order, grid = self.lay(ids, start[k], length[k])
            out[k[order]] = self.net.run(gates, grid, length[k][order])
        return out, owner, start, length

    def highest(self, texts: list[list[str]]) -> np.ndarray:
        logit, owner, _, _ = self.logits(*lexicon(texts))
        out = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(out, owner, logit)
        return out

    def train(self, texts: list[list[str]], y: np.ndarray, fit: np.ndarray, rng: np.random.Generator, epochs: int, rate: float) -> None:
        chosen = np.flatnonzero(fit)
        texts, y = [texts[k] for k in chosen], y[chosen]
        ids, vocabulary, sizes = lexicon(texts)
        adam = Adam(rate)
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
        for epoch in range(epochs):
            logit, owner, start, length = self.logits(ids, vocabulary, sizes) if epoch else (None, *windows(sizes))
            if epoch == 0:  # before any training, by the words' log-odds
                x = np.concatenate([[0.0], np.cumsum(np.maximum(self.words[[self.at.get(w, 0) for w in vocabulary], 0] - 0.5, 0)[ids])]) if len(ids) else np.zeros(1)
                logit = x[start + length] - x[start]
            by = np.lexsort((-logit, owner))
            top = by[np.r_[True, np.diff(owner[by]) > 0]]
            clean = np.flatnonzero(y[owner] == 0)
            picked = np.concatenate([top, rng.choice(clean, min(len(clean), len(texts)), replace=False)])
            rng.shuffle(picked)
            for a in range(0, len(picked), 128):
                k = picked[a : a + 128]
                order, grid = self.lay(ids, start[k], length[k])
                k = k[order]
                used, local = np.unique(grid, return_inverse=True)
                local = local.reshape(grid.shape)
                x, rows, flat, of = self.table([vocabulary[j] for j in used] if vocabulary else [])
                if not len(x):
                    x = np.zeros((1, WORD + CHAR), np.float32)
                kept: dict = {}
                z = self.net.run(self.net.inputs(x), local, length[k], kept)
                d = ((sigmoid(z) - y[owner[k]]) * weight[owner[k]] / len(k)).astype(np.float32)
                grads, dx = self.net.back(d, local, x, kept)
                adam.move(self.net.p, grads)
                if len(rows):
                    step = 20 * rate
                    np.subtract.at(self.words, rows, step * dx[:, :WORD] * (rows > 0)[:, None])
                    np.subtract.at(self.chars, flat, step * (dx[:, WORD:] / np.maximum(np.bincount(of, minlength=len(rows)), 1)[:, None])[of])

    def calibrate(self, z: np.ndarray, y: np.ndarray, shares: dict[int, float], rows: np.ndarray) -> None:
        """Slope and offset that fit the highest logits to the labels, weighted to the classes' shares among all labels."""
        z, y = z[rows].astype(float), y[rows]
        weight = np.where(y == 1, 1 / shares[1], 1 / shares[0])
        self.slope, self.offset = 1.0, 0.0
        for _ in range(50):
            q = sigmoid(self.slope * z + self.offset)
            g, c = weight * (q - y), weight * q * (1 - q)
            grad = np.array([(g * z).sum() + 0.1 * (self.slope - 1), g.sum()])
            hess = np.array([[(c * z * z).sum() + 0.1, (c * z).sum()], [(c * z).sum(), c.sum() + 1e-3]])
            step = np.clip(np.linalg.solve(hess, grad), -1, 1)
            self.slope, self.offset = max(0.05, self.slope - step[0]), self.offset - step[1]

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return sigmoid(self.slope * self.highest([tokens(x) for x in texts]).astype(float) + self.offset)


def learn(docs: DataFrame, labels: DataFrame, rows: int = 1000, of: int = 4, left_out: int = 2) -> Model:
    """A model from at most ``rows`` labelled documents of each class, outside the fold left out."""
    return Model(*labelled_sample(docs, labels, "toxic", rows, of, left_out))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) for every row of ``docs`` (doc_id, text): that of the highest of all overlapping windows.

    Null texts score as empty ones do, repeated rows alike, null ids stay, an empty table gives no rows, other columns are
    not read. A model fitted on one class only gives that class's label, without labels 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's size
    return map_rows(docs, ["doc_id"], ["text"], "score double", lambda texts: (sent.value.scores([x or "" for x in texts]),), 400)


def keep_clean(docs: DataFrame, model: Model, most: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``most``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return decided(docs, "score double", lambda texts: (sent.value.scores([x or "" for x in texts]),), lambda x: x < most)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; learns from labels outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
