"""Language identification by cross-parsing with suffix automata."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import fold, map_rows, table

LETTER = re.compile(r"[^\W\d_]")
#: Texts are parsed in stretches of this many characters, side by side; a phrase ends at the end of a stretch.
STRETCH = 1024
MORE = 28  # bits below those that count phrases in an entry of a transition table
#: Characters of a language that have columns in its table; edges by the others, however many, are looked up in a sorted list.
DENSE = 63


def normalise(text: str) -> str:
    """Lower case; every run of what is not a letter becomes one space."""
    return " ".join(re.sub(r"[\W\d_]+", " ", text.lower()).split())


def automaton(text: str, codes: dict[str, int]) -> list[dict[int, int]]:
    """The suffix automaton of a text: for each state, the next state by code; the root is state 0."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        c = codes[ch]
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """One language's automaton. Its commonest DENSE characters have columns of a table that both moves and counts; edges by its other characters are looked up.

    ``page`` gives each character of all languages its code here: 0 if this language's text lacks it, 1 to ``width`` - 1 for
    columns, higher for the others. A state is the beginning of its row; a table's entry is the next state and, above
    MORE bits, the phrases that end. Where a match can't go on, its phrase ends and the next begins with this
    character, which is a phrase of its own if the language's text lacks it.
    """

    def __init__(self, text: str, letters: dict[str, int]):
        common = sorted(Counter(text).items(), key=lambda x: (-x[1], x[0]))
        own = {ch: k + 1 for k, (ch, _) in enumerate(common)}
        self.width = min(DENSE, len(own)) + 1
        self.page = np.zeros(len(letters) + 1, np.int32)
        for ch, k in own.items():
            self.page[letters[ch]] = k
        states = automaton(text, own)
        at, code, to = (np.array(x, np.int64) for x in zip(*((s, c, t) for s, moves in enumerate(states) for c, t in moves.items()), strict=True)) if len(states) > 1 else (np.zeros(0, np.int64),) * 3
        assert len(states) * self.width < 1 << MORE  # a sample's length is bounded
        dense = code < self.width
        moves = np.zeros((len(states), self.width), np.int64)
        moves[at[dense], code[dense]] = to[dense] * self.width
        start = np.where(moves[0] > 0, moves[0], 1 << MORE)
        out = np.where(moves > 0, moves, start + (1 << MORE))
        out[0] = start
        self.table = out.astype(np.int32).ravel()
        self.span = len(own) + 1
        key = at[~dense] * self.span + code[~dense]
        order = np.argsort(key)
        self.edges, self.targets = key[order], (to[~dense][order] * self.width).astype(np.int32)
        self.first = np.zeros(self.span, np.int32)  # the root's moves by the characters without columns
        self.first[code[~dense & (at == 0)]] = to[~dense & (at == 0)] * self.width

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the phrases that end."""
        v = self.table[state + np.where(code < self.width, code, 0)]
        after, ended = v & ((1 << MORE) - 1), v >> MORE
        if len(self.edges):
            k = np.flatnonzero(code >= self.width)
            if len(k):
                key = state[k].astype(np.int64) // self.width * self.span + code[k]
                at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                goes = self.edges[at] == key
                after[k] = np.where(goes, self.targets[at], self.first[code[k]])
                ended[k] = ~goes & (state[k] > 0)
        return after, ended


def phrases(parsers: list[Parser], texts: list[np.ndarray]) -> np.ndarray:
    """Texts (arrays of characters' codes) x parsers: numbers of phrases."""
    owner, parts = [], []
    for k, x in enumerate(texts):
        for a in range(0, len(x), STRETCH):
            owner.append(k)
            parts.append(x[a : a + STRETCH])
    out = np.zeros((len(texts), len(parsers)), np.int64)
    if not parts:
        return out
    sizes = np.array([len(x) for x in parts])
    order = np.argsort(-sizes, kind="stable")
    owner, sizes = np.array(owner)[order], sizes[order]
    grid = np.zeros((sizes[0], len(parts)), np.int32)
    for j, k in enumerate(order):
        grid[: len(parts[k]), j] = parts[k]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # stretches longer than t
    for i, parser in enumerate(parsers):
        state, count = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int32)
        own = parser.page[grid]
        plain = own.max() < parser.width
        for t in range(sizes[0]):
            a = active[t]
            if plain:
                v = parser.table[state[:a] + own[t, :a]]
                count[:a] += v >> MORE
                state[:a] = v & ((1 << MORE) - 1)
            else:
                state[:a], ended = parser.step(state[:a], own[t, :a])
                count[:a] += ended
        np.add.at(out[:, i], owner, count + (state > 0))
    return out


class Model:
    """Parsers by language; every character of the samples has a code of its own."""

    def __init__(self, samples: dict[str, str]):
        self.letters = {ch: k + 1 for k, ch in enumerate(sorted({ch for text in samples.values() for ch in text}))}
        self.langs = sorted(samples)
        self.parsers = [Parser(samples[x], self.letters) for x in self.langs]
        self.bits = np.array([math.log2(len(samples[x]) + 1) for x in self.langs])
        self.points = np.array([ord(ch) for ch in self.letters], np.uint32)  # sorted, as the codes are

    def encode(self, text: str) -> np.ndarray:
        """Codes of a text's characters, 0 for those that no sample has."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(self.points) or not len(points):
            return np.zeros(len(points), np.int32)
        if not hasattr(self, "_direct"):  # built where it is used: not sent
            self._direct = np.zeros(0x110000, np.int32)
            self._direct[self.points] = np.arange(1, len(self.points) + 1)
        return self._direct[points]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_direct"}

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the share of exp(-8 x bits a character) that the language with the fewest bits has."""
        plain = [normalise(x) if isinstance(x, str) and LETTER.search(x) else "" for x in texts]
        n = np.array([max(len(x), 1) for x in plain], float)
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, score
        cost = phrases(self.parsers, [self.encode(x) for x in plain]) * self.bits / n[:, None]
        share = np.exp(-8 * (cost - cost.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = cost.argmin(axis=1)
        for k, x in enumerate(plain):
            if x:
                langs[k], score[k] = self.langs[best[k]], share[k, best[k]]
        return langs, score


def learn(labelled: DataFrame, chars: int = 60_000, rows: int = 400) -> Model:
    """A model from rows (text, lang) without nulls. Fits on a bounded sample: about ``rows`` texts of each language, drawn by a
    hash of the text, until ``chars`` characters are reached; of a text that is longer than what is left, a stretch
    from a place that its hash says. Equal texts of a language count once, in the rate of the draw too, so that copies of one text,
    however many, neither come to the driver nor use up the draw. Languages are taken to be some hundreds at most: each costs
    its sample on the driver and some tens of MB in every worker.
    """
    h = F.xxhash64("text")
    kept = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in kept.select("lang", h.alias("h")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model({})
    few = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, rows / n)))])
    begin = F.pmod(F.xxhash64(F.lit("from"), "text"), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    drawn = kept.filter(F.pmod(h, F.lit(1 << 20)) < few[F.col("lang")] * (1 << 20)).select("lang", F.substr("text", begin, F.lit(chars)).alias("text"), h.alias("h")).dropDuplicates(["lang", "h"])
    samples: dict[str, str] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["h"], r["text"])):
        if len(had := samples.get(r["lang"], "")) < chars and (plain := normalise(r["text"])):
            samples[r["lang"]] = (f"{had} {plain}" if had else plain)[:chars]
    return Model(samples)


def identify(docs: DataFrame, model: Model, batch: int = 1000) -> DataFrame:
    """``docs`` (doc_id, text) with ``lang_pred`` and ``score``. Null texts and texts without a letter get und and 0; others the
    language that parses the whole text, in stretches of STRETCH characters, into the fewest phrases, each counted as the bits of a position in that language's
    text, so that texts of unlike length compare. Ties go to the language that sorts first. Repeated rows get the same
    answer, an empty table gives no rows, other columns are not read; without any language learnt, all get und.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's size

    return map_rows(docs, ["doc_id"], ["text"], "lang_pred string, score double", lambda texts: sent.value.predict(texts), batch)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learns from those outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(fold(F.col("doc_id"), 4) != 2).select("text", "lang"))
    out = identify(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
