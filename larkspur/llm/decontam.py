"""Benchmark decontamination: pigeonhole pieces and Myers' bit-parallel edit distance."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Workspace, decided, map_rows, table

#: Edits allowed for each character of a test item.
RATE = 0.1
#: Characters of test items that are matched in one pass over the documents; a larger benchmark takes more passes.
BLOCK_CHARS = 2_000_000


def normalise(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """Bounds of budget + 1 pieces: whatever ``budget`` edits touch, one piece at least stays whole."""
    return [(length * k // (budget + 1), length * (k + 1) // (budget + 1)) for k in range(budget + 1)]


class Pattern:
    """A stretch of a test item: where it begins in the item, its edit budget and, by character, the bits of its places."""

    def __init__(self, text: str, offset: int, budget: int):
        self.offset, self.length, self.budget = offset, len(text), budget
        self.places: dict[str, int] = defaultdict(int)
        for k, ch in enumerate(text):
            self.places[ch] |= 1 << k

    def search(self, text: str) -> tuple[int, int]:
        """The least edit distance of the stretch to any substring of ``text``, and where the first such substring ends."""
        mask, top = (1 << self.length) - 1, 1 << (self.length - 1)
        plus, minus, score = mask, 0, self.length
        best, end = score, 0
        get = self.places.get
        for k, ch in enumerate(text):
            eq = get(ch, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (mask & ~(xh | plus))
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, k + 1
                    if not best:
                        break
            ph <<= 1
            plus = (mh << 1 | ~(xv | ph)) & mask
            minus = ph & xv & mask
        return best, end

    def near(self, text: str, start: int) -> bool:
        """Whether it is within its budget of some substring around where an item that starts at ``start`` has it."""
        a = max(0, start + self.offset - self.budget)
        return self.search(text[a : max(0, start + self.offset + self.length + self.budget)])[0] <= self.budget


class Item(Pattern):
    """A whole test item, its pieces, and above each piece the growing stretches that hold it, smallest first.

    A stretch of n pieces has a budget of n - 1 edits. If it is within that, so is one of its halves within its own; so an
    item within budget has a whole piece all of whose stretches are within theirs, and a hit whose small stretches are
    not is given up early without losing an item.
    """

    def __init__(self, item_id: int, text: str, rate: float):
        super().__init__(text, 0, math.floor(rate * len(text)))
        self.item_id, self.text = item_id, text
        self.pieces = pieces(len(text), self.budget)
        self.above: list[list[Pattern]] = [[] for _ in self.pieces]
        self._split(0, len(self.pieces))

    def _split(self, a: int, b: int) -> None:
        if b - a > 1:
            mid = (a + b) // 2
            self._split(a, mid)
            self._split(mid, b)
            if b - a < len(self.pieces):
                start, end = self.pieces[a][0], self.pieces[b - 1][1]
                stretch = Pattern(self.text[start:end], start, b - a - 1)
                for k in range(a, b):
                    self.above[k].append(stretch)


class Matcher:
    """Finds test items in texts. Items without words are never found; those too short for an edit are found as whole words only, not inside others."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [Item(k, plain, rate) for k, text in items if (plain := normalise(text))]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, item in enumerate(self.items):
            for k, (a, b) in enumerate(item.pieces):
                where[item.text[a:b]].append((n, k))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def find(self, raw: str | None) -> list[dict]:
        """Items within their budget of some substring of the text, with the least distance and the substring's end in the normalised text."""
        text = normalise(raw)
        if not text or not self.items:
            return []
        hits: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for end, (size, at) in self.automaton.iter(text):
            for n, k in at:
                hits[n].add((end + 1 - size - self.items[n].pieces[k][0], k))
        out = []
        for n in sorted(hits):
            item = self.items[n]
            best = (item.budget + 1, 0)
            starts = sorted({s for s, _ in hits[n]})
            if not item.budget:
                whole = lambda k: not 0 <= k < len(text) or text[k] == " "
                starts = [s for s in starts if whole(s - 1) and whole(s + item.length)]
                hits[n] = {(s, 0) for s in starts}
            exact = next((s for s in starts if s >= 0 and text.startswith(item.text, s)), None)
            if exact is not None:
                best = (0, exact + item.length)
            else:
                # An occurrence around a whole piece starts at most ``budget`` places from where the piece puts it; stretches of text that overlap are searched as one.
                reach: list[list[int]] = []
                for s in sorted({s for s, k in hits[n] if all(p.near(text, s) for p in item.above[k])}):
                    a, b = max(0, s - item.budget), min(len(text), s + item.length + item.budget)
                    if reach and a <= reach[-1][1]:
                        reach[-1][1] = max(reach[-1][1], b)
                    else:
                        reach.append([a, b])
                for a, b in reach:
                    distance, end = item.search(text[a:b])
                    best = min(best, (distance, a + end))
            if best[0] <= item.budget:
                out.append({"item_id": item.item_id, "distance": best[0], "budget": item.budget, "end_at": best[1]})
        return out


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows (item_id, text) in blocks of about ``chars`` characters, dealt by a hash, one at a time; null texts are left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / chars))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield sorted(((r["item_id"], r["text"]) for r in dealt.filter(F.col("block") == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def passes(benchmark: DataFrame, chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """Each block, sent to the executors, and whether more follow; a block is let go when the next one is asked for, so the driver holds two at most."""
    rest = blocks(benchmark, chars)
    block = next(rest)
    while block is not None:
        after = next(rest, None)
        sent = benchmark.sparkSession.sparkContext.broadcast(block)  # bounded by the block's characters
        yield sent, after is not None
        if after is not None:
            sent.destroy()
        block = after


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance``, ``budget`` and ``end_at`` for every document and test item found in it.

    An item is found where a substring of the whole normalised text is within floor(rate x length) edits of it; with no edit
    to spare it must stand between spaces. Its budget + 1 pieces are looked up by one automaton for all items; Myers'
    algorithm verifies around each hit. Ties between places go to the first. Null and empty texts and items match
    nothing, repeated rows match alike, very long texts are read whole, null ids stay, empty tables give no rows, other columns
    are not read. Documents are not shuffled; the benchmark is broadcast in blocks of about ``chars`` characters, a pass over
    the documents each, whose hits are written before the next.
    """
    work, parts = Workspace(docs.sparkSession, "leaks"), []
    kind = "array<struct<item_id:bigint,distance:int,budget:int,end_at:bigint>>"
    for sent, more in passes(benchmark, chars):
        made = _found(sent, rate)
        hits = map_rows(docs, ["doc_id"], ["text"], f"hits {kind}", lambda texts, made=made: ([made().find(x) for x in texts],))
        found = hits.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
        parts.append(work.write(found, f"hits-{len(parts)}") if more else found)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _found(sent: Broadcast, rate: float):
    """A function that builds the block's matcher once for each task."""
    held: list[Matcher] = []

    def matcher() -> Matcher:
        if not held:
            held.append(Matcher(sent.value, rate))
        return held[0]

    return matcher


def drop_leaked(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no test item is found; see ``find_leaks``."""
    work, k = Workspace(docs.sparkSession, "clean"), 0
    for sent, more in passes(benchmark, chars):
        made = _found(sent, rate)
        docs = decided(docs, "leaks int", lambda texts, made=made: ([len(made().find(x)) for x in texts],), lambda x: x == 0)
        if more:
            docs = work.write(docs, f"kept-{k}")
            work.drop(f"kept-{k - 1}")
            k += 1
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``find_leaks`` of all documents and benchmark items."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
