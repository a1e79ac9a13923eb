"""Language-model scores by Katz backoff: Good-Turing discounted counts of n-grams, exactly normalised, order by order.

Texts become chunks: about a million tokens as numbers of a dictionary of the chunk's own. For each order, a chunk sends each
of its distinct n-grams once, with what makes up the probability that the order below gives its last word, to the partition
that holds all n-grams of that history; the partition counts them, and gives counts, what the history's weight takes and, from
triples on, the n-grams' own numbers back in the same order. The numbers are the histories of the next order, so that order
n + 1 lies in the partitions of order n; triples, whose histories are named by their two words, are dealt by the second one. From
the answers and the order's discounts, which the driver works out from the sums over all partitions, a chunk
evaluates the recursion for each of its n-grams: the discounted share where it was seen, else the history's backoff weight
times what the order below gives.

What is shuffled is a few bytes for each distinct n-gram of a chunk, so it grows with the input; a frequent n-gram counts
once a chunk; and neither side holds more than a chunk or a partition. The n-grams of a history with more than half a
partition's tokens are spread by their last word over as many partitions as it would fill twice, and its sums are added up.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Workspace, table

ORDER = 3
#: Tokens of a chunk, and tokens for each partition of the counts.
CHUNK, SHARE = 1_200_000, 1_000_000
#: Histories spread at most, so that their sums stay few; one has more than this part of all tokens.
SPREAD = 65_536
#: Counts up to this one are discounted.
KATZ = 5
#: A number is a partition and, in its lower bits, a place in it.
PLACE = np.uint64(24)
BEGIN = np.uint64(1 << 63)
#: The rank of what stands before a text; words have lower ones.
NONE = np.uint64((1 << 32) - 1)
FOLDS, HELD = 10, 0
#: Texts that are Python strings at once.
FEW = 500


def pack(a: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed."""
    if not len(a):
        return b""
    whole = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
    planes = np.empty((a.itemsize, len(a)), np.uint8)
    for k in range(a.itemsize):  # a plane at a time takes a tenth of the time of a transposed copy
        planes[k] = whole[:, k]
    return zstandard.compress(planes, 3)


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    whole = np.empty((planes.shape[1], size), np.uint8)
    for k in range(size):
        whole[:, k] = planes[k]
    return whole.reshape(-1).view(kind)


def pack_steps(a: np.ndarray) -> bytes:
    """Whole numbers that mostly rise, as steps."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_steps(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def pack_runs(a: np.ndarray) -> bytes:
    """Values as runs of equal ones where these are long, else as steps where they mostly rise, else as they are."""
    first = firsts(a)
    if 2 * len(first) <= len(a):
        sizes = pack(np.diff(first, append=len(a)).astype(np.uint32))
        return b"r" + len(sizes).to_bytes(4, "little") + sizes + pack_runs(a[first])
    if a.dtype.kind == "u" and 10 * np.count_nonzero(a[1:] < a[:-1]) <= len(a):
        return b"s" + pack_steps(a)
    return b"p" + pack(a)


def unpack_runs(data: bytes, kind: type) -> np.ndarray:
    if data[:1] == b"r":
        end = 5 + int.from_bytes(data[1:5], "little")
        return np.repeat(unpack_runs(data[end:], kind), unpack(data[5:end], np.uint32))
    return (unpack_steps if data[:1] == b"s" else unpack)(data[1:], kind)


def pack_histories(a: np.ndarray) -> bytes:
    """The upper and the lower halves, each by itself."""
    upper = pack_runs((a >> np.uint64(32)).astype(np.uint32))
    return len(upper).to_bytes(4, "little") + upper + pack_runs(a.astype(np.uint32))


def unpack_histories(data: bytes, kind: type) -> np.ndarray:
    end = 4 + int.from_bytes(data[:4], "little")
    return unpack_runs(data[4:end], np.uint32).astype(kind) << kind(32) | unpack_runs(data[end:], np.uint32)


def give_back() -> None:
    """Freed memory goes back to the system, where its allocators can do that: a worker stays, beside its executor's JVM, for the steps to come."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def good_turing(n: list[int]) -> np.ndarray | None:
    """Katz's Good-Turing factors of counts 1 to KATZ from smoothed numbers of types with counts 1 to KATZ + 1.

    Simple Good-Turing: each number is averaged over the empty counts beside it, and log Z is fitted as linear in log r, weighted
    by Z, the inverse variance of its logarithm. So a bump, as groups of copies make one, cannot push a factor out of
    (0, 1): below a slope of -1 all are inside. None without such a fit: fewer than two numbers, or a flatter slope.
    """
    r = np.flatnonzero(n) + 1.0
    if len(r) < 2:
        return None
    before = np.r_[0.0, r[:-1]]
    after = np.r_[r[1:], 2 * r[-1] - before[-1]]
    z = 2 * np.array(n, float)[r.astype(np.int64) - 1] / (after - before)
    slope = np.polyfit(np.log(r), np.log(z), 1, w=np.sqrt(z))[0]
    if slope >= -1:
        return None
    common = (KATZ + 1) ** (slope + 1)
    return ((1 + 1 / np.arange(1, KATZ + 1)) ** (slope + 1) - common) / (1 - common)


def discounts(n: list[int]) -> np.ndarray:
    """Discount factors of counts 0 to KATZ from the numbers of types with counts 1 to KATZ + 1.

    Good-Turing's, rescaled so that counts above KATZ stay; only where their numbers do not fall with the count (see
    ``good_turing``), as on a handful of texts, one part n1 / (n1 + 2 n2) of a count is taken off each instead.
    """
    d = good_turing(n)
    if d is not None:
        return np.array([0.0, *d])
    part = min(0.9, n[0] / (n[0] + 2 * n[1])) if n[0] + n[1] else 0.5
    return np.array([0.0, *((r - max(part, 0.1)) / r for r in range(1, KATZ + 1))])


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= KATZ, d[np.minimum(c, KATZ).astype(np.int64)], 1.0) * c


class Words:
    """Probabilities of single tokens: discounted counts, the rest for the one event of an unknown word."""

    def __init__(self, total: int, types: int, n: list[int]):
        self.total, self.types, self.d = total, types, discounts(n)
        left = sum(r * n[r - 1] * (1 - self.d[r]) for r in range(1, KATZ + 1)) / total if total else 1.0
        self.unknown = max(left, 1 / (total + 1))
        #: The probability of a seen word over its discounted count.
        self.share = (1 - self.unknown) / (1 - left) / max(self.total, 1) if left < 1 else 0.0

    def probability(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.float64)
        return np.where(c > 0, self.share * discounted(c, self.d), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.types + 1)))


class Grams:
    """What the driver knows of an order above the first: its discounts, and the sums of histories that are spread."""

    def __init__(self, n: list[int], spread: dict[int, tuple[np.ndarray, float]]):
        self.d, self.spread = discounts(n), spread

    def weights(self, sums: np.ndarray, few: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each history what a seen n-gram has for its discounted count, and the backoff weight, by which one not seen has the
        lower order's probability.

        The weight is what discounting leaves of the history's ``sums``, over ``free``: the lower order's probability of all
        words not seen after the history (the unknown word is never seen, so that is above 0). So a history's
        probabilities add up to 1. One from which nothing is discounted leaves 1 / (sum + 1); one never seen leaves all.
        """
        total = np.maximum(sums, 1)
        left = (np.arange(1, KATZ + 1)[:, None] * few * (1 - self.d[1:, None])).sum(axis=0) / total
        kept = np.where(sums > 0, np.maximum(left, 1 / (total + 1)), 1.0)
        return (1 - kept) / np.maximum(1 - left, 1e-300) / total, kept / np.maximum(np.where(sums > 0, free, 1.0), 1e-300)


CHUNK_ROWS = "kind string, chunk long, ids array<bigint>, lens binary, held binary, tokens binary, place binary, word binary, n binary, size long, learnt long"


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents to two rows a chunk: its texts, and its words in order of hash with how often its training texts have them.

    A text's tokens are its words and one end, the empty word, which is number 0; ``place`` is each number's place among the words.
    """
    part, nth = TaskContext.get().partitionId(), 0
    ids: list = []
    texts: list[np.ndarray] = []
    held: list[bool] = []
    number: dict[bytes, int] = {b"": 0}
    size = 0
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6, pa.int64(), pa.int64())
    names = ["kind", "chunk", "ids", "lens", "held", "tokens", "place", "word", "n", "size", "learnt"]

    def rows() -> pa.RecordBatch:
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        order = np.argsort(words)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        tokens, lens = np.concatenate(texts), np.array([len(t) for t in texts], np.uint32)
        n = np.bincount(tokens, np.repeat(~np.array(held), lens), len(number)).astype(np.uint32)
        cells = [
            ["texts", "words"], [part << 32 | nth] * 2, [ids, None], [pack(lens), None], [pack(np.array(held, np.uint8)), None], [pack(tokens), None], [pack(place), None],
            [None, pack_steps(words[order])], [None, pack(n[order])], [size, 0], [held.count(False), 0],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=names)

    def docs() -> Iterator[tuple]:
        for batch in batches:
            for k in range(0, batch.num_rows, FEW):
                few = batch.slice(k, FEW)
                yield from zip(few.column("doc_id").to_pylist(), few.column("text").to_pylist(), strict=True)

    for doc_id, text in docs():
        own = [number.setdefault(w, len(number)) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
        own.append(0)
        ids.append(doc_id)
        texts.append(np.array(own, np.uint32))
        held.append(doc_id is None or crc32(str(doc_id).encode()) % FOLDS == HELD)
        size += len(own)
        if size >= CHUNK:
            yield rows()
            nth, size, ids, texts, held, number = nth + 1, 0, [], [], [], {b"": 0}
            give_back()
    if ids:
        yield rows()
        ids, texts, held, number = [], [], [], {}
        give_back()


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where columns begin new values."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def histories(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ones in order, where each is first, and which one each entry has."""
    if (h[1:] >= h[:-1]).all():
        first = firsts(h)
        return h[first], first, np.repeat(np.arange(len(first)), np.diff(first, append=len(h)))
    return np.unique(h, return_index=True, return_inverse=True)


def spans(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each partition's stretch of entries in order of partition."""
    ends = [*firsts(part), len(part)]
    for a, b in zip(ends, ends[1:], strict=False):
        yield int(part[a]), slice(a, b)


def by_part(part: np.ndarray) -> np.ndarray:
    """The order by partition that keeps the order within; numbers of two bytes are sorted by radix."""
    return np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")


def ranks(order: np.ndarray) -> np.ndarray:
    """Where each entry stands in an order."""
    at = np.empty(len(order), np.int32)
    at[order] = np.arange(len(order), dtype=np.int32)
    return at


class Chunk:
    """One chunk's tokens, and its n-grams of the order reached. ``p`` is each token's probability by that order.

    What numbers tokens, words and n-grams within the chunk has 32 bits, and each array goes with its last reader: workers
    share an executor's memory with its JVM.
    """

    def __init__(self, r: dict, parts: int):
        self.parts, self.ids, self.lens = parts, r["ids"], unpack(r["lens"], np.uint32).astype(np.int64)
        self.held, self.packed = unpack(r["held"], np.uint8), (r["tokens"], r["place"])
        self.starts = np.cumsum(self.lens) - self.lens
        self.learnt = np.repeat(self.held == 0, self.lens)

    def learn_words(self, got: dict[int, dict], words: Words, begins: int) -> None:
        """From here on, words are numbered in the order of their global ranks, about the commonest first; after them comes what stands before a text."""
        places, numbers, counts = [], [], []
        for p in sorted(got):  # the partitions are ranges of the hash, so together they are all words in its order
            place = unpack(got[p]["place"], np.uint32)
            places.append(place * np.uint64(self.parts) + np.uint64(p))
            numbers.append(place | np.uint64(p) << PLACE)
            counts.append(unpack(got[p]["count"], np.uint64).astype(np.int64))
        rank, number, count = np.concatenate(places), np.concatenate(numbers), np.concatenate(counts)
        if rank.max() >= NONE:
            raise OverflowError("triples are named by ranks of words, which have 32 bits")
        order = np.argsort(rank)
        tokens, place = (unpack(x, np.uint32) for x in self.packed)
        self.w = ranks(order)[place][tokens]
        self.word_rank, self.word_number = np.append(rank[order], NONE), np.append(number[order], BEGIN)
        count = count[order]
        self.p = words.probability(count).astype(np.float32)[self.w]
        self.known = np.add.reduceat((count > 0)[self.w].astype(np.int64), self.starts)
        self.base = np.add.reduceat(words.base(count)[self.w], self.starts)
        self.number, self.count = self.word_number, np.append(count, begins)
        self.word_count, self.share = self.count, np.full(len(count), words.share, np.float32)
        self.gram = self.w

    def grams(self, order: int, limit: int) -> None:
        """Distinct n-grams of the next order, by partition, history and word: a token after the n-gram of the order reached that ends before it.

        Pairs are in order of word and history instead, so what goes with a word is one run in a message. Triples are dealt by their
        middle word (with more than ``limit`` tokens, by the first one too) and are in order of middle, last and first word: what goes
        with the last two is one run for a chunk, however many partitions there are.
        A text's first token follows what stands before all texts; tokens with fewer tokens before them than ``order`` asks for
        have no n-gram.
        """
        self.order, size = order, np.int64(len(self.word_number))
        history = np.empty_like(self.gram)
        history[1:] = self.gram[:-1]
        history[self.starts] = size - 1 if order == 2 else -1
        self.has = history >= 0
        below, history, w = self.gram[self.has], history[self.has], self.w[self.has]
        self.gram = None
        if order == 2:
            key = w * size + history
        elif order == 3:
            before = np.empty_like(self.w)
            before[1:] = self.w[:-1]
            middle = before[self.has]
            before[self.starts] = size - 1
            before[1:] = before[:-1].copy()
            before = before[self.has]
            key = middle * size + w
            if int(size) ** 3 >= 1 << 63:
                key = np.unique(key, return_inverse=True)[1]
            key *= size
            key += before
        else:
            key = history * size + w
        at = np.argsort(key)
        first = firsts(key[at]).astype(np.int32)
        key = None
        at = at.astype(np.int32)
        sizes = np.diff(first, append=np.int32(len(at)))
        token = at[first]
        h, w = history[token], w[token]
        history = None
        if order == 3:
            before, middle = before[token], middle[token]
            number, part = self.word_rank[middle] << np.uint64(32) | self.word_rank[before], (self.word_number[middle] >> PLACE) % np.uint64(self.parts)
        else:
            number = self.number[h]
            part = (number >> PLACE) % np.uint64(self.parts)
        part = part.astype(np.int32)
        if order == 3:
            hot = np.flatnonzero(self.word_count[middle] > limit)
            part[hot] = self.deal(part[hot], self.word_count[middle[hot]], self.word_number[before[hot]], limit)
            before = middle = None
        hot = np.flatnonzero(self.count[h] > limit)
        part[hot] = self.deal(part[hot], self.count[h[hot]], self.word_number[w[hot]], limit)
        again = by_part(part).astype(np.int32)
        place = ranks(again)
        self.sums = self.count[h][again]
        self.number = h = None
        self.part, self.h, self.word = part[again], number[again], w[again]
        number = w = part = None
        self.spread = np.zeros(len(again), bool)
        self.spread[place[hot]] = True
        token = token[again]
        self.lower = self.p[self.has][token]
        below = below[token]
        self.below = self.count[below], self.share[below]
        self.count = self.share = below = token = None
        self.n = np.add.reduceat(self.learnt[self.has][at], first, dtype=np.uint32)[again]
        self.of = np.empty(len(at), np.int32)
        self.of[at] = np.repeat(place, sizes)

    def deal(self, part: np.ndarray, count: np.ndarray, by: np.ndarray, limit: int) -> np.ndarray:
        """Partitions for what has too many tokens for one: as many as these would fill twice."""
        over = -(-2 * count.astype(np.int64) // limit)
        return (part + (mix(by) % over.astype(np.uint64)).astype(np.int64)) % self.parts

    def message(self, k: slice) -> tuple[bytes, ...]:
        """What a partition gets: its n-grams' histories and words, their counts and lower probabilities, and the histories that are spread.

        A lower probability that a partition needs is that of an n-gram seen there: a count, which is short, and a share, which
        depends on the history's last words alone.
        """
        count, share = (x[k] for x in self.below)
        share = pack_runs(share)
        lower = len(share).to_bytes(4, "little") + share + pack_runs(count.astype(np.uint64))
        return pack_histories(self.h[k]), pack_runs(self.word_rank[self.word[k]]), pack(self.n[k]), lower, pack(np.unique(self.h[k][self.spread[k]]))

    def learn(self, got: dict[int, dict], model: Grams, last: bool) -> None:
        """The n-grams' probabilities from what the partitions sent back. A history's sum is its own count: a token follows each."""
        size = len(self.h)
        p, count, number = np.zeros(size, np.float32), np.zeros(size, np.uint32), np.zeros(0 if last or self.order == 2 else size, np.uint64)
        share = np.zeros(0 if last else size, np.float32)
        for of, k in spans(self.part):
            g = got[of]
            count[k] = unpack(g["count"], np.uint32)
            h, first, at = histories(self.h[k])
            spread, sums = self.spread[k][first], self.sums[k][first].astype(np.int64)
            few = unpack(g["few"], np.uint32).reshape(KATZ, len(h)).astype(np.int64)
            few[0] = sums - few[0] - (np.arange(2, KATZ + 1)[:, None] * few[1:]).sum(axis=0)
            free = np.ones(len(h))
            free[(np.bincount(at, count[k] == 0) > 0) & ~spread] = unpack(g["free"], np.float32)
            # Of a history that is spread the driver knows the whole sums.
            for j in np.flatnonzero(spread):
                whole, covered = model.spread[int(h[j])]
                sums[j], few[:, j], free[j] = whole[0], whole[1:], 1 - covered
            seen, back = model.weights(sums, few, free)
            c = count[k].astype(np.int64)
            p[k] = np.where(c > 0, seen[at] * discounted(c, model.d), back[at] * self.lower[k])
            if not last:
                share[k] = seen[at]
            if len(number):
                number[k] = unpack_steps(g["place"], np.uint32) | np.uint64(of) << PLACE
        self.p[self.has] = p[self.of]
        if not last:
            self.gram = np.full(len(self.w), -1, np.int32)
            self.gram[self.has] = self.of
            self.number, self.count, self.share = number, count, share
        self.part = self.h = self.word = self.spread = self.lower = self.below = self.sums = self.n = self.of = None

    def scores(self) -> np.ndarray:
        return np.add.reduceat(np.log10(self.p.astype(np.float64)), self.starts)


ANSWER = {"chunk": pa.int64(), "p": pa.int32(), "place": pa.binary(), "count": pa.binary(), "few": pa.binary(), "free": pa.binary(), "total": pa.list_(pa.int64()), "spread": pa.list_(pa.int64()), "covered": pa.list_(pa.float64())}
ANSWER_ROWS = "chunk long, p int, place binary, count binary, few binary, free binary, total array<bigint>, spread array<bigint>, covered array<double>"


def answers(rows: list[dict]) -> pa.Table:
    return pa.table({c: pa.array([r.get(c) for r in rows], t) for c, t in ANSWER.items()})


def count_words(group: pa.Table) -> pa.Table:
    """A partition's words: totals and places by total back to each chunk, and one row of sums."""
    chunk, p = group.column("chunk").to_pylist(), group.column("p")[0].as_py()
    words = [unpack_steps(x, np.uint64) for x in group.column("word").to_pylist()]
    uniq, inv = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(inv, np.concatenate([unpack(x, np.uint32) for x in group.column("n").to_pylist()])).astype(np.int64)
    place = np.empty(len(uniq), np.uint32)
    place[np.argsort(-total, kind="stable")] = np.arange(len(uniq), dtype=np.uint32)
    ends = np.cumsum([len(w) for w in words])[:-1]
    of = np.bincount(np.minimum(total, KATZ + 2), minlength=KATZ + 3)
    out = [{"chunk": c, "p": p, "place": pack(place[k]), "count": pack(total[k].astype(np.uint64))} for c, k in zip(chunk, np.split(inv, ends), strict=True)]
    return answers([*out, {"p": p, "total": [int(total.sum()), int((total > 0).sum()), *map(int, of[1 : KATZ + 2])]}])


def lowers(data: bytes, d: np.ndarray) -> np.ndarray:
    end = 4 + int.from_bytes(data[:4], "little")
    return unpack_runs(data[4:end], np.float32) * discounted(unpack_runs(data[end:], np.uint64).astype(np.int64), d)


def count_grams(group: pa.Table, last: bool, d: np.ndarray = np.ones(KATZ + 1), pairs: bool = True) -> pa.Table:
    """A partition's n-grams: totals back to each chunk, and for each of its histories the numbers of low counts and the
    lower order's probability left for words not seen after it, where the chunk has such a word; and one row of sums.

    ``d`` are the lower order's discounts; ``pairs`` need no numbers, since their words name them. Instead of the number of count 1 goes what all low counts leave of the history's sum,
    which is mostly 0. Histories that are spread get neither here.
    """
    chunk, p = group.column("chunk").to_pylist(), group.column("p")[0].as_py()
    get = lambda name, how, kind: [how(x, kind) for x in group.column(name).to_pylist()]
    hs, w = [histories(h) for h in get("h", unpack_histories, np.uint64)], np.concatenate(get("word", unpack_runs, np.uint64))
    n, lower = np.concatenate(get("n", unpack, np.uint32)), np.concatenate([lowers(x, d).astype(np.float32) for x in group.column("lower").to_pylist()])
    sizes = [len(at) for _, _, at in hs]
    uh = np.unique(np.concatenate([u for u, _, _ in hs]))
    own = [np.searchsorted(uh, u) for u, _, _ in hs]
    h = np.concatenate([o[at] for o, (_, _, at) in zip(own, hs, strict=True)])
    bits = int(w.max()).bit_length()
    order = np.argsort(h.astype(np.uint64) << np.uint64(bits) | w) if bits + len(uh).bit_length() <= 64 else np.lexsort((w, h))
    first = firsts(h[order], w[order])
    total = np.add.reduceat(n[order].astype(np.int64), first)
    kind = np.empty(len(h), np.int64)
    kind[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(h)]))
    th, seen = h[order[first]], total > 0
    sums, covered = np.bincount(th, total, len(uh)).astype(np.int64), np.bincount(th, np.where(seen, lower[order[first]], 0).astype(np.float64), len(uh))
    few = np.stack([np.bincount(th[total == r], minlength=len(uh)) for r in range(1, KATZ + 1)])
    of = np.bincount(np.minimum(total, KATZ + 2), minlength=KATZ + 3)
    spread = np.unique(np.concatenate(get("spread", unpack, np.uint64)))
    mine = np.searchsorted(uh, spread)
    whole = np.ones(len(uh), bool)
    whole[mine] = False
    sent = np.stack([sums - (np.arange(1, KATZ + 1)[:, None] * few).sum(axis=0), *few[1:]]) * whole
    out = []
    for c, k, o, (_, _, at) in zip(chunk, np.split(kind, np.cumsum(sizes)[:-1]), own, hs, strict=True):
        asked = (np.bincount(at, total[k] == 0) > 0) & whole[o]
        out.append({
            "chunk": c, "p": p, "count": pack(total[k].astype(np.uint32)), "few": pack(sent[:, o].astype(np.uint32).ravel()),
            "free": pack((1 - covered[o[asked]]).astype(np.float32)), "place": None if last or pairs else pack_steps(k.astype(np.uint32)),
        })
    out.append({"p": p, "total": [int(x) for x in of[1 : KATZ + 2]], "spread": [int(x) for h, k in zip(spread, mine, strict=True) for x in (h.astype(np.int64), sums[k], *few[:, k])], "covered": [float(covered[k]) for k in mine]})
    return answers(out)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _record(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cells = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, kinds.values(), strict=True)], names=list(kinds))


class Scorer:
    """The steps of one run; see ``score``."""

    def __init__(self, docs: DataFrame, order: int):
        self.order, self.work = order, Workspace(docs.sparkSession, "lm")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        # The joins by chunk find the chunks where they are, and move only the answers.
        self.buckets = max(12, math.ceil(chars / 6 / CHUNK))
        made = self.work.write_bucketed(texts.mapInArrow(chunks, CHUNK_ROWS), "chunks", "chunk", self.buckets, "kind")
        self.texts = made.filter("kind = 'texts'").drop("kind", "word", "n")
        tokens, self.begins = (x or 0 for x in self.texts.agg(F.sum("size"), F.sum("learnt")).first())
        self.parts = max(12, math.ceil(tokens / SHARE))
        self.limit = max(SHARE // 2, tokens // SPREAD, 1)
        self.told: list[DataFrame] = []  # each order's answers, by chunk
        self.words: Words | None = None
        self.models: list[Grams] = []

    def reached(self, upto: int) -> Callable[[dict], Chunk]:
        """A function that brings a joined row to the n-grams of an order; the last answers are for those of the order before."""
        parts, words, begins, models, limit, last = self.parts, self.words, self.begins, list(self.models), self.limit, self.order

        def bring(r: dict) -> Chunk:
            c = Chunk(r, parts)
            got: dict[int, dict[int, dict]] = {}
            for g in r["got"]:
                got.setdefault(g["nth"], {})[g["p"]] = g
            c.learn_words(got[1], words, begins)
            for k in range(2, upto + 1):
                c.grams(k, limit)
                if k - 2 < len(models):
                    c.learn(got.get(k, {}), models[k - 2], k == last)
            return c

        return bring

    def joined(self) -> DataFrame:
        """Each chunk with all answers so far; one of empty texts alone has none above the second order."""
        rows, names = self.texts, [f"got{k}" for k in range(1, len(self.told) + 1)]
        for name, told in zip(names, self.told, strict=True):
            rows = rows.join(told.withColumnRenamed("got", name).hint("merge"), "chunk", "left")
        return rows.withColumn("got", F.concat(*(F.coalesce(x, F.array()) for x in names))).drop(*names)

    def tell(self, answers: DataFrame) -> list[int]:
        """Keeps an order's answers for its chunks, and returns the sums over all partitions.

        They move to where the chunks are once, in a step of their own, so that they are not in shuffle files beside the next order's
        messages; the last order's move when the result runs.
        """
        k = len(self.told) + 1
        size = KATZ + (3 if k == 1 else 1)
        sums = [x or 0 for x in answers.filter("chunk IS NULL").select(*(F.sum(F.col("total")[j]).alias(f"s{j}") for j in range(size))).first()]
        got = F.struct(F.lit(k).alias("nth"), "p", "place", "count", "few", "free")
        back = answers.filter("chunk IS NOT NULL").select("chunk", got.alias("g")).repartition(self.buckets, "chunk").groupBy("chunk").agg(F.collect_list("g").alias("got"))
        if k < self.order:
            back = self.work.write_bucketed(back, f"told-{k}", "chunk", self.buckets)
            self.work.drop(f"grams-{k}")
        self.told.append(back)
        return sums

    def count_words(self) -> None:
        parts = self.parts
        kinds = {"p": pa.int32(), "chunk": pa.int64(), "word": pa.binary(), "n": pa.binary()}

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                words, n = unpack_steps(r["word"], np.uint64), unpack(r["n"], np.uint32)
                part = ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # a range of hashes each
                yield _record(kinds, [(p, r["chunk"], pack_steps(words[k]), pack(n[k])) for p, k in spans(part)])

        words = self.work.read("chunks/kind=words", "chunk long, word binary, n binary")
        sent = words.mapInArrow(send, "p int, chunk long, word binary, n binary")
        told = self.work.write(sent.groupBy("p").applyInArrow(count_words, ANSWER_ROWS), "grams-1")
        self.work.drop("chunks/kind=words")
        sums = self.tell(told)
        self.words = Words(sums[0], sums[1], sums[2:])

    def count(self, order: int) -> None:
        """The n-grams of one order above the first."""
        bring, last = self.reached(order), order == self.order
        d = self.models[-1].d if self.models else self.words.d
        kinds = {"p": pa.int32(), "chunk": pa.int64(), "h": pa.binary(), "word": pa.binary(), "n": pa.binary(), "lower": pa.binary(), "spread": pa.binary()}

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                c = bring(r)
                for p, k in spans(c.part):
                    yield _record(kinds, [(p, r["chunk"], *c.message(k))])

        sent = self.joined().mapInArrow(send, "p int, chunk long, h binary, word binary, n binary, lower binary, spread binary")
        # A bucket may have several chunks; Python gets them one by one.
        told = self.work.write(sent.groupBy("p").applyInArrow(lambda group: count_grams(group, last, d, order == 2), ANSWER_ROWS), f"grams-{order}", at_once=1)
        whole: dict[int, tuple[np.ndarray, float]] = {}
        for r in told.filter("chunk IS NULL AND size(spread) > 0").select("spread", "covered").collect():  # at most SPREAD histories, and their pieces
            for k, covered in enumerate(r["covered"]):
                h, *x = r["spread"][k * (KATZ + 2) : (k + 1) * (KATZ + 2)]
                old = whole.get(h % (1 << 64), (np.zeros(KATZ + 1, np.int64), 0.0))
                whole[h % (1 << 64)] = (old[0] + np.array(x, np.int64), old[1] + covered)
        self.models.append(Grams(self.tell(told), whole))

    def finish(self) -> DataFrame:
        bring, total = self.reached(self.order), self.words.total
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

        def score_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                c = bring(r)
                cells = (r["ids"], c.held == 1, c.lens, c.known, np.full(len(c.lens), total, np.int64), c.base, c.scores())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, kinds.values(), strict=True)], names=list(kinds))

        return self.joined().mapInArrow(score_chunk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``, by n-grams of up to ``order`` tokens.

    Learns from the texts whose crc32(doc_id as text) mod 10 is not 0. Null and empty texts are one end token; rows with a
    null id are held out; repeated rows count and score as often as they are there; ties change nothing; a text longer than
    a chunk is a chunk of its own; an empty table gives no rows; other columns are not read. Without any text to learn
    from, every token is the unknown word, with probability 1.
    """
    run = Scorer(docs, order)
    run.count_words()
    for k in range(2, order + 1):
        run.count(k)
    return run.finish()


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` over all documents, with n-grams of up to three tokens."""
    return score(table(spark, sf_dir, "documents"))
