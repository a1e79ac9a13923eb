"""Document fingerprints of closed syncmers with their places, with DataFrame functions only."""

from __future__ import annotations

import math
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import table

#: Characters one by one: Java then looks most of them up in a table, where ranges and intersections are tested in turn.
VOWEL = "[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ]"
CONSONANT = "[bcdfghjklmnpqrstvwxzßçðñþ]"
LETTER = f"[{VOWEL[1:-1]}{CONSONANT[1:-1]}]"
#: What texts are made of: Latin letters up to one to three vowels, with the last consonants of a word, nine at most; any
#: other character but white space alone. Where a unit ends is told by the letters beside it, so units fall into step
#: again soon after an edit, without spaces too.
UNIT = rf"{CONSONANT}{{0,3}}{VOWEL}{{1,3}}(?:{CONSONANT}{{1,3}}(?!{LETTER}))?|{CONSONANT}{{1,4}}|[^\x20\x09\x0A\x0B\x0C\x0D]"
#: Units in a k-mer and in its inner s-mers. Of K - S + 1 inner s-mers the least must be the first or the last.
K, S = 5, 2
#: Anchors that a fingerprint keeps: those with the least hashes. Texts of fewer than SHORT units have their s-mers as anchors
#: too, of fewer than TINY their units.
KEPT, SHORT, TINY = 40, 24, 8
#: An anchor and its place are one number, the place in so many lower bits.
PLACE = 31
#: Units by which places of shared anchors may differ from one offset and count as in step.
STEP = 24
#: Rows that one range of ids should hold, and the most ranges.
RANGE_ROWS, RANGES, CHUNK = 2000, 16384, 128


def units(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(UNIT), F.lit(0))


def smers(u: Column) -> Column:
    """Hashes of the s-mers that begin at each unit; those of the last S - 1 units are of fewer."""
    return F.transform(u, lambda x, i: F.xxhash64(x, *(F.get(u, i + k) for k in range(1, S))))


def short(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << 32) - 1))


def syncmers(s: Column) -> Column:
    """From s-mers: for each unit the hash (32 bits) of the k-mer that begins there, null where that is no closed syncmer or not whole."""
    last = F.size(s) - K

    def choose(x: Column, i: Column) -> Column:
        inner = [x, *(F.get(s, i + k) for k in range(1, K - S + 1))]
        chosen = (i <= last) & (F.least(x, inner[-1]) <= F.least(*inner[1:-1]))
        return F.when(chosen, short(F.xxhash64(*inner[::S], *([inner[-1]] if (K - S) % S else []))))

    return F.transform(s, choose)


def placed(c: Column, begin: Column) -> Column:
    """Hashes with their places, counted from ``begin``, as numbers that rise with the hash, then the place; without nulls."""
    return F.array_compact(F.transform(c, lambda x, i: F.shiftleft(x, PLACE) + i + begin))


def least(a: Column, to: str, rows: DataFrame) -> DataFrame:
    """``rows`` with ``to``: of the numbers in ``a``, the KEPT least hashes, each where it first occurs."""
    t = f"{to}_sorted"
    rows = rows.withColumn(t, F.sort_array(a))
    hash_of = lambda x: F.shiftright(x, PLACE)
    new = F.filter(F.col(t), lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(F.col(t), i - 1))))
    return rows.withColumn(to, F.slice(new, 1, KEPT)).drop(t)


def anchors(rows: DataFrame, stem: str, ends: dict[str, str]) -> DataFrame:
    """``rows`` with the anchors of some texts that begin alike: column ``stem``, which is empty or ends with a space, then one of ``ends``.

    For each of these, by the name that ``ends`` gives, a struct of ``hashes`` (32 bits, rising) and their ``places``: closed
    syncmers of the text's units. A k-mer is chosen by its own units alone, so an edit changes only the anchors that overlap
    it. Of all distinct anchors the KEPT least ones stay, each with the number of the unit at which it first begins; so a
    long text's fingerprint is no longer than a page's, and repeats count once. Texts are lower-cased, and white space only
    ends units, so a stem's are the same whatever follows: its k-mers are hashed once, and only those that reach beyond it for
    each end. Any text with a unit has an anchor; null, empty and blank texts have none.
    """
    col = F.col
    # Each step reads the one before more than once, so the optimiser keeps them apart and each is computed once a row.
    rows = rows.withColumn("_u", units(F.coalesce(col(stem), F.lit("")))).withColumn("_s", smers(col("_u")))
    rows = rows.withColumn("_c", placed(F.slice(syncmers(col("_s")), F.lit(1), F.greatest(F.size("_s") - (K - 1), F.lit(0))), F.lit(0)))
    rows = least(col("_c"), "_p", rows)
    # The k-mers that reach beyond the stem begin here.
    rows = rows.withColumn("_m", F.greatest(F.size("_u") - (K - 1), F.lit(0))).withColumn("_t", F.slice(col("_u"), col("_m") + 1, F.lit(K - 1)))
    for end, to in ends.items():
        rows = rows.withColumn("_v", F.concat("_t", units(F.coalesce(col(end), F.lit(""))))).withColumn("_w", smers(col("_v")))
        rows = rows.withColumn("_n", col("_m") + F.size("_v"))
        # A short text's syncmers stand after its units and s-mers, as many places each.
        whole = F.concat(F.slice(col("_u"), F.lit(1), col("_m")), col("_v"))
        s = F.concat(F.slice(col("_s"), F.lit(1), col("_m")), col("_w"))
        mers = F.transform(s, lambda x, i: F.when((i == 0) | (i <= col("_n") - S), short(x)))  # noqa: B023
        few = F.concat(mers, syncmers(s))
        tiny = F.concat(F.transform(whole, lambda x: short(F.xxhash64(x))), few)
        much = F.concat("_p", placed(syncmers(col("_w")), col("_m")))
        rows = least(F.when(col("_n") < TINY, placed(tiny, F.lit(0))).when(col("_n") < SHORT, placed(few, F.lit(0))).otherwise(much), "_h", rows)
        place = lambda x: F.pmod(x.bitwiseAND(F.lit((1 << PLACE) - 1)), F.greatest(col("_n"), F.lit(1)))
        rows = rows.withColumn(to, F.struct(F.transform("_h", lambda x: F.shiftright(x, PLACE)).alias("hashes"), F.transform("_h", place).alias("places")))
        rows = rows.drop("_v", "_w", "_n", "_h")
    return rows.drop("_u", "_s", "_c", "_p", "_m", "_t")


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors that lie at one offset, give or take STEP units, twice, over those of both.

    The offset is that of most shared anchors, so a passage that stands elsewhere in one text counts with those that moved
    alike. Where one fingerprint was cut, both count up to the lower of their highest hashes only, as the other's
    anchors above it are not known. Two empty fingerprints are alike, an empty one is like no other.
    """
    last = lambda x: F.when(F.size(x["hashes"]) == KEPT, F.element_at(x["hashes"], -1))
    limit = F.coalesce(F.least(last(a), last(b)), F.lit(1 << 32))
    count = lambda x: F.size(F.filter(x["hashes"], lambda h: h <= limit))
    moved = F.transform(a["hashes"], lambda h, i: F.get(b["places"], (F.array_position(b["hashes"], h) - 1).cast("int")) - F.get(a["places"], i))
    moved = F.filter(F.array_compact(moved), lambda x: x.isNotNull())
    best = F.array_max(F.transform(F.array_distinct(moved), lambda x: F.size(F.filter(moved, lambda y: F.abs(y - x) <= STEP))))
    total = count(a) + count(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.coalesce(best, F.lit(0)) / total)


def spelled(a: Column) -> Column:
    """A fingerprint as a string: hashes and places, both hexadecimal, as hash.place between spaces."""
    return F.array_join(F.transform(a["hashes"], lambda x, i: F.concat(F.lower(F.hex(x)), F.lit("."), F.lower(F.hex(F.get(a["places"], i))))), " ")


def with_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt into ranges of ids: ``part``, ``extra``, ``key`` and ``tie``.

    Rows follow by id and, where ids are equal, by a hash of the text. Bounds are approximate quantiles of the ids, so that
    ranges have about RANGE_ROWS rows however the ids lie; an id that fills several ranges, as null does where many ids
    are null, is dealt to them by the hash. Each range also gets the first rows of the next one as ``extra`` rows, and the
    last one those of the first, so that what follows a row is in its own range, and no step puts all rows in one order.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key")).withColumn("tie", F.xxhash64("text"))
    count = rows.count()
    n = min(RANGES, max(1, math.ceil(count / RANGE_ROWS)))
    shares = [k / n for k in range(1, n)]
    found = sorted(rows.agg(F.percentile_approx("key", shares, 10 * n).alias("b")).first()["b"] or []) if shares else []
    times = Counter(found)
    # An id that is several bounds fills as many ranges; those of the k-th bound begin at begins[k], after range 0 of the rows below all.
    bounds, many = sorted(times), [times[b] for b in sorted(times)]
    begins = [1, *(1 + x for x in accumulate(many[:-1]))]
    if bounds:
        nested = lambda values, kind: F.array(*(F.array(*(F.lit(v).cast(kind) for v in values[k : k + CHUNK])) for k in range(0, len(values), CHUNK)))
        below = lambda a: F.size(F.filter(a, lambda b: b <= F.col("key")))
        rows = rows.withColumn("chunk", below(F.array(*(F.lit(bounds[k]).cast("long") for k in range(0, len(bounds), CHUNK)))) - 1)
        rows = rows.withColumn("place", F.when(F.col("chunk") >= 0, below(F.get(nested(bounds, "long"), F.col("chunk"))) - 1))
        of = lambda values, kind: F.get(F.get(nested(values, kind), F.col("chunk")), F.col("place"))
        part = of(begins, "int")
        if max(many) > 1:
            m = of(many, "int")
            share = F.least(F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * m).cast("int"), m - 1)
            part = part + F.when(of(bounds, "long") == F.col("key"), share).otherwise(m - 1)
        rows = rows.withColumn("part", F.coalesce(part, F.lit(0)).cast("int")).drop("chunk", "place")
    else:
        rows = rows.withColumn("part", F.lit(0))
    firsts = sorted((r["part"], r["low"]["key"], r["low"]["tie"]) for r in rows.groupBy("part").agg(F.min(F.struct("key", "tie")).alias("low")).collect())  # a row for each range
    moved = [(key, tie, firsts[k - 1][0]) for k, (_, key, tie) in enumerate(firsts)]
    ahead = F.broadcast(spark.createDataFrame(moved, "key long, tie long, to int"))
    again = rows.join(ahead, ["key", "tie"]).select("doc_id", "text", "key", "tie", F.col("to").alias("part"), F.lit(True).alias("extra")).dropDuplicates(["key", "tie"])
    return rows.select("doc_id", "text", "key", "tie", "part", F.lit(False).alias("extra")).union(again)


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many, or all, of the
    next document's; documents follow by ascending id (null ids first, ties by a hash of the text), and the first follows
    the last, so that a single row follows itself. Null texts count as empty, very long ones are read whole, equal rows get equal
    fingerprints, an empty table gives no rows, other columns are not read. The texts are shuffled once, by ranges of ids.
    """
    follows = Window.partitionBy("part").orderBy("extra", "key", "tie")
    rows = with_ranges(docs).withColumn("next", F.lead("text").over(follows))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substr(F.coalesce("next", F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("edited", F.when(F.col("extra"), F.lit("")).otherwise(edited))
    # What is before the last space of what both texts begin with; nothing where there is no space.
    kept = (F.col("n_chars") - cut).cast("int")
    stem = F.when(F.col("extra"), F.lit(0)).otherwise(kept - F.length(F.substring_index(F.substr("text", F.lit(1), kept), " ", -1)))
    rows = rows.withColumn("stem_chars", stem)
    after = lambda x: F.substr(x, F.col("stem_chars") + 1)
    rows = rows.withColumn("stem", F.substr("text", F.lit(1), F.col("stem_chars"))).withColumn("end", after("text")).withColumn("changed_end", after("edited"))
    rows = anchors(rows, "stem", {"end": "own", "changed_end": "changed"})
    rows = rows.select("part", "extra", "key", "tie", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "changed")
    none = F.struct(F.array().cast("array<bigint>").alias("hashes"), F.array().cast("array<bigint>").alias("places"))
    rows = rows.withColumn("ahead", F.coalesce(F.lead("own").over(follows), none)).filter(~F.col("extra"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("own")).alias("fingerprint"), spelled(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("ahead")).alias("near_next"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fingerprints`` of all documents."""
    return fingerprints(table(spark, sf_dir, "documents"))
