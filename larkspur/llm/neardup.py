"""Near-duplicates by MinHash with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Workspace, fresh_name, map_rows, table

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Nodes, and shingles of theirs, in each side of a block.
TILE, TILE_SHINGLES = 1000, 1_000_000
#: Signature positions compared at a time, and the chance with which a true link may be pruned at each look.
LOOK, MISS = 16, 1e-7

_rng = np.random.default_rng(20_011)
_MUL = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; bytes split at ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of ``width`` words; with fewer words the whole sequence as one; without words none."""
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(width)), strict=False))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(w))):
        out = (out ^ (out >> np.uint64(29))) * _MIX[0] + h[k : k + n] * _MIX[1 + k % 3]
    out = (out ^ (out >> np.uint64(32))) * _MIX[3]
    return np.unique(out ^ (out >> np.uint64(31)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of HASHES multiply-add permutations of the hashes' upper halves."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        np.minimum(out, (x[a : a + 1024, None] * _MUL + _ADD).min(axis=0), out=out)
    return out


def sketch(texts: list[str | None], width: int) -> tuple[list, list, list]:
    """Size of each text's shingle set, a digest of its words, and its signature; None for both where the set is empty.

    Texts of one digest are the same words in the same order, so they have the same set; other texts of equal sets are left to
    the search. Sizes are numbers of unlike 64-bit hashes.
    """
    sizes, digests, signatures = [], [], []
    for text in texts:
        h = shingle_hashes(text, width)
        sizes.append(len(h))
        digests.append(hashlib.sha256(b" ".join(words(text))).digest() if len(h) else None)
        signatures.append(signature(h).tobytes() if len(h) else None)
    return sizes, digests, signatures


def least_matches(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """For each look, positions compared so far and the fewest matches that go on.

    With a uniform prior, m matches among n leave the similarity the distribution Beta(m + 1, n - m + 1), which lies at or
    above t with the chance that a binomial of n + 1 trials at t is at most m. A pair is pruned where that is below ``miss``.
    """
    t = percent / 100
    out = []
    for n in range(LOOK, HASHES + 1, LOOK):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def may_link(a: np.ndarray, b: np.ndarray, looks: list[tuple[int, int]]) -> np.ndarray:
    """For rows of two signature arrays: whether no look pruned the pair."""
    alive = np.arange(len(a))
    seen = np.zeros(len(a), np.int64)
    at = 0
    for n, least in looks:
        seen = seen + (a[alive, at:n] == b[alive, at:n]).sum(axis=1)
        alive, seen, at = alive[seen >= least], seen[seen >= least], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``node`` and ``label``, the smallest node that edges (a, b) reach, for every node of an edge.

    Each round takes the least label of all neighbours, aggregated before the shuffle, and then the label's own label, so
    that rounds grow with the logarithm of the longest path. Rounds are written tables; the driver sees a count only.
    """
    both = work.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = work.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        # Every node has a neighbour, so an inner join loses none.
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        k += 1
        moved = work.write(low.join(up, "low").select("node", "old", F.least("low", "up").alias("label")), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            work.drop(f"{name}-edges")
            return labels


def candidates(x: list[dict], y: list[dict], band: int, percent: int, looks: list[tuple[int, int]]) -> list[dict]:
    """Pairs of a node of x and one of y, in different components, near enough in size, that no look prunes and whose first common band is this one."""
    if not x or not y:
        return []
    sig = [np.frombuffer(b"".join(r["sig"] for r in side), np.uint32).reshape(-1, HASHES) for side in (x, y)]
    node, label, n = ([np.array([r[c] for r in side], np.int64) for side in (x, y)] for c in ("node", "label", "n"))
    asks = {int(k) for k in node[0]}
    out = []
    for k in range(len(x)):
        other = np.flatnonzero((label[1] != label[0][k]) & (100 * n[1] >= percent * n[0][k]) & (100 * n[0][k] >= percent * n[1]))
        other = other[may_link(np.broadcast_to(sig[0][k], (len(other), HASHES)), sig[1][other], looks)]
        same = (sig[1][other] == sig[0][k]).reshape(-1, BANDS, ROWS).all(axis=2)
        a = int(node[0][k])
        for b in node[1][other[same[:, band] & ~same[:, :band].any(axis=1)]].tolist():
            if a < b or b not in asks:  # two that ask meet twice
                out.append({"a": a, "b": b})
    return out


def confirmed(pairs: list[dict], nodes: list[dict], width: int, percent: int) -> list[dict]:
    """The pairs that whole shingle sets link; each set is made once, of numbers that stand for shingles."""
    number: dict[tuple[bytes, ...], int] = {}
    sets = {r["node"]: frozenset(number.setdefault(g, len(number)) for g in shingle_set(r["text"], width)) for r in nodes}
    out = []
    for p in pairs:
        a, b = sets[p["a"]], sets[p["b"]]
        both = len(a & b)
        if 100 * both >= percent * (len(a) + len(b) - both):
            out.append({"a": min(p["a"], p["b"]), "b": max(p["a"], p["b"])})
    return out


class Finder:
    """The steps of one search; see ``near_duplicates``."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.width, self.percent = width, percent
        self.work = Workspace(docs.sparkSession, "neardup")
        # A repeated id may have unlike texts: h tells them apart.
        self.docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
        sketches = map_rows(self.docs, ["doc_id", "h"], ["text"], "n long, digest binary, sig binary", lambda texts: sketch(texts, width))
        self.sketches = self.work.write(sketches, "sketches")
        linked = self.sketches.filter("n > 0 AND doc_id IS NOT NULL")
        # Texts of the same words are linked without comparing: one node stands for all of them.
        nodes = linked.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        self.nodes = self.work.write(nodes.select("digest", F.col("low.doc_id").alias("node"), F.col("low.h").alias("h"), "n", "sig"), "nodes")

    def bands(self) -> DataFrame:
        keys = [F.xxhash64(F.lit(k), F.substring("sig", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)]
        return self.nodes.select("node", "n", F.posexplode(F.array(*keys)).alias("band", "key"))

    def star(self) -> DataFrame:
        """Each bucket's nodes paired with its hub: the node whose buckets are the fullest.

        Of copies with edits, the least edited one shares the most bands with the others, so it is the likeliest to link
        with all of them.
        """
        full = self.bands().groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        full = self.work.write(full, "full")
        self.shared = self.work.write(self.bands().join(full, "key"), "shared")
        self.work.drop("full")
        weight = self.work.write(self.shared.groupBy("node").agg(F.sum("m").alias("w")), "weight")
        hubs = self.shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", (-F.col("node")).alias("less"))).alias("top"))
        hubs = self.work.write(hubs.select("key", (-F.col("top.less")).alias("hub")), "hubs")
        return self.shared.join(hubs, "key").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    def rest(self, labels: DataFrame) -> DataFrame:
        """Links between components that the star leaves apart; nodes of one component need no comparison.

        Nodes outside their bucket's largest component are compared with all of the bucket's nodes, as blocks of signatures
        and then, where pairs are left, of whole texts. A block has at most about TILE nodes and TILE_SHINGLES shingles a
        side, and a row leaves it for each link only.
        """
        labelled = self.work.write(self.shared.join(labels, "node", "left").select("key", "band", "node", "n", "m", F.coalesce("label", "node").alias("label")), "labelled")
        sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
        main = sizes.groupBy("key").agg(F.max(F.struct("c", "label", "s")).alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("c").alias("c"), F.sum("s").alias("s"))
        tiles = lambda c, s: F.greatest(F.ceil(c / TILE), F.ceil(s / TILE_SHINGLES)).cast("int")
        main = main.filter("labels > 1").select("key", F.col("top.label").alias("main"), tiles(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("rows"), tiles(F.col("c"), F.col("s")).alias("cols"))
        main = self.work.write(main, "main")
        members = labelled.join(main, "key").select("key", "band", "node", "n", "label", (F.col("label") != F.col("main")).alias("asks"), "rows", "cols")
        members = self.work.write(members, "members")
        self.work.drop("labelled")
        place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asked = members.withColumn("asks", F.lit(False)).withColumn("col", place("cols")).withColumn("row", every("rows"))
        asking = members.filter("asks").withColumn("row", place("rows")).withColumn("col", every("cols"))
        cells = asked.drop("rows", "cols").unionByName(asking.drop("rows", "cols")).join(self.nodes.select("node", "sig"), "node")
        side = lambda x: F.collect_list(F.when(F.col("asks") == x, F.struct("node", "label", "n", "sig")))
        block = ["key", "band", "row", "col"]
        blocks = cells.groupBy(*block).agg(side(True).alias("x"), side(False).alias("y"))
        width, percent, looks = self.width, self.percent, least_matches(self.percent)
        kind = "array<struct<a:bigint,b:bigint>>"

        def compare(bands: list[int], xs: list[list[dict]], ys: list[list[dict]]) -> tuple[list[list[dict]]]:
            return ([candidates(x, y, band, percent, looks) for band, x, y in zip(bands, xs, ys, strict=True)],)

        left = map_rows(blocks, block, ["band", "x", "y"], f"pairs {kind}", compare, 20).filter(F.size("pairs") > 0)
        left = self.work.write(left, "left")
        nodes = left.select(*block, F.explode(F.array_distinct(F.concat(F.col("pairs.a"), F.col("pairs.b")))).alias("node"))
        nodes = self.work.write(nodes, "left-nodes")
        texts = self.texts(nodes.select(F.col("node").alias("doc_id")).distinct(), "rest").withColumnRenamed("doc_id", "node")
        whole = left.join(nodes.join(texts, "node").groupBy(*block).agg(F.collect_list(F.struct("node", "text")).alias("nodes")), block)

        def confirm(pairs: list[list[dict]], nodes: list[list[dict]]) -> tuple[list[list[dict]]]:
            return ([confirmed(p, n, width, percent) for p, n in zip(pairs, nodes, strict=True)],)

        found = map_rows(whole, [], ["pairs", "nodes"], f"links {kind}", confirm, 1)
        found = self.work.write(found.select(F.explode("links").alias("p")).select("p.a", "p.b").distinct(), "rest-links")
        self.work.drop("rest-texts")
        return found

    def texts(self, wanted: DataFrame, name: str) -> DataFrame:
        """Each wanted node's own text."""
        own = self.nodes.select(F.col("node").alias("doc_id"), "h").join(wanted, "doc_id")
        return self.work.write(self.docs.join(own, ["doc_id", "h"]).select("doc_id", "text").dropDuplicates(["doc_id"]), f"{name}-texts")

    def survivors(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose signatures no look prunes."""
        looks = least_matches(self.percent)
        sig = lambda c: self.nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
        both = pairs.join(sig("b"), "b").join(sig("a"), "a")

        def look(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray]:
            return (may_link(*(np.frombuffer(b"".join(x), np.uint32).reshape(-1, HASHES) for x in (a, b)), looks),)

        return map_rows(both, ["a", "b"], ["sig_a", "sig_b"], "alive boolean", look, 5000).filter("alive").select("a", "b")

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that whole shingle sets confirm."""
        pairs = self.work.write(pairs, f"{name}-pairs")
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        texts = self.texts(wanted, name)
        side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
        width, percent = self.width, self.percent

        def confirm(ids: list[int], a: list[str], b: list[str]) -> tuple[list[bool]]:
            out, held, own = [], None, set()
            for k, x, y in zip(ids, a, b, strict=True):
                if k != held or not out:
                    held, own = k, shingle_set(x, width)
                other = shingle_set(y, width)
                both = len(own & other)
                out.append(100 * both >= percent * (len(own) + len(other) - both))
            return (out,)

        both = pairs.join(side("b"), "b").join(side("a"), "a")
        found = map_rows(both, ["a", "b"], ["a", "text_a", "text_b"], "linked boolean", confirm, 200).filter("linked").select("a", "b")
        found = self.work.write(found, f"{name}-links")
        self.work.drop(f"{name}-texts")
        return found

    def labels(self) -> DataFrame:
        first = self.links(self.survivors(self.star()), "star")
        self.work.drop("weight")
        self.work.drop("hubs")
        self.work.drop("star-pairs")
        labels = components(first, self.work, "first")
        more = self.rest(labels)
        for name in ("shared", "main", "members", "left", "left-nodes"):
            self.work.drop(name)
        if more.isEmpty():
            return labels
        return components(first.union(more), self.work, "all")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs`` (doc_id, text).

    Links documents whose sets of ``width``-word shingles have 100 x intersection >= percent x union; a component's id is
    the smallest doc_id that links reach, and ``kept`` marks the row that has it. Candidates share one of 32 bands of 4
    minima (a pair at 80 % shares none with a chance of 5e-8); looks at 16 more positions each prune them by the posterior
    of their similarity, and whole sets confirm the rest. A bucket's nodes are first compared with its hub only; then
    nodes outside its largest component are compared with the others, as blocks of signatures, so large groups of copies
    don't grow into all their pairs. Texts of the same words are one node from the start. Very long texts are read whole; a
    tie for a bucket's hub goes to the smallest id.

    Empty and null texts have 0 shingles and link with nothing, nor do rows with a null id: those have component null and
    are kept. Repeated rows are in one component and marked alike, as are all rows of one id, which count as one document; an empty table gives no rows; other columns are not read.
    """
    return marked(docs, width, percent).drop("h")


def marked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` with ``h``, a hash of each row's text."""
    find = Finder(docs, width, percent)
    labels = find.labels().select(F.col("node").alias("of"), "label")
    own = find.nodes.select("digest", "node").join(labels, F.col("node") == F.col("of"), "left").select("digest", F.coalesce("label", "node").alias("label"))
    rows = find.sketches.select("doc_id", "h", "n", "digest").join(own, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return rows.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps the one with its smallest id; of rows of one id that with the least hash of the text stays."""
    kept = marked(docs, width, percent).filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("h").alias("h"))
    h = fresh_name("h", docs.columns)
    rows = docs.filter("doc_id IS NOT NULL").withColumn(h, F.xxhash64("text"))
    found = rows.join(kept.withColumnRenamed("h", h), ["doc_id", h]).dropDuplicates(["doc_id"]).select(*docs.columns)
    return found.union(docs.filter("doc_id IS NULL").select(*docs.columns))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all documents by three-word shingles at 85 %."""
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


OP1_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS sh FROM t),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n_shingles + nb.n_shingles - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)
"""
