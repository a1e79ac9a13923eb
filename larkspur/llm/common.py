"""What the operators of this package share: tables, folds and the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: The white space that separates words: the space and the five control characters of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``, a path that only Spark needs to read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal text, modulo ``of``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)), F.lit(0)).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session of one process, as in tests, gets a temporary one; on a cluster each machine would write
    to its own disk, so there it is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: Removes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a batch that Python gets.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Workspace:
    """Tables written to the shared folder to cut lineage.

    ``drop`` removes those that no later step reads; the others serve the result, which runs after its operator has
    returned, and go when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.path, self.known = spark, f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}", []
        # Kept for the end, when the session may have been stopped.
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(self.close)

    @contextlib.contextmanager
    def _clean(self, at_once: int | None = None) -> Iterator[None]:
        wanted = {CLEAN: "true"} | ({BATCH: str(at_once)} if at_once else {})
        had = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in had.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def write(self, df: DataFrame, name: str, at_once: int | None = None) -> DataFrame:
        """A table of ``df``; Python functions in it get batches of at most ``at_once`` rows."""
        to = f"{self.path}/{name}"
        with self._clean(at_once):
            df.write.mode("overwrite").option("compression", "zstd").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def read(self, name: str, columns: str) -> DataFrame:
        """A table, or a folder of one, with columns by name and type; without rows where nothing was written."""
        if not self._fs().exists(self._at(name)):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(f"{self.path}/{name}")

    def write_bucketed(self, df: DataFrame, name: str, by: str, buckets: int, *apart: str) -> DataFrame:
        """Like ``write``, with rows dealt by a column, so that joins by it leave them where they are, and a folder for each value of ``apart``, if named.

        The catalogue knows the table meanwhile.
        """
        known = f"larkspur_{uuid.uuid4().hex}"
        with self._clean():
            df.write.partitionBy(*apart).bucketBy(buckets, by).option("path", f"{self.path}/{name}").option("compression", "zstd").format("parquet").saveAsTable(known)
        self.known.append(known)
        return self.spark.table(known)

    def drop(self, name: str) -> None:
        """Removes a table, or with an empty name all of them."""
        self._fs().delete(self._at(name), True)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at("").getFileSystem(self.conf)

    def close(self) -> None:
        """Removes everything, as far as it can still be reached."""
        with contextlib.suppress(Exception):
            self.drop("")
        with contextlib.suppress(Exception):
            for known in self.known:
                self.spark.sql(f"DROP TABLE IF EXISTS {known}")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, of: int, left_out: int) -> tuple[list[tuple[str, int]], dict[int, float]]:
    """At most ``rows`` labelled texts of each class, and the share of each class's labels that these are.

    Draws by a hash of the id from rows of ``labels`` whose id and label are not null and whose fold ``of`` is not
    ``left_out``; all of them where there are fewer. Null texts count as empty; of rows that share an id the one with the
    least hash of its text is taken. The labels drawn are bounded by ``rows``
    for each of the two classes, so they are broadcast.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), of) != left_out))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [known.filter(F.col("label") == k).orderBy(F.xxhash64(F.lit(label), "doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")
    # Of rows with one id, however many, one comes to the driver.
    found = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text", "label").collect()
    texts = [(r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"], r["label"]))]
    return texts, {k: min(1.0, rows / n) for k, n in counts.items()}


def fresh_name(wanted: str, taken: list[str]) -> str:
    """A column name that none of the taken ones equals, whatever the case."""
    while wanted.lower() in {x.lower() for x in taken}:
        wanted += "_"
    return wanted


def map_rows(rows: DataFrame, keep: list[str], using: list[str], made: str, run: Callable[..., tuple], batch: int = 1000) -> DataFrame:
    """``rows`` with the columns ``made`` (a DDL string) beside those named in ``keep``, which pass unchanged, nulls included.

    ``run`` gets a list of values for each column named in ``using``, of at most ``batch`` rows, and returns one sequence
    for each column made.
    """
    more = _parse_datatype_string(made)
    types = [f.type for f in to_arrow_schema(more)]
    names = [*keep, *more.names]
    rows = rows.select(*dict.fromkeys([*keep, *using]))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                part = whole.slice(k, batch)
                found = run(*(part.column(c).to_pylist() for c in using))
                arrays = [part.column(c) for c in keep] + [pa.array(x, t) for x, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(go, StructType([*(rows.schema[c] for c in keep), *more.fields]))


def decided(docs: DataFrame, made: str, run: Callable[..., tuple], keep_if: Callable[[Column], Column]) -> DataFrame:
    """The rows of ``docs``, all columns, for which ``keep_if`` holds on the column ``made`` from the text."""
    name = fresh_name(made.split()[0], docs.columns)
    scored = map_rows(docs, docs.columns, ["text"], f"{name} {made.split()[1]}", run)
    return scored.filter(keep_if(F.col(name))).select(*docs.columns)
