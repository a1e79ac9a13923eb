"""Parquet tables as tables of the dialect: keys become UUIDs, amounts whole cents, times whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.functions.values import BYTES, INT, TEXT, UUID
from larkspur.sources.schema import ColumnDef, IndexDef, TableDef

C = ColumnDef
USERS = TableDef("users", (C("id", UUID, pk=True), C("name", TEXT), C("nation", INT), C("segment", TEXT), C("cents", INT), C("grp", INT, nullable=True)), (IndexDef("", ("cents",), True), IndexDef("", ("segment",)), IndexDef("", ("grp",))))
_POST = (C("id", UUID, pk=True), C("author", UUID), C("status", TEXT), C("cents", INT), C("day", INT), C("prio", TEXT), C("score", INT, nullable=True))
POSTS = TableDef("posts", _POST, (IndexDef("", ("author",)), IndexDef("", ("status", "day"), True)))
POSTS_F = TableDef("posts_f", _POST, (IndexDef("", ("author",)), IndexDef("", ("status", "day"), True)))
MESSAGES = TableDef("messages", (C("id", UUID, pk=True), C("thread", UUID, partition_key=True), C("seq", INT, immutable=True), C("role", TEXT), C("body", TEXT)))
EVT = TableDef("evt", (C("id", UUID, pk=True), C("actor", UUID, partition_key=True), C("ts_us", INT), C("kind", TEXT), C("cents", INT)))
DOCS = TableDef("docs", (C("id", UUID, pk=True), C("lang", TEXT), C("source", TEXT), C("n", INT), C("raw", BYTES)), (IndexDef("", ("lang",)), IndexDef("", ("source",))))


def tid(n: Column) -> Column:
    """A UUID of version 7 shape that holds ``n`` where the time stands, so that keys sort as numbers do."""
    h = F.lower(F.lpad(F.hex(n), 12, "0"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-7000-8000-000000000000"))


def cents(x: str) -> Column:
    return F.round(F.col(x) * 100).cast("long")


def bridge(spark: SparkSession, sf_dir: str, *wanted: str) -> Engine:
    """An engine whose tables are views over the Parquet files; nothing is copied, so filters and columns reach the scans."""
    read = lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    posts = lambda: read("orders").select(
        tid(F.col("o_orderkey")).alias("id"), tid(F.col("o_custkey")).alias("author"), F.col("o_orderstatus").alias("status"), cents("o_totalprice").alias("cents"),
        F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("day"), F.col("o_orderpriority").alias("prio"), F.nullif(F.col("o_orderkey") % 5, F.lit(0)).cast("long").alias("score"),
    )
    made: dict[str, tuple[TableDef, object]] = {
        "users": (USERS, lambda: read("customer").select(
            tid(F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment"),
            cents("c_acctbal").alias("cents"), F.nullif(F.col("c_custkey") % 7, F.lit(0)).cast("long").alias("grp"))),
        "posts": (POSTS, posts),
        "posts_f": (POSTS_F, lambda: posts().filter("status = 'F'")),
        "messages": (MESSAGES, lambda: read("conversations").select(
            tid(F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tid(F.col("conv_id")).alias("thread"), F.col("turn").alias("seq"), "role", F.col("text").alias("body"))),
        "evt": (EVT, lambda: read("events").select(
            tid(F.col("event_id")).alias("id"), tid(F.col("user_id")).alias("actor"),
            F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("ts_us"), F.col("event_type").alias("kind"), cents("value").alias("cents"))),
        "docs": (DOCS, lambda: read("documents").select(
            tid(F.col("doc_id")).alias("id"), "lang", "source", F.col("n_chars").alias("n"), F.encode(F.col("text"), "UTF-8").alias("raw"))),
    }
    engine = Engine.open(spark)
    for name in wanted or made:
        define, rows = made[name]
        engine.register(define, rows())
    return engine


def live(df: DataFrame, *names: str) -> DataFrame:
    """A result under other names, so that each is there once."""
    return df.toDF(*names)
