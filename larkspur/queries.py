"""Queries that show each operator of the engine over the Parquet tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.sources.bridge import EVT, POSTS, USERS, bridge
from larkspur.sources.schema import ColumnDef, TableDef
from larkspur.sources.store import scratch
from larkspur.streaming.drain import drain

_H = "substr(printf('%012x', {n}), 1, 8) || '-' || substr(printf('%012x', {n}), 9, 4) || '-7000-8000-000000000000'"
_TID = lambda n: "(" + _H.format(n=n) + ")"
_POST = f"""SELECT {_TID('o_orderkey')} AS id, {_TID('o_custkey')} AS author, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, o_orderpriority AS prio, CAST(nullif(o_orderkey % 5, 0) AS BIGINT) AS score FROM orders"""
#: The bridge's tables in SQL.
TABLES = {
    "users": f"SELECT {_TID('c_custkey')} AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, CAST(nullif(c_custkey % 7, 0) AS BIGINT) AS grp FROM customer",
    "posts": _POST,
    "posts_f": _POST + " WHERE o_orderstatus = 'F'",
    "messages": f"SELECT {_TID('conv_id * 1000 + turn')} AS id, {_TID('conv_id')} AS thread, turn AS seq, role, text AS body FROM conversations",
    "evt": f"SELECT {_TID('event_id')} AS id, {_TID('user_id')} AS actor, CAST(epoch_us(ts) AS BIGINT) AS ts_us, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS cents FROM events",
    "docs": f"SELECT {_TID('doc_id')} AS id, lang, source, n_chars AS n, encode(text) AS raw FROM documents",
}


def tid(n: int) -> str:
    h = f"{n:012x}"
    return f"{h[:8]}-{h[8:]}-7000-8000-000000000000"


def sql(body: str, *tables: str) -> str:
    return "WITH " + ", ".join(f"{t} AS ({TABLES[t]})" for t in tables) + " " + body


@dataclass
class Case:
    """A statement, its arguments and, where names repeat or hold dots, other names; ``same`` is SQL over the bridge's tables."""

    tables: str
    statement: str
    args: tuple[Any, ...]
    same: str
    names: tuple[str, ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = bridge(spark, sf_dir, *self.tables.split()).df(self.statement, *self.args)
        return out.toDF(*self.names) if self.names else out

    def oracle(self) -> str:
        return sql(self.same, *self.tables.split())


T7 = tid(7)
CASES = {
    "scan_project": Case("users", "SELECT name, cents FROM users", (), "SELECT name, cents FROM users"),
    "select_star": Case("users", "SELECT * FROM users", (), "SELECT * FROM users"),
    "pk_point": Case("posts", "SELECT * FROM posts WHERE id = ?", (T7,), f"SELECT * FROM posts WHERE id = '{T7}'"),
    "pk_probe_residual": Case("posts", "SELECT id, cents FROM posts WHERE cents > ? AND id = ?", (100, T7), f"SELECT id, cents FROM posts WHERE cents > 100 AND id = '{T7}'"),
    "partition_scan": Case("messages", "SELECT id, seq, role FROM messages WHERE thread = ?", (T7,), f"SELECT id, seq, role FROM messages WHERE thread = '{T7}'"),
    "partition_feed_topn": Case("messages", "SELECT seq, role FROM messages WHERE thread = ? ORDER BY seq DESC LIMIT 3", (T7,), f"SELECT seq, role FROM messages WHERE thread = '{T7}' ORDER BY seq DESC LIMIT 3"),
    "idx_eq": Case("users", "SELECT id, name FROM users WHERE segment = ?", ("BUILDING",), "SELECT id, name FROM users WHERE segment = 'BUILDING'"),
    "idx_intersect": Case("users", "SELECT id FROM users WHERE segment = ? AND grp = ?", ("BUILDING", 3), "SELECT id FROM users WHERE segment = 'BUILDING' AND grp = 3"),
    "idx_first": Case("users", "SELECT id, cents FROM users WHERE segment = ? ORDER BY id LIMIT 1", ("BUILDING",), "SELECT id, cents FROM users WHERE segment = 'BUILDING' ORDER BY id LIMIT 1"),
    "comp_prefix": Case("posts", "SELECT id, day FROM posts WHERE status = ? AND day = ?", ("F", 9143), "SELECT id, day FROM posts WHERE status = 'F' AND day = 9143"),
    "comp_walk": Case("posts", "SELECT id, day FROM posts WHERE status = ? ORDER BY day DESC LIMIT 20", ("F",), "SELECT id, day FROM posts WHERE status = 'F' ORDER BY day DESC NULLS LAST, id LIMIT 20"),
    "order_walk": Case("users", "SELECT id, cents FROM users ORDER BY cents LIMIT 15 OFFSET 4", (), "SELECT id, cents FROM users ORDER BY cents NULLS FIRST, id LIMIT 15 OFFSET 4"),
    "range_seek": Case("users", "SELECT id, cents FROM users WHERE cents >= ? AND ? > cents ORDER BY cents LIMIT 30", (10000, 500000), "SELECT id, cents FROM users WHERE cents >= 10000 AND cents < 500000 ORDER BY cents, id LIMIT 30"),
    "eq_null_safe": Case("posts", "SELECT id FROM posts WHERE score = ?", (None,), "SELECT id FROM posts WHERE score IS NULL"),
    "neq_two_valued": Case("posts", "SELECT id, score FROM posts WHERE score != ?", (2,), "SELECT id, score FROM posts WHERE score IS DISTINCT FROM 2"),
    "range_null": Case("posts", "SELECT id, score FROM posts WHERE score < ?", (3,), "SELECT id, score FROM posts WHERE score < 3"),
    "not_range_null": Case("posts", "SELECT id, score FROM posts WHERE NOT score < ?", (3,), "SELECT id, score FROM posts WHERE NOT coalesce(score < 3, false)"),
    "or_mixed": Case("posts", "SELECT id FROM posts WHERE (score >= ? OR status = ?) AND NOT (prio = ? OR score IS NULL)", (3, "F", "1-URGENT"), "SELECT id FROM posts WHERE (score >= 3 OR status = 'F') AND NOT (prio = '1-URGENT' OR score IS NULL)"),
    "is_null": Case("posts", "SELECT id FROM posts WHERE score IS NULL", (), "SELECT id FROM posts WHERE score IS NULL"),
    "is_not_null": Case("posts", "SELECT id, score FROM posts WHERE score IS NOT NULL", (), "SELECT id, score FROM posts WHERE score IS NOT NULL"),
    "not_in_nested_logic": Case("posts", "SELECT id FROM posts WHERE NOT (NOT (score > ?) AND status != ?)", (2, "O"), "SELECT id FROM posts WHERE NOT ((NOT coalesce(score > 2, false)) AND status IS DISTINCT FROM 'O')"),
    "int_truthiness": Case("posts", "SELECT id FROM posts WHERE score - ?", (2,), "SELECT id FROM posts WHERE coalesce(score - 2, 0) <> 0"),
    "arith_where": Case("posts", "SELECT id, cents FROM posts WHERE cents * ? - day > ?", (2, 1000000), "SELECT id, cents FROM posts WHERE cents * 2 - day > 1000000"),
    "arith_wrap": Case("posts", "SELECT id FROM posts WHERE cents * ? > ?", (2**60 + 3, 0), "SELECT id FROM posts WHERE (((CAST(cents AS HUGEINT) * 1152921504606846979 + 9223372036854775808) % 18446744073709551616) + 18446744073709551616) % 18446744073709551616 - 9223372036854775808 > 0"),
    "arith_error_skips_row": Case("posts", "SELECT id FROM posts WHERE prio + ? > ? OR cents > ?", (1, 0, 0), "SELECT id FROM posts WHERE false"),
    "mixed_kind_compare": Case("posts", "SELECT id, cents FROM posts WHERE cents < ?", ("2",), "SELECT id, cents FROM posts WHERE CAST(cents AS VARCHAR) < '2'"),
    "mixed_kind_equal": Case("posts", "SELECT id FROM posts WHERE cents = ?", ("2",), "SELECT id FROM posts WHERE false"),
    "column_compare": Case("posts", "SELECT id FROM posts WHERE score < day AND score != cents", (), "SELECT id FROM posts WHERE score < day AND score IS DISTINCT FROM cents"),
    "bytes_range": Case("docs", "SELECT id, n FROM docs WHERE raw < ?", (b"E",), "SELECT id, n FROM docs WHERE raw < CAST('E' AS BLOB)"),
    "null_pin_index": Case("users", "SELECT id FROM users WHERE grp = ?", (None,), "SELECT id FROM users WHERE false"),
    "count_all": Case("posts", "SELECT COUNT(*) FROM posts", (), 'SELECT count(*) AS "count" FROM posts'),
    "count_where": Case("posts", "SELECT COUNT(*) FROM posts WHERE cents > ? AND score != ?", (10000000, 1), 'SELECT count(*) AS "count" FROM posts WHERE cents > 10000000 AND score IS DISTINCT FROM 1'),
    "count_pk": Case("posts", "SELECT COUNT(*) FROM posts WHERE id = ?", (T7,), f"SELECT count(*) AS \"count\" FROM posts WHERE id = '{T7}'"),
    "count_indexed": Case("users", "SELECT COUNT(*) FROM users WHERE segment = ?", ("MACHINERY",), "SELECT count(*) AS \"count\" FROM users WHERE segment = 'MACHINERY'"),
    "join_inner_pk": Case("posts users", "SELECT p.id, u.name FROM posts p JOIN users u ON p.author = u.id", (), "SELECT p.id, u.name FROM posts p JOIN users u ON p.author = u.id"),
    "join_inner_idx": Case("users posts", "SELECT u.id, p.id FROM users u INNER JOIN posts p ON u.id = p.author WHERE u.segment = ?", ("BUILDING",), "SELECT u.id AS uid, p.id AS pid FROM users u JOIN posts p ON u.id = p.author WHERE u.segment = 'BUILDING'", ("uid", "pid")),
    "join_left": Case("users posts_f", "SELECT u.name, p.cents FROM users u LEFT OUTER JOIN posts_f p ON u.id = p.author", (), "SELECT u.name, p.cents FROM users u LEFT JOIN posts_f p ON u.id = p.author"),
    "join_right": Case("posts_f users", "SELECT p.cents, u.name FROM posts_f p RIGHT JOIN users u ON p.author = u.id", (), "SELECT p.cents, u.name FROM posts_f p RIGHT JOIN users u ON p.author = u.id"),
    "join_where_padded": Case("users posts_f", "SELECT u.name, p.score FROM users u LEFT JOIN posts_f p ON u.id = p.author WHERE p.score != ?", (1,), "SELECT u.name, p.score FROM users u LEFT JOIN posts_f p ON u.id = p.author WHERE p.score IS DISTINCT FROM 1"),
    "join_where_rejects": Case("users posts_f", "SELECT u.name, p.score FROM users u LEFT JOIN posts_f p ON u.id = p.author WHERE p.score = ?", (1,), "SELECT u.name, p.score FROM users u LEFT JOIN posts_f p ON u.id = p.author WHERE p.score = 1"),
    "join_order_limit": Case("users posts", "SELECT p.id, u.name, p.day FROM users u JOIN posts p ON u.id = p.author WHERE u.segment = ? ORDER BY p.day DESC LIMIT 10 OFFSET 20", ("BUILDING",), "SELECT p.id, u.name, p.day FROM users u JOIN posts p ON u.id = p.author WHERE u.segment = 'BUILDING' ORDER BY p.day DESC, u.id, p.id LIMIT 10 OFFSET 20"),
    "join_star": Case("posts users", "SELECT * FROM posts p JOIN users u ON p.author = u.id WHERE p.status = ?", ("P",), "SELECT p.id AS p0, p.author AS p1, p.status AS p2, p.cents AS p3, p.day AS p4, p.prio AS p5, p.score AS p6, u.id AS u0, u.name AS u1, u.nation AS u2, u.segment AS u3, u.cents AS u4, u.grp AS u5 FROM posts p JOIN users u ON p.author = u.id WHERE p.status = 'P'", ("p0", "p1", "p2", "p3", "p4", "p5", "p6", "u0", "u1", "u2", "u3", "u4", "u5")),
    "join_text_uuid_index": Case("users posts", "SELECT u.id, p.id FROM users u JOIN posts p ON u.name = p.author", (), "SELECT u.id AS uid, p.id AS pid FROM users u JOIN posts p ON false", ("uid", "pid")),
    "order_nulls_first": Case("posts", "SELECT id, score FROM posts ORDER BY score LIMIT 25", (), "SELECT id, score FROM posts ORDER BY score NULLS FIRST, id LIMIT 25"),
    "order_desc_nulls_last": Case("posts", "SELECT id, score FROM posts WHERE cents < ? ORDER BY score DESC LIMIT 25", (20000000,), "SELECT id, score FROM posts WHERE cents < 20000000 ORDER BY score DESC NULLS LAST, id LIMIT 25"),
    "order_unprojected": Case("evt", "SELECT id FROM evt ORDER BY cents DESC LIMIT 12", (), "SELECT id FROM evt ORDER BY cents DESC NULLS LAST, id LIMIT 12"),
    "offset_alone": Case("users", "SELECT id FROM users ORDER BY id OFFSET 100", (), "SELECT id FROM users ORDER BY id OFFSET 100"),
    "limit_zero": Case("users", "SELECT id FROM users LIMIT 0", (), "SELECT id FROM users LIMIT 0"),
}


def _changed(*tables: str):
    """Decorates a function over an engine with these tables; it returns the result."""

    def wrap(f: Callable[[Engine], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(bridge(spark, sf_dir, *tables))

    return wrap


@_changed("posts")
def update_scan(e: Engine) -> DataFrame:
    e.exec("UPDATE posts SET cents = cents + ?, day = day - cents WHERE NOT score < ?", 100, 3)
    return e.table("posts")


@_changed("posts")
def update_index(e: Engine) -> DataFrame:
    e.exec("UPDATE posts SET prio = ? WHERE status = ? AND day < ?", "late", "F", 9500)
    return e.table("posts")


@_changed("users")
def update_pk(e: Engine) -> DataFrame:
    for n in (1, 2, 3):
        e.exec("UPDATE users SET grp = ?, cents = cents * ? WHERE id = ?", None, 2, tid(n))
    return e.table("users")


@_changed("posts")
def delete_scan(e: Engine) -> DataFrame:
    e.exec("DELETE FROM posts WHERE cents > ? OR score IS NULL", 15000000)
    return e.table("posts")


@_changed("users")
def delete_index(e: Engine) -> DataFrame:
    e.exec("DELETE FROM users WHERE segment = ? AND cents < ?", "BUILDING", 0)
    e.exec("DELETE FROM users WHERE id = ?", tid(4))
    return e.table("users")


@_changed("users")
def insert_rows(e: Engine) -> DataFrame:
    marks = ", ".join("(?, ?, ?, ?, ? + ?, ?)" for _ in range(50))
    args = [x for n in range(50) for x in (tid(10**9 + n), f"new {n}", n % 25, "NEW", n * 100, n, None if n % 3 else n)]
    e.exec(f"INSERT INTO users (id, name, nation, segment, cents, grp) VALUES {marks}", *args)
    return e.df("SELECT id, name, cents, grp FROM users WHERE cents >= ?", 0)


@_changed("messages")
def insert_partitioned(e: Engine) -> DataFrame:
    e.exec("INSERT INTO messages (id, thread, seq, role, body) VALUES (?, ?, ?, ?, ?), (?, ?, ?, ?, ?)", tid(5 * 10**8), T7, 1000, "user", "one", tid(5 * 10**8 + 1), T7, 1001, "user", "two")
    return e.df("SELECT id, seq, body FROM messages WHERE thread = ? ORDER BY seq DESC LIMIT 5", T7)


@_changed("users")
def transaction(e: Engine) -> DataFrame:
    with e.transaction() as tx:
        tx.exec("UPDATE users SET cents = cents - ? WHERE id = ?", 500, tid(1))
        tx.exec("UPDATE users SET cents = cents + ? WHERE id = ?", 500, tid(2))
        tx.exec("UPDATE users SET cents = cents + ? WHERE id = ?", 1, tid(1))
        tx.exec("DELETE FROM users WHERE id = ?", tid(3))
    return e.table("users")


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine.open(spark)
    e.exec_script(
        "CREATE TABLE cfg (id uuid PRIMARY KEY, k text, v text NULL, n int); -- a comment\n"
        f"INSERT INTO cfg (id, k, v, n) VALUES ('{tid(1)}', 'a;b', 'it''s', 1), ('{tid(2)}', 'c', NULL, 2); UPDATE cfg SET n = n + 5 WHERE k = 'c'; DELETE FROM cfg WHERE k = 'zzz';"
    )
    return e.table("cfg")


def _kept(spark: SparkSession, sf_dir: str, place: str) -> None:
    """A durable store with rows and changes of every kind."""
    rows = bridge(spark, sf_dir, "users").table("users")
    with Engine.open(spark, place) as e:
        e.register(USERS, rows)
        e.exec("UPDATE users SET cents = cents + ? WHERE segment = ?", 7, "BUILDING")
        e.exec("DELETE FROM users WHERE id = ?", tid(5))
        e.exec("INSERT INTO users (id, name, nation, segment, cents) VALUES (?, ?, ?, ?, ?)", tid(10**9), "new", 1, "NEW", 1)


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch(spark)
    _kept(spark, sf_dir, place)
    return Engine.open(spark, place).table("users")


def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch(spark)
    _kept(spark, sf_dir, place)
    with Engine.open(spark, place) as e:
        e.compact()
    return Engine.open(spark, place).table("users")


def drain_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch(spark)
    _kept(spark, sf_dir, place)
    e = Engine.open(spark, place)
    query = drain(e)
    query.awaitTermination()
    return e.table("users")


def ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge(spark, sf_dir, "evt")
    e.exec("CREATE TABLE kinds (id uuid PRIMARY KEY, actor uuid PARTITION KEY, ts_us int IMMUTABLE, kind text, cents int NULL)")
    e.load("kinds", e.table("evt"))
    e.exec("DROP TABLE evt")
    e.register(EVT, e.df("SELECT * FROM kinds WHERE kind != ?", "click"))
    return e.df("SELECT id, kind, cents FROM evt WHERE cents > ?", 0)


def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of the engine's own JSON, one a row."""
    return bridge(spark, sf_dir, "posts").json_rows("SELECT id, status, score FROM posts WHERE cents > ?", 20000000)


def prepared_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge(spark, sf_dir, "posts")
    stmt = e.prepare("SELECT id, cents FROM posts WHERE status = ?")
    before = stmt.query_row("O")[1]
    rows = e.table("posts").filter("status = 'F'")
    e.exec("DROP TABLE posts")
    e.register(TableDef("posts", (*POSTS.columns, ColumnDef("note", "text", nullable=True)), POSTS.indexes), rows.withColumn("note", F.lit(None).cast("string")))
    assert before is not None and stmt.query_row("O")[1] is None
    return stmt.df("F")


def recovered_sql(more: str = "") -> str:
    return sql(f"SELECT id, name, nation, segment, cents + CASE WHEN segment = 'BUILDING' THEN 7 ELSE 0 END AS cents, grp FROM users WHERE id <> '{tid(5)}' UNION ALL SELECT '{tid(10**9)}', 'new', 1, 'NEW', 1, NULL{more}", "users")


_NEW = f"SELECT {_TID('1000000000 + n')} AS id, 'new ' || n AS name, n * 100 + n AS cents, CASE WHEN n % 3 = 0 THEN n END AS grp FROM (SELECT CAST(range AS BIGINT) AS n FROM range(50))"
CHANGES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "update_scan": (update_scan, sql("SELECT id, author, status, cents + CASE WHEN NOT coalesce(score < 3, false) THEN 100 ELSE 0 END AS cents, CASE WHEN NOT coalesce(score < 3, false) THEN day - cents ELSE day END AS day, prio, score FROM posts", "posts")),
    "update_index": (update_index, sql("SELECT id, author, status, cents, day, CASE WHEN status = 'F' AND day < 9500 THEN 'late' ELSE prio END AS prio, score FROM posts", "posts")),
    "update_pk": (update_pk, sql(f"SELECT id, name, nation, segment, CASE WHEN id IN ('{tid(1)}', '{tid(2)}', '{tid(3)}') THEN cents * 2 ELSE cents END AS cents, CASE WHEN id IN ('{tid(1)}', '{tid(2)}', '{tid(3)}') THEN NULL ELSE grp END AS grp FROM users", "users")),
    "delete_scan": (delete_scan, sql("SELECT * FROM posts WHERE NOT (cents > 15000000 OR score IS NULL)", "posts")),
    "delete_index": (delete_index, sql(f"SELECT * FROM users WHERE NOT (segment = 'BUILDING' AND cents < 0) AND id <> '{tid(4)}'", "users")),
    "insert_rows": (insert_rows, sql(f"SELECT id, name, cents, grp FROM users WHERE cents >= 0 UNION ALL {_NEW}", "users")),
    "insert_partitioned": (insert_partitioned, sql(f"SELECT id, seq, body FROM (SELECT id, seq, body FROM messages WHERE thread = '{T7}' UNION ALL SELECT '{tid(5 * 10**8)}', 1000, 'one' UNION ALL SELECT '{tid(5 * 10**8 + 1)}', 1001, 'two') ORDER BY seq DESC, id LIMIT 5", "messages")),
    "transaction": (transaction, sql(f"SELECT id, name, nation, segment, cents + CASE id WHEN '{tid(1)}' THEN -499 WHEN '{tid(2)}' THEN 500 ELSE 0 END AS cents, grp FROM users WHERE id <> '{tid(3)}'", "users")),
    "script": (script, f"SELECT '{tid(1)}' AS id, 'a;b' AS k, 'it''s' AS v, CAST(1 AS BIGINT) AS n UNION ALL SELECT '{tid(2)}', 'c', NULL, 7"),
    "recovery": (recovery, recovered_sql()),
    "compaction": (compaction, recovered_sql()),
    "drain_stream": (drain_stream, recovered_sql()),
    "ddl": (ddl, sql("SELECT id, kind, cents FROM evt WHERE kind <> 'click' AND cents > 0", "evt")),
    "json_objects": (json_objects, sql("SELECT CAST(to_json({'id': id, 'status': status, 'score': score}) AS VARCHAR) AS object FROM posts WHERE cents > 20000000", "posts")),
    "prepared_rebind": (prepared_rebind, sql("SELECT id, cents FROM posts WHERE status = 'F'", "posts")),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: case.run for name, case in CASES.items()} | {name: run for name, (run, _) in CHANGES.items()}
SQL: dict[str, str] = {name: case.oracle() for name, case in CASES.items()} | {name: same for name, (_, same) in CHANGES.items()}
FLAGSHIP = "join_order_limit"
