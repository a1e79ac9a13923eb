"""Queries that show what callers of the engine see: values, JSON, requests, refusals, state after restarts; with SQL that gives the same rows."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from larkspur import errors, registry, wire
from larkspur.engine import Engine
from larkspur.queries import sql, tid
from larkspur.service import Functions, Service
from larkspur.sources.bridge import POSTS, USERS, bridge
from larkspur.sources.schema import ColumnDef, IndexDef, TableDef
from larkspur.sources.store import scratch

T7 = tid(7)
#: Posts whose author is found by the first column of an index of two.
POSTS_BY_DAY = TableDef("posts", POSTS.columns, (IndexDef("", ("author", "day"), True), IndexDef("", ("status", "day"), True)))


def told(spark: SparkSession, kinds: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([tuple(str(v) if isinstance(v, uuid.UUID) else v for v in r) for r in rows], kinds)


def values(kinds: str, rows: list[tuple]) -> str:
    """Rows as SQL; ``kinds`` as ``told`` takes them."""
    names, types = zip(*(x.split() for x in kinds.split(", ")), strict=True)
    of = {"string": "VARCHAR", "long": "BIGINT", "boolean": "BOOLEAN"}
    spell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(f"CAST({spell(v)} AS {of[t]})" for v, t in zip(r, types, strict=True)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


def by_day(spark: SparkSession, sf_dir: str) -> Engine:
    e = bridge(spark, sf_dir, "users", "posts")
    rows = e.table("posts")
    e.exec("DROP TABLE posts")
    e.register(POSTS_BY_DAY, rows)
    return e


# Joins, limits and names.
def join_composite_leading(spark, sf_dir):
    return by_day(spark, sf_dir).df("SELECT u.name, p.cents FROM users u LEFT JOIN posts p ON u.id = p.author WHERE p.status = ?", "P")


def join_probe_walk(spark, sf_dir):
    out = by_day(spark, sf_dir).df("SELECT u.name, p.id, p.day FROM users u JOIN posts p ON u.id = p.author WHERE u.id = ? ORDER BY p.day DESC LIMIT 5", T7)
    return out.toDF("name", "pid", "day")


def join_driver_walk(spark, sf_dir):
    return bridge(spark, sf_dir, "users", "posts").df("SELECT u.cents, p.id FROM users u JOIN posts p ON u.id = p.author ORDER BY u.cents LIMIT 25")


def join_composite_walk(spark, sf_dir):
    return bridge(spark, sf_dir, "users", "posts").df("SELECT p.id, p.day, u.name FROM posts p JOIN users u ON p.author = u.id WHERE p.status = ? ORDER BY p.day DESC LIMIT 15", "O")


def join_text_key(spark, sf_dir):
    """Texts that spell keys, in capitals, probe the key's own form."""
    e = bridge(spark, sf_dir, "users", "posts")
    notes = TableDef("notes", (ColumnDef("id", "uuid", pk=True), ColumnDef("author", "text")))
    e.register(notes, e.table("posts").filter("status = 'P'").selectExpr("id", "upper(author) AS author"))
    return e.df("SELECT n.id, u.name FROM notes n LEFT JOIN users u ON n.author = u.id").toDF("nid", "name")


def early_stop(spark, sf_dir):
    """Limits without an order: how many rows come, and how many of them are rows of the whole result."""
    e = bridge(spark, sf_dir, "users", "posts")
    rows = []
    for name, statement in (("join", "SELECT p.id FROM users u JOIN posts p ON u.id = p.author WHERE p.status = ?"), ("scan", "SELECT id FROM posts WHERE status = ?")):
        some = e.df(f"{statement} LIMIT 7 OFFSET 2", "F").cache()
        rows.append((name, some.count(), some.join(e.df(statement, "F").distinct(), "id", "left_semi").distinct().count()))
        some.unpersist()
    return told(spark, "path string, n long, valid long", rows)


def pk_limit_offset(spark, sf_dir):
    e = bridge(spark, sf_dir, "posts")
    cases = ("LIMIT 1", "LIMIT 0", "OFFSET 1", "LIMIT 5 OFFSET 0", "LIMIT 5 OFFSET 1")
    return told(spark, "clause string, n long", [(c, len(e.query(f"SELECT id FROM posts WHERE id = ? {c}", T7)[1])) for c in cases])


def pk_single_row(spark, sf_dir):
    e = bridge(spark, sf_dir, "posts")
    none = e.query_row("SELECT id FROM posts WHERE id = ?", tid(2**40))[1]
    return told(spark, "id string, status string, score long, missing boolean", [(*e.query_row("SELECT id, status, score FROM posts WHERE id = ?", T7)[1], none is None)])


NAMES = [
    ("SELECT * FROM posts p JOIN users u ON p.author = u.id", "p.id,p.author,p.status,p.cents,p.day,p.prio,p.score,u.id,u.name,u.nation,u.segment,u.cents,u.grp"),
    ("SELECT * FROM posts JOIN users u ON posts.author = u.id", "posts.id,posts.author,posts.status,posts.cents,posts.day,posts.prio,posts.score,u.id,u.name,u.nation,u.segment,u.cents,u.grp"),
    ("SELECT u.id, p.id, name FROM posts p JOIN users u ON p.author = u.id", "id,id,name"), ("SELECT x.id, id FROM posts x", "id,id"), ("SELECT COUNT(*) FROM posts", "count"), ("SELECT * FROM users; -- all", "id,name,nation,segment,cents,grp"),
]


def output_names(spark, sf_dir):
    e = bridge(spark, sf_dir, "users", "posts")
    return told(spark, "statement string, names string", [(s, ",".join(e.prepare(s).columns)) for s, _ in NAMES])


# Refusals.
DEEP = "SELECT id FROM posts WHERE " + "(" * 300 + "day = ?" + ")" * 300
REFUSED = [
    ("SELECT COUNT(*) FROM posts ORDER BY id", (), "ParseError"), ("SELECT COUNT(*) FROM posts LIMIT 1", (), "ParseError"), ("SELECT COUNT(*) FROM posts OFFSET 1", (), "ParseError"), ("SELECT COUNT(*) FROM posts p JOIN users u ON p.author = u.id", (), "ParseError"),
    ("SELECT u.id FROM users u JOIN posts p ON u.nation = p.day", (), "UnindexedJoin"), ("SELECT u.id FROM posts p LEFT JOIN users u ON p.day = u.nation", (), "UnindexedJoin"), ("SELECT id FROM users u JOIN posts p ON u.id = p.author", (), "UnknownColumn"),
    ("SELECT x.id FROM users u JOIN posts p ON u.id = p.author", (), "UnknownColumn"), ("SELECT u.id FROM users u JOIN posts p ON u.id = u.grp", (), "ParseError"), ("SELECT a.id FROM users a JOIN users b ON a.id = b.id", (), "ParseError"),
    ("SELECT u.id FROM users u JOIN posts p ON u.id = p.author JOIN posts_f f ON u.id = f.author", (), "ParseError"), ("SELECT u.id FROM users u FULL JOIN posts p ON u.id = p.author", (), "ParseError"),
    ("SELECT id FROM posts WHERE day = 5", (), "ParseError"), ("SELECT id FROM posts WHERE status = 'F'", (), "ParseError"), ("UPDATE posts SET day = 5 WHERE id = ?", (T7,), "ParseError"), ("INSERT INTO users (name, nation, segment, cents) VALUES (?, 1, ?, ?)", ("a", "b", 1), "ParseError"),
    (DEEP, (1,), "ParseError"), ("SELECT id FROM posts WHERE id = ?", ("no key",), "TypeMismatch"), ("SELECT id FROM posts WHERE day = ?", (1.5,), "TypeMismatch"), ("SELECT id FROM posts WHERE day = ?", (), "ParamMismatch"), ("SELECT id FROM posts WHERE day = ?", (1, 2), "ParamMismatch"),
    ("SELECT id FROM nobody", (), "UnknownTable"), ("SELECT nothing FROM posts", (), "UnknownColumn"), ("SELECT id FROM posts WHERE day IN (?)", (1,), "ParseError"), ("SELECT id, day FROM posts GROUP BY day", (), "ParseError"), ("SELECT id FROM posts WHERE day = ? = ?", (1, 1), "ParseError"),
    ("UPDATE posts SET id = ?", (T7,), "PKUpdate"), ("UPDATE messages SET thread = ?", (T7,), "PKUpdate"), ("UPDATE messages SET seq = ?", (1,), "PKUpdate"), ("UPDATE posts SET status = ?", (None,), "TypeMismatch"), ("UPDATE posts SET day = status + ? WHERE id = ?", (1, T7), "TypeMismatch"),
    ("INSERT INTO users (id, name, nation, segment, cents) VALUES (?, ?, ?, ?, ?)", (T7, "a", 1, "b", 1), "DuplicatePK"), ("INSERT INTO users (name) VALUES (?)", ("a",), "ParseError"), ("INSERT INTO users (name, name, nation, segment, cents) VALUES (?, ?, ?, ?, ?)", ("a", "b", 1, "c", 1), "ParseError"),
    ("CREATE TABLE posts (id uuid PRIMARY KEY)", (), "TableExists"), ("CREATE TABLE _hz_x (id uuid PRIMARY KEY)", (), "ReservedName"), ("DROP TABLE nobody", (), "UnknownTable"), ("DELETE posts", (), "ParseError"), ("SELECT id FROM posts AS p", (), "ParseError"),
]


def refused(spark, sf_dir):
    e = bridge(spark, sf_dir, "users", "posts", "posts_f", "messages")
    rows = []
    for statement, args, _ in REFUSED:
        try:
            (e.query if statement.startswith("SELECT") else e.exec)(statement, *args)
            got = "none"
        except errors.EngineError as x:
            got = type(x).__name__
        rows.append((statement, repr(args), got))
    return told(spark, "statement string, args string, error string", rows)


CLASSES = "BatchTooLarge CapacityError CatalogTooLarge ClosedError CompanionInMemory DuplicatePK MirrorCorrupt MirrorSchema PKUpdate ParamMismatch ParseError ReservedName TableExists TooManyTables TxConflict TxUnsupported TypeMismatch UnindexedJoin UnknownColumn UnknownTable WALCorrupt WALVersion".split()


def error_classes(spark, sf_dir):
    found = [k for k, v in vars(errors).items() if isinstance(v, type) and issubclass(v, errors.EngineError) and v is not errors.EngineError]
    return told(spark, "name string", [(k,) for k in found])


# Values and JSON.
def query_values(spark, sf_dir):
    e = bridge(spark, sf_dir, "posts")
    e.exec_values("UPDATE posts SET score = ? WHERE id = ?", [99, T7])
    many = e.df("SELECT id, score FROM posts WHERE status = ? AND day < ? ORDER BY id", "P", 9500)
    return many.union(told(spark, "id string, score long", [tuple(e.query_row_values("SELECT id, score FROM posts WHERE id = ?", [T7])[1])]))


def query_rows(spark, sf_dir):
    """Keys come as UUIDs, bytes as bytes."""

    def sized(_: list[str], row: list[Any]) -> tuple | None:
        k, lang, n, raw = row
        return (str(k), lang, n, len(raw)) if isinstance(k, uuid.UUID) and isinstance(raw, bytes) else None

    return bridge(spark, sf_dir, "docs").mapped(sized, "id string, lang string, n long, size long", "SELECT id, lang, n, raw FROM docs WHERE n < ?", 200)


def query_each(spark, sf_dir):
    seen: list[tuple] = []
    bridge(spark, sf_dir, "users").query_each("SELECT id, name FROM users WHERE segment = ? ORDER BY name DESC", ["BUILDING"], lambda names, row: seen.append(tuple(row)) or len(seen) < 6)
    return told(spark, "id string, name string", seen)


def query_json(spark, sf_dir):
    e = bridge(spark, sf_dir, "docs", "posts")
    into = bytearray()
    names = e.query_json_into(into, "SELECT id, status, score FROM posts WHERE day < ? ORDER BY id", 9140)
    return told(spark, "kind string, body string", [("bytes", e.query_json("SELECT id, n, raw FROM docs WHERE n < ? ORDER BY id", 60)[1].decode()), ("nulls", into.decode()), ("names", ",".join(names))])


def rows_json(spark, sf_dir):
    e = bridge(spark, sf_dir, "posts")
    names, rows = e.query("SELECT id, score, prio FROM posts WHERE day < ? ORDER BY id", 9140)
    return told(spark, "kind string, body string", [("rows", wire.rows_to_json(names, rows).decode()), ("objects", wire.rows_to_json_objects(names, rows[:2]).decode()), ("object", wire.row_to_json_object(names, rows[0]).decode()), ("exec", wire.exec_result_json(3).decode()), ("error", wire.error_json('a "b"').decode())])


def row_json_by_key(spark, sf_dir):
    e = bridge(spark, sf_dir, "posts", "users")
    rows = [e.query_row_json_by_pk("SELECT id, score FROM posts WHERE id = ?", T7), e.query_row_json_by_pk("SELECT id FROM posts WHERE id = ?", tid(2**40)), e.query_row_json_by_index("SELECT grp, nation FROM users WHERE cents = ?", e.query_row("SELECT cents FROM users WHERE id = ?", T7)[1][0])]
    return told(spark, "nth long, body string", [(k, None if r is None else r.decode()) for k, r in enumerate(rows)])


def prepared_statement(spark, sf_dir):
    e = bridge(spark, sf_dir, "users")
    stmt, write = e.prepare("SELECT id, cents FROM users WHERE segment = ?"), e.prepare("UPDATE users SET cents = cents + ? WHERE id = ?")
    write.exec(5, T7)
    one = e.prepare("SELECT id, cents FROM users WHERE id = ?").query_row_by_pk(T7)[1]
    return stmt.df("BUILDING").union(told(spark, "id string, cents long", [one]))


def store_meta(spark, sf_dir):
    m = bridge(spark, sf_dir, "users", "posts", "messages").meta()
    kinds = "name string, rows long, columns long, indexes long, partitioned boolean, bytes long"
    return told(spark, kinds, [tuple(t[k] for k in ("name", "rows", "columns", "indexes", "partitioned", "bytes")) for t in m["tables"]])


def registered(spark, sf_dir):
    e, other = bridge(spark, sf_dir, "users"), Engine.open(spark)
    name = uuid.uuid4().hex
    slot = registry.register(name, e)
    found = [registry.lookup(name) is e, registry.lookup_slot(name) == (slot, e)]
    again = registry.register(name, other)
    found += [registry.deregister_if(name, slot), registry.lookup(name) is other, registry.deregister_if(name, again), registry.lookup(name) is None]
    return told(spark, "nth long, yes boolean", list(enumerate(found)))


# Requests.
POST = "SELECT id, score FROM posts WHERE id = ?"


def requests(spark, sf_dir):
    s = Service(bridge(spark, sf_dir, "users", "posts"), largest_body=2000)
    ask = lambda sql, *args: json.dumps({"sql": sql, "args": list(args)}).encode()
    sent: list[tuple[str, str, dict, bytes]] = [
        ("GET", "/get", {"table": "posts", "id": T7, "cols": "id,score"}, b""), ("GET", "/get", {"table": "posts", "id": tid(2**40)}, b""), ("GET", "/get", {"table": "users", "col": "name", "val": "Customer#000000007", "cols": "id"}, b""),
        ("GET", "/list", {"table": "users", "cols": "id", "col": "segment", "val": "nothing", "limit": "3"}, b""), ("POST", "/query", {}, ask(POST, T7)), ("POST", "/exec", {}, ask("UPDATE posts SET score = ? WHERE id = ?", 42, T7)), ("POST", "/query", {}, ask(POST, T7)),
        ("POST", "/exec", {}, ask("DELETE FROM posts WHERE id = ?", tid(2**40))), ("GET", "/exec", {}, b""), ("POST", "/get", {}, b""), ("POST", "/exec", {}, b" " * 3000), ("GET", "/list", {"table": "users; DROP TABLE users"}, b""), ("GET", "/get", {"table": "users", "col": "name = name OR name", "val": "x"}, b""),
        ("POST", "/query", {}, b"no json"), ("GET", "/nowhere", {}, b""),
    ]
    rows = []
    for k, (method, path, params, body) in enumerate(sent):
        status, out = s.handle(method, path, params, body)
        rows.append((k, f"{method} {path}", status, out.decode() if status == 200 else None))
    listed = json.loads(s.handle("GET", "/list", {"table": "users", "cols": "id"})[1])
    found = json.loads(s.handle("GET", "/meta")[1])
    rows.append((100, "GET /list", len(listed), str(len({x["id"] for x in listed}))))
    rows += [(101 + k, "GET /meta", t["rows"], t["name"]) for k, t in enumerate(found["tables"])]
    return told(spark, "nth long, request string, status long, body string", rows)


_ONE = "(SELECT '{\"id\":\"' || id || '\",\"score\":' || coalesce(CAST(score AS VARCHAR), 'null') || '}' FROM posts WHERE id = '" + T7 + "')"
_TABLE = "(SELECT '{\"columns\":[\"id\",\"score\"],\"rows\":[[\"' || id || '\",' || @ || ']]}' FROM posts WHERE id = '" + T7 + "')"
REQUESTS_SQL = sql(
    f"""SELECT CAST(nth AS BIGINT) AS nth, request, CAST(status AS BIGINT) AS status, body FROM (
  SELECT 0 AS nth, 'GET /get' AS request, 200 AS status, {_ONE} AS body UNION ALL SELECT 1, 'GET /get', 200, 'null'
  UNION ALL SELECT 2, 'GET /get', 200, coalesce((SELECT '{{"id":"' || min(id) || '"}}' FROM users WHERE name = 'Customer#000000007'), 'null') UNION ALL SELECT 3, 'GET /list', 200, '[]'
  UNION ALL SELECT 4, 'POST /query', 200, {_TABLE.replace("@", "coalesce(CAST(score AS VARCHAR), 'null')")} UNION ALL SELECT 5, 'POST /exec', 200, '{{"affected":1}}' UNION ALL SELECT 6, 'POST /query', 200, {_TABLE.replace("@", "'42'")}
  UNION ALL SELECT 7, 'POST /exec', 200, '{{"affected":0}}' UNION ALL SELECT 8, 'GET /exec', 405, NULL UNION ALL SELECT 9, 'POST /get', 405, NULL UNION ALL SELECT 10, 'POST /exec', 413, NULL
  UNION ALL SELECT 11, 'GET /list', 400, NULL UNION ALL SELECT 12, 'GET /get', 400, NULL UNION ALL SELECT 13, 'POST /query', 400, NULL UNION ALL SELECT 14, 'GET /nowhere', 404, NULL
  UNION ALL SELECT 100, 'GET /list', count(*), CAST(count(*) AS VARCHAR) FROM users UNION ALL SELECT 101, 'GET /meta', count(*), 'users' FROM users UNION ALL SELECT 102, 'GET /meta', count(*), 'posts' FROM posts)""",
    "users", "posts",
)


def functions(spark, sf_dir):
    f = Functions(bridge(spark, sf_dir, "users", "posts"))
    text = lambda x: json.dumps(x, separators=(",", ":"))
    rows = [
        ("fetch", text(f.fetch(POST, T7))), ("fetch", text(f.fetch(POST, [tid(2**40)]))), ("fetchall", text(f.fetchall("SELECT id, score FROM posts WHERE id = ?", [T7]))), ("fetchall", text(f.fetchall(POST, [tid(2**40)]))),
        ("fetchall_json", f.fetchall_json(POST, T7)), ("exec", text(f.exec("DELETE FROM posts WHERE id = ?", [T7]))), ("exec", text(f.exec("DELETE FROM nobody"))),
        ("transaction", text(f.transaction([("UPDATE users SET cents = ? WHERE id = ?", [1, T7]), ("DELETE FROM users WHERE id = ?", [tid(8)])]))), ("ping", text(f.ping())), *(("meta", f"{t['name']} {t['rows']}") for t in f.meta()["tables"]),
    ]
    return told(spark, "nth long, called string, got string", [(k, *r) for k, r in enumerate(rows)])


FUNCTIONS_SQL = sql(
    f"""SELECT CAST(nth AS BIGINT) AS nth, called, got FROM (SELECT 0 AS nth, 'fetch' AS called, {_ONE} AS got UNION ALL SELECT 1, 'fetch', 'null' UNION ALL SELECT 2, 'fetchall', '[' || {_ONE} || ']' UNION ALL SELECT 3, 'fetchall', '[]'
  UNION ALL SELECT 4, 'fetchall_json', '[' || {_ONE} || ']' UNION ALL SELECT 5, 'exec', '1' UNION ALL SELECT 6, 'exec', '-1' UNION ALL SELECT 7, 'transaction', '2' UNION ALL SELECT 8, 'ping', 'true'
  UNION ALL SELECT 9, 'meta', 'users ' || (count(*) - 1) FROM users UNION ALL SELECT 10, 'meta', 'posts ' || (count(*) - 1) FROM posts)""",
    "users", "posts",
)


# Writes and state.
def update_probe(spark, sf_dir):
    e = bridge(spark, sf_dir, "posts")
    for key, most in ((T7, 2**60), (tid(1), -1), (tid(2), 2**60)):
        e.exec("UPDATE posts SET day = day + ?, prio = ? WHERE cents < ? AND id = ?", 1, "probed", most, key)
    e.exec("DELETE FROM posts WHERE id = ? AND cents < ?", tid(3), 2**60)
    return e.df("SELECT id, day, prio FROM posts WHERE id = ? OR id = ? OR id = ? OR id = ?", T7, tid(1), tid(2), tid(3))


def auto_keys(spark, sf_dir):
    """Keys made for 1,500 rows: how many, how many unlike ones, of version 7, and above the one before."""
    e = Engine.open(spark)
    e.exec("CREATE TABLE t (id uuid PRIMARY KEY, n int)")
    for part in (range(1000), range(1000, 1500)):
        e.exec("INSERT INTO t (n) VALUES " + ", ".join(["(?)"] * len(part)), *part)
    keys = [r[0] for r in e.query("SELECT id FROM t ORDER BY n")[1]]
    return told(spark, "n long, unlike long, version long, rising long", [(len(keys), len(set(keys)), sum(k.version == 7 for k in keys), sum(a < b for a, b in zip(keys, keys[1:], strict=False)))])


def _users(spark: SparkSession, sf_dir: str, place: str) -> Engine:
    e = Engine.open(spark, place)
    e.register(USERS, bridge(spark, sf_dir, "users").table("users"))
    return e


def capacity(spark, sf_dir):
    """Bytes that a table counts for: loaded, after changes of many and of few rows, after a restart, after compaction; and what a limit refuses."""
    place = scratch(spark)
    e = _users(spark, sf_dir, place)
    rows = [("loaded", e.store.used())]
    e.exec("UPDATE users SET segment = ? WHERE cents > ?", "a longer segment", 0)
    e.exec("DELETE FROM users WHERE id = ?", T7)
    e.exec("INSERT INTO users (id, name, nation, segment, cents) VALUES (?, ?, ?, ?, ?)", tid(10**9), "né", 1, "", 1)
    rows.append(("changed", e.store.used()))
    e.close()
    e = Engine.open(spark, place)
    rows.append(("reopened", e.store.used()))
    e.compact()
    rows.append(("compacted", e.store.used()))
    e.close()
    full = Engine.open(spark, place, max_bytes=rows[-1][1] + 100)
    try:
        full.exec("INSERT INTO users (id, name, nation, segment, cents) VALUES (?, ?, ?, ?, ?)", tid(10**9 + 1), "x", 1, "", 1)
    except errors.CapacityError:
        rows.append(("refused", full.store.used()))
    return told(spark, "stage string, bytes long", rows)


_COST = "32 * 6 + 64 + 48 * 3 + octet_length(encode(name)) + octet_length(encode(segment))"
_AFTER = f"(SELECT sum({_COST}) FROM (SELECT name, CASE WHEN cents > 0 THEN 'a longer segment' ELSE segment END AS segment FROM users WHERE id <> '{T7}' UNION ALL SELECT 'né', ''))"
CAPACITY_SQL = sql(f"SELECT stage, CAST(bytes AS BIGINT) AS bytes FROM (SELECT 'loaded' AS stage, sum({_COST}) AS bytes FROM users " + "".join(f"UNION ALL SELECT '{x}', {_AFTER} " for x in ("changed", "reopened", "compacted", "refused")) + ")", "users")


def recovery_ddl(spark, sf_dir):
    """Definitions come back from the log alone: created, dropped, created again, in several segments."""
    place = scratch(spark)
    with Engine.open(spark, place) as e:
        e.exec("CREATE TABLE a (id uuid PRIMARY KEY, n int)")
        e.exec("INSERT INTO a (id, n) VALUES (?, ?)", tid(1), 1)
        e.flush()
        e.exec("DROP TABLE a")
        e.exec("CREATE TABLE a (id uuid PRIMARY KEY, s text NULL, thread uuid NULL, ORDERED INDEX(s))")
        e.flush()
        e.exec("INSERT INTO a (id, s) VALUES (?, ?), (?, ?)", tid(2), "two", tid(3), None)
    e = Engine.open(spark, place)
    return told(spark, "id string, s string, path string, sealed long", [(*r, e.explain("SELECT id FROM a WHERE s = ?"), e.store.segment) for r in e.query("SELECT id, s FROM a")[1]])


def _damage(e: Engine, segment: int, record: int) -> None:
    """Spoils a record of a sealed segment."""
    name = f"log/{segment:012d}"
    lines = e.store.files.read(name).split(b"\n")
    lines[record] = lines[record][:-1] + bytes([lines[record][-1] ^ 1])
    e.store.files.delete(name)
    e.store.files.write_new(name, b"\n".join(lines))


def recovery_damaged(spark, sf_dir):
    """Changes after a damaged record stand in their order: a change of many rows, and one of few after it."""
    place = scratch(spark)
    e = _users(spark, sf_dir, place)
    for k in range(5):
        e.exec("UPDATE users SET grp = ? WHERE id = ?", k, tid(1))
    e.flush()
    first = e.store.segment
    e.exec("UPDATE users SET nation = nation + ? WHERE NOT id = ?", 100, tid(2))
    e.exec("UPDATE users SET nation = ? WHERE id = ?", -5, tid(1))
    e.exec("UPDATE users SET nation = ? WHERE id = ?", -6, tid(2))
    e.close()
    _damage(e, first, 3)
    e = Engine.open(spark, place)
    again = Engine.open(spark, place)
    return again.df("SELECT id, nation, grp FROM users WHERE nation < ? OR cents > ?", 0, 900000).withColumn("noted", _lit(len(e.events()) + len(again.events())))


def _lit(n: int):
    from pyspark.sql import functions as F

    return F.lit(n).cast("long")


def idle_seal(spark, sf_dir):
    """A write that nothing follows is sealed soon: another reader sees it though the writer neither flushed nor closed."""
    place = scratch(spark)
    e = Engine.open(spark, place)
    e.exec("CREATE TABLE t (id uuid PRIMARY KEY, n int)")
    e.flush()
    e.exec("INSERT INTO t (id, n) VALUES (?, ?)", tid(1), 1)
    until = time.monotonic() + 20
    while e.store.buffer and time.monotonic() < until:
        time.sleep(0.1)
    return Engine.open(spark, place).table("t")


GUARDS = [("same", "none"), ("other", "MirrorSchema"), ("closed", "ClosedError"), ("memory", "CompanionInMemory"), ("gap", "WALCorrupt"), ("version", "WALVersion")]


def guards(spark, sf_dir):
    """What opening and closing refuse."""
    place = scratch(spark)
    one = TableDef("t", (ColumnDef("id", "uuid", pk=True), ColumnDef("n", "int")))
    other = TableDef("t", (ColumnDef("id", "uuid", pk=True), ColumnDef("n", "text")))
    Engine.open(spark, place, [one]).close()

    def closed() -> None:
        e = Engine.open(spark)
        e.close()
        e.query("SELECT n FROM t")

    def spoiled(change: Callable[[Engine], Any]) -> Callable[[], Any]:
        def run() -> Engine:
            at = scratch(spark)
            with Engine.open(spark, at, [one]) as e:
                for n in range(3):
                    e.exec("INSERT INTO t (id, n) VALUES (?, ?)", tid(n), n)
                    e.flush()
                change(e)
            return Engine.open(spark, at)

        return run

    def new_format(e: Engine) -> None:
        e.store.files.delete("log/000000000002")
        e.store.files.write_new("log/000000000002", b"larkspur-log 99\n")

    tried = {
        "same": lambda: Engine.open(spark, place, [one]).close(), "other": lambda: Engine.open(spark, place, [other]), "closed": closed, "memory": lambda: Engine.open(spark).compact(),
        "gap": spoiled(lambda e: e.store.files.delete("log/000000000002")), "version": spoiled(new_format),
    }
    rows = []
    for name, _ in GUARDS:
        try:
            tried[name]()
            rows.append((name, "none"))
        except errors.EngineError as x:
            rows.append((name, type(x).__name__))
    return told(spark, "tried string, error string", rows)


_JSON_ROW = "'[\"' || id || '\",' || coalesce(CAST(score AS VARCHAR), 'null') || ',\"' || prio || '\"]'"
_JSON_OBJECT = "'{\"id\":\"' || id || '\",\"score\":' || coalesce(CAST(score AS VARCHAR), 'null') || ',\"prio\":\"' || prio || '\"}'"
_EARLY = "(SELECT * FROM posts WHERE day < 9140 ORDER BY id)"
API: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "pk_single_row": (pk_single_row, sql(f"SELECT id, status, score, true AS missing FROM posts WHERE id = '{T7}'", "posts")),
    "pk_limit_offset": (pk_limit_offset, values("clause string, n long", [("LIMIT 1", 1), ("LIMIT 0", 0), ("OFFSET 1", 0), ("LIMIT 5 OFFSET 0", 1), ("LIMIT 5 OFFSET 1", 0)])),
    "join_composite_leading": (join_composite_leading, sql("SELECT u.name, p.cents FROM users u LEFT JOIN posts p ON u.id = p.author WHERE p.status = 'P'", "users", "posts")),
    "join_probe_walk": (join_probe_walk, sql(f"SELECT u.name, p.id AS pid, p.day FROM users u JOIN posts p ON u.id = p.author WHERE u.id = '{T7}' ORDER BY p.day DESC, u.id, p.id LIMIT 5", "users", "posts")),
    "join_driver_walk": (join_driver_walk, sql("SELECT u.cents, p.id FROM users u JOIN posts p ON u.id = p.author ORDER BY u.cents, u.id, p.id LIMIT 25", "users", "posts")),
    "join_composite_walk": (join_composite_walk, sql("SELECT p.id, p.day, u.name FROM posts p JOIN users u ON p.author = u.id WHERE p.status = 'O' ORDER BY p.day DESC, p.id LIMIT 15", "users", "posts")),
    "join_text_key": (join_text_key, sql("SELECT p.id AS nid, u.name FROM posts p LEFT JOIN users u ON p.author = u.id WHERE p.status = 'P'", "users", "posts")),
    "early_stop": (early_stop, values("path string, n long, valid long", [("join", 7, 7), ("scan", 7, 7)])),
    "output_names": (output_names, values("statement string, names string", NAMES)),
    "refused": (refused, values("statement string, args string, error string", [(s, repr(a), x) for s, a, x in REFUSED])),
    "error_classes": (error_classes, values("name string", [(x,) for x in CLASSES])),
    "query_values": (query_values, sql(f"SELECT id, score FROM (SELECT id, CASE WHEN id = '{T7}' THEN 99 ELSE score END AS score, status, day FROM posts) WHERE status = 'P' AND day < 9500 UNION ALL SELECT '{T7}', 99", "posts")),
    "query_rows": (query_rows, sql("SELECT id, lang, n, CAST(octet_length(raw) AS BIGINT) AS size FROM docs WHERE n < 200", "docs")),
    "query_each": (query_each, sql("SELECT id, name FROM users WHERE segment = 'BUILDING' ORDER BY name DESC, id LIMIT 6", "users")),
    "query_json": (query_json, sql(
        """SELECT 'bytes' AS kind, '[' || coalesce(string_agg('{"id":"' || id || '","n":' || n || ',"raw":"' || base64(raw) || '"}', ',' ORDER BY id), '') || ']' AS body FROM docs WHERE n < 60
  UNION ALL SELECT 'nulls', '[' || coalesce(string_agg('{"id":"' || id || '","status":"' || status || '","score":' || coalesce(CAST(score AS VARCHAR), 'null') || '}', ',' ORDER BY id), '') || ']' FROM posts WHERE day < 9140
  UNION ALL SELECT 'names', 'id,status,score'""", "docs", "posts")),
    "rows_json": (rows_json, sql(
        f"""SELECT 'rows' AS kind, '{{"columns":["id","score","prio"],"rows":[' || string_agg({_JSON_ROW}, ',' ORDER BY id) || ']}}' AS body FROM {_EARLY}
  UNION ALL SELECT 'objects', '[' || string_agg({_JSON_OBJECT}, ',' ORDER BY id) || ']' FROM (SELECT * FROM {_EARLY} LIMIT 2) UNION ALL SELECT 'object', {_JSON_OBJECT} FROM (SELECT * FROM {_EARLY} LIMIT 1)
  UNION ALL SELECT 'exec', '{{"affected":3}}' UNION ALL SELECT 'error', '{{"error":"a \\"b\\""}}'""", "posts")),
    "row_json_by_key": (row_json_by_key, sql(
        f"""SELECT CAST(0 AS BIGINT) AS nth, '{{"id":"' || id || '","score":' || coalesce(CAST(score AS VARCHAR), 'null') || '}}' AS body FROM posts WHERE id = '{T7}' UNION ALL SELECT 1, NULL
  UNION ALL SELECT 2, '{{"grp":' || coalesce(CAST(grp AS VARCHAR), 'null') || ',"nation":' || nation || '}}' FROM users WHERE id = '{T7}'""", "posts", "users")),
    "prepared_statement": (prepared_statement, sql(f"SELECT id, cents + CASE WHEN id = '{T7}' THEN 5 ELSE 0 END AS cents FROM users WHERE segment = 'BUILDING' UNION ALL SELECT id, cents + 5 FROM users WHERE id = '{T7}'", "users")),
    "store_meta": (store_meta, sql(
        f"""SELECT 'users' AS name, count(*) AS rows, CAST(6 AS BIGINT) AS columns, CAST(3 AS BIGINT) AS indexes, false AS partitioned, CAST(sum({_COST}) AS BIGINT) AS bytes FROM users
  UNION ALL SELECT 'posts', count(*), 7, 2, false, CAST(sum(32 * 7 + 64 + 48 * 2 + octet_length(encode(status)) + octet_length(encode(prio))) AS BIGINT) FROM posts
  UNION ALL SELECT 'messages', count(*), 5, 0, true, CAST(sum(32 * 5 + 64 + octet_length(encode(role)) + coalesce(octet_length(encode(body)), 0)) AS BIGINT) FROM messages""", "users", "posts", "messages")),
    "registered": (registered, values("nth long, yes boolean", [(0, True), (1, True), (2, False), (3, True), (4, True), (5, True)])),
    "requests": (requests, REQUESTS_SQL),
    "functions": (functions, FUNCTIONS_SQL),
    "update_probe": (update_probe, sql(f"SELECT id, day + CASE WHEN id IN ('{T7}', '{tid(2)}') THEN 1 ELSE 0 END AS day, CASE WHEN id IN ('{T7}', '{tid(2)}') THEN 'probed' ELSE prio END AS prio FROM posts WHERE id IN ('{T7}', '{tid(1)}', '{tid(2)}')", "posts")),
    "auto_keys": (auto_keys, values("n long, unlike long, version long, rising long", [(1500, 1500, 1500, 1499)])),
    "capacity": (capacity, CAPACITY_SQL),
    "recovery_ddl": (recovery_ddl, values("id string, s string, path string, sealed long", [(tid(2), "two", "index idx_s", 3), (tid(3), None, "index idx_s", 3)])),
    "recovery_damaged": (recovery_damaged, sql(
        f"""SELECT id, CASE id WHEN '{tid(1)}' THEN -5 WHEN '{tid(2)}' THEN -6 ELSE nation + 100 END AS nation, CASE id WHEN '{tid(1)}' THEN __GRP__ ELSE grp END AS grp, CAST(2 AS BIGINT) AS noted
  FROM users WHERE id IN ('{tid(1)}', '{tid(2)}') OR cents > 900000""".replace("__GRP__", "4"), "users")),
    "idle_seal": (idle_seal, values("id string, n long", [(tid(1), 1)])),
    "guards": (guards, values("tried string, error string", GUARDS)),
}
