"""Named queries over the driver's tables, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import functions as F

from keyloft import functions as fn
from keyloft.operators import hashes, keyspace, lists, sets, zsets
from keyloft.plans import replay, session
from keyloft.plans.tables import command_log, customer_strings, list_log, mixed_log, multi_key_log, order_lists, part_scores, set_log, table, wide_set_log
from keyloft.sources import binary, snapshot, wire

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def shared_folder(spark) -> str:
    """A new folder under spark.checkpoint.dir, or a local one where the session runs on one machine and has none; it goes when the driver's Python ends."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='keyloft-')}"
    folder = f"{found}/keyloft-{uuid.uuid4().hex}"

    def leave() -> None:
        with suppress(Exception):  # the session may be gone, and what is left is only disk
            if sc._jsc is not None:
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(leave)
    return folder


# -- keys and strings ---------------------------------------------------------

WANTED = [1, 5, 5, 77, 1000, 99999999]
_WANTED = ", ".join(f"({i}, {k})" for i, k in enumerate(WANTED))


@query("select c_custkey as key, c_name as value from customer where c_custkey in (1, 5, 77)")
def get_point(spark, sf_dir):
    return keyspace.lookup(customer_strings(spark, sf_dir), [1, 5, 77])


@query(f"select req, w.key, c_name as value from (values {_WANTED}) w(req, key) left join customer on c_custkey = w.key")
def get_multi(spark, sf_dir):
    wanted = spark.sql(f"select cast(req as int) req, cast(key as bigint) key from values {_WANTED} as w(req, key)")
    return keyspace.get(customer_strings(spark, sf_dir), wanted).select("req", "key", "value")


@query("select 'u' || user_id as key, arg_max(props, event_id) as value from events group by 1")
def set_last_write(spark, sf_dir):
    return keyspace.set_last(table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("seq")))


def _requests(spark, sf_dir):
    """Each order names its customer, the one after, and its own again."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("req"), F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") + 7, F.col("o_custkey"))).alias("key"))


_REQUESTS = "(select o_orderkey as req, unnest([o_custkey, o_custkey + 7, o_custkey]) as key from orders)"


@query(f"select req, count(c_custkey) as found from {_REQUESTS} r left join customer on c_custkey = key group by req")
def exists_multi(spark, sf_dir):
    return keyspace.exists(customer_strings(spark, sf_dir), _requests(spark, sf_dir))


@query("select c_custkey as key, c_name as value from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def del_state(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    return keyspace.delete(customer_strings(spark, sf_dir), gone)


@query(f"""with r as {_REQUESTS}, f as (select key, min(req) as first from r group by key),
h as (select first, count(*) as n from f join customer on c_custkey = key group by first)
select req, coalesce(n, 0)::bigint as removed from (select distinct req from r) left join h on first = req""")
def del_count(spark, sf_dir):
    return keyspace.delete_counts(customer_strings(spark, sf_dir), _requests(spark, sf_dir))


@query("select n_name as key from nation")
def keys_all(spark, sf_dir):
    return keyspace.keys(table(spark, sf_dir, "nation").select(F.col("n_name").alias("key")), "*")


@query("select n_name as key from nation where false")
def keys_pattern_none(spark, sf_dir):
    return keyspace.keys(table(spark, sf_dir, "nation").select(F.col("n_name").alias("key")), "A*")


@query("select count(distinct c_custkey) as keys, sum(strlen(c_custkey::varchar) + strlen(c_name))::bigint as bytes from customer")
def memory_keyspace(spark, sf_dir):
    rows = customer_strings(spark, sf_dir).withColumn("key", F.col("key").cast("string"))
    return keyspace.memory_usage(rows, "key", "value")


# -- maps ---------------------------------------------------------------------

_SUPPLIER = "(select s_suppkey::varchar as key, unnest(['s_name', 's_nationkey']) as field, unnest([s_name, s_nationkey::varchar]) as value from supplier)"


def _supplier(spark, sf_dir):
    return hashes.from_rows(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_name", "s_nationkey"])


_FIELDS = "(values ('1', 's_name'), ('2', 'none'), ('3', 's_nationkey'), ('none', 's_name')) w(key, field)"


@query(f"select w.key, w.field, value from {_FIELDS} left join {_SUPPLIER} s on s.key = w.key and s.field = w.field")
def hget(spark, sf_dir):
    return hashes.hget(_supplier(spark, sf_dir), spark.sql(f"select * from {_FIELDS.replace('(values', 'values', 1).replace(')) w', ') as w')}"))


@query(f"select key, field, value from {_SUPPLIER} where key in ('1', '7')")
def hgetall(spark, sf_dir):
    return hashes.hgetall(_supplier(spark, sf_dir), ["1", "7"])


@query(f"select key, count(*) as fields from {_SUPPLIER} group by key")
def hlen(spark, sf_dir):
    return hashes.hlen(_supplier(spark, sf_dir))


@query(f"select w.key, w.field, value is not null as found from {_FIELDS} left join {_SUPPLIER} s on s.key = w.key and s.field = w.field")
def hexists(spark, sf_dir):
    return hashes.hexists(_supplier(spark, sf_dir), spark.sql(f"select * from {_FIELDS.replace('(values', 'values', 1).replace(')) w', ') as w')}"))


@query(f"select key, field, value from {_SUPPLIER} where not (field = 's_name' and key in (select s_suppkey::varchar from supplier where s_acctbal < 0))")
def hdel(spark, sf_dir):
    gone = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("key"), F.lit("s_name").alias("field"))
    return hashes.hdel(_supplier(spark, sf_dir), gone)


@query("select 'u' || user_id as key, event_type as field, arg_max(props, event_id) as value from events group by 1, 2")
def hset_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("key"), F.col("event_type").alias("field"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    return hashes.hset(e.select("key", "field", "value").limit(0), e)


@query("select 'u' || user_id as key, event_type as field, arg_max(props, event_id) as value from events group by 1, 2")
def hset_existing(spark, sf_dir):
    """Writes over maps that the first 500 events made: the last write of a field wins."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("key"), F.col("event_type").alias("field"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    old = hashes.hset(e.select("key", "field", "value").limit(0), e.where("seq < 500"))
    return hashes.hset(old, e.where("seq >= 500"))


@query("""select key, case when count(*) >= 512 or max(greatest(strlen(field), strlen(value))) > 64 then 'table' else 'small' end as encoding from (
select 'u' || user_id as key, 'e' || event_id as field, props as value from events union all select event_type, 'e' || event_id, props from events) group by 1""")
def encoding_of_hash(spark, sf_dir):
    """A map of events for each user, and one for each type."""
    e, pair = table(spark, sf_dir, "events"), (F.concat(F.lit("e"), "event_id").alias("field"), F.col("props").alias("value"))
    return hashes.encoding(e.select(F.concat(F.lit("u"), "user_id").alias("key"), *pair).union(e.select("event_type", *pair)))


@query("select lang as key, sum(strlen(doc_id::varchar) + strlen(coalesce(text, '')))::bigint as bytes from documents group by 1")
def memory_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("key"), F.col("doc_id").cast("string").alias("field"), F.col("text").alias("value"))
    return hashes.memory_usage(d)


# -- replay -------------------------------------------------------------------

_LOG = """select event_id as seq, 'u' || (user_id % 40) as key,
  case event_type when 'signup' then 'SET' when 'error' then 'DEL' when 'view' then 'HSET' when 'click' then 'HGET' else 'GET' end as op,
  'f' || (user_id % 3) as field, ((event_id * 7919) % 1009)::varchar as value from events"""

_HISTORY = f"""log as ({_LOG}),
e as (select *, sum((op in ('SET', 'DEL'))::int) over w as epoch, max(case when op in ('SET', 'DEL') then seq end) over w as reset_seq,
        max(case when op in ('SET', 'DEL', 'HSET') then seq end) over (partition by key order by seq rows between unbounded preceding and 1 preceding) as write_seq
      from log window w as (partition by key order by seq rows between unbounded preceding and current row)),
f as (select *, max(case when op = 'HSET' then seq end) over (partition by key, epoch, field order by seq rows between unbounded preceding and current row) as field_seq from e),
h as (select f.*, r.op as reset, r.value as text, m.value as mapped, coalesce(p.op in ('SET', 'HSET'), false) as existed
      from f left join log r on r.seq = reset_seq left join log m on m.seq = field_seq left join log p on p.seq = write_seq)"""

_REPLIES = f"""with {_HISTORY}
select seq,
  case when op = 'SET' then 'simple' when op = 'DEL' then 'integer' when op = 'HSET' then case when reset = 'SET' then 'error' else 'integer' end else 'bulk' end as kind,
  case when op = 'SET' then 'OK' when op = 'HSET' and reset = 'SET' then '{replay.WRONG_TYPE}' when op = 'GET' and reset = 'SET' then text
       when op = 'HGET' and reset is distinct from 'SET' then mapped end as str,
  case when op = 'DEL' then existed::bigint when op = 'HSET' and reset is distinct from 'SET' then 1::bigint end as "int"
from h"""


@query(_REPLIES)
def replay_replies(spark, sf_dir):
    return replay.replies(command_log(spark, sf_dir))


_STATE = f"""log as ({_LOG}), last as (select key, arg_max(op, seq) as op, arg_max(value, seq) as value, max(seq) as seq from log where op in ('SET', 'DEL') group by key),
state as (select key, 'string' as type, null::varchar as field, value from last where op = 'SET'
union all select log.key, 'hash', field, arg_max(log.value, log.seq) from log left join last on last.key = log.key
where log.op = 'HSET' and (last.op is null or last.op = 'DEL' and log.seq > last.seq) group by log.key, field)"""


@query(f"with {_STATE} select key, type, field, value from state")
def replay_state(spark, sf_dir):
    return replay.state(command_log(spark, sf_dir))


@query(f"with {_STATE} select distinct key, type from state")
def type_of_key(spark, sf_dir):
    return replay.types(command_log(spark, sf_dir))


@query(f"with {_STATE} select key, type from (select distinct key, type from state) where (key, type) in (('u1', 'string'), ('u2', 'hash'), ('u3', 'string'), ('u4', 'hash'))")
def check_type(spark, sf_dir):
    wanted = spark.sql("select * from values ('u1', 'string'), ('u2', 'hash'), ('u3', 'string'), ('u4', 'hash') as w(key, type)")
    return keyspace.check_type(replay.types(command_log(spark, sf_dir)), wanted)


_MULTI = """select event_id * 4 + pos as ord, event_id as seq, op, case when pos = 1 then k2 else k1 end as key from (
  select event_id, 'u' || (user_id % 40) as k1, 'u' || ((user_id * 7 + 1) % 40) as k2,
  case event_type when 'signup' then 'SET' when 'error' then 'DEL' when 'view' then 'HSET' else 'EXISTS' end as op from events) e
  join (values (0), (1), (2)) p(pos) on pos = 0 or op in ('DEL', 'EXISTS')"""


@query(f"""with log as ({_MULTI}),
e as (select *, max(case when op <> 'EXISTS' then ord end) over (partition by key order by ord rows between unbounded preceding and 1 preceding) as before from log)
select e.seq, 'integer' as kind, null::varchar as str, sum(coalesce(p.op in ('SET', 'HSET'), false)::bigint)::bigint as "int"
from e left join log p on p.ord = e.before where e.op in ('DEL', 'EXISTS') group by e.seq""")
def replay_multi_key(spark, sf_dir):
    return replay.replies(multi_key_log(spark, sf_dir).where("op in ('SET', 'DEL', 'HSET', 'EXISTS')")).where("kind = 'integer' and str is null").join(
        multi_key_log(spark, sf_dir).where("op in ('DEL', 'EXISTS')").select("seq").distinct(), "seq", "left_semi"
    )


_LIVES = f"""log as ({_LOG}), w as (select key, seq, op <> 'DEL' as alive, coalesce(lag(op <> 'DEL') over (partition by key order by seq), false) as was from log where op in ('SET', 'DEL', 'HSET')),
c as (select key, alive, seq as born, lead(seq) over (partition by key order by seq) as gone from w where alive <> was), lives as (select key, born, gone from c where alive)"""


@query(f'with {_LIVES}, q as (select min(event_id) as "at" from events group by user_id) select q."at", key from q join lives on born < q."at" and (gone is null or gone >= q."at")')
def keys_at(spark, sf_dir):
    """The keys that exist at the first event of each user."""
    times = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("at")).select("at")
    return replay.keys_at(command_log(spark, sf_dir), times)


@query(f"""with {_LIVES}, q as (select distinct event_id as "at", 'u' || (event_id % 45) as key from events where event_type = 'purchase')
select q."at", q.key, coalesce(bool_or(born < q."at" and (gone is null or gone >= q."at")), false) as found from q left join lives on lives.key = q.key group by q."at", q.key""")
def exists_at(spark, sf_dir):
    q = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("at"), F.concat(F.lit("u"), F.col("event_id") % 45).alias("key"))
    return replay.exists_at(command_log(spark, sf_dir), q.distinct())


_WORDS = [
    ["ping", "a"], ["set", "k", "v", "EX", "9"], ["GET", "k"], ["GET", "none"], ["GET"], ["HSET", "h", "a", "1", "b", "2"], ["HGET", "h", "b"], ["HGET", "h", "a"], ["HSET", "h", "a", "1", "b"],
    ["HSET", "k", "f", "1"], ["EXISTS", "k", "k", "z"], ["DEL", "k", "k", "z"], ["EXISTS", "k"], ["nope"], [], ["SAVE"], ["SAVE", "x"], ["KEYS"], ["SET", "", ""], ["GET", ""], ["SET", "é", "é"], ["GET", "é"],
]
_ANSWERS = [
    "+PONG\r\n", "+OK\r\n", "$1\r\nv\r\n", "$-1\r\n", "-ERR wrong number of arguments for 'GET'\r\n", ":1\r\n", "$-1\r\n", "$1\r\n1\r\n", "-ERR wrong number of arguments for 'HSET'\r\n",
    f"-ERR {replay.WRONG_TYPE}\r\n", ":2\r\n", ":1\r\n", ":0\r\n", "-ERR unknown command `nope`\r\n", "-ERR empty command\r\n", "+OK\r\n", "-ERR SAVE command takes no arguments\r\n", "-ERR wrong number of arguments for 'KEYS'\r\n", "+OK\r\n", "$0\r\n\r\n", "+OK\r\n", "$2\r\né\r\n",
]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\r\n", "|") + "'"


@query("select seq::bigint as seq, reply from (values " + ", ".join(f"({i}, {_quoted(a)})" for i, a in enumerate(_ANSWERS)) + ") t(seq, reply)")
def wire_session(spark, sf_dir):
    """A short session from wire frames to wire replies; line ends are shown as bars."""
    frames = spark.createDataFrame([(i, wire.encode([w.encode() for w in ws])) for i, ws in enumerate(_WORDS)], "seq bigint, frame binary")
    r = replay.replies(replay.from_words(wire.parse_frames(frames)))
    return r.select(replay.frame_of(F.col("seq")).alias("seq"), F.regexp_replace(fn.encode_reply(F.col("kind"), F.col("str"), F.col("int")), "\r\n", "|").alias("reply"))


_PIPELINED = [(k // 5, k % 5, a) for k, a in enumerate(_ANSWERS)]


def _bytes_sql(rows: list[tuple[int, int, bytes]]) -> str:
    return "select seq::bigint as seq, cmd, reply from (values " + ", ".join(f"({i}, {k}, '{a.hex().upper()}')" for i, k, a in rows) + ") t(seq, cmd, reply)"


def _answered(frames, conn=None):
    r = replay.wire_replies(replay.from_words(wire.parse_frames(frames, conn=conn)))
    return r.select(replay.frame_of(F.col("seq")).alias("seq"), replay.place_of(F.col("seq")).alias("cmd"), F.hex("reply").alias("reply"))


@query(_bytes_sql([(i, k, a.encode()) for i, k, a in _PIPELINED]))
def wire_pipelined(spark, sf_dir):
    """The session with five commands to a frame: all of them run. Replies are shown in hexadecimal."""
    sent = [b"".join(wire.encode([w.encode() for w in ws]) for ws in _WORDS[k : k + 5]) for k in range(0, len(_WORDS), 5)]
    return _answered(spark.createDataFrame(list(enumerate(sent)), "seq bigint, frame binary"))


#: Connection, frame and what it is answered: garbage, lengths that are no numbers, halves of commands, bytes that are no text.
_RAW = [
    ("a", b"PING\r\n", [b"-ERR protocol error\r\n"]),
    ("b", b"*1\r\n$4\r\nPI", []),
    ("a", b"*2\r\n$3\r\nGET\r\n$x\r\nk\r\n", [b"-ERR protocol error\r\n"]),
    ("b", b"NG\r\n  *3\r\n$3\r\nSET\r\n$2\r\n\xff\x00\r\n$1\r\n\xfe", [b"+PONG\r\n"]),
    ("a", b"*1\r\n$4\r\nPING\r\n*1\r\n$-2\r\n*1\r\n$4\r\nPING\r\n", [b"+PONG\r\n", b"-ERR protocol error\r\n"]),
    ("b", b"\r\n*2\r\n$3\r\nget\r\n$2\r\n\xff\x00\r\n*2\r\n$4\r\nKEYS\r\n$1\r\n*\r\n*", [b"+OK\r\n", b"$1\r\n\xfe\r\n", b"*1\r\n$2\r\n\xff\x00\r\n"]),
    ("c", b"*1\r\n$4\r\nPINGxx", [b"-ERR protocol error\r\n"]),
    ("b", b"2\r\n$4\r\nKEYS\r\n$2\r\na*\r\n*2\r\n$3\r\nGET\r\n$-1\r\n", [b"*0\r\n", b"$-1\r\n"]),
    ("c", b"*1\r\n", []),
]


@query(_bytes_sql([(i, k, a) for i, (_, _, answers) in enumerate(_RAW) for k, a in enumerate(answers)]))
def wire_errors(spark, sf_dir):
    """Frames of three connections that hold errors, commands in pieces and any bytes."""
    return _answered(spark.createDataFrame([(i, c, f) for i, (c, f, _) in enumerate(_RAW)], "seq bigint, conn string, frame binary"), conn="conn")


_MIXED = f"""log as (select seq, key, field, value, case when op = 'GET' and seq % 7 = 0 then 'KEYS' when op = 'GET' and seq % 7 = 1 then 'PING' when op = 'GET' and seq % 7 = 2 then 'SAVE'
  when op = 'GET' and seq % 7 = 3 then 'bad' else op end as op from ({_LOG}))"""
_MIXED_REPLIES = f"""with {_HISTORY.replace(f"log as ({_LOG})", _MIXED)}
select seq,
  case when op in ('SET', 'PING', 'SAVE') then 'simple' when op = 'bad' then 'error' when op = 'DEL' then 'integer' when op = 'HSET' then case when reset = 'SET' then 'error' else 'integer' end else 'bulk' end as kind,
  case when op in ('SET', 'SAVE') then 'OK' when op = 'PING' then 'PONG' when op = 'bad' then 'wrong number of arguments for ''HSET''' when op = 'HSET' and reset = 'SET' then '{replay.WRONG_TYPE}'
       when op = 'GET' and reset = 'SET' then text when op = 'HGET' and reset is distinct from 'SET' then mapped end as str,
  case when op = 'DEL' then existed::bigint when op = 'HSET' and reset is distinct from 'SET' then 1::bigint end as "int"
from h where op <> 'KEYS'"""
_KEY_ARRAYS = f"""with {_LIVES}, q as (select event_id as seq from events where event_type = 'purchase' and event_id % 7 = 0),
found as (select q.seq, count(*) as n, string_agg(key, ',' order by key) as items from q join lives on born < q.seq and (gone is null or gone >= q.seq) where q.seq % 2 = 0 group by q.seq)
select q.seq, 'array' as kind, coalesce(n, 0)::bigint as "int", coalesce(items, '') as items from q left join found using (seq)"""


@query(_KEY_ARRAYS)
def replay_keys(spark, sf_dir):
    """The arrays that answer KEYS in a log, all keys in byte order."""
    r = replay.all_replies(mixed_log(table(spark, sf_dir, "events"))).where("kind = 'array'")
    return r.select("seq", "kind", "int", F.array_join("items", ",").alias("items"))


@query(_MIXED_REPLIES)
def replay_mixed(spark, sf_dir):
    """Replies of a log that also has PING, SAVE and commands that cannot run."""
    return replay.replies(mixed_log(table(spark, sf_dir, "events")))


@query(_REPLIES + " where seq > 600")
def session_restart(spark, sf_dir):
    """The log with a SAVE and a new start after its 600th command: what follows is answered as if nothing had happened."""
    path, log = shared_folder(spark), command_log(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    save = spark.sql("select 601L as seq, 0 as pos, 'SAVE' as op, cast(null as string) as key, cast(null as string) as field, cast(null as string) as value, cast(null as string) as error")
    session.run(log.where("seq <= 600").unionByName(save), path)
    return session.run(log.where("seq > 600"), path).select("seq", "kind", "str", "int")


@query("select event_id as seq, ':' || (event_id * 3) || '|$' || strlen(event_type) || '|' || event_type || '|+' || event_type || '|-ERR ' || event_type || '|*1|$' || strlen(event_type) || '|' || event_type || '|' as reply from events")
def encode_replies(spark, sf_dir):
    t = F.col("event_type")
    all_ = F.concat(fn.integer_reply(F.col("event_id") * 3), fn.bulk_reply(t), fn.simple_reply(t), fn.error_reply(t), fn.array_reply(F.array(t)))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.replace(all_, F.lit("\r\n"), F.lit("|")).alias("reply"))


# -- scored sets --------------------------------------------------------------

_SCORES = "(select p_brand as key, p_partkey::varchar as member, p_retailprice as score from part)"


def _scores(spark, sf_dir):
    return zsets.add(part_scores(spark, sf_dir))


@query("select event_type as key, 'u' || user_id as member, arg_max(value, event_id) as score from events group by 1, 2")
def zadd(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return zsets.add(e.select(F.col("event_type").alias("key"), F.concat(F.lit("u"), "user_id").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq")))


@query("select p_brand as key, p_partkey::varchar as member, p_retailprice as score from part where p_partkey in (1, 10, 100)")
def zscore(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").where(F.col("p_partkey").isin(1, 10, 100)).select(F.col("p_brand").alias("key"), F.col("p_partkey").cast("string").alias("member"))
    return zsets.score(_scores(spark, sf_dir), wanted).select("key", "member", "score")


@query(f"select key, member, score, (row_number() over (partition by key order by score, member) - 1)::bigint as rank from {_SCORES}")
def zrank(spark, sf_dir):
    return zsets.rank(_scores(spark, sf_dir))


@query(f"select key, member, rank from (select key, member, (row_number() over (partition by key order by score, member) - 1)::bigint as rank from {_SCORES}) where member in ('1', '10', '100')")
def zrank_of(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").where(F.col("p_partkey").isin(1, 10, 100)).select(F.col("p_brand").alias("key"), F.col("p_partkey").cast("string").alias("member"))
    return zsets.rank_of(_scores(spark, sf_dir), wanted)


@query("""with w as (select p_brand as key, case when p_size % 5 = 0 then 'none' else p_partkey::varchar end as member from part)
select distinct w.key, w.member, score from w left join (select p_brand as key, p_partkey::varchar as member, p_retailprice as score from part) s on s.key = w.key and s.member = w.member""")
def zscore_all(spark, sf_dir):
    """Scores of every part in its brand, and of members that are not there."""
    wanted = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.when(F.col("p_size") % 5 == 0, "none").otherwise(F.col("p_partkey").cast("string")).alias("member")).distinct()
    return zsets.score(_scores(spark, sf_dir), wanted).select("key", "member", "score")


@query(f"""select key, member, rank from (select key, member, (row_number() over (partition by key order by score, member) - 1)::bigint as rank from {_SCORES})
where member in (select p_partkey::varchar from part where p_size > 25)""")
def zrank_of_many(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_brand").alias("key"), F.col("p_partkey").cast("string").alias("member"))
    return zsets.rank_of(_scores(spark, sf_dir), wanted.union(spark.sql("select 'none' as key, '1' as member")))


@query(f"select key, member, score from {_SCORES} where score between 950 and 1050.5")
def zrange_by_score(spark, sf_dir):
    return zsets.range_by_score(_scores(spark, sf_dir), 950, 1050.5)


@query(f"select key, member, score from {_SCORES} where member not in (select p_partkey::varchar from part where p_size > 25)")
def zrem(spark, sf_dir):
    gone = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_brand").alias("key"), F.col("p_partkey").cast("string").alias("member"))
    return zsets.remove(_scores(spark, sf_dir), gone)


@query(f"select key, count(*) as size from {_SCORES} group by key")
def zcard(spark, sf_dir):
    return zsets.size(_scores(spark, sf_dir))


# -- sets ---------------------------------------------------------------------

_MEMBERS = "(select distinct o_custkey as key, o_orderpriority as member from orders)"


def _members(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("member"))
    return o.distinct()


@query("select distinct o_custkey as key, o_orderpriority as member from orders union select c_custkey, 'none' from customer")
def sadd(spark, sf_dir):
    return sets.add(_members(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("none").alias("member")))


@query(f"select c_custkey as key, '1-URGENT' as member, exists (select 1 from {_MEMBERS} m where m.key = c_custkey and m.member = '1-URGENT') as found from customer")
def sismember(spark, sf_dir):
    return sets.contains(_members(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("1-URGENT").alias("member")))


@query(f"select key, member from {_MEMBERS} m where not (member = '1-URGENT' and key in (select c_custkey from customer))")
def srem(spark, sf_dir):
    return sets.remove(_members(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("1-URGENT").alias("member")))


@query(f"select key, count(*) as size from {_MEMBERS} m group by key")
def scard(spark, sf_dir):
    return sets.size(_members(spark, sf_dir))


@query("""with m as (select 's' || (user_id % 50) as key, case when event_id % 2 = 0 then '0' else '+' end || (event_id % 40) as member from events
union all select 'x' || (user_id % 5), case when user_id % 5 = 0 then 'm' else '0' end || (event_id % 9) from events)
select distinct key, case when bool_and(regexp_full_match(member, '[+-]?[0-9]+')) over (partition by key) then (member::bigint)::varchar else member end as member from m where key <> 'x0'
union select distinct key, member from m where key = 'x0'""")
def smembers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.select(F.concat(F.lit("s"), F.col("user_id") % 50).alias("key"), F.concat(F.when(F.col("event_id") % 2 == 0, "0").otherwise("+"), F.col("event_id") % 40).alias("member"))
    b = e.select(F.concat(F.lit("x"), F.col("user_id") % 5).alias("key"), F.concat(F.when(F.col("user_id") % 5 == 0, "m").otherwise("0"), F.col("event_id") % 9).alias("member"))
    return sets.canonical(a.union(b))


#: Integer sets for parts of customers, texts for others; what is asked is spelled in other ways.
_INTS = "(select distinct c_nationkey as key, case when c_nationkey % 4 = 0 then 'x' else '' end || (c_custkey % 50) as member from customer)"
_ASKED = "(select distinct c_nationkey as key, case when c_custkey % 3 = 0 then '0' when c_custkey % 3 = 1 then '+' else 'y' end || (c_custkey % 60) as member from customer where c_custkey % 2 = 0)"
_ASKED_ID = f"(select distinct key, member, case when key % 4 = 0 then member when regexp_full_match(member, '[+-]?[0-9]+') then (member::bigint)::varchar end as id from {_ASKED})"


def _int_sets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("key"), F.concat(F.when(F.col("c_nationkey") % 4 == 0, "x").otherwise(""), F.col("c_custkey") % 50).alias("member")).distinct()


def _asked(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    n = F.col("c_custkey") % 3
    return c.select(F.col("c_nationkey").alias("key"), F.concat(F.when(n == 0, "0").when(n == 1, "+").otherwise("y"), F.col("c_custkey") % 60).alias("member")).distinct()


@query(f"""select key, member from {_INTS} union select key, member from {_ASKED_ID} where key % 4 = 0 union select key, id from {_ASKED_ID} where key % 4 <> 0 and id is not null
union select key, member from {_ASKED_ID} where id is null""")
def sadd_int(spark, sf_dir):
    """Adds to integer sets and to others: integers, which count by value, before texts, which promote their set."""
    return sets.add(_int_sets(spark, sf_dir), _asked(spark, sf_dir))


@query(f"select a.key, a.member, i.member is not null as found from {_ASKED_ID} a left join {_INTS} i on i.key = a.key and i.member = a.id")
def sismember_int(spark, sf_dir):
    return sets.contains(_int_sets(spark, sf_dir), _asked(spark, sf_dir))


@query(f"select i.key, i.member from {_INTS} i where not exists (select 1 from {_ASKED_ID} a where a.key = i.key and a.id = i.member)")
def srem_int(spark, sf_dir):
    return sets.remove(_int_sets(spark, sf_dir), _asked(spark, sf_dir))


_SET_LOG = """select event_id as seq, 's' || (user_id % 50) as key,
  case when event_type in ('signup', 'view', 'purchase') then 'ADD' when event_type = 'error' then 'REM' else 'HAS' end as op,
  case when event_id % 97 = 0 then 'x' || ((event_id * 31) % 17) when event_id % 5 = 0 then '0' || ((event_id * 31) % 17)
       when event_id % 7 = 0 then '+' || ((event_id * 31) % 17) else ((event_id * 31) % 17)::varchar end as member from events"""


_WIDE_LOG = """select event_id as seq, 'w' || (event_id % 3) as key, case when event_id % 10 = 3 then 'REM' when event_id % 10 = 6 then 'HAS' else 'ADD' end as op,
  case when event_id % 5 = 0 then '0' when event_id % 7 = 0 then '+' else '' end || ((event_id * 31) % 700) as member from events"""


def _set_sql(limit: int, source: str = _SET_LOG) -> str:
    return f"""with log as (select *, case when regexp_full_match(member, '[+-]?[0-9]+') then member::bigint end as num from ({source})),
raw as (select key, min(seq) as s from log where op = 'ADD' and num is null group by key),
i as (select *, coalesce(arg_max(op, case when op <> 'HAS' then seq end) over (partition by key, num order by seq rows between unbounded preceding and 1 preceding) = 'ADD', false) as there from log where num is not null),
n as (select *, coalesce(sum(case when op = 'ADD' and not there then 1 when op = 'REM' and there then -1 else 0 end) over (partition by key order by seq rows between unbounded preceding and 1 preceding), 0) as n from i),
full_ as (select key, min(seq) as s from n where op = 'ADD' and n >= {limit} group by key),
p as (select key, least(raw.s, full_.s) as promoted from raw full join full_ using (key)),
k as (select log.*, case when coalesce(seq >= promoted, false) then member else num::varchar end as id from log left join p using (key)),
r as (select *, coalesce(arg_max(op, case when op <> 'HAS' then seq end) over (partition by key, id order by seq rows between unbounded preceding and 1 preceding) = 'ADD', false) and id is not null as there from k)
"""


@query(_set_sql(9) + "select seq, key, op, member, id, case when op = 'ADD' then (not there)::bigint else there::bigint end as reply from r")
def set_replay(spark, sf_dir):
    return sets.replay(set_log(spark, sf_dir), limit=9, by_blocks=True)


@query(_set_sql(512) + "select key, id as member from (select key, id, arg_max(op, seq) as op from r where id is not null and op <> 'HAS' group by key, id) where op = 'ADD'")
def set_replay_members(spark, sf_dir):
    return sets.final_members(set_log(spark, sf_dir))


@query(_set_sql(512, _WIDE_LOG) + "select seq, key, op, member, id, case when op = 'ADD' then (not there)::bigint else there::bigint end as reply from r")
def set_replay_512(spark, sf_dir):
    """Sets that pass the limit of 512 integers."""
    return sets.replay(wide_set_log(spark, sf_dir), by_blocks=True)


@query(f"select key, sum(strlen(member))::bigint as bytes from {_MEMBERS} m group by key")
def memory_set(spark, sf_dir):
    return sets.memory_usage(_members(spark, sf_dir))


@query(f"select key, case when key % 4 = 0 then sum(strlen(member)) else 8 * count(*) end::bigint as bytes from {_INTS} group by key")
def memory_set_int(spark, sf_dir):
    return sets.memory_usage(_int_sets(spark, sf_dir))


# -- lists --------------------------------------------------------------------

_BACK = "(select o_custkey as key, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as pos, o_orderpriority as value, count(*) over (partition by o_custkey) as n from orders)"
_FRONT = "(select o_custkey as key, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) - 1 as pos, o_orderpriority as value from orders)"


def _items(spark, sf_dir):
    return lists.push_back(order_lists(spark, sf_dir), "o_orderdate", "o_orderkey")


@query(f"select key, pos::bigint as pos, value from {_BACK}")
def rpush(spark, sf_dir):
    return _items(spark, sf_dir)


@query(f"select key, pos::bigint as pos, value from {_FRONT}")
def lpush(spark, sf_dir):
    return lists.push_front(order_lists(spark, sf_dir), "o_orderdate", "o_orderkey")


@query(f"select key, pos::bigint as pos, value from {_BACK} union all select key, n, 'end' from {_BACK} where pos = 0")
def rpush_existing(spark, sf_dir):
    items = _items(spark, sf_dir)
    return lists.append(items, items.where("pos = 0").select("key", F.lit("end").alias("value")), "value")


@query(f"""select key, (row_number() over (partition by key order by part, place) - 1)::bigint as pos, value from (
select key, 1 as part, pos as place, value from {_BACK} union all select c_custkey, 0, -n, 'front' || n from customer, (values (1), (2)) v(n) where c_custkey in (select o_custkey from orders))""")
def lpush_existing(spark, sf_dir):
    """Two values put in front of every list, one after the other."""
    items = _items(spark, sf_dir)
    writes = items.select("key").distinct().select("key", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).select("key", "n", F.concat(F.lit("front"), "n").alias("value"))
    return lists.prepend(items, writes, "n")


@query(f"select k.key, count(b.key) as length from (select distinct o_custkey as key from orders) k left join (select * from {_BACK} where pos >= 12) b on b.key = k.key group by k.key")
def llen_emptied(spark, sf_dir):
    """Lengths after a trim that empties short lists: they stay, with length 0."""
    items = _items(spark, sf_dir)
    return lists.length(lists.trim(items, 12, -1), items.select("key"))


@query(f"select key, value from {_BACK} where pos = n - 2")
def lindex(spark, sf_dir):
    return lists.index(_items(spark, sf_dir), -2)


@query(f"select key, value from {_BACK} where pos = 3")
def lindex_front(spark, sf_dir):
    return lists.index(_items(spark, sf_dir), 3)


@query("select o_custkey as key, count(*) as length from orders group by 1")
def llen(spark, sf_dir):
    return lists.length(order_lists(spark, sf_dir))


@query(f"select key, (pos - greatest(n - 5, 0))::bigint as pos, value from {_BACK} where pos >= greatest(n - 5, 0) and pos <= n - 2")
def ltrim(spark, sf_dir):
    return lists.trim(_items(spark, sf_dir), -5, -2)


def _lrem_sql(order: str, keep: str) -> str:
    return f"""with r as (select *, case when value = '1-URGENT' then sum((value = '1-URGENT')::int) over (partition by key order by {order}) end as hit from {_BACK})
select key, (row_number() over (partition by key order by pos) - 1)::bigint as pos, value from r where {keep}"""


@query(_lrem_sql("pos", "hit is null or hit > 2"))
def lrem_head(spark, sf_dir):
    return lists.remove(_items(spark, sf_dir), 2, "1-URGENT")


@query(_lrem_sql("pos desc", "hit is null or hit > 1"))
def lrem_tail(spark, sf_dir):
    return lists.remove(_items(spark, sf_dir), -1, "1-URGENT")


@query(_lrem_sql("pos", "hit is null"))
def lrem_all(spark, sf_dir):
    return lists.remove(_items(spark, sf_dir), 0, "1-URGENT")


@query(f"select key, least(count(*) filter (value = '1-URGENT'), 2)::bigint as removed from {_BACK} group by key")
def lrem_count(spark, sf_dir):
    return lists.removed(_items(spark, sf_dir), 2, "1-URGENT")


def _linsert_sql(shift: float) -> str:
    return f"""select key, (row_number() over (partition by key order by pos) - 1)::bigint as pos, value from (
select key, pos::double as pos, value from {_BACK} union all select key, min(pos) + ({shift}), 'new' from {_BACK} where value = '2-HIGH' group by key)"""


@query(_linsert_sql(-0.5))
def linsert(spark, sf_dir):
    return lists.insert(_items(spark, sf_dir), "2-HIGH", "new", before=True)


@query(_linsert_sql(0.5))
def linsert_after(spark, sf_dir):
    return lists.insert(_items(spark, sf_dir), "2-HIGH", "new", before=False)


@query(f"select key, value from {_BACK} where pos = 0")
def lpop(spark, sf_dir):
    return lists.pop(_items(spark, sf_dir), front=True)[1]


@query(f"select key, value from {_BACK} where pos = n - 1")
def rpop(spark, sf_dir):
    return lists.pop(_items(spark, sf_dir), front=False)[1]


@query(f"select key, (pos - 1)::bigint as pos, value from {_BACK} where pos > 0")
def lpop_rest(spark, sf_dir):
    return lists.pop(_items(spark, sf_dir), front=True)[0]


@query(f"select key, pos::bigint as pos, value from {_BACK} where pos < n - 1")
def rpop_rest(spark, sf_dir):
    return lists.pop(_items(spark, sf_dir), front=False)[0]


@query(f"select key, case when count(*) > 512 or max(strlen(value)) > 64 then 'linked' else 'small' end as encoding from {_BACK} group by key")
def encoding_of_list(spark, sf_dir):
    return lists.encoding(_items(spark, sf_dir))


_FOLD = """with recursive log as (select 'l' || user_id as key, row_number() over (partition by user_id order by event_id) as rn, event_id % 11 as k,
  'v' || (event_id % 7) as v, 'n' || (event_id % 5) as arg, case when event_id % 11 = 5 then 1 - event_id % 2 else event_id % 5 - 2 end as a, -1 - event_id % 3 as b from events),
folded(key, rn, x) as (select distinct key, 0::bigint, []::varchar[] from log
union all select s.key, l.rn, case
  when k < 4 then list_append(x, v) when k = 4 then list_prepend(v, x)
  when k = 5 then case when len(x) + b < 0 then [] else x[(a + 1):(len(x) + b + 1)] end
  when k = 6 then x[2:] when k = 7 then x[:(len(x) - 1)]
  when k = 8 then [x[i] for i in range(1, len(x) + 1) if x[i] <> v or a > 0 and len([j for j in range(1, i + 1) if x[j] = v]) > a or a < 0 and len([j for j in range(i, len(x) + 1) if x[j] = v]) > -a]
  when not list_contains(x, v) then x
  when k = 9 then x[:(list_position(x, v) - 1)] || [arg] || x[list_position(x, v):]
  else x[:list_position(x, v)] || [arg] || x[(list_position(x, v) + 1):] end
from folded s join log l on l.key = s.key and l.rn = s.rn + 1),
done as (select key, arg_max(x, rn) as x from folded group by key)
"""


@query(_FOLD + "select key, unnest(range(0, len(x))) as pos, unnest(x) as value from done")
def lpop_rpop_fold(spark, sf_dir):
    """A log of mixed list operations, folded for each key."""
    return lists.fold(list_log(spark, sf_dir))


@query(_FOLD + "select key, len(x)::bigint as length from done")
def fold_lengths(spark, sf_dir):
    """Lengths after that log, also of lists that it emptied."""
    return lists.fold_lengths(list_log(spark, sf_dir))


# -- snapshots, streams -------------------------------------------------------


@query(f"with {_STATE} select key, type, field, value from state")
def snapshot_roundtrip(spark, sf_dir):
    path = shared_folder(spark)
    snapshot.save(replay.state(command_log(spark, sf_dir)), path)
    return snapshot.load(spark, path, "key string, type string, field string, value string")


@query("select n_name as key, 'hash' as type, unnest(['id', 'region']) as field, unnest([n_nationkey::varchar, n_regionkey::varchar]) as value from nation")
def binary_snapshot(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a fixed table of 25 rows
    data = binary.encode((r["n_name"].encode(), {b"id": str(r["n_nationkey"]).encode(), b"region": str(r["n_regionkey"]).encode()}) for r in rows)
    binary.register(spark)
    df = spark.read.format("keysnapshot").option("data", data.hex()).load()
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query(f"with {_STATE} select key, type, field, value from state")
def binary_files(spark, sf_dir):
    """The state of the log in compact files, written and read in parallel."""
    path = shared_folder(spark)
    binary.write_files(replay.state(command_log(spark, sf_dir)), path, size=200)
    df = binary.read_files(spark, path)
    return df.select(*[F.col(c).cast("string").alias(c) for c in ("key", "type", "field", "value")])


@query(_MIXED_REPLIES)
def stream_mixed(spark, sf_dir):
    """The log of replay_mixed as a stream."""
    from keyloft.streaming.replay import whole_replies
    from keyloft.streaming.runner import run_parts

    return whole_replies(run_parts(spark, sf_dir, shared_folder(spark), "events.parquet", mixed_log))


@query(_KEY_ARRAYS)
def stream_keys(spark, sf_dir):
    """The arrays of replay_keys, from a stream's parts."""
    from keyloft.streaming.replay import key_replies
    from keyloft.streaming.runner import run_parts

    r = key_replies(run_parts(spark, sf_dir, shared_folder(spark), "events.parquet", mixed_log))
    return r.select("seq", "kind", "int", F.array_join("items", ",").alias("items"))


@query(_REPLIES)
def stream_replay(spark, sf_dir):
    """The log of replay_replies as a stream with state for each key; the replies are the same."""
    from keyloft.streaming.runner import run_log

    return run_log(spark, sf_dir, shared_folder(spark))
