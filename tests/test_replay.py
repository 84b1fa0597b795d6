import random

from pyspark.sql import functions as F

from keyloft import functions as fn
from keyloft.plans import replay
from keyloft.sources import wire
from tests.interpreter import WRONG, Store


def commands(spark, session):
    frames = spark.createDataFrame([(i, w) for i, w in enumerate(session)], "seq bigint, words array<string>")
    return replay.from_words(frames)


def answers(spark, session):
    return {r["seq"]: (r["kind"], r["str"], r["int"]) for r in replay.replies(commands(spark, session)).collect()}


def test_golden_rows(spark):
    session = [
        ["PING", "a", "b"], ["set", "k", "v", "EX", "9"], ["GET", "k"], ["GET", "none"], ["GET"], ["HSET", "h", "a", "1", "b", "2"], ["HGET", "h", "b"], ["HSET", "h", "a", "9"], ["HGET", "h", "a"],
        ["HSET", "h", "a", "1", "b"], ["HSET", "k", "f", "1"], ["HGET", "k", "f"], ["GET", "h"], ["SET", "h", "s"], ["GET", "h"], ["HGET", "h", "a"], ["EXISTS", "k", "k", "b"], ["DEL", "k", "k", "b"], ["EXISTS", "k"],
        ["nope"], [], ["SET", "", ""], ["GET", ""], ["SAVE"], ["SAVE", "now"], ["ſet", "a", "b"],
    ]
    got = answers(spark, session)
    assert [got[i] for i in range(len(session))] == [Store.run(s, w) for s in [Store()] for w in session]
    assert got[10] == ("error", WRONG, None) and got[16] == ("integer", None, 2) and got[17] == ("integer", None, 1)


def random_session(seed, n):
    rnd = random.Random(seed)
    keys, fields = [f"k{i}" for i in range(7)], ["f", "g"]
    out = []
    for i in range(n):
        k = rnd.choice(keys)
        out.append(rnd.choice([["SET", k, f"v{i * 7919 % 101}"], ["GET", k], ["HSET", k, rnd.choice(fields), f"w{i * 31 % 57}"], ["HGET", k, rnd.choice(fields)], ["DEL", k, rnd.choice(keys), k], ["EXISTS", k, rnd.choice(keys), k], ["DEL", k], ["KEYS", "*"], ["KEYS", "k*"], ["hget", k], ["bad"]]))
    return out


def test_random_logs_match_a_sequential_interpreter(spark):
    for seed in (1, 2):
        session = random_session(seed, 400)
        store, expected, keys = Store(), {}, set()
        for i, w in enumerate(session):
            r = store.run(w)
            if r[0] == "keys":
                keys |= {(i, k) for k in r[1]}
            else:
                expected[i] = r
        c = commands(spark, session).cache()
        assert {r["seq"]: (r["kind"], r["str"], r["int"]) for r in replay.replies(c).collect()} == expected
        good = c.where("error is null")
        assert {tuple(r) for r in replay.state(c).select("key", "type", "field", "value").collect()} == store.rows()
        times = spark.createDataFrame([(i,) for i, w in enumerate(session) if w == ["KEYS", "*"]], "at bigint")
        assert {(r["at"], r["key"]) for r in replay.keys_at(good, times).collect()} == keys
        c.unpersist()


def test_wire_forms(spark):
    cases = [(b"*1\r\n$4\r\nPING\r\n", "complete", [b"PING"]), (b"PING\r\n", "error", []), (b"*1\r\n$4\r\nPI", "incomplete", []), (b"*0\r\n", "complete", []), (b"*1\r\n$-1\r\n", "complete", [b""]), (b"*-1\r\n", "error", []), (b"  \r\n*1\r\n$1\r\na\r\n", "complete", [b"a"]), (b"*1\r\n$1\r\nabc", "error", []), (b"", "incomplete", [])]
    for frame, status, words in cases:
        assert wire.parse(frame)[:2] == (status, words) or status == "incomplete" and wire.parse(frame)[0] == status
    both = wire.encode([b"SET", b"a", "é".encode()]) + wire.encode([b"GET", b"a"])
    assert wire.parse_all(both) == ([[b"SET", b"a", "é".encode()], [b"GET", b"a"]], "complete", len(both))
    row = spark.range(1).select(fn.bulk_reply(F.lit("é")).alias("a"), fn.bulk_reply(F.lit(None).cast("string")).alias("b"), fn.integer_reply(F.lit(3)).alias("c"), fn.error_reply(F.lit("x")).alias("d"), fn.array_reply(F.array(F.lit("k"))).alias("e")).first()
    assert tuple(row) == ("$2\r\né\r\n", "$-1\r\n", ":3\r\n", "-ERR x\r\n", "*1\r\n$1\r\nk\r\n")


def test_stream_equals_batch(spark):
    from keyloft.plans.catalog import replay_replies, stream_replay

    d = "/root/testdata/sf0.001"
    assert sorted(map(tuple, stream_replay(spark, d).select("seq", "kind", "str", "int").collect()), key=lambda r: r[0]) == sorted(map(tuple, replay_replies(spark, d).select("seq", "kind", "str", "int").collect()), key=lambda r: r[0])


def test_streams_of_bytes_in_any_cuts():
    rnd = random.Random(3)
    sent = [[bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 5, 40]))) for _ in range(rnd.randint(0, 4))] for _ in range(120)]
    stream = b"".join(rnd.choice([b"", b"\r\n", b"  "]) + wire.encode(words) for words in sent)
    for most in (1, 7, 200):
        splitter, got, at = wire.Splitter(), [], 0
        while at < len(stream):
            n = rnd.randint(1, most)
            done, broken = splitter.feed(stream[at : at + n])
            assert not broken
            got += done
            at += n
        assert got == sent and not splitter.waits()
    for bad in (b"*x\r\n", b"*\r\n", b"*1 \r\n", b"*+1\r\n", b"*1\r\n$\r\n", b"*1\r\n$1x\r\na\r\n", b"*1\r\n$-2\r\n", b"*-1\r\n", b"*1\r\n:1\r\n", b"*1\r\n$1\r\nab\r\n"):
        assert wire.parse_all(wire.encode([b"A"]) + bad + wire.encode([b"B"])) == ([[b"A"]], "error", len(bad) + 22)
    assert wire.parse_all(wire.encode([b"A"]) + b"*2\r\n$1\r\n") == ([[b"A"]], "incomplete", 11)


def test_all_commands_of_all_frames_run(spark):
    """A session in frames of any cuts over three connections answers as a sequential interpreter, KEYS too."""
    rnd = random.Random(4)
    session = [w for w in random_session(5, 150) if w]
    store, expected = Store(), []
    for w in session:
        kind, text, number = store.run(w)
        expected.append(fn_reply(kind, text, number))
    stream = b"".join(wire.encode([x.encode() for x in w]) for w in session)
    frames, at = [], 0
    while at < len(stream):
        n = rnd.choice([1, 30, 200, 700])
        frames.append((len(frames), "c", stream[at : at + n]))
        at += n
    df = spark.createDataFrame(frames, "seq bigint, conn string, frame binary").repartition(3)
    log = replay.from_words(wire.parse_frames(df, conn="conn"))
    assert [bytes(r["reply"]) for r in replay.wire_replies(log).orderBy("seq").collect()] == expected
    pieces = spark.createDataFrame([(0, b"*1\r\n$4\r\nPI"), (1, None), (2, b"x")], "seq bigint, frame binary")
    assert [(r["seq"], r["status"]) for r in wire.parse_frames(pieces).orderBy("seq").collect()] == [(0, "incomplete"), (1, "incomplete"), (2, "error")]
    assert [tuple(r) for r in replay.replies(replay.from_words(wire.parse_frames(pieces))).select("kind", "str").collect()] == [("error", "protocol error")]


def fn_reply(kind, text, number):
    def bulk(x):
        return b"$-1\r\n" if x is None else b"$%d\r\n%s\r\n" % (len(x.encode()), x.encode())

    if kind == "keys":
        return b"*%d\r\n" % len(text) + b"".join(map(bulk, text))
    return {"simple": f"+{text}\r\n".encode(), "error": f"-ERR {text}\r\n".encode(), "integer": f":{number}\r\n".encode(), "bulk": bulk(text)}[kind]


def test_exists_at_looks_before_the_command(spark):
    log = commands(spark, [["SET", "a", "1"], ["DEL", "a", "b"], ["HSET", "a", "f", "1"], ["GET", "a"]])
    wanted = spark.createDataFrame([(t, k) for t in range(6) for k in ("a", "b")] + [(2, "a")], "at bigint, key string")
    got = {(r["at"], r["key"]): r["found"] for r in replay.exists_at(log, wanted).collect()}
    assert got == {(t, k): k == "a" and t in (1, 3, 4, 5) for t in range(6) for k in ("a", "b")}


def test_a_session_saves_and_starts_again(spark, tmp_path):
    from keyloft.plans import session

    path = f"file://{tmp_path}/state"
    first = commands(spark, [["SET", "k", "v"], ["HSET", "h", "f", "1"], ["SAVE"], ["SET", "k", "later"], ["SAVE", "x"]])
    assert [(r["kind"], r["str"]) for r in session.run(first, path).orderBy("seq").collect()][2:] == [("simple", "OK"), ("simple", "OK"), ("error", "SAVE command takes no arguments")]
    again = session.run(commands(spark, [["GET", "k"], ["HGET", "h", "f"], ["KEYS", "*"], ["HSET", "k", "f", "1"], ["DEL", "h", "k"]]), path).orderBy("seq").collect()
    assert [(r["kind"], r["str"], r["int"], r["items"]) for r in again] == [("bulk", "v", None, None), ("bulk", "1", None, None), ("array", None, 2, ["h", "k"]), ("error", WRONG, None, None), ("integer", None, 2, None)]
    (tmp_path / "file").write_text("no folder")
    failed = session.run(first, f"file://{tmp_path}/file/state").orderBy("seq").collect()
    assert (failed[2]["kind"], failed[2]["str"]) == ("error", "ERR Failed to save RDB") and failed[0]["str"] == "OK"


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    """Two runs on one checkpoint, the second over what came since, answer as one replay; what ran before is not answered again."""
    from keyloft.plans import tables
    from keyloft.streaming.replay import key_replies, whole_replies
    from keyloft.streaming.runner import run_parts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    events.where("event_id <= 400").coalesce(1).write.parquet(source)
    first = run_parts(spark, source, folder, "*.parquet", tables.mixed_log).count()
    events.where("event_id > 400").coalesce(1).write.mode("append").parquet(source)
    parts = run_parts(spark, source, folder, "*.parquet", tables.mixed_log)
    assert first == events.where("event_id <= 400").count() and parts.count() == events.count()
    log = tables.mixed_log(events)
    assert sorted(map(str, whole_replies(parts).collect())) == sorted(map(str, replay.replies(log).collect()))
    assert sorted(map(str, key_replies(parts).collect())) == sorted(map(str, replay.key_arrays(log).collect()))


def test_stream_state_calls_do_not_grow_with_rows():
    """Each batch asks the state store for what older ones left, and tells it what is left, not once for each command."""
    import random

    import pandas as pd
    from keyloft.streaming.replay import OPS, KeyReplay

    calls, state = [0], {"head": None, "fields": {}}

    class Head:
        def exists(self):
            calls[0] += 1
            return state["head"] is not None

        def get(self):
            calls[0] += 1
            return state["head"]

        def update(self, new):
            calls[0] += 1
            state["head"] = new

        def clear(self):
            self.update(None)

    class Fields:
        def containsKey(self, f):
            calls[0] += 1
            return f in state["fields"]

        def getValue(self, f):
            calls[0] += 1
            return state["fields"][f]

        def updateValue(self, f, v):
            calls[0] += 1
            state["fields"][f] = v

        def clear(self):
            calls[0] += 1
            state["fields"] = {}

    class Handle:
        def getValueState(self, *_):
            return Head()

        def getMapState(self, *_):
            return Fields()

    draw, kept = random.Random(1), None  # kept: None, a text, or a dict
    replay_of = KeyReplay()
    replay_of.init(Handle())
    seq = 0
    for size in (1, 3, 700, 1, 2, 5, 900, 4, 40, 1, 6, 300, *[2] * 60):
        rows, expected = [], []
        resets = draw.random() < 0.5
        for _ in range(size):
            seq += 1
            op = draw.choice(OPS if resets else ("HSET", "GET", "HGET", "EXISTS"))
            f, v = draw.choice(["a", "b", None, "c"]), draw.choice(["x", "y", None, str(seq)])
            rows.append((seq, 0, OPS.index(op), f, v))
            string, existed, found = isinstance(kept, tuple), kept is not None, None
            if op == "SET":
                kept, string = (v,), True
            elif op == "DEL":
                kept, string = None, False
            elif op == "HSET" and not string:
                kept = {**(kept or {}), f: v}
            elif op == "GET" and string:
                found = kept[0]
            elif op == "HGET" and kept and not string:
                found = kept.get(f)
            expected.append((seq, 0, "k", OPS.index(op), string, existed, found))
        draw.shuffle(rows)
        frames = [pd.DataFrame(rows[a : a + 256], columns=["seq", "pos", "op", "field", "value"]) for a in range(0, size, 256)]
        calls[0] = 0
        got = [tuple(r) for frame in replay_of.handleInputRows(("k",), iter(frames), None) for r in frame.itertuples(index=False)]
        assert [tuple(None if x != x else x for x in r) for r in got] == expected
        assert calls[0] <= 20
        assert isinstance(kept, dict) == (state["head"] is not None and state["head"][0] == "hash")
