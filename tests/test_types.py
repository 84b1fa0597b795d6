import random

import pytest
from pyspark.sql import functions as F

from keyloft import functions as fn
from keyloft.operators import hashes, lists, sets, zsets
from keyloft.sources import binary, snapshot
from tests.interpreter import IntSet, run_list


def of_list(spark, values, key="l"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "key string, pos bigint, value string")


def values(df):
    return [r["value"] for r in df.orderBy("pos").collect()]


def test_list_rows(spark):
    x = of_list(spark, "abc")
    assert [[r["value"] for r in lists.index(x, i).collect()] for i in (-1, 0, 3, -4)] == [["c"], ["a"], [], []]
    y = of_list(spark, "abaca")
    assert [values(lists.remove(y, n, "a")) for n in (2, -2, 0)] == [list("bca"), list("abc"), list("bc")]
    assert [lists.removed(y, n, "a").first()["removed"] for n in (2, -2, 0)] == [2, 2, 3]
    z = of_list(spark, "abcd")
    cuts = [((1, 2), "bc"), ((-2, -1), "cd"), ((-9, 1), "ab"), ((1, 99), "bcd"), ((3, 1), ""), ((4, 9), ""), ((0, -9), "")]
    for (a, b), left in cuts:
        got = lists.trim(z, a, b)
        assert values(got) == list(left) and [r["pos"] for r in got.orderBy("pos").collect()] == list(range(len(left)))
    p = of_list(spark, "pqp")
    assert values(lists.insert(p, "p", "x", True)) == list("xpqp") and values(lists.insert(p, "p", "x", False)) == list("pxqp") and values(lists.insert(p, "z", "x", True)) == list("pqp")
    rest, popped = lists.pop(z, front=False)
    assert values(rest) == list("abc") and popped.first()["value"] == "d"
    assert lists.pop(z.limit(0), front=True)[1].count() == 0


def test_list_fold_matches_an_interpreter(spark):
    rnd = random.Random(5)
    log, expected = [], {}
    for k in range(25):
        ops = []
        for s in range(rnd.randint(0, 40)):
            op = rnd.choice(["LPUSH", "RPUSH", "RPUSH", "LPOP", "RPOP", "LTRIM", "LREM", "LINSERT_BEFORE", "LINSERT_AFTER"])
            ops.append((op, rnd.choice("abc"), rnd.choice("xyz"), rnd.randint(-3, 3), rnd.randint(-9, 9)))
            log.append((f"k{k}", s, *ops[-1]))
        if run_list(ops):
            expected[f"k{k}"] = run_list(ops)
    df = spark.createDataFrame(log, "key string, seq bigint, op string, value string, arg string, a bigint, b bigint")
    got = {}
    for r in lists.fold(df).orderBy("key", "pos").collect():
        got.setdefault(r["key"], []).append(r["value"])
    assert got == expected


def test_integer_parsing(spark):
    texts = ["7", "+7", "007", "-0", "9223372036854775807", "9223372036854775808", " 5 ", "5\n", "+", "", "1.0", "٣", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(fn.parse_int(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [7, 7, 7, 0, 2**63 - 1, None, None, None, None, None, None, None, None]


@pytest.mark.parametrize("limit", [4, 512])
def test_set_replay_matches_an_interpreter(spark, limit):
    rnd = random.Random(limit)
    log, expected, stores = [], [], {}
    for s in range(900):
        k, op = f"k{rnd.randint(0, 9)}", rnd.choice(["ADD", "ADD", "REM", "HAS"])
        m = rnd.choice(["", "0", "+", "00"]) + str(rnd.randint(0, 8)) if rnd.random() < 0.985 else rnd.choice(["x", " 5", "5\n", "+"])
        log.append((s, k, op, m))
        expected.append(stores.setdefault(k, IntSet(limit)).run(op, m))
    df = spark.createDataFrame(log, "seq bigint, key string, op string, member string")
    assert [r["reply"] for r in sets.replay(df, limit).orderBy("seq").collect()] == expected
    assert {tuple(r) for r in sets.final_members(df, limit).collect()} == {(k, m) for k, s in stores.items() for m in s.members()}


def test_full_integer_set_is_promoted_by_a_member_it_has(spark):
    log = [(i, "k", "ADD", str(i)) for i in range(1, 513)] + [(600, "k", "ADD", "1"), (601, "k", "ADD", "01")]
    got = {r["seq"]: r["reply"] for r in sets.replay(spark.createDataFrame(log, "seq bigint, key string, op string, member string")).collect()}
    assert got[600] == 0 and got[601] == 1


def test_scored_sets(spark):
    w = spark.createDataFrame([("z", "b", 1.0, 1), ("z", "a", 1.0, 2), ("z", "c", 0.0, 3)], "key string, member string, score double, seq bigint")
    s = zsets.add(w)
    assert [r["member"] for r in zsets.rank(s).orderBy("rank").collect()] == ["c", "a", "b"]
    assert zsets.range_by_score(s, 0, 1).count() == 3
    later = zsets.add(spark.createDataFrame([("z", "c", 5.0, 1)], w.schema), s)
    assert {r["member"]: r["rank"] for r in zsets.rank(later).collect()}["c"] == 2
    with pytest.raises(Exception, match="not a number"):
        zsets.add(spark.createDataFrame([("z", "c", float("nan"), 1)], w.schema)).collect()


def test_hash_encoding_and_maps(spark):
    rows = [("a", f"f{i}", "v") for i in range(511)] + [("b", f"f{i}", "v") for i in range(512)] + [("c", "f", "v" * 65), ("d", "é" * 32, "v")]
    f = spark.createDataFrame(rows, "key string, field string, value string")
    assert dict(map(tuple, hashes.encoding(f).collect())) == {"a": "small", "b": "table", "c": "table", "d": "small"}
    assert {r["key"]: len(r["fields"]) for r in hashes.as_maps(f).collect()} == {"a": 511, "b": 512, "c": 1, "d": 1}
    after = hashes.hset(f.where("key = 'c'"), spark.createDataFrame([("c", "f", "x", 2), ("c", "f", "y", 1)], "key string, field string, value string, seq bigint"))
    assert [tuple(r) for r in after.collect()] == [("c", "f", "x")]


def test_snapshots(spark, tmp_path):
    sizes = [0, 63, 64, 127, 128, 255, 256, 16383, 16384]
    df = spark.createDataFrame([(f"k{n}", "x" * n) for n in sizes], "key string, value string")
    path = f"file://{tmp_path}/snap"
    assert snapshot.load(spark, path, "key string, value string").count() == 0
    snapshot.save(df, path)
    assert sorted(len(r["value"]) for r in snapshot.load(spark, path, "key string, value string").collect()) == sizes
    snapshot.save(df.limit(1), path)
    assert snapshot.load(spark, path, "key string, value string").count() == 1


def test_binary_snapshot(spark, tmp_path):
    pairs = [(b"a", b""), (b"b", {b"f": b"1", b"g": b"\xff"}), (b"c", b"x" * 63), (b"d", b"y" * 256), (b"a", b"later")]
    data = binary.encode(pairs)
    assert list(binary.decode(data)) == pairs[:4]
    for n in (64, 127, 128, 255, 16384):
        with pytest.raises(ValueError):
            binary.encode([(b"k", b"x" * n)])
    for bad in (b"", data[:-12], b"X" + data, binary.HEADER + bytes([7])):
        with pytest.raises(binary.Damaged):
            list(binary.decode(bad))
    (tmp_path / "a.snap").write_bytes(data)
    assert binary.read_files(spark, f"file://{tmp_path}/a.snap").count() == 5
    binary.register(spark)
    assert spark.read.format("keysnapshot").option("data", data.hex()).load().count() == 5


def test_set_operators_know_integers_by_value(spark):
    rnd = random.Random(6)
    spell = lambda: rnd.choice(["", "0", "+", "00"]) + str(rnd.randint(0, 9)) if rnd.random() < 0.9 else rnd.choice(["x", "+", " 5"])
    for limit in (4, 512):
        start, stores, adds, asks = [], {}, [], []
        for k in range(30):
            store = stores[f"k{k}"] = IntSet(limit)
            for _ in range(rnd.randint(0, 6)):
                store.run("ADD", spell())
            if store.strings is not None and all(IntSet.number(m) is not None and str(IntSet.number(m)) == m for m in store.strings) and len(store.strings) <= limit:
                store.strings, store.ints = None, {int(m) for m in store.strings}  # its members do not tell that it was promoted
            start += [(f"k{k}", m) for m in store.members()]
            own = [(f"k{k}", spell()) for _ in range(rnd.randint(0, 5))]
            asks += own
            adds += [(*x, s) for s, x in enumerate(own)]
        schema = "key string, member string"
        members, asked = spark.createDataFrame(start, schema), spark.createDataFrame(asks, schema)
        assert {(r["key"], r["member"]): r["found"] for r in sets.contains(members, asked, limit).collect()} == {(k, m): bool(stores[k].run("HAS", m)) for k, m in asks}
        left = {(r["key"], r["member"]) for r in sets.remove(members, asked, limit).collect()}
        gone = {k: IntSet(limit) for k in stores}
        for k, s in gone.items():
            s.ints, s.strings = set(stores[k].ints), None if stores[k].strings is None else set(stores[k].strings)
        for k, m in asks:
            gone[k].run("REM", m)
        assert left == {(k, m) for k, s in gone.items() for m in s.members()}
        after = {tuple(r) for r in sets.add(members, spark.createDataFrame(adds, schema + ", seq bigint"), limit).collect()}
        for k, m, _ in adds:
            stores[k].run("ADD", m)
        assert after == {(k, m) for k, s in stores.items() for m in s.members()}


def test_one_exchange_for_a_set_replay(spark):
    log = spark.createDataFrame([(1, "k", "ADD", "7")], "seq bigint, key string, op string, member string")
    plan = sets.replay(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_pushes_in_front_and_emptied_lists(spark):
    x = of_list(spark, "abc")
    writes = spark.createDataFrame([("l", 1, "p"), ("l", 2, "q"), ("m", 1, "r")], "key string, n int, value string")
    got = lists.prepend(x, writes, "n")
    assert values(got.where("key = 'l'")) == list("qpabc") and values(got.where("key = 'm'")) == ["r"]
    assert [r["pos"] for r in got.where("key = 'l'").orderBy("pos").collect()] == list(range(5))
    empty = lists.trim(x, 5, 9)
    assert [tuple(r) for r in lists.length(empty, x.select("key")).collect()] == [("l", 0)] and lists.length(empty).count() == 0
    log = spark.createDataFrame([("a", 1, "RPUSH", "v", None, None, None), ("a", 2, "LPOP", None, None, None, None), ("b", 1, "LPUSH", "v", None, None, None)], "key string, seq bigint, op string, value string, arg string, a bigint, b bigint")
    assert sorted(map(tuple, lists.fold_lengths(log).collect())) == [("a", 0), ("b", 1)] and [tuple(r) for r in lists.fold(log).collect()] == [("b", 0, "v")]
    assert lists.fold(log.limit(0)).count() == 0


def test_a_long_list_folds_in_linear_time(spark):
    log = spark.range(60_000).selectExpr("'k' as key", "id as seq", "case when id % 3 = 2 then 'LPOP' else 'RPUSH' end as op", "cast(id as string) as value", "'' as arg", "0L as a", "0L as b")
    assert lists.fold(log).count() == 20_000


def test_a_save_that_dies_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    path, schema = f"file://{tmp_path}/s", "key string"
    one, two = spark.createDataFrame([("one",)], schema), spark.createDataFrame([("two",), ("2",)], schema)
    snapshot.save(one, path)

    def die(*a):
        raise RuntimeError("power is gone")

    with monkeypatch.context() as m:
        m.setattr(snapshot, "_point", die)
        with pytest.raises(RuntimeError):
            snapshot.save(two, path)
    assert [r["key"] for r in snapshot.load(spark, path, schema).collect()] == ["one"]
    reader = snapshot.load(spark, path, schema)
    snapshot.save(two, path)
    assert snapshot.load(spark, path, schema).count() == 2 and [r["key"] for r in reader.collect()] == ["one"]
    snapshot.save(one, path)
    assert len(snapshot._pointers(spark, path)) == snapshot.KEPT
    for _, version in snapshot._pointers(spark, path)[:1]:
        fs, folder = snapshot._path(spark, f"{path}/{version}")
        fs.delete(folder, True)
    with pytest.raises(OSError):
        snapshot.load(spark, path, schema)


def test_binary_files_are_written_in_parallel(spark, tmp_path):
    rows = [(f"k{i}".encode(), "string", None, bytes([i % 256]) * (i % 60)) for i in range(300)] + [(f"h{i}".encode(), "hash", f"f{j}".encode(), b"\xff\x00\n" * j) for i in range(40) for j in range(1 + i % 5)]
    df = spark.createDataFrame(rows, "key binary, type string, field binary, value binary").repartition(5)
    path = f"file://{tmp_path}/many"
    binary.write_files(df, path, size=500)
    got = {(bytes(r["key"]), r["type"], None if r["field"] is None else bytes(r["field"]), bytes(r["value"])) for r in binary.read_files(spark, path).collect()}
    assert got == set(rows)
    names = [f for f in (tmp_path / "many").iterdir() if f.name.startswith("part")]
    assert len(names) > 8 and all(f.read_bytes().endswith(b"\xff" + bytes(8)) and f.read_bytes()[:9] == binary.HEADER for f in names)
    with pytest.raises(Exception, match="cannot be read back"):
        binary.write_files(spark.createDataFrame([(b"k", "string", None, b"x" * 100)], df.schema), f"file://{tmp_path}/bad")


def test_one_set_is_replayed_over_many_tasks(spark):
    """No exchange or window deals the log by its key alone, and a promotion counts what other blocks of seqs left."""
    import re

    from keyloft.operators import sets

    step = 1 << sets.BLOCK - 1  # two seqs to a block
    ops = [("ADD", "1"), ("ADD", "+1"), ("ADD", "2"), ("REM", "01"), ("ADD", "3"), ("HAS", "x"), ("ADD", "4"), ("ADD", "05"), ("HAS", "05"), ("HAS", "4"), ("REM", "04"), ("ADD", "6")]
    log = spark.createDataFrame([(n * step, key, op, m) for key in ("a", None) for n, (op, m) in enumerate(ops)], "seq bigint, key string, op string, member string")
    replay = sets.replay(log, limit=3, by_blocks=True)
    got = {(r["key"], r["seq"] // step): (r["id"], r["reply"]) for r in replay.collect()}
    # 1, 2, then 2, 3, 4 at seq 6; 05 finds three members and promotes
    expected = [("1", 1), ("1", 0), ("2", 1), ("1", 1), ("3", 1), (None, 0), ("4", 1), ("05", 1), ("05", 1), ("4", 1), ("04", 0), ("6", 1)]
    assert got == {(key, n): x for key in ("a", None) for n, x in enumerate(expected)}
    assert not re.search(r"hashpartitioning\(key#\d+, \d+\)", replay._jdf.queryExecution().executedPlan().toString())
