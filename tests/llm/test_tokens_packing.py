import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from keyloft.llm.packing import best_two_fit, pack, pack_documents, tightest_pair, token_pieces
from keyloft.llm.tokens import PieceCounter, WordIds, count_tokens
from tests.llm.conftest import EDGES

PARTS = ["a", " ", "  ", "\n", "\t", "É", "é", "it's", "don't", "<|endoftext|>", "<|EndOfText|>", "1", "23", "!!", ",", "ß", "Σ", "ΑΣ", "日本", "▁", " ", "İ", "x.y", "'s", " ", "<s>", "</s>", "<unk>", "\x00", "ﬁ", "µ", "ª", "'", "🙂", "<", "|", "hello"]


def texts(n, seed=0):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 16))) for _ in range(n)]


def test_counts_equal_the_library(spark):
    c = PieceCounter(P.path("piece_bpe_32k.model"))
    some = texts(3000)
    assert c.counts(some) == [c.whole(t) for t in some]
    docs = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert c.counts(docs) == [c.whole(t) for t in docs]


def test_memory_of_chunks_is_bounded(monkeypatch):
    from keyloft.llm import tokens

    monkeypatch.setattr(tokens, "MEMORY", 50)
    c, w = PieceCounter(P.path("piece_bpe_32k.model")), WordIds(P.path("word_bpe_49k.json"))
    some = texts(500, 1)
    assert [c.counts([t])[0] for t in some] == [c.whole(t) for t in some]
    assert [w.of_text(t) for t in some] == [w.pack(w.tokenizer.encode(t, add_special_tokens=False).ids) for t in some]
    assert len(c.known) <= 60 and len(w.known) <= 200


def test_ids_equal_the_library(spark):
    w = WordIds(P.path("word_bpe_49k.json"))
    some = texts(3000, 2) + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in some:
        assert w.of_text(t) == w.pack(w.tokenizer.encode(t, add_special_tokens=False).ids), t


def test_count_tokens_on_edges(spark, edges, none):
    rows = count_tokens(edges, limit=100).collect()
    assert len(rows) == len(EDGES) and count_tokens(none).count() == 0
    model = PieceCounter(P.path("piece_bpe_32k.model")).model
    expected = sorted((str(d), len((t or "").encode()), len(model.encode(t or ""))) for d, t, *_ in EDGES)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in rows)


def test_tightest_pair_is_the_best():
    rng = np.random.default_rng(0)
    for _ in range(300):
        free, room = rng.integers(0, 3, 20) * (rng.random(20) < 0.5), int(rng.integers(1, 30))
        free[0] = 0
        free = np.pad(free, (0, 20))
        sums = [a + b for a in range(1, 20) for b in range(1, 20) if free[a] and free[b] and (a != b or free[a] > 1) and a + b <= room]
        got = tightest_pair(free, room)
        assert (sum(got) if got else None) == (max(sums) if sums else None)
        assert got is None or free[got[0]] and free[got[1]] and (got[0] != got[1] or free[got[0]] > 1)


def one_by_one(counts, capacity):
    """Bins filled one at a time by the same rule."""
    left, bins = counts.copy(), []
    while left.any():
        b, gap = [], capacity
        while True:
            fits = [s for s in range(1, gap + 1) if left[s]]
            if not fits:
                break
            b.append(fits[-1])
            left[fits[-1]] -= 1
            gap -= fits[-1]
        while gap and len(b) > 1:
            b.sort(reverse=True)
            pair = tightest_pair(left, gap + b[-1])
            if pair is None or sum(pair) <= b[-1]:
                break
            gap += b[-1] - sum(pair)
            left[b.pop()] += 1
            for s in pair:
                left[s] -= 1
            b += pair
        bins.append(sorted(b, reverse=True))
    return bins


def test_plan_equals_filling_bins_one_by_one():
    rng = np.random.default_rng(1)
    for _ in range(60):
        capacity = 24
        counts = np.zeros(capacity + 1, np.int64)
        counts[1:] = rng.integers(0, 5, capacity)
        plan = best_two_fit(counts, capacity)
        bins = [b for b, n in plan for _ in range(n)]
        total = np.zeros_like(counts)
        for b in bins:
            assert sum(b) <= capacity
            for s in b:
                total[s] += 1
        assert (total == counts).all()
        assert bins == one_by_one(counts, capacity)


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_on_edges(spark, edges, none):
    rows = pack_documents(edges, capacity=512).collect()
    w = WordIds(P.path("word_bpe_49k.json"))
    expected = []
    for d, t, *_ in EDGES:
        ids = w.of_text(t or "") + bytes(4)
        expected += [(str(d), k, at // 4, len(ids[at : at + 2048]) // 4, zlib.crc32(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    n = check_packing(rows, 512)
    assert n <= -(-sum(r["length"] for r in rows) // 512) + 1
    assert pack_documents(none).count() == 0


def test_packing_of_documents_is_tight(spark):
    rows = pack_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert check_packing(rows, 2048) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_one_length_with_many_rows(spark):
    pieces = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "0L as start", "700L as length", "1L as ids_crc32")
    rows = pack(pieces).collect()
    assert check_packing(rows, 2048) == 2500 and len(rows) == 5000


def test_lengths_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError, match="does not fit"):
        pack(spark.sql("select 1L doc_id, 3000L length, 1L ids_crc32"))


def test_ids_column_holds_the_tokens(spark, edges):
    for r in token_pieces(edges, with_ids=True).collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]


def test_place_columns_are_replaced_and_saved_tables_go(spark):
    from pyspark.sql import functions as F

    from keyloft.llm import common
    from keyloft.llm.packing import pack

    rows = spark.range(50).select((F.col("id") % 7 * 300 + 1).alias("length"), F.lit(1).cast("bigint").alias("ids_crc32"), F.lit("own").alias("sequence_id"), F.lit("own").alias("Offset"))
    got = pack(rows)
    assert got.columns == ["length", "ids_crc32", "sequence_id", "offset"] and {type(r["offset"]) for r in got.collect()} == {int}
    with common.tidied():
        with common.tidied():
            inner, outer = common.Saved(spark.range(3), "inner"), common.Saved(spark.range(3), "outer", outer=True)
        assert outer.df.count() == 3
        fs = spark._jvm.org.apache.hadoop.fs.Path(inner.path).getFileSystem(spark._jsc.hadoopConfiguration())
        there = lambda t: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(t.path))
        assert not there(inner) and there(outer)
    assert not there(outer)


def test_long_texts_without_spaces_are_cut_where_no_piece_crosses(monkeypatch):
    """Counts equal those of the whole text, whatever is cut: scripts without spaces, signs of spaces, special strings."""
    import public_tokenizers as P

    from keyloft.llm import tokens

    c = tokens.PieceCounter(P.path("piece_bpe_32k.model"))
    rnd = random.Random(7)
    signs = ["a", "the", "in", "é", "日", "本", "▁", " ", "  ", "\n", "\t", "ing", "<s>", "<0x41>", "🙂", "\u0301", "0", "ион", "\x00", "</s>"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 80))) for _ in range(300)] + ["日本語" * 2000, "x" * 30_000, "ab\n" * 5000, "▁" * 50, ""]
    for split in (1, 5, 64):
        monkeypatch.setattr(tokens, "SPLIT", split)
        c.known.clear()
        c.known[""] = 1
        assert c.counts(texts) == [c.whole(t) for t in texts]
    monkeypatch.setattr(tokens, "SPLIT", 100)
    assert max(map(len, c.parts("日本語" * 2000))) < 110 and "".join(c.parts("日本語" * 2000)) == "日本語" * 2000
