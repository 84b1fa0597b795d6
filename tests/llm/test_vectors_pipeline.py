import importlib

import numpy as np
import pytest

from keyloft.llm import vectors
from keyloft.llm.vectors import near_vectors, nodes_of

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """vec_id -> (links, component) by comparing all pairs."""
    ids = [r[0] for r in rows]
    root = dict(zip(ids, ids))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = dict.fromkeys(ids, 0)
    good = [(i, np.array(x, np.float32).astype(float), y) for i, x, y in rows if i is not None and y is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
    for k, (i, x, y) in enumerate(good):
        for j, z, w in good[:k]:
            if y == w and len(x) == len(z) and x @ z / np.linalg.norm(x) / np.linalg.norm(z) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (links[i], find(i)) for i in ids}


def result(df):
    out = {}
    for r in df.collect():
        assert r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"])
        out[r["vec_id"]] = (r["n_links"], r["component_id"])
    return out


def clustered(n, dim, clusters, size, seed, noise=0.12):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for c in range(clusters):
        x[c * size : (c + 1) * size] = x[c * size] + rng.standard_normal((size, dim)) * noise
    order = rng.permutation(n)
    return [(int(i), x[k].tolist(), int(k // size % 3)) for i, k in enumerate(order)]


def test_links_equal_brute_force(spark):
    rows = clustered(500, 16, 12, 9, 1)
    expected = brute(rows)
    assert sum(n for n, _ in expected.values()) > 200
    assert result(near_vectors(spark.createDataFrame(rows, SCHEMA))) == expected


def test_saturated_lists_are_enlarged(spark):
    rows = clustered(260, 12, 1, 150, 2, noise=0.08)
    expected = brute(rows)
    assert max(n for n, _ in expected.values()) > 40
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(near_vectors(df, k=8)) == expected
    members = nodes_of(df).selectExpr("1 as root", "node", "x", "copies", "label").where("label = 0")
    counts = {r["node"]: r["linked"] for r in vectors.component_counts(members, 0.93, block=7).collect()}
    assert all(counts[i] == expected[i][0] for i, _, y in rows if y == 0)


def split_group(size, dim=64, seed=5):
    """Two groups of one label: all links within a group are closer than those across."""
    rng = np.random.default_rng(seed)
    one = rng.standard_normal(dim)
    one /= np.linalg.norm(one)
    side = rng.standard_normal(dim)
    side -= side @ one * one
    two = 0.945 * one + np.sqrt(1 - 0.945**2) * side / np.linalg.norm(side)
    x = [c + rng.standard_normal(dim) * 0.008 for c in (one, two) for _ in range(size)]
    return [(int(i), x[k].tolist(), 0) for i, k in enumerate(rng.permutation(2 * size))]


def test_links_across_saturated_components(spark):
    rows = split_group(40) + [(100 + i, x, 1) for i, x, _ in split_group(25, seed=6)]
    expected = brute(rows)
    assert {expected[i][1] for i in range(80)} == {0} and min(n for n, _ in expected.values()) > 24
    assert result(near_vectors(spark.createDataFrame(rows, SCHEMA))) == expected
    assert result(near_vectors(spark.createDataFrame(rows, SCHEMA), k=8)) == expected


def test_every_component_is_computed_whole(spark, monkeypatch):
    from keyloft.llm.common import Saved

    rows = split_group(6)
    chain = spark.createDataFrame([(i, [i + 1], [0.95]) for i in range(11)], vectors.LISTS)
    monkeypatch.setattr(vectors, "descend", lambda *a, **b: Saved(chain, "lists"))
    monkeypatch.setattr(vectors, "audit", lambda *a: 1.0)
    assert result(near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (6, [1.0, 0.0], None), (7, [0.0, 0.0], 1), (8, None, 1), (10, [], 1), (11, [nan, 1.0], 1), (12, [inf, 1.0], 1), (13, [1.0, None], 1), (14, [1.0, 0.0, 0.0], 1), (15, [1e-30, 0.0], 1), (16, [0.9, 0.5], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(near_vectors(df)) == brute(rows)
    more = near_vectors(df.union(spark.createDataFrame([(None, [1.0, 0.0], 1)], SCHEMA)).selectExpr("*", "'own' as node", "1 as n_links"))
    assert more.columns == ["vec_id", "n_links", "component_id", "kept"] and more.count() == len(rows) + 1
    assert near_vectors(df.limit(0)).count() == 0


def test_audit_sees_missing_links(spark):
    rows = clustered(200, 16, 10, 8, 3)
    nodes = nodes_of(spark.createDataFrame(rows, SCHEMA)).cache()
    full = spark.createDataFrame([(i, n) for i, (n, _) in brute(rows).items()], "node bigint, linked bigint")
    assert vectors.audit(nodes, full, 0.93) == 1.0
    assert vectors.audit(nodes, full.selectExpr("node", "cast(linked / 2 as bigint) as linked"), 0.93) < 0.6
    assert vectors.audit(nodes, full.limit(0), 0.93) == 0.0


def test_audit_is_not_hidden_by_a_large_group(spark):
    rng = np.random.default_rng(8)
    hot = rng.standard_normal(16) + rng.standard_normal((200, 16)) * 0.01
    pairs = np.repeat(rng.standard_normal((15, 16)), 2, axis=0) + rng.standard_normal((30, 16)) * 0.01
    rows = [(i, x.tolist(), 0) for i, x in enumerate(np.concatenate([hot, pairs]))]
    nodes = nodes_of(spark.createDataFrame(rows, SCHEMA)).cache()
    counts = {i: n for i, (n, _) in brute(rows).items()}
    assert vectors.audit(nodes, spark.createDataFrame([*counts.items()], "node bigint, linked bigint"), 0.93) == 1.0
    assert vectors.audit(nodes, spark.createDataFrame([*counts.items()][:200], "node bigint, linked bigint"), 0.93) == 0.0


def test_a_failed_audit_ends_in_exact_blocks(spark, monkeypatch):
    first = vectors.first_lists
    monkeypatch.setattr(vectors, "first_lists", lambda *a: first(*a).limit(0))
    rows = clustered(200, 16, 10, 8, 3) + [(300, [1.0, 0.0], 1), (301, [1.0, 0.1], 1)]
    expected = brute(rows)
    assert result(near_vectors(spark.createDataFrame(rows, SCHEMA), most=1)) == expected


def test_a_failed_search_of_saturated_groups_ends_in_exact_blocks(spark, monkeypatch):
    """Four attempts whose lists lose most neighbours do not reach the recall; the result is whole all the same."""
    rows = split_group(30) + [(100 + i, x, 1) for i, x, _ in clustered(120, 12, 8, 9, 9)]
    whole, tried = vectors.descend, []

    def poor(*a, **b):
        tried.append(a[1])
        return vectors.Saved(whole(*a, **b).df.where("node % 3 = 0"), "lists")

    monkeypatch.setattr(vectors, "descend", poor)
    assert result(near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert len(tried) == 4 and tried == [tried[0] << k for k in range(4)]


def test_a_component_of_over_4096_vectors(spark):
    """A chain of vectors with lists far from full: every link of the one large component counts."""
    rng, x = np.random.default_rng(7), [np.eye(32)[0]]
    for _ in range(4400):
        side = rng.standard_normal(32)
        side -= side @ x[-1] * x[-1]
        x.append(0.95 * x[-1] + np.sqrt(1 - 0.95**2) * side / np.linalg.norm(side))
    kept = np.array(x, np.float32).astype(float)
    unit = kept / np.linalg.norm(kept, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    got = result(near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)))
    assert [got[i][0] for i in range(len(x))] == (linked.sum(axis=1) - 1).tolist()
    assert {r[1] for r in got.values()} == {0}


def test_an_audit_without_links_is_not_a_pass(spark):
    rng = np.random.default_rng(4)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(rng.standard_normal((60, 48)))]
    nodes = nodes_of(spark.createDataFrame(rows, SCHEMA)).cache()
    assert vectors.audit(nodes, spark.createDataFrame([], "node bigint, linked bigint"), 0.93) is None
    with pytest.warns(UserWarning, match="not measured"):
        assert {r for r in result(near_vectors(spark.createDataFrame(rows, SCHEMA))).values()} == {(0, i) for i in range(60)}


def test_repeated_rows_of_a_vector_are_no_other_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [2.0, 0.0], 0), (4, [1.0, 0.0], 0)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(k, 3, 1) for k in (1, 2, 3, 4)}


def test_unlike_vectors_of_one_vec_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [1.0, 0.0], 1), (7, [-1.0, 0.0], 0), (9, [-1.0, 0.0], 0), (9, [0.0, -1.0], 1)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = [(1, 1, 1, True)] * 3 + [(2, 1, 1, False), (3, 1, 1, False), (4, 1, 1, False), (7, 1, 7, True), (9, 0, 9, True), (9, 1, 7, False)]
    assert sorted(map(tuple, got)) == expected


def test_lists_of_one_node_are_combined_before_the_shuffle():
    found = [(7, np.array([1, 2]), np.array([0.9, 0.8])), (5, np.array([7]), np.array([0.9])), (7, np.array([3, 1]), np.array([0.95, 0.9]))]
    (batch,) = vectors._combined(found, 2)
    assert batch.to_pylist() == [{"node": 5, "nbrs": [7], "sims": [0.9]}, {"node": 7, "nbrs": [3, 1], "sims": [0.95, 0.9]}]
    assert list(vectors._combined([], 2)) == []


def test_trees_grow_with_the_label(spark):
    of = {n: vectors.trees_for(spark.range(n).selectExpr("id as node", "0 as label", "array(1f) as x")) for n in (0, 64, 2000, 20000, 200000)}
    assert of[0] == of[64] == vectors.TREES < of[2000] < of[20000] < of[200000]
    assert of[20000] == 10


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the pipeline and after each stage, at a small scale."""
    pipeline = importlib.import_module("corpus_pipeline")
    from keyloft.llm.common import save, table

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    out = [docs]
    for name, stage in pipeline.STAGES:
        docs = save(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_take_effect(spark, stages):
    names = [c for c in stages[0].columns]
    assert all(s.columns == names for s in stages[:5])
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in stages[:5]]
    assert ids[0] > ids[1] > ids[2] > ids[3] >= ids[4]
    labels = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    clean = {i for i, r in labels.items() if r["quality"] == 1 and not r["toxic"]}
    assert len(clean & ids[2]) >= 0.97 * len(clean)


def test_near_copies_go_and_one_stays(spark, stages):
    """Of each group of texts with a similarity of five-word shingles of 0.8 or more, one document stays, as by comparing all that share a shingle."""
    from tests.llm.test_simhash import plain_shingles

    rows = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    sets, of = [plain_shingles(t) for _, t in rows], {}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, s in enumerate(sets):
        for j in {j for x in s for j in of.get(x, ())} | ({j for j in range(k) if not sets[j]} if not s else set()):
            if not s or len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                a, b = sorted((find(k), find(j)))
                root[b] = a
        for x in s:
            of.setdefault(x, []).append(k)
    expected = {rows[find(k)][0] for k in range(len(rows))}
    kept = {r["doc_id"] for r in stages[3].collect()}
    assert expected <= kept and len(kept - expected) <= 0.02 * (len(rows) - len(expected))


def test_mixed_words_meet_the_targets(spark, stages):
    from tests.llm.test_urls_mixing import plain_targets

    def words(df):
        out = {}
        for r in df.collect():
            out[r["source"]] = out.get(r["source"], 0) + len(r["text"].encode().split())
        return out

    expected, got = plain_targets(words(stages[3])), words(stages[4])
    assert all(abs(got.get(s, 0) - t) <= 64 for s, t in expected.items())
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_packed_pieces_hold_every_token(spark, stages):
    from tests.llm.test_tokens_packing import check_packing
    import public_tokenizers as P

    from keyloft.llm.tokens import WordIds

    w = WordIds(P.path("word_bpe_49k.json"))
    rows = stages[5].collect()
    assert sum(r["length"] for r in rows) == sum(len(w.of_text(r["text"])) // 4 + 1 for r in stages[4].collect())
    check_packing(rows, 2048)


def folder_of(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def own_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 1, 0), (4, 0, 1), (7, 0, 1), (9, 0, 1), (None, 1, 0), (2, None, 0), (2, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")


def test_the_pipeline_on_edge_rows(spark, edges, own_labels, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and clashing names: no stage fails, each keeps the columns, and a second run agrees."""
    pipeline = importlib.import_module("corpus_pipeline")
    sf = folder_of(spark, f"file://{tmp_path}/sf", edges, own_labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == edges.columns
        before = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
        after = out.collect()
        if name != "mixing":
            assert {(r["doc_id"], r["text"]) for r in after} <= before
        assert all(r["score"] == r["size"] == "own" for r in after)
        # what a stage leaves of these few rows depends on its model; the next one gets all of them
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
    first, again = (sorted(map(str, pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) for _ in range(2))
    assert first == again


def test_the_pipeline_without_documents_or_labels(spark, none, edges, own_labels, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    assert pipeline.run(spark, folder_of(spark, f"file://{tmp_path}/a", none, own_labels)).count() == 0
    assert pipeline.run(spark, folder_of(spark, f"file://{tmp_path}/b", edges, own_labels.limit(0))).count() >= 0
    no_labels = spark.read.parquet(f"file://{tmp_path}/b/documents.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, no_labels.limit(0), f"file://{tmp_path}/b").count() == 0


def test_the_pipeline_clears_what_it_saved(spark, edges, own_labels, tmp_path):
    import os

    from keyloft.llm import common

    pipeline = importlib.import_module("corpus_pipeline")
    folder = "/" + common._own_folder(spark).removeprefix("file:").lstrip("/")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    pipeline.run(spark, folder_of(spark, f"file://{tmp_path}/c", edges, own_labels)).count()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert left <= {"mixing", "pieces"}
