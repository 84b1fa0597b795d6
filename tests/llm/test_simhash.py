import random

import numpy as np
import xxhash

from keyloft.llm.components import components
from keyloft.llm import simhash
from keyloft.llm.simhash import Bands, Tries, distinct_documents, fingerprint, near_duplicates, near_links, similar_documents, sketch, trie_pairs
from tests.llm.conftest import DOCUMENT, EDGES


def plain_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(fps, budget=4):
    """Root of each position by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints_equal_the_definition():
    rnd = random.Random(1)
    for t in ["", None, "One two", "a b c d", "A\x0bb\x0cC d e É", " ".join(rnd.choice(["x", "Yy", "zé"]) for _ in range(20_000)), *(" ".join(str(rnd.randint(0, 9)) for _ in range(n)) for n in range(1, 30))]:
        assert fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t)


def test_trie_pairs_equal_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    near = np.concatenate([base, *[base ^ sum(np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64) for _ in range(n)) for n in (1, 2, 3)]])
    x = np.unique(np.concatenate([near, [np.uint64(0), np.uint64(2**64 - 1)]]))
    y = np.unique(np.concatenate([near[::2], rng.integers(0, 2**63, 50).astype(np.uint64)]))
    for budget in (0, 2, 4):
        got = {(i, j) for a, b in trie_pairs(x, y, budget) for i, j in zip(a.tolist(), b.tolist())}
        assert got == {(i, j) for i in range(len(x)) for j in range(len(y)) if int(x[i] ^ y[j]).bit_count() <= budget}


def test_pairs_within_a_range_only():
    rng = np.random.default_rng(6)
    x = np.unique((rng.integers(0, 8, 400).astype(np.uint64) << np.uint64(61)) | rng.integers(0, 64, 400).astype(np.uint64))
    starts = np.flatnonzero(np.concatenate([[True], (x[1:] >> np.uint64(61)) != (x[:-1] >> np.uint64(61))]))
    roots = np.stack([starts, np.append(starts[1:], len(x))])
    got = {tuple(sorted(p)) for a, b in trie_pairs(x, x, 2, 3, roots) for p in zip(a.tolist(), b.tolist()) if p[0] != p[1]}
    assert got == {(i, j) for j in range(len(x)) for i in range(j) if int(x[i] ^ x[j]).bit_count() <= 2 and x[i] >> np.uint64(61) == x[j] >> np.uint64(61)}


def test_fingerprints_within_the_budget_share_a_subtrie():
    rng = np.random.default_rng(4)
    for budget, n in ((4, 10**5), (4, 10**9), (4, 10**12), (0, 10), (3, 10**7)):
        tries = Tries(budget, n, 4096)
        assert len(set(map(tuple, tries.orders))) == len(tries.orders) and min(tries.bits) >= 1
        x = rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 500).astype(np.uint64)
        y = x.copy()
        for k in range(len(y)):
            for b in rng.choice(64, budget, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(b)
        shared = np.zeros(len(x), bool)
        for t in range(len(tries.orders)):
            u, v = tries.values(t, x), tries.values(t, y)
            assert (np.bitwise_count(u ^ v) == np.bitwise_count(x ^ y)).all()
            shared |= tries.subtries(t, u) == tries.subtries(t, v)
        assert shared.all()


def test_links_of_a_hot_subtrie_equal_brute_force(spark):
    """Half of all fingerprints share their first bits, and subtries are dealt into parts."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    x[:150] = (x[:150] & np.uint64(0x3FF)) | np.uint64(0xABC0_0000_0000_0000)
    x = np.unique(x)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp bigint")
    for leaf in (7, 50, 4096):
        root = {int(r["node"]): int(r["root"]) for r in components(near_links(df, 4, leaf)).collect()}
        groups, expected = {}, {}
        for k, g in enumerate(groups_of([int(v) for v in x])):
            v = int(x.view(np.int64)[k])
            groups.setdefault(root.get(v, v), set()).add(v)
            expected.setdefault(g, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_equal_union_find(spark):
    rnd = random.Random(7)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000), (2001, None), (3000, 3000 + 1)] * 2
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in links:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(links, "u bigint, v bigint")).collect()))
    assert got == {a: find(a) for a in root if find(a) != a}


def test_few_links_are_settled_in_one_task(spark):
    links = spark.range(1, 400).selectExpr("(id * 37) % 401 as u", "((id + 1) * 37) % 401 as v").union(spark.createDataFrame([(900, 907), (907, 907), (None, 3), (911, 907)], "u bigint, v bigint"))
    stepped = sorted(map(tuple, components(links, alone=0).collect()))
    spark.sparkContext.setJobGroup("settled", "settled")
    try:
        assert sorted(map(tuple, components(links).collect())) == stepped
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("settled")) < 12  # the steps of a chain take dozens
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert components(links.where("u < 0")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(30):
        t = [rnd.choice(words) for _ in range(120)]
        for _ in range(rnd.randint(1, 6)):
            u = list(t)
            for _ in range(rnd.randint(0, 2)):
                u[rnd.randrange(len(u))] = rnd.choice(words)
            rows.append((len(rows), " ".join(u), "en", "s", 1))
    rnd.shuffle(rows)
    fps = [plain_fingerprint(r[1]) for r in rows]
    root = groups_of(fps)
    least = {}
    for r, k in zip(rows, root):
        least[k] = min(least.get(k, 10**9), r[0])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, DOCUMENT), leaf=16).collect()}
    assert got == {r[0]: (f"{f:016x}", least[k]) for r, f, k in zip(rows, fps, root)}
    kept = distinct_documents(spark.createDataFrame(rows, DOCUMENT)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(least.values()))


def test_edges(spark, edges, none):
    got = near_duplicates(edges).collect()
    assert len(got) == len(EDGES) and near_duplicates(none).count() == 0
    of = {r["doc_id"]: r for r in got}
    assert of[1]["component_id"] == of[5]["component_id"] == of[6]["component_id"] == 1
    assert of[2]["fingerprint"] == of[3]["fingerprint"] == of[8]["fingerprint"] == "0" * 16 and of[8]["component_id"] == 2
    assert of[None]["component_id"] is None
    kept = distinct_documents(edges)
    assert kept.columns == edges.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "4", "7", "9", "None"])
    assert distinct_documents(none).count() == 0
    kept = similar_documents(edges)
    assert kept.columns == edges.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "4", "7", "9", "None"])
    assert similar_documents(none).count() == 0


def test_no_text_is_lost_where_doc_ids_repeat(spark):
    a, b = "one two three four five six seven", "quite another text that has nothing of it"
    for rows in ([(3, b), (5, b), (5, a)], [(5, a), (5, b), (3, b)], [(5, b), (3, b), (5, a), (5, a)]):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCUMENT).coalesce(1)
        for f in (distinct_documents, similar_documents):
            assert sorted((r["doc_id"], r["text"]) for r in f(docs).collect()) == [(3, b), (5, a)]
    nameless = spark.createDataFrame([(None, a, "en", "s", 1), (None, a, "en", "s", 1), (None, b, "en", "s", 1), (7, b, "en", "s", 1)], DOCUMENT)
    for f in (distinct_documents, similar_documents):
        assert sorted((str(r["doc_id"]), r["text"]) for r in f(nameless).collect()) == [("7", b), ("None", a)]


def plain_shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_sketches_equal_the_definition():
    for t in ("", None, "One two", "a b a b a b a b a b", " ".join(map(str, range(5000)))):
        h = [xxhash.xxh64_intdigest(s, 42) for s in plain_shingles(t)]
        bits = ""
        for k in range(3):
            mixed = []
            for x in h:
                x = (x + k * 0x9E3779B97F4A7C15) % 2**64
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                mixed.append((x ^ x >> 31).to_bytes(8, "little"))
            bits += "".join(str(int(2 * sum(m[b // 8] >> (7 - b % 8) & 1 for m in mixed) > len(h))) for b in range(64))
        assert sketch(t.encode() if t is not None else None, 5, 3) == int(bits, 2).to_bytes(24, "big")


def test_similar_documents_follow_the_similarity_of_shingles(spark):
    """Copies with scattered edits: nearly all at a similarity of 0.8 or more go, unlike ones stay; also where subtries are dealt into parts."""
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    rows, similar = [], []
    for g in range(150):
        t = [rnd.choice(words) for _ in range(400)]
        u = list(t)
        for _ in range(rnd.choice([0, 1, 4, 7, 30, 60])):
            u[rnd.randrange(400)] = rnd.choice(words)
        a, b = plain_shingles(" ".join(t)), plain_shingles(" ".join(u))
        similar.append(len(a & b) / len(a | b))
        rows += [(2 * g, " ".join(t), "en", "s", 1), (2 * g + 1, " ".join(u), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENT)
    for leaf in (4096, 16):
        kept = {r["doc_id"] for r in similar_documents(docs, leaf=leaf).collect()}
        assert all(2 * g in kept for g in range(150))
        near = [g for g, x in enumerate(similar) if x >= 0.8]
        far = [g for g, x in enumerate(similar) if x < 0.8]
        assert len(near) > 60 and len(far) > 30
        assert sum(2 * g + 1 not in kept for g in near) >= 0.93 * len(near)
        assert sum(2 * g + 1 in kept for g in far) >= 0.98 * len(far)


def test_spanning_forests():
    rng = np.random.default_rng(3)
    for _ in range(30):
        i, j, bits = rng.integers(0, 40, 60), rng.integers(0, 40, 60), rng.integers(0, 5, 60)
        root = np.arange(40)
        used = simhash.spanning(root, i, j)
        assert (root == simhash.forest(40, iter([(i, j)]))).all() and len(used) == 40 - len(set(root.tolist()))
        doubt, whole = simhash.Doubtful(), simhash.Doubtful()
        whole.add(np.arange(40), i, j, bits)
        for k in range(0, 60, 20):
            doubt.add(np.arange(40), i[k : k + 20], j[k : k + 20], bits[k : k + 20])
            doubt.pairs = [doubt.forest(np.arange(40))]
        a, b = (d.forest(np.arange(40)) for d in (doubt, whole))
        assert a[2].sum() == b[2].sum() and a.shape == b.shape


def test_bands_bring_similar_texts_together():
    for n in (10, 10**5, 10**8, 10**11):
        b = Bands(0.8, n, 4096)
        assert 1 - (1 - (1 - b.differ) ** b.first) ** b.tries >= 0.96 and b.width * 64 >= b.tries * b.first
        assert n / 2**b.first <= 4096 / 16 or b.first == 32


def test_similar_documents_leave_out_no_pair(spark):
    """Short and long texts around the similarity, some sharing very frequent shingles: the groups are those of comparing all pairs."""
    rnd = random.Random(21)
    words, line = [f"w{i}" for i in range(2000)], "this line stands in every second text of the table".split()
    rows = []
    for g in range(160):
        t = [rnd.choice(words) for _ in range(rnd.choice([8, 9, 10, 14, 30, 60, 250]))] + line * (g % 2)
        for _ in range(rnd.randint(1, 4)):
            u = t + [rnd.choice(words) for _ in range(rnd.choice([0, 1, 1, 2, len(t) // 6]))]
            for _ in range(rnd.choice([0, 0, 1, len(t) // 60])):
                u[rnd.choice([0, -1, rnd.randrange(len(u))])] = rnd.choice(words)
            rows.append((len(rows), " ".join(u), "en", "s", 1))
    sets, root = [plain_shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    expected = sorted({find(k) for k in range(len(rows))})
    assert len(expected) < 0.75 * len(rows)
    assert sorted(r["doc_id"] for r in similar_documents(spark.createDataFrame(rows, DOCUMENT)).collect()) == expected


def test_a_large_group_of_near_copies_costs_links_by_its_texts(spark):
    """No pair of subtries or parts meets: what joins a group grows with its texts, and one of it stays."""
    rnd = random.Random(22)
    t = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    texts = []
    for _ in range(600):
        u = list(t)
        u[rnd.randrange(300)] = f"v{rnd.randrange(10**6)}"
        texts.append(" ".join(u))
    bands = Bands(0.8, len(texts), 16)
    distinct = spark.createDataFrame([(k, sketch(x.encode(), 5, bands.width)) for k, x in enumerate(texts)], "node bigint, sketch binary")
    links = simhash.star_links(distinct, bands)
    assert links.count() <= simhash.STARS * len(texts)
    assert components(links).count() == len(texts) - 1
    docs = spark.createDataFrame([(k, x, "en", "s", 1) for k, x in enumerate(texts)], DOCUMENT)
    assert [r["doc_id"] for r in similar_documents(docs, leaf=16).collect()] == [0]


def joined_groups(sets, root):
    """The smallest position that each reaches, by comparing all pairs of sets, from the given groups on."""
    root = list(root)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def test_links_by_differences_are_those_of_all_pairs():
    """Whatever the centre is, also none, and with groups known before."""
    rnd = random.Random(31)
    for trial in range(30):
        base = [rnd.sample(range(10**6), 60) for _ in range(rnd.choice([1, 2]))]
        sets = []
        for _ in range(60):
            s = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 12)):
                s[rnd.randrange(len(s))] = rnd.choice([rnd.randrange(10**6), rnd.randrange(20)])
            sets.append(set(s[: rnd.randint(40, 60)]))
        centre = set(rnd.choice([base[0], base[-1][:30], [], rnd.sample(range(10**6), 500)]))
        first = list(range(60))
        for i in range(1, 60, 7):
            first[i] = i - 1
        differ = [np.array(sorted(s ^ centre), np.uint64) for s in sets]
        links = [*simhash.linked_by_differences(np.array(first), np.array([len(s) for s in sets]), differ, 0.8)]
        expected = joined_groups(sets, first)
        assert len(links) == len(set(first)) - len(set(expected))  # a spanning forest
        root = {i: i for i in range(60)}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        assert [find(x) for x in first] == expected


def test_near_copies_around_the_similarity_are_no_pairs(spark, monkeypatch):
    """Copies of one text with none to nine edits, many under 0.8 to most others: the groups are those of all pairs, the pairs that leave a task grow with the texts, also where a cell is dealt into parts."""
    rnd = random.Random(32)
    base, texts = [f"w{rnd.randrange(5000)}" for _ in range(150)], []
    for _ in range(500):
        u = list(base)
        for _ in range(rnd.randint(0, 9)):
            u[rnd.randrange(150)] = f"v{rnd.randrange(10**6)}"
        texts.append(" ".join(u))
    sets = [plain_shingles(t) for t in texts]
    expected = sorted(set(joined_groups(sets, range(len(sets)))))
    assert 100 < len(expected) < 400
    docs, pairs, whole = spark.createDataFrame([(k, x, "en", "s", 1) for k, x in enumerate(texts)], DOCUMENT), [], simhash.possible_pairs
    monkeypatch.setattr(simhash, "possible_pairs", lambda found, *a: (pairs.append(found.count()), whole(found, *a))[1])
    for leaf in (4096, 200):
        pairs.clear()
        assert sorted(r["doc_id"] for r in similar_documents(docs, leaf=leaf).collect()) == expected
        assert sum(pairs) <= 10 * len(texts)
