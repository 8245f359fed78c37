"""SimHash with BK-trees and the pivot-permutation index, against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import pivot_index, simhash_bk
from pagewright.workspace import Workspace

DOCS = "doc_id long, text string, fp string, component_id string, a int"


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    for x, y in linked:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def test_fingerprints_of_odd_texts():
    for text in ("", " \t\n\v\f\r ", "One", "Two words", "ÀÉ stay, ABC don't\x1cjoined", "a b c d " * 400, "x y z w"):
        assert simhash_bk.fingerprint(text.encode()) == brute_fingerprint(text), text


@pytest.mark.parametrize(("tree_size", "broadcast_entries"), [(1024, 1 << 20), (3, 0), (5, 200)])
def test_groups_match_brute_force(spark, tree_size, broadcast_entries):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:25]:  # near ones, some of them chains
        at = int(b)
        for _ in range(4):
            at ^= 1 << int(rng.integers(64))
            if rng.random() < 0.5:
                at ^= 1 << int(rng.integers(64))
            fps.add(at)
    fps |= {int(base[0]) ^ (1 << i) ^ (1 << j) ^ (1 << 40) for i in range(6) for j in range(6)}  # a dense ball
    fps = sorted(fps)
    ws = Workspace(spark, "test")
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    signed = lambda x: x % (1 << 64)
    found = {frozenset((signed(r.a), signed(r.b))) for r in simhash_bk.links(ws, frame, 2, tree_size, broadcast_entries).collect()}
    brute = {frozenset((x, y)) for i, x in enumerate(fps) for y in fps[:i] if (x ^ y).bit_count() <= 2}
    assert found == brute


def test_fingerprints_of_the_table(spark, sf_dir):
    from pagewright.llm.queries import QUERIES, table

    rows = {r.doc_id: brute_fingerprint(r.text) for r in table(spark, sf_dir, "documents").collect()}
    ids = sorted(rows)
    linked = [(i, j) for k, i in enumerate(ids) for j in ids[:k] if (rows[i] ^ rows[j]).bit_count() <= 2]
    component = components(ids, linked)
    found = QUERIES["op3_simhash_bk_trees"](spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {(i, f"{rows[i]:016x}", component[i]) for i in ids}


def test_bk_tree_follows_edges_within_the_radius():
    rng = np.random.default_rng(1)
    items = np.unique(rng.integers(0, 1 << 20, 500, dtype=np.uint64))
    tree = simhash_bk.BKTree(items)
    for radius in (0, 1, 3):
        q, n = tree.near(items, radius)
        brute = {(i, j) for i in range(len(items)) for j in range(len(items)) if int(items[i] ^ items[j]).bit_count() <= radius}
        assert set(zip(q.tolist(), n.tolist(), strict=True)) == brute


def test_documents_with_nulls_ties_and_clashing_columns(spark):
    rows = [(3, "A b c d e", "x", "y", 1), (1, "a B c d e", None, None, None), (1, "a B c d e", "x", "y", 1), (7, None, "x", "y", 1), (8, "", "x", "y", 1), (None, "a b c d e", "x", "y", 1), (None, "other words are here now", "x", "y", 1), (9, "long " * 50_000, "x", "y", 1)]
    found = simhash_bk.near_duplicates(Workspace(spark, "test"), spark.createDataFrame(rows, DOCS)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, -1 if r.component_id is None else r.component_id) for r in found)
    assert got[:-2] == [(False, 1, 1), (False, 1, 1), (False, 3, 1), (False, 7, 7), (False, 8, 7), (False, 9, 9)]
    assert {x[2] for x in got[-2:]} == {1, -1}
    empty = simhash_bk.near_duplicates(Workspace(spark, "test"), spark.createDataFrame([], DOCS))
    assert empty.columns == ["doc_id", "fp", "component_id"] and empty.count() == 0


def test_keep_one_keeps_columns(spark):
    rows = [(3, "A b c d e", "x", "y", 1), (1, "a B c d e", "x", "y", 2), (5, "something else entirely, it is", "x", "y", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash_bk.keep_one(Workspace(spark, "test"), docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5]


def test_keep_one_similar_keeps_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long, 1, 2, 3, "a"), (1, long + " more", 4, 5, 6, "b"), (None, long, 7, 8, 9, "c"), (1, long + " more", 4, 5, 6, "b"), (4, None, 1, 1, 1, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, id int, component_id int, `row.x` string")
    kept = simhash_bk.keep_one_similar(Workspace(spark, "test"), docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(spark.createDataFrame([r], docs.schema).first()) for r in rows[1:])
    assert simhash_bk.keep_one_similar(Workspace(spark, "test"), docs.limit(0)).count() == 0


@pytest.mark.parametrize("part", [512, 4])
def test_similar_texts_match_brute_force(spark, part):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = rng.choice(vocabulary, 150).tolist()
        for k in range(10):
            text = list(base)
            for at in rng.integers(0, 150, (0, 1, 2, 4, 8)[k % 5]):
                text[at] = str(rng.choice(vocabulary))
            rows.append((len(rows) * 3, " ".join(text), "x", "y", g))
    rows += [(1, "short text", "x", "y", 1), (2, "short  text", "x", "y", 1), (4, None, "x", "y", 1), (5, "", "x", "y", 1), (None, rows[0][1], "x", "y", 1), (0, rows[0][1], "x", "y", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash_bk.keep_one_similar(Workspace(spark, "test"), docs, 0.8) if part == 512 else None
    groups = simhash_bk.similar_groups(Workspace(spark, "test"), docs, part=part)
    named = {r.text or "": r.component_id for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS n").join(groups, F.expr("n = node")).collect()}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {t or "": shingles(t) for _, t, *_ in rows}
    ids = {t: min(i for i, u, *_ in rows if (u or "") == t and i is not None) for t in sets}
    linked = [(ids[t], ids[u]) for t in sets for u in sets if t < u and sets[t] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])]
    comp = components(set(ids.values()), linked)
    assert {t: comp[i] for t, i in ids.items()} == named and len(linked) > 100
    if kept is not None:
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, t, *_ in rows if i is not None and comp[ids[t or ""]] == i)
        assert kept.where("doc_id is null").count() == 1


def test_copies_that_link_by_their_original_only(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 400)]
    texts = [base]
    for k in range(600):  # each at 0.8 or more to the original, two of them far below
        copy = list(base)
        for n, at in enumerate(rng.choice(400, 8, replace=False)):
            copy[at] = f"c{k}x{n}"
        texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(396)} for t in texts]
    assert all(len(x & sets[0]) >= 0.8 * len(x | sets[0]) for x in sets)
    docs = spark.createDataFrame([(i, " ".join(t), "x", "y", 1) for i, t in enumerate(texts)], DOCS)
    for shingles in (simhash_bk.PART_SHINGLES, 50_000):
        groups = simhash_bk.similar_groups(Workspace(spark, "test"), docs, part_shingles=shingles).collect()
        assert len(groups) == 601 and {r.component_id for r in groups} == {0}


def test_similar_texts_with_far_fingerprints(spark):
    rows, told = [], {}

    def add(*texts):
        first = len(rows)
        for t in texts:
            told[len(rows)] = first
            rows.append((len(rows), " ".join(t), "x", "y", 1))

    for g in range(20):  # a line that one of two copies repeats
        base, line = [f"a{g}x{i}" for i in range(300)], [f"b{g}x{i}" for i in range(12)]
        add(base, *(base + line * n for n in (10, 20, 50, 200)))
    for g in range(3000):  # 8 words and 9 words, 4 of 5 shingles in common: those whose fingerprints are far apart
        base = [f"s{g}x{i}" for i in range(9)]
        one, two = (simhash_bk._bits_of(simhash_bk.shingle_hashes(" ".join(t).encode())) for t in (base[:8], base))
        if (one ^ two).bit_count() > simhash_bk.WIDE_RADIUS:
            add(base[:8], base)
    assert len(rows) > 105
    groups = simhash_bk.similar_groups(Workspace(spark, "test"), spark.createDataFrame(rows, DOCS))
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "xxhash64(text) AS n")
    assert {r.doc_id: r.component_id for r in docs.join(groups, F.expr("n = node")).collect()} == told


# ---------------------------------------------------------------------------------------------- vectors


VECTORS = "vec_id long, embedding array<float>, label int, rep int, n_links string"


def brute_vectors(rows, threshold=0.93):
    """{vec_id: (links, component)} by comparing all pairs."""
    good = [(i, np.array(v, dtype=np.float32).astype(float), g) for i, v, g in rows if i is not None and v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {}
    for k, (i, x, g) in enumerate(good):
        for j, y, h in good[:k]:
            if g == h and i != j and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links.setdefault(i, set()).add(j)
                links.setdefault(j, set()).add(i)
    ids = {i for i, *_ in rows if i is not None}
    comp = components(ids, [(i, j) for i, js in links.items() for j in js])
    return {i: (len(links.get(i, ())), comp[i]) for i in ids}


def test_all_vectors_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    found = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_duplicates(Workspace(spark, "test"), table).collect()}
    brute = brute_vectors(rows)
    assert sum(n for n, _ in found.values()) >= 0.9 * sum(n for n, _ in brute.values())
    assert all(found[i][0] <= brute[i][0] for i in brute)
    assert sum(found[i] == brute[i] for i in brute) >= 0.98 * len(brute)


@pytest.mark.parametrize("part_rows", [256, 7])
def test_recall_on_clusters_at_the_threshold(spark, part_rows):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(24)
        for _ in range(12):
            rows.append((len(rows), (centre + rng.uniform(0.1, 0.3) * rng.standard_normal(24)).astype(float).tolist(), c % 2, 0, "x"))
    found = {r.vec_id: r.n_links for r in pivot_index.near_duplicates(Workspace(spark, "test"), spark.createDataFrame(rows, VECTORS), part_rows=part_rows).collect()}
    brute = brute_vectors([r[:3] for r in rows])
    total = sum(n for n, _ in brute.values())
    assert total > 200 and sum(found.values()) >= 0.97 * total
    assert all(found[i] <= brute[i][0] for i in brute)


def test_vectors_with_nulls_and_copies(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 1), (3, v, 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, [], 1), (None, v, 1), (12, [1.0, 2.0], 1), (13, [3e38, 3e38, 3e38], 3), (14, [1.0, 1.0, 1.0], 3)]
    found = pivot_index.near_duplicates(Workspace(spark, "test"), spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS)).collect()
    assert len(found) == len(rows)
    brute = brute_vectors(rows)
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id) == brute[r.vec_id], r
            assert r.kept == (r.vec_id == r.component_id)
    assert pivot_index.near_duplicates(Workspace(spark, "test"), spark.createDataFrame([], VECTORS)).count() == 0


# ---------------------------------------------------------------------------------------------- what joins move


def moved_rows(node):
    """Most rows that one exchange of an executed plan has written."""
    name, below = node.nodeName(), [node.children().apply(i) for i in range(node.children().size())]
    if name == "AdaptiveSparkPlan":
        below = [node.executedPlan()]
    elif name.endswith("QueryStage"):
        below = [node.plan()]
    own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return max([own, *map(moved_rows, below)])


def test_texts_that_stay_are_not_moved(spark):
    rows = [(i, " ".join(f"w{i % 950}x{k}" for k in range(12)), "x", "y", 1) for i in range(1000)]
    bar = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the rows that go were too many to be sent
    try:
        kept = simhash_bk.keep_one_similar(Workspace(spark, "test"), spark.createDataFrame([*rows, (None, rows[0][1], "x", "y", 1)], DOCS))
        ids = [r.doc_id for r in kept.collect()]
        assert sorted(i for i in ids if i is not None) == list(range(950)) and ids.count(None) == 1
        assert 50 <= moved_rows(kept._jdf.queryExecution().executedPlan()) <= 100  # 50 of 1,001 go
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bar)


def test_a_sieve_holds_all_its_keys_and_few_others(spark):
    from pagewright.sieve import Sieve

    rows = spark.range(20000)
    found = rows.where(Sieve(rows.where("id < 10000"), 10000, "id").may_hold(F.col("id"))).agg(F.count_if(F.col("id") < 10000), F.count("*")).first()
    assert found[0] == 10000 and found[1] < 10150
    assert rows.where(Sieve(rows.limit(0), 0, "id").may_hold(F.col("id"))).count() == 0
