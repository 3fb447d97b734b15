import random

import pytest

from tests.llm.helpers import ODD, documents
from vertexloom.llm.components import connected_components
from vertexloom.llm.near_duplicates import NearDuplicateSettings, near_duplicates


def brute(rows, k, percent=80):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().translate(bytes(range(256)).lower()).split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 30, 80]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, rng.choice([" ", "  ", "\n"]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
            n += 1
            base = copy if rng.random() < 0.4 else base
    rng.shuffle(rows)
    found = near_duplicates(documents(spark, rows), NearDuplicateSettings(shingle_words=4)).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == brute(rows, 4)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(400):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(60)] = f"x{rng.randrange(50)}"
        rows.append((n, " ".join(copy)))
    found = near_duplicates(documents(spark, rows), NearDuplicateSettings(shingle_words=4)).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == brute(rows, 4)


def test_odd_rows(spark):
    found = near_duplicates(documents(spark, ODD, extra=True), NearDuplicateSettings(shingle_words=4)).collect()
    got = sorted((str(r[0]), *r[1:]) for r in found)
    assert got == [("1", 0, 1, True), ("2", 0, 2, True), ("3", 0, 3, True), ("4", 1, 4, True), ("4", 1, 4, True), ("5", 4, 5, True), ("6", 4, 5, False), ("7", 1, 7, True), ("8", 2, 8, True), ("9", 1, 9, True), ("None", 2, None, True)]


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert near_duplicates(documents(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}


@pytest.mark.parametrize("block", [3, 512])
def test_blocks_lose_no_pair(spark, monkeypatch, block):
    import vertexloom.llm.near_duplicates as n

    monkeypatch.setattr(n, "BLOCK_NODES", block)
    monkeypatch.setattr(n, "BLOCK_SHINGLES", block * 1000)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(40)] = f"x{rng.randrange(8)}"
        rows.append((i, " ".join(copy)))
    found = near_duplicates(documents(spark, rows), NearDuplicateSettings(shingle_words=4)).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == brute(rows, 4)


def test_links_within_a_block():
    import numpy as np

    from vertexloom.llm.near_duplicates import joined_labels, links_within

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 20000, np.uint64)
    sets = [np.unique(np.concatenate([base[: 20000 - k], rng.integers(0, 2**64, k, np.uint64)])) for k in (0, 1000, 4300, 2300, 7000)] + [np.unique(base[:13000]), rng.integers(0, 2**64, 3, np.uint64)]
    ok = links_within(sets, 80)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            common = len(np.intersect1d(x, y))
            assert i == j or ok[i, j] == (100 * common >= 80 * (len(x) + len(y) - common))
    linked = np.zeros((6, 6), bool)
    linked[0, 3] = linked[4, 5] = True
    assert joined_labels(np.array([2, 2, 1, 1, 3, 0]), linked | linked.T).tolist() == [0, 1, 1, 0]


def test_bitmaps_rule_out_no_link():
    import numpy as np

    from vertexloom.llm.near_duplicates import bitmap, links_within, may_link

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 3000, np.uint64)
    sets = [np.unique(np.concatenate([base[: n - n * k // 100], rng.integers(0, 2**64, n * k // 100, np.uint64)])) for n in (1, 2, 5, 9, 60, 64, 65, 70, 500, 520, 600, 2900) for k in (0, 5, 11, 15, 60)]
    linked = links_within(sets, 80)
    labels = np.arange(len(sets))
    keep = may_link([np.frombuffer(bitmap(s), np.uint8) for s in sets], np.array([len(s) for s in sets]), labels, 80)
    linked[labels, labels] = False
    assert (keep >= linked.any(axis=1)).all() and not keep.all()
    assert not may_link([np.frombuffer(bitmap(s), np.uint8) for s in sets], np.array([len(s) for s in sets]), np.zeros(len(sets), int), 80).any()


def test_rows_shipped_grow_with_the_bucket(spark):
    """Documents that share a template, and a band, but no link: their sets don't travel."""
    import vertexloom.llm.near_duplicates as n

    shipped = []
    for size in (30, 300):
        rng = random.Random(size)
        template = [f"w{i}" for i in range(80)]
        rows = [(i, " ".join(template + [f"y{i}-{j}" for j in range(40)])) for i in range(size)]
        found = n.near_duplicates(documents(spark, rows), NearDuplicateSettings(shingle_words=4, band_rows=1))
        assert found.where("kept").count() == size
        sets = n._sets_of(documents(spark, rows).selectExpr("doc_id AS id", "text AS body"), spark.range(size).select("id"), False, NearDuplicateSettings(shingle_words=4))
        prefixes = n._prefix_members(spark.range(size).withColumnRenamed("id", "node"), sets, NearDuplicateSettings(shingle_words=4))
        shipped.append(n._groups_to_compare(prefixes, spark.createDataFrame([], "node bigint, label bigint")).count())
    assert shipped[1] <= 10 * shipped[0]


def test_memory_of_a_worker_is_bounded():
    """Spark reuses Python workers: what they keep stays in the way of every later stage."""
    import tracemalloc

    from vertexloom.llm import near_duplicates as module

    texts = [b"some words of a text " * 50] * (module.SLICE_BYTES // 1050)
    module.shingle_sets(texts, 5)
    assert sum(kept.nbytes for kept in module._cache.values()) <= 20 << 20
    tracemalloc.start()
    try:
        module.shingle_sets(texts, 5)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
