import re

import numpy as np
import pytest
import xxhash

from lexloom.llm import graph, queries, simhash

SF = "/root/testdata/sf0.001"


def brute_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(prints, near=lambda a, b: (a ^ b).bit_count() <= 3):
    """prints: (key, fingerprint); the least key of each component."""
    root = {k: k for k, _ in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if near(x, y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k in root}


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = [(r["doc_id"], brute_print(r["text"])) for r in rows]
    expected = brute_components(prints)
    got = queries.op2_simhash_dedup(spark, SF).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(k, f"{x:016x}", expected[k]) for k, x in prints}
    assert len(got) == len(rows)


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 1), (4, " \t\n", 1), (7, "A b", 1), (6, "a B", 1), (6, "a B", 1), (None, "zz yy xx ww", 1), (9, "é " * 30000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    two = f"{xxhash.xxh64_intdigest(b'a b', 42):016x}"
    assert {(5, "0" * 16, 3), (3, "0" * 16, 3), (4, "0" * 16, 3), (7, two, 6), (6, two, 6)} <= got
    assert (None, f"{brute_print('zz yy xx ww'):016x}", None) in got and len(got) == 7
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_links_within_the_radius_are_all_found(spark, seed, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)  # cells are cut into blocks
    rng = np.random.default_rng(seed)
    fp = list(rng.integers(0, 2**64, 30, dtype=np.uint64))
    for _ in range(170):  # chains of neighbours
        x = fp[rng.integers(0, len(fp))]
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= np.uint64(1 << int(b))
        fp.append(x)
    fp = sorted({int(x) for x in fp})
    signed = [x - 2**64 * (x >= 2**63) for x in fp]
    points = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "node long, fp0 long")
    edges = simhash.links(points, 1, 3, lambda f: simhash.grid_cells(f[:, 0].copy(), 3))
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    expected = brute_components(list(enumerate(fp)))
    assert {i: got.get(i, i) for i in range(len(fp))} == expected


def test_cells_share_a_key_within_the_radius():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 500, dtype=np.uint64)
    b = a.copy()
    for i in range(500):
        for bit in rng.choice(64, 3, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    assert (simhash.grid_cells(a, 3) == simhash.grid_cells(b, 3)).any(axis=1).all()


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 160)] + [(7, 7), (300, 300), (2, 1)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys([*range(100, 160), 200], 100)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def words(rng, n):
    return [f"w{int(x)}" for x in rng.integers(0, 5000, n)]


def test_keep_one_drops_near_copies_and_keeps_others(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        text = words(rng, 400)
        rows.append((10 * i, " ".join(text), "s"))
        rows.append((10 * i + 1, " ".join(text), "s"))  # exact copy
        edited = text.copy()
        for at in (40, 160, 300):  # 15 of 396 shingles: similarity above 0.9
            edited[at] = "changed"
        rows.append((10 * i + 2, " ".join(edited), "s"))
        rows.append((10 * i + 3, " ".join(text[:200] + words(rng, 200)), "s"))  # half shared: stays
    rows += [(5000, None, "s"), (5001, "", "s"), (5002, "  ", None), (None, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = {r["doc_id"] for r in got.collect()}
    assert kept == {10 * i + j for i in range(40) for j in (0, 3)} | {5000, 5001, 5002, None}


def test_similar_classes_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        if w:
            sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    expected = brute_components(list(sets.items()), lambda a, b: 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links = sum(expected[k] != k for k in expected)
    wrong = [k for k in expected if expected[k] != got[k]]
    assert set(got) == set(expected) and links > 40 and len(wrong) <= 0.01 * links, wrong


def test_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TEXT_BLOCK", 5)
    monkeypatch.setattr(simhash, "BLOCK", 9)
    rng = np.random.default_rng(8)
    text = words(rng, 300)
    rows = []
    for i in range(60):
        edited = text.copy()
        edited[int(rng.integers(0, 300))] = f"x{i}"
        rows.append((i, " ".join(edited)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(60), 0)


def test_unequal_numbers_of_repeats_part_no_near_copies(spark):
    rng = np.random.default_rng(11)
    rows, sets = [], {}
    for i in range(40):
        text, phrase = words(rng, 300), words(rng, 10)
        at = int(rng.integers(20, 280))
        rows.append((10 * i, " ".join(text)))
        rows.append((10 * i + 1, " ".join(text[:at] + phrase * 8 + text[at:])))
        rows.append((10 * i + 2, " ".join(text + text[-1:] * 25)))
    for k, t in rows:
        w = t.split()
        sets[k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    expected = brute_components(list(sets.items()), lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    assert expected == {k: k // 10 * 10 for k in sets}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_texts_with_the_same_long_run_stay_apart(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(words(rng, 60) + ["0"] * 300)) for i in range(30)]
    rows += [(100 + i, t) for i, t in rows[:5]]  # exact copies
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(docs).collect()}
    assert got == {k: k % 100 for k, _ in rows}


def test_a_node_is_a_set_of_shingles(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b  c d e f"), (3, "a b c d e f a b c d e f"), (4, "x y"), (5, "X Y"), (6, " "), (7, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["node"] for r in simhash.fingerprint_column(docs, "doc_id", "text", 5, 2, distinct=True).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5] and got[6] is got[7] is None


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_a_small_set_is_compared_whichever_comes_first(order):
    """Seven shingles against eight, with fingerprints that are far from each other."""
    texts = ["a b c d e f g h i j k", "a b c d e f g h i j k l"]
    fp = np.array([[0] * 16, [2**64 - 1] * 16], np.uint64)
    picked = [texts[i] for i in order]
    assert simhash.alike(picked, np.array([5, 9])[list(order)], fp, 10, 5, 0.8, np.zeros(2, int))[0] == [(5, 9)[order[0]]]
