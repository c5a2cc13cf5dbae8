import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import chunk_rules as rules
from lexloom.operators import chunking, models, sparse, vectors


def absorb(counts, least):
    """Small pieces join their left neighbour, a small first one its right neighbour."""
    out = list(counts)
    i = 0
    while i < len(out):
        if out[i] < least and i:
            out[i - 1] += out.pop(i)
        elif out[i] < least and len(out) > 1:
            out[:2] = [out[0] + out[1]]
        else:
            i += 1
    return out


def test_closed_form_equals_absorbing(spark):
    rng = np.random.default_rng(0)
    cases = [[100, 60, 200, 10, 150, 149], [10, 20], [5], [150], [149, 150]] + [rng.integers(1, 300, rng.integers(1, 12)).tolist() for _ in range(300)]
    rows = [(d, p, "w", n) for d, case in enumerate(cases) for p, n in enumerate(case)]
    got = chunking.merge_small(spark.createDataFrame(rows, "doc_id int, pos int, text string, tokens int"), min_tokens=150).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["chunk_id"])):
        by.setdefault(r["doc_id"], []).append(r["token_count"])
    assert by == {d: absorb(case, 150) for d, case in enumerate(cases)}
    assert by[0] == [160, 210, 299] and by[1] == [30]


def test_end_to_end_drops_short_sentences_and_keeps_order(spark):
    docs = spark.createDataFrame([(1, "One two three four five. Too short. " + "Again " + "word " * 30 + "end. Last sentence of this text here."), (2, "a b")], "doc_id long, text string")
    got = chunking.chunk_documents(docs, min_tokens=20).orderBy("doc_id", "chunk_id").collect()
    assert [r["text"].split()[0] for r in got] == ["One"] and got[0]["token_count"] == 5 + 32 + 6
    full = docs.select("doc_id", F.inline(chunking.chunk_or_head(F.col("text")))).filter("doc_id = 2").collect()
    assert [(r["text"], r["token_count"]) for r in full] == [("a b", 2)]


def test_chunks_inside_the_row_equal_the_table_form(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join("Begin " + "word " * int(n) + "end." for n in rng.integers(1, 40, rng.integers(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "x"), (99, None)], "doc_id int, text string")
    key = lambda rows: sorted((r["doc_id"], r["chunk_id"], r["text"], r["token_count"]) for r in rows)
    for least in (5, 20, 150):
        table = chunking.merge_small(chunking.chunk_pieces(docs), min_tokens=least).collect()
        assert key(chunking.chunk_documents(docs, min_tokens=least).collect()) == key(table)


def test_repeated_ids_stay_documents_of_their_own(spark):
    text = "One two three four five six. " * 40
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id int, text string")
    got = chunking.chunk_documents(docs).collect()
    assert len(got) == 3 and {r["token_count"] for r in got} == {240}


def test_last_sentences(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "s array<string>")
    for k, expected in ((2, [["b", "c"], ["a"], []]), (0, [[], [], []])):
        assert [r[0] for r in rows.select(chunking.last_sentences(F.col("s"), k)).collect()] == expected


def test_config(spark):
    rows = spark.createDataFrame([("Fast", 60000), ("Fast", 10), ("x", 60000), ("High Quality", 1), ("Balanced", 50000)], "q string, n int")
    assert [r[0] for r in rows.select(chunking.chunk_config(F.col("q"), F.col("n"))).collect()] == [1200, 1000, 1000, 600, 800]


words = lambda n: " ".join(["w"] * n)


def test_pack():
    assert rules.pack([[words(3)], [words(4)]], 10, 1) == [(words(7), 7)]
    assert rules.pack([[words(6)], [words(6)]], 10, 1) == [(words(6) + ".", 6), (words(12), 12)]
    assert rules.pack([[words(6)], [words(6)]], 10, 0) == [(words(6) + ".", 6), (words(6), 6)]
    # an oversized group comes out before the chunk that was open
    assert rules.pack([["a"], ["b b b.", "c c c."]], 4, 0) == [("b b b.", 3), ("c c c.", 3), ("a", 1)]


@given(st.lists(st.lists(st.integers(1, 9), min_size=1, max_size=4), max_size=6), st.integers(3, 20))
def test_pack_without_overlap_loses_no_word(groups, most):
    made = rules.pack([[words(n) for n in g] for g in groups], most, 0)
    assert sum(n for _, n in made) == sum(map(sum, groups))


@given(st.lists(st.lists(st.integers(1, 9), min_size=1, max_size=5), min_size=1, max_size=7), st.integers(3, 25), st.integers(0, 3))
def test_cuts_follow_the_rules(groups, most, overlap):
    counts, sizes = [n for g in groups for n in g], [len(g) for g in groups]
    ends = np.cumsum(sizes).tolist()
    heavy = {e - n: e for n, e, g in zip(sizes, ends, groups, strict=True) if sum(g) > most}  # begin: end of oversized groups
    inside = {i for a, b in heavy.items() for i in range(a, b)}
    found = rules.cut_places(counts, sizes, most, overlap)
    held = [[i for a, b in spans for i in range(a, b)] for spans, _ in found]
    split = [c for c in held if c[-1] in inside]
    whole = [c for c in held if c[-1] not in inside]
    assert sum(closes for _, closes in found) <= 2
    # oversized groups: cuts in order, each as long as fits behind the overlap, one new sentence at least
    for a, b in heavy.items():
        cuts = [c for c in split if a <= c[-1] < b]
        at = a
        for c in cuts:
            assert c == list(range(max(a, at - overlap) if at > a else a, c[-1] + 1)) and c[-1] >= at
            total = sum(counts[i] for i in c)
            assert total <= most or c[-1] == at
            assert c[-1] == b - 1 or total + counts[c[-1] + 1] > most
            at = c[-1] + 1
        assert at == b
    # other groups: whole, in order; a chunk ends where the next group does not fit, and the next begins with its last sentences
    plain = [i for i in range(len(counts)) if i not in inside]
    new, before = [], []
    for c in whole:
        head = before[-overlap:] if overlap else []
        assert c[: len(head)] == head
        own = c[len(head) :]
        assert own and not set(own) & set(new)
        new += own
        if before:
            first = next(e for e in ends if e > own[0])
            assert sum(counts[i] for i in before) + sum(counts[own[0] : first]) > most
        before = c
    assert new == plain


def test_groups_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        v = rng.normal(size=(int(rng.integers(1, 14)), 3)) + rng.choice([0.0, 1.0])
        cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
        groups = [[0]]
        near = [cos(a, b) for a, b in zip(v, v[1:], strict=False)]
        least = max(0.35, np.mean(near) - 0.15 * np.std(near)) if len(v) > 3 and np.std(near) else 0.4
        for i in range(1, len(v)):
            if len(v) > 3 and len(groups[-1]) > 1 and cos(np.mean(v[groups[-1]], axis=0), v[i]) < least:
                groups.append([])
            groups[-1].append(i)
        assert rules.group_by_meaning(v) == [g for g, members in enumerate(groups) for _ in members]


def test_columns_equal_the_rules(spark):
    rng = np.random.default_rng(7)
    cases, rows = [], []
    for n in [0, 1, 2, 3, 4, 5, *rng.integers(4, 40, 120)]:
        sentences = [" ".join(["w"] * int(k) + [rng.choice(["end.", "end!", "end"])]) for k in rng.integers(0, 12, n)]
        v = rng.integers(-2, 3, (n, 3)).astype(float) if len(cases) % 3 else rng.normal(size=(n, 3)) + 1
        cases.append((sentences, v))
        rows.append((len(cases) - 1, sentences, v.tolist()))
    df = spark.createDataFrame(rows, "k int, s array<string>, v array<array<double>>")
    for most, overlap in ((20, 1), (9, 2), (30, 0), (5, 9)):
        got = {r["k"]: r for r in df.select("k", chunking.group_numbers(F.col("v")).alias("g"), chunking.semantic_chunks(F.col("s"), F.col("v"), most, overlap).alias("c")).collect()}
        for k, (sentences, v) in enumerate(cases):
            numbers = rules.group_by_meaning(v)
            groups = {}
            for x, g in zip(sentences, numbers, strict=True):
                groups.setdefault(g, []).append(x)
            assert got[k]["g"] == numbers
            assert [(c["text"], c["token_count"]) for c in got[k]["c"]] == rules.pack(list(groups.values()), most, overlap)
            assert [c["chunk_id"] for c in got[k]["c"]] == list(range(len(got[k]["c"])))


def test_semantic_chunks_run_without_python(spark):
    from lexloom.plans import catalog

    plan = catalog.queries()["semantic_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sparse_vectors(spark):
    texts = ["", "a", "a b a c", "A  b\nB ünder 😀", " ".join(f"w{i % 300}" for i in range(900)), None]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    embed = models.hashing_embedder()
    both = pairs.select("a", "b", sparse.cosine(sparse.hashed(F.col("a")), sparse.hashed(F.col("b"))).alias("c"), sparse.dense(sparse.hashed(F.col("a"))).alias("d"))
    for r in both.collect():
        u, w = embed([r["a"] or ""])[0], embed([r["b"] or ""])[0]
        assert r["c"] == pytest.approx(float(u @ w), abs=1e-12)
        d = np.array(r["d"])
        assert len(d) == 256 and np.allclose(d / (np.linalg.norm(d) or 1), u)


def test_grouping():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert rules.group_by_meaning(np.array([a, b, a])) == [0, 0, 0]
    assert rules.group_by_meaning(np.array([a, a, b, b, a])) == [0, 0, 1, 1, 2]
    assert rules.group_by_meaning(np.array([a, b, b, b])) == [0, 0, 0, 0]  # a group of one takes the next in


def test_thresholds(spark):
    rows = spark.createDataFrame([([],), ([0.5, 0.5],), ([0.9, 0.1],), ([0.9, 0.8],)], "s array<double>")
    got = [r[0] for r in rows.select(chunking.group_threshold(F.col("s"))).collect()]
    assert got == [0.4, 0.4, pytest.approx(0.5 - 0.15 * 0.4), pytest.approx(0.85 - 0.15 * 0.05)]


def test_semantic_chunks(spark):
    rows = spark.createDataFrame([(["red red", "red red", "blue blue", "blue blue", "red red"],), ([],), (None,)], "s array<string>")
    vectors_of = F.transform("s", lambda x: sparse.dense(sparse.hashed(x)))
    got = [r[0] for r in rows.select(chunking.semantic_chunks(F.col("s"), vectors_of, 4, 0)).collect()]
    assert [c["text"] for c in got[0]] == ["red red red red.", "blue blue blue blue.", "red red"] and got[1:] == [[], []]


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.5])
def test_greedy_dedup_equals_a_loop(spark, threshold):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    kept = []
    for i in range(60):
        if not any(unit[i] @ unit[k] > threshold for k in kept):
            kept.append(i)
    rows = spark.createDataFrame([(v.tolist(),)], "v array<array<double>>")
    assert rows.select(vectors.greedy_dedup(F.col("v"), threshold)).first()[0] == kept


def test_dropped_vectors_drop_no_others(spark):
    chain = [[1.0, 0.0], [0.8, 0.6], [0.28, 0.96]]  # each near the next only
    rows = spark.createDataFrame([(chain,)], "v array<array<double>>")
    assert rows.select(vectors.greedy_dedup(F.col("v"), 0.75)).first()[0] == [0, 2]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.8), 0.0]


@pytest.mark.parametrize("name", ["semantic_chunks", "adjacent_similarity"])
def test_no_filter_computes_an_array_again(spark, name):
    """Of a column that a generator takes, Spark asks first whether it is null and whether it is empty."""
    from lexloom.plans import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan
