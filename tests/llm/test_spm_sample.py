import hashlib
import itertools
import time
from collections import Counter

import numpy as np
import pytest
import public_tokenizers

from lexloom.llm import queries, spm_sample
from lexloom.llm.spm_sample import Bank, Vocabulary, ids_of, ids_of_all, sample

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(MODEL)


def segmentations(vocabulary, text):
    """(ids, score) of all segmentations, by plain recursion over the whole text."""
    by_text = {p: i for i, p in enumerate(vocabulary.pieces) if isinstance(p, str)}
    whole = "▁" + text.replace(" ", "▁")

    def rest(at):
        if at == len(whole):
            yield (), 0.0
            return
        for end in range(at + 1, min(len(whole), at + 16) + 1):
            if whole[at:end] in by_text:
                i = by_text[whole[at:end]]
                for ids, s in rest(end):
                    yield (i, *ids), s + vocabulary.logp[i]
        if whole[at] not in by_text:
            raw = whole[at].encode()
            for ids, s in rest(at + 1):
                yield (*(vocabulary.byte_ids[b] for b in raw), *ids), s + vocabulary.byte_logp * len(raw)

    return dict(rest(0))


def seeds(n):
    return np.array([spm_sample.row_seed(i, 0) for i in range(n)], np.uint64)


@pytest.mark.parametrize("theta", [0.4, 1.0, 3.0])
@pytest.mark.parametrize("text", ["the", "the cat", "of the", "a  b ", "x", "é\n𝄞s", "in in", "national"])
def test_all_segmentations_come_once_with_their_probabilities(vocabulary, text, theta):
    every = {i: theta * s for i, s in segmentations(vocabulary, text).items()}
    total = np.log(sum(np.exp(s) for s in every.values()))
    bank = Bank(vocabulary, theta)
    got = sample([text], seeds(1), bank, len(every) + 3)
    found = {tuple(ids_of(e, bank).tolist()): lp for e, lp in zip(got.edges[0], got.logp[0], strict=True)}
    assert len(found) == len(got.logp[0])  # distinct
    assert set(found) == set(every)
    for ids, lp in found.items():
        assert lp == pytest.approx(every[ids] - total, abs=1e-9)
        assert vocabulary.decode(ids) == text
    assert got.perturbed[0] == sorted(got.perturbed[0], reverse=True)
    assert got.inclusion[0] == [1.0] * len(every)  # nothing is left
    for k in (1, 2, len(every) - 1):
        if 0 < k < len(every):
            fewer = sample([text], seeds(1), bank, k)
            assert len(fewer.logp[0]) == k and fewer.logp[0] == pytest.approx(got.logp[0][:k])
            assert max(fewer.inclusion[0]) <= 1.0 and min(fewer.inclusion[0]) > 0.0


def test_a_word_of_thousands_of_segmentations_gives_as_many_as_asked(vocabulary):
    every = segmentations(vocabulary, "international")
    bank = Bank(vocabulary)
    got = sample(["international"], seeds(1), bank, 1000)
    found = {tuple(ids_of(e, bank).tolist()) for e in got.edges[0]}
    assert len(found) == 1000 < len(every) and found <= set(every)
    assert sum(np.exp(every[i]) for i in found) / sum(map(np.exp, every.values())) > 0.99


def test_a_unit_of_a_million_characters_takes_bounded_time(vocabulary):
    began = time.perf_counter()
    bank = Bank(vocabulary)
    text = "internationalisation" * 50_000
    got = sample([text], seeds(1), bank, 2)
    assert [vocabulary.decode(ids_of(e, bank)) == text for e in got.edges[0]] == [True, True]
    assert time.perf_counter() - began < 120


def test_samples_follow_the_law_without_replacement(vocabulary):
    """Frequencies of the first and second over many seeds, against drawing one after the other; and the inclusion
    scores as weights: the mean of the sum of p / inclusion over a sample is 1."""
    text, n = "then an", 20000
    every = segmentations(vocabulary, text)
    scores = {i: s * 0.4 for i, s in every.items()}
    total = np.log(sum(np.exp(s) for s in scores.values()))
    p = {i: float(np.exp(s - total)) for i, s in scores.items()}
    bank = Bank(vocabulary, theta=0.4)
    got = sample([text] * n, seeds(n), bank, 2)
    pairs = Counter(tuple(tuple(ids_of(e, bank).tolist()) for e in es) for es in got.edges)
    first = Counter()
    for (a, _), c in pairs.items():
        first[a] += c
    top = sorted(p, key=p.get, reverse=True)[:6]
    for a in top:
        assert first[a] / n == pytest.approx(p[a], abs=4 * (p[a] * (1 - p[a]) / n) ** 0.5 + 1e-4)
    for a, b in itertools.permutations(top[:4], 2):
        q = p[a] * p[b] / (1 - p[a])
        assert pairs[a, b] / n == pytest.approx(q, abs=4 * (q / n) ** 0.5 + 1e-4)
    weights = [sum(np.exp(lp) / inc for lp, inc in zip(lps, incs, strict=True)) for lps, incs in zip(got.logp, got.inclusion, strict=True)]
    assert np.mean(weights) == pytest.approx(1.0, abs=4 * np.std(weights) / n**0.5 + 1e-3)


def test_batches_and_banks_change_nothing(vocabulary, monkeypatch):
    texts = ["the quick brown fox", "", "jumps over", "the lazy dog  ", "\0 ﷐ ▁ é"] * 3
    s = seeds(len(texts))
    bank = Bank(vocabulary)
    whole = sample(texts, s, bank, 3)
    ids = [[ids_of(e, bank).tolist() for e in es] for es in whole.edges]
    monkeypatch.setattr(spm_sample, "BANK_EDGES", 50)
    small = Bank(vocabulary)
    for i, t in enumerate(texts):
        one = sample([t], s[i : i + 1], small, 3)
        assert [ids_of(e, small).tolist() for e in one.edges[0]] == ids[i]
        assert one.perturbed[0] == pytest.approx(whole.perturbed[i]) and one.inclusion[0] == pytest.approx(whole.inclusion[i])
    assert all(vocabulary.decode(x) == t for t, xs in zip(texts, ids, strict=True) for x in xs)


def test_query_round_trips(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op1_sentencepiece(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(texts) and all(r["round_trip"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["sample"])
        assert [r["sample"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 2
        assert len({r["ids_sha256"] for r in rows}) == len(rows)
        assert all(r["log_prob"] <= 1e-9 and 0 < r["inclusion"] <= 1 for r in rows)
        assert [r["perturbed"] for r in rows] == sorted((r["perturbed"] for r in rows), reverse=True)


def test_odd_rows(spark, vocabulary):
    rows = [(1, None, 1), (2, "", 1), (3, " ", 1), (4, "dup", 1), (4, "dup", 1), (None, "null key", 1), (5, "long " * 30000, 1), (6, "x" * 20000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sample int")
    got = spm_sample.encode(docs, MODEL, decoded=True)
    back = {(r["doc_id"], r["sample"]): r for r in got.collect()}
    assert back[1, 1]["n_pieces"] == back[2, 1]["n_pieces"] == 0 and (1, 2) not in back
    assert all(r["round_trip"] and len(r["ids"]) == r["n_pieces"] for r in back.values())
    assert all(r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest() for r in back.values())
    texts = {k: t or "" for k, t, _ in rows}
    assert all(r["decoded"] == texts[k] for (k, _), r in back.items())
    assert got.count() == len(back) + 2  # the repeated row's
    again = spm_sample.decode(got.filter("doc_id = 3"), MODEL).collect()
    assert {r["text"] for r in again} == {" "}
    assert spm_sample.encode(docs.limit(0), MODEL).collect() == []


def test_a_unigram_model_keeps_its_scores(vocabulary):
    assert np.exp(vocabulary.logp[np.isfinite(vocabulary.logp)]).sum() == pytest.approx(1.0)
    assert vocabulary.byte_logp < vocabulary.logp[np.isfinite(vocabulary.logp)].min()


def test_the_query_returns_its_segmentations(spark):
    got = queries.op1_sentencepiece(spark, SF).select("n_pieces", "ids_sha256", "ids").collect()
    assert got and all(len(r["ids"]) == r["n_pieces"] for r in got)
    assert all(hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest() == r["ids_sha256"] for r in got)


def test_paths_of_a_batch_are_coded_and_decoded_at_once(vocabulary):
    texts = ["the cat", "", "é\n𝄞s ▁▁ ", "\0\x7f\x80 \u07ff\u0800 \uffff 𐀀", "  a", "", "слово 漢字 ﷐"]
    bank = Bank(vocabulary)
    paths = [e for es in sample(texts, seeds(len(texts)), bank, 2).edges for e in es]
    plain = []
    for path in paths:
        ids = []
        for p in bank.piece[path].tolist():
            char = "▁" if p == -1 - 0xDFFF else chr(-1 - p) if p < 0 else ""
            ids += [vocabulary.byte_ids[b] for b in char.encode()] if p < 0 else [p]
        plain.append(ids)
    flat, ends = ids_of_all(paths, bank)
    assert [flat[a:b].tolist() for a, b in itertools.pairwise(ends.tolist())] == plain == [ids_of(e, bank).tolist() for e in paths]
    assert [b.decode() for b in vocabulary.decode_all(flat, ends)] == [vocabulary.decode(ids) for ids in plain]
    assert set(texts) == {vocabulary.decode(ids) for ids in plain}
    flat, ends = ids_of_all([np.empty(0, np.int32)] * 2, bank)
    assert len(flat) == 0 and vocabulary.decode_all(flat, ends) == [b"", b""]
    flat, ends = ids_of_all([], bank)
    assert ends.tolist() == [0] and vocabulary.decode_all(flat, ends) == []


def test_a_known_unit_is_looked_up_once_and_a_full_bank_keeps_its_memory(vocabulary, monkeypatch):
    class Counted(dict):
        n = 0

        def get(self, *a):
            Counted.n += 1
            return super().get(*a)

        def __getitem__(self, a):
            Counted.n += 1
            return super().__getitem__(a)

        def __contains__(self, a):
            Counted.n += 1
            return super().__contains__(a)

    bank = Bank(vocabulary)
    units = [f"word{i}" for i in range(300)]
    root = bank.nodes(units)
    bank.types = Counted(bank.types)
    assert bank.nodes(units).tolist() == root.tolist() and Counted.n == len(units)
    assert bank.nodes(["new", "word7", "new"]).tolist() == [bank.types["new"], root[7], bank.types["new"]]
    kept = [rows.data for rows in (bank._cum, bank._logc, bank._others, bank._target, bank._piece)]
    monkeypatch.setattr(spm_sample, "BANK_EDGES", len(bank._cum) - 1)
    assert bank.nodes([*units, "other"])[0] == 0  # it began anew
    assert all(a is rows.data for a, rows in zip(kept, (bank._cum, bank._logc, bank._others, bank._target, bank._piece), strict=True))
    whole = sample(["word1 other"], seeds(1), bank, 3)
    plain = sample(["word1 other"], seeds(1), Bank(vocabulary), 3)
    assert [ids_of(e, bank).tolist() for e in whole.edges[0]] and whole.logp == plain.logp and whole.inclusion == plain.inclusion


def test_a_batch_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").coalesce(1)
    got = spm_sample.encode(docs, MODEL, decoded=True).collect()
    assert [(r["n_pieces"], r["round_trip"], r["ids"], r["decoded"]) for r in got] == [(0, True, [], "")] * 2
    assert all(r["round_trip"] is None for r in spm_sample.encode(docs, MODEL, verify=False).collect())
