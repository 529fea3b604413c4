"""The toxicity vote over the whole vocabulary of the examples against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest


def made(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    common = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        text = [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(rng.randrange(8, 40))]
        text += [rng.choice(text)] * rng.randrange(6)
        if i % 3 == 0:
            text += ["vile", rng.choice(["nasty", "awful"])]
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    return rows


def test_votes_are_of_the_whole_vocabulary_with_real_frequencies(spark):
    from evalgrid.llm.toxicity import NEIGHBOURS, _split, fit

    rows = made(700)
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = fit(spark, docs, docs, labelled=dict(Counter(y for _, _, y in rows)))
    bags = [Counter(t.split()) for _, t, _ in rows]
    df = Counter(w for bag in bags for w in bag)
    assert model.known.size == len(df) > 384 and int(model.pos.sum() + model.neg.sum()) == len(rows)
    idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(bag):
        v = {w: n * idf[w] for w, n in bag.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = [unit(bag) for bag in bags]
    queries = [t for _, t, _ in made(40, seed=4)] + [rows[5][1] + " " + rows[5][1], "unknownword", ""]
    part = pa.RecordBatch.from_arrays([pa.array(queries)], ["text"])
    labels = np.array([y for _, _, y in rows])
    base = labels.mean()
    for text, (vote, _) in zip(queries, model.votes(_split(part, 0)), strict=True):
        q = unit(Counter(text.split()))
        cosine = np.array([sum(x * e.get(w, 0.0) for w, x in q.items()) for e in examples])
        best = np.argsort(-cosine, kind="stable")[: NEIGHBOURS + 1]
        if cosine[best[-2]] - cosine[best[-1]] < 1e-9 and cosine[best[0]] > 0:
            continue  # either may vote
        best = best[:-1]
        share = cosine[best] ** 2
        assert abs(vote - (share @ labels[best] + base) / (share.sum() + 1)) < 1e-6


def test_texts_without_cues_are_compared_too(spark):
    from evalgrid.llm.toxicity import fit, score

    rows = made(300)
    examples = spark.createDataFrame(rows, "doc_id long, text string, label int")
    rare = [next(w for w in t.split() if w not in ("vile", "nasty", "awful")) for _, t, _ in rows[:2]]
    found = score(spark, spark.createDataFrame(list(enumerate([*rare, ""])), "doc_id long, text string"), fit(spark, examples, examples)).collect()
    assert all(r["neighbours"] for r in found if r["doc_id"] < 2) and len({r["score"] for r in found}) > 1


@pytest.mark.parametrize("often", [0.02, 0.3])
def test_block_max_index_is_exact_and_skips_blocks(often):
    from evalgrid.llm.toxicity import BlockMaxIndex

    rng = np.random.default_rng(1)
    dense = rng.random((900, 500)) * (rng.random((900, 500)) < rng.choice([0.02, often], 500))
    dense[:, :20] = 0
    for kind in range(10):  # families that share common words
        dense[kind * 90 : (kind + 1) * 90, 2 * kind : 2 * kind + 2] = 3 + rng.random((90, 2))
    dense[13] = dense[700]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    row, term = np.nonzero(dense)
    first = np.searchsorted(row, np.arange(901))
    index = BlockMaxIndex(first, term, dense[row, term], 500)
    for i, (found, cosine) in enumerate(index.nearest(first, term, dense[row, term], 15)):
        exact = dense @ dense[i]
        assert np.allclose(cosine[:15], np.sort(exact)[::-1][:15], rtol=0, atol=1e-12) and np.allclose(exact[found], cosine, rtol=0, atol=1e-12)
        assert i in found[:2].tolist()
    read, all_blocks = index.read
    assert read < 0.6 * all_blocks


def test_near_copies_among_the_examples_are_one(spark):
    from evalgrid.llm.toxicity import fit

    rng = random.Random(5)
    rows = [(i, t, y) for i, t, y in made(60)]
    long = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    for i in range(40):  # one word of 200 differs: 0.95 alike
        copy = list(long)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((1000 + i, " ".join(copy), 1))
    unlike = " ".join(long[:100] + [f"y{rng.randrange(10**6)}" for _ in range(100)])
    rows += [(2000, unlike, 1), (2001, unlike, 1), (2002, unlike, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = fit(spark, df, df)
    ids = set(model.ids.tolist())
    assert len([i for i in ids if 1000 <= i < 1040]) < 5 and 2000 in ids and 2001 not in ids
    assert int(model.pos.sum() + model.neg.sum()) == len(model.ids) + 1  # 2000 and 2002 have equal words


def test_a_model_takes_few_bytes_in_a_worker():
    import pickle
    import tracemalloc

    from evalgrid.llm.toxicity import Cues, Model, Vocabulary

    size, each, terms = 4000, 100, 50_000
    rng = np.random.default_rng(2)
    term = (np.arange(each) * (terms // each) + rng.integers(0, terms // each, (size, each))).astype(np.int32).ravel()
    n, first, half = rng.integers(1, 300, term.size).astype(np.int32), np.arange(size + 1) * each, np.arange(size) % 2.0
    cues = Cues(Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int32)), np.zeros(0), [([], 1, 1)], (1.0, 1.0))
    sent = pickle.dumps(Model(np.arange(terms, dtype=np.uint64), np.linspace(1, 9, terms), first, term, n, half, 1 - half, np.arange(size), (1.0, 1.0), cues, np.zeros(size, np.int64)))
    tracemalloc.start()
    model = pickle.loads(sent)
    found = model.others(np.arange(0, size, 500))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 28 * terms + 10 * term.size  # 25 bytes for a word of an example before
    assert np.array_equal(pickle.loads(pickle.dumps(model)).others(np.arange(0, size, 500)), found)


def test_tables_give_the_vectors_back():
    from evalgrid.llm.toxicity import BlockMaxIndex

    rng = np.random.default_rng(4)
    dense = rng.integers(1, 400, (300, 80)) * (rng.random((300, 80)) < np.where(np.arange(80) < 20, 0.5, 0.03))
    dense[[0, 7, 299]] = 0  # texts without words
    row, term = np.nonzero(dense)
    by_term, by_example = rng.random(80), rng.random(300)
    index = BlockMaxIndex(np.searchsorted(row, np.arange(301)), term, dense[row, term], 80, by_term, by_example)
    some = rng.permutation(300)[:150]
    first, t, w = index.vectors(some)
    again = np.zeros((150, 80))
    again[np.repeat(np.arange(150), np.diff(first)), t] = w
    assert np.allclose(again, (dense * by_term * by_example[:, None])[some], rtol=1e-15, atol=0)
    for (found, cosine), exact in zip(index.nearest(first, t, w, 5), again @ (dense * by_term * by_example[:, None]).T, strict=True):
        assert np.allclose(cosine[:5], np.sort(exact)[::-1][: min(5, found.size)], rtol=1e-12, atol=0)
