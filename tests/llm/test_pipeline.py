"""The pipeline's stages against plain Python."""

from __future__ import annotations

import random

import brute
import pytest

import corpus_pipeline as P

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(4))
    leak = " ".join(word("pqrst") for _ in range(20))
    docs, labels = [], []
    for i in range(400):
        lang = rng.choice(["en", "en", "de"])
        text = [word("abcdef" if lang == "en" else "ghijkl") for _ in range(rng.randrange(30, 80))]
        toxic = rng.random() < 0.25
        if toxic:
            text[3] = text[9] = rng.choice(["vile", "nasty"])
        docs.append((i, " ".join(text), lang, "s", 0))
        if i < 350:
            labels.append((i, 1, int(toxic)))
    clean = [d for d, (_, _, t) in zip(docs, labels, strict=False) if not t][:6]
    copy = clean[0][1].split()
    copy[10] = "other"
    docs += [(500, clean[0][1], "en", "s", 0), (501, " ".join(copy), "en", "s", 0), (502, clean[1][1] + " " + leak + " end", "en", "s", 0)]
    docs += [(510 + i, f"the very same line in all of them\n{clean[2 + i][1][::-1]}", "en", "s", 0) for i in range(3)]
    docs += [(600, None, "en", "s", 0)]
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in docs]
    path = str(tmp_path_factory.mktemp("pipeline"))
    for name, rows, schema in (("documents", docs, COLUMNS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [("q", leak)], "item_id string, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path, docs, {i: t for i, _, t in labels}


def test_stages(spark, folder, tmp_path):
    path, docs, toxic = folder
    df = spark.createDataFrame(docs, COLUMNS)
    kept = {name: None for name, _ in P.STAGES}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, df, path).write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r["doc_id"]: r["text"] for r in df.collect()}
        if k < len(P.STAGES) - 1:
            assert df.columns == list(P.COLUMNS)
    first, lines, copies, leaks, mixed = kept.values()
    right = sum((i not in first) == bool(t) for i, t in toxic.items())
    assert right / len(toxic) > 0.95 and {500, 501, 502, 510, 600} <= set(first)
    expected = {i: d for i, _, d, _ in brute.op8(sorted(first.items()))}
    assert set(lines) == set(first) and sum(expected.values()) == 2
    assert [i for i in first if first[i] != lines[i]] == [510, 511] or {i for i in first if first[i] != lines[i]} == {510, 511}
    groups = brute.near_copies(sorted(lines.items()))
    assert set(copies) == {i for i, root in groups.items() if i == root} and not {500, 501} & set(copies)
    hits = {row[0] for row in brute.op2(sorted(copies.items()), [("q", spark.read.parquet(f"{path}/benchmark.parquet").first()["text"])]) if row[-1]}
    assert set(leaks) == set(copies) - hits and 502 in hits
    assert set(mixed) == set(leaks) and all(r["rate"] > 0 for r in df.collect())


def test_run_keeps_what_the_stages_keep(spark, folder):
    path, _, _ = folder
    out = P.run(spark, path)
    assert {"doc_id", "text", "rate", "copies"} <= set(out.columns) and 320 > out.count() > 200
