"""The pipeline's stages, each held against a brute-force version on what its predecessor kept."""

import re

import numpy as np
import pytest

import corpus_pipeline
from rangeweave.llm import substrings, toxicity
from rangeweave.llm.common import materialize

from test_llm_operators import brute_components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    """name -> (what the stage read, what it gave), each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs.toPandas(), made.toPandas())
        docs = made
    return out


def test_order_and_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "substrings", "decontamination", "packing"]
    for name, (_, after) in list(kept.items())[:-1]:
        assert sorted(after.columns) == sorted(COLUMNS), name
    assert set(kept["packing"][1].columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_toxicity(spark, kept):
    before, after = kept["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    weight = model.known()
    score = [toxicity.noisy_or(np.array([s[2] for s in model.sentences(t, weight)])) for t in before.text]
    assert sorted(after.doc_id) == sorted(i for i, s in zip(before.doc_id, score) if s < 0.5)
    assert dict(zip(after.doc_id, after.text)).items() <= dict(zip(before.doc_id, before.text)).items()


def test_near_copies(kept):
    before, after = kept["near_copies"]
    before = before.sort_values("doc_id")
    _, comp = brute_components(list(before.text))
    ids = list(before.doc_id)
    assert sorted(after.doc_id) == sorted(ids[c] for c in set(comp))


def test_substrings(kept):
    """Chunk by chunk in plain Python: the smallest id that holds a chunk keeps it."""
    before, after = kept["substrings"]
    raw, ends, found, _ = substrings.batch_digests(list(before.text))
    owner: dict = {}
    for i, f in zip(before.doc_id, found):
        for d in f.tolist():
            owner[d] = min(owner.get(d, i), i)
    got = after.set_index("doc_id")
    for i, data, e, f in zip(before.doc_id, raw, ends, found):
        spans = substrings.cut_runs(data, e, np.array([owner[d] != i for d in f.tolist()], bool), substrings.MIN_WORDS)
        left, at = b"", 0
        for a, b, _ in spans:
            left, at = left + data[at:a], b
        want = (left + data[at:]).decode()
        assert got.loc[i].text == want
        if spans:
            assert got.loc[i].n_chars == len(want)
    assert len(after) == len(before)


def test_decontamination(spark, kept):
    before, after = kept["decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for w in (words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert sorted(after.doc_id) == sorted(i for i, t in zip(before.doc_id, before.text) if not hit(words(t)))


def test_packing(kept):
    before, after = kept["packing"]
    assert set(after.doc_id) == set(before.doc_id)
    assert (after.groupby("doc_id").length.sum() == after.groupby("doc_id").doc_tokens.first()).all()


def test_run_gives_the_same(spark, kept):
    key = ["doc_id", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, got[key].to_numpy())) == sorted(map(tuple, kept["packing"][1][key].to_numpy()))
