"""The ten queries against SQL where SQL can say it, and against brute force elsewhere, over whole tables of the small scale."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from rangeweave.llm import queries as llm

from compare import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_equals_sql(spark, name):
    assert_same(spark, llm.QUERIES[name], llm.ORACLE_SQL[name], SF)


@pytest.fixture(scope="module")
def documents():
    return duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing(spark, documents, tokenizer):
    got = llm.QUERIES["op4_packing"](spark, SF).toPandas()
    assert got.sequence_id.is_unique and (got.offset == 0).all()
    assert all(n & (n - 1) == 0 and n <= 2048 for n in got.length)
    by = dict(list(got.groupby("doc_id")))
    assert len(by) == len(documents)
    for doc_id, text in documents:
        ids, at = ids_of(tokenizer, text, 1), 0
        for r in by[doc_id].sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_token_file(spark, documents, tokenizer):
    got = llm.QUERIES["op9_token_file"](spark, SF).toPandas().set_index("doc_id")
    at = 0
    for doc_id, text in documents:
        ids = ids_of(tokenizer, text, 2)
        r = got.loc[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(documents)


def test_language_model_counts(spark, documents):
    got = llm.QUERIES["op7_lm_score"](spark, SF).toPandas().set_index("doc_id")
    tokens = {i: [w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if w] + [None] for i, t in documents}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
        assert r.score < 0
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    return (r[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("name,label,cut,least", [("op3_quality", "quality", 0.3, 0.97), ("op6_toxicity", "toxic", 0.5, 0.9)])
def test_classifiers(spark, name, label, cut, least):
    sf = "/root/testdata/sf0.1"
    got = llm.QUERIES[name](spark, sf).toPandas()
    labels = duckdb.connect().execute(f"select doc_id, {label} as y from '{sf}/labels.parquet'").fetchdf()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= cut)).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert auc(both.y.to_numpy(), both.score.to_numpy()) > least
    assert (both.predicted == both.y).mean() > 0.95


def test_main_text(spark):
    import html

    got = llm.QUERIES["op8_main_text"](spark, SF).toPandas().set_index("page_id")
    for page_id, page in duckdb.connect().execute(f"select page_id, html from '{SF}/pages.parquet'").fetchall():
        body = page.split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(p for p in parts if p)
        assert got.loc[page_id].text == want and got.loc[page_id].n_chars == len(want)


def test_substrings_keep_the_first(spark, documents):
    got = llm.QUERIES["op1_substring_dedup"](spark, SF).toPandas().set_index("doc_id")
    texts = dict(documents)
    copies = {}
    for i, t in documents:
        copies.setdefault(t, []).append(i)
    for t, ids in copies.items():
        if len(ids) > 1 and len(t.split()) > 40:
            for i in ids[1:]:
                assert len(got.loc[i].text) < 0.1 * len(t) and got.loc[i].kept_by
    for i, r in got.iterrows():
        assert (r.n_cut == 0) == (r.text == texts[i])
