"""Each operator on small tables: brute force, planted cases, and nulls, empty, long and repeated rows, empty tables and clashing names."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from rangeweave.llm import decontaminate, graph, html_pages, html_text, lm, ngram_join, packing, quality, rans, substrings, tokens, topk, toxicity

DOCS = "doc_id long, text string, n_chunks int, hit_id string"
LABELS = "doc_id long, quality int, toxic int"


def words(r, n, size=4000):
    return " ".join(f"w{r.randrange(size)}x" for _ in range(n))


def odd_documents(r):
    """Null and empty texts, a null id, white space only, repeated rows, one very long text."""
    same = words(r, 60)
    return [(1, None, 5, "h"), (2, "", 5, "h"), (None, words(r, 30), 5, None), (3, "  \n\t ", 5, "h"), (4, same, 5, "h"), (4, same, 5, "h"), (5, words(r, 40_000), 5, "h"), (6, "one", 5, "h"), (None, None, None, None), (7, "x" * 50_000, 5, "h")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(random.Random(1)), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 8)] + [(None, 1, 1), (4, None, None)], LABELS)


def test_odd_tables(spark, odd, none, labels):
    """Every operator gives a row for each row (packing: for each piece) and nothing for nothing; columns of clashing names stay."""
    benchmark = spark.createDataFrame([(1, "a b c"), (None, None), (2, "")], "item_id long, text string")
    for docs, n in ((odd, 10), (none, 0)):
        assert substrings.dedup_substrings(docs).count() == n
        assert ngram_join.jaccard_components(docs).count() == n
        assert len(quality.report(docs, labels).where("score between 0 and 1").collect()) == n
        assert packing.pack_documents(docs).where("start = 0").count() == n
        assert decontaminate.report(docs, benchmark).count() == n
        assert decontaminate.decontaminate(docs, benchmark).columns == docs.columns
        assert len(toxicity.report(docs, labels).where("score between 0 and 1").collect()) == n
        assert lm.report(docs).count() == n
        assert rans.read_tokens(rans.write_tokens(docs)).count() == n
    no_labels = spark.createDataFrame([], LABELS)
    assert quality.report(odd, no_labels).count() == toxicity.report(odd, no_labels).count() == 10
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>"), (None, "u", "<article><p>" + "word " * 90_000 + ".</p></article>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert got[1].text == got[2].text == got[3].text == "" and got[None].n_chars == 450_001
    assert html_text.extract(pages.limit(0)).count() == 0


# 1 ------------------------------------------------------------------------------------------------------------------------------------


def test_chunks_follow_content():
    r = random.Random(2)
    a = words(r, 3000).encode()
    b = b"inserted text " + a[:5000] + b" more" + a[5000:]
    cut = lambda t: {t[x:y] for e in [substrings.chunks([t])[0]] for x, y in zip([0, *e[:-1]], e)}
    assert b"".join(a[x:y] for e in [substrings.chunks([a])[0]] for x, y in zip([0, *e[:-1]], e)) == a
    assert len(cut(a) & cut(b)) > 0.97 * len(cut(a))
    assert [list(e) for e in substrings.chunks([a, b""])] == [list(substrings.chunks([a])[0]), []]


def test_planted_passages(spark):
    """Passages of 51 words and more are cut everywhere but in the first document; clean documents stay as they are."""
    r = random.Random(3)
    docs, planted = [], {}
    for i in range(600):
        text = words(r, r.randint(20, 300), 50_000)
        docs.append([i, text])
    for p in range(60):
        passage = words(r, r.randint(51, 120), 50_000)
        for i in r.sample(range(600), 2 if p % 3 else 9):
            at = docs[i][1].split(" ")
            k = r.randrange(len(at) + 1)
            docs[i][1] = " ".join([*at[:k], passage, *at[k:]])
            planted.setdefault(p, (passage, []))[1].append(i)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r_.doc_id: r_ for r_ in substrings.dedup_substrings(frame.repartition(5)).collect()}
    before = dict(map(tuple, docs))
    missed = total = 0
    for passage, ids in planted.values():
        first, *others = sorted(set(ids))
        middle = " ".join(passage.split(" ")[20:31])
        for i in others:
            total += 1
            missed += middle in got[i].text
    assert missed <= 0.02 * total
    touched = {i for _, ids in planted.values() for i in ids}
    for i, text in before.items():
        if i not in touched:
            assert got[i].text == text and got[i].n_cut == 0 and got[i].kept_by == []
    assert all(set(got[i].kept_by) <= touched for i in touched)


# 2 ------------------------------------------------------------------------------------------------------------------------------------


def brute_components(texts):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed,split", [(4, False), (5, True)])
def test_jaccard_equals_brute_force(spark, monkeypatch, seed, split):
    """Chains of edits around the threshold, copies, short texts; with and without groups split into parts."""
    r = random.Random(seed)
    if split:
        monkeypatch.setattr(ngram_join, "GROUP_BYTES", 4000)
    texts = []
    for _ in range(25):
        base = words(r, r.choice((1, 3, 5, 8, 20, 60, 150)), 300).split(" ")
        for _ in range(r.randint(1, 9)):
            texts.append(" ".join(base))
            if r.random() < 0.3:
                texts.append(texts[-1].upper())
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(base))
                base[k : k + r.randint(0, 1)] = [f"new{r.randrange(99)}"]
    r.shuffle(texts)
    texts += ["", None]
    sizes, comp = brute_components(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(frame).collect()}
    assert got == {i: (sizes[i], comp[i]) for i in range(len(texts))}
    kept = sorted(x.doc_id for x in ngram_join.keep_one(frame).collect())
    assert kept == sorted(set(comp))


def test_keep_one_with_null_and_repeated_ids(spark):
    """Rows that link with none stay under any id; of those that link one stays."""
    r = random.Random(16)
    t = [words(r, 40, 50_000) for _ in range(10)]
    clean = [(None, t[0]), (None, t[1]), (9, t[2]), (9, t[3]), (1, None), (1, None), (None, ""), (None, "")]
    linked = [(None, t[4]), (7, t[4]), (7, t[5]), (8, t[5] + " more"), (None, t[6]), (None, t[6]), (None, t[6] + " more"), (9, t[7]), (9, t[7]), (9, t[8]), (9, t[8] + " more")]
    for extra in ([], linked):
        got = [tuple(x) for x in ngram_join.keep_one(spark.createDataFrame(clean + extra, "doc_id long, text string").repartition(3)).select("doc_id", "text").collect()]
        left = list(got)
        for row in clean:
            left.remove(row)
        bases = [next(i for i in range(10) if x[1].startswith(t[i])) for x in left]
        assert sorted(bases) == ([4, 5, 6, 7, 8] if extra else [])
        assert not extra or {i: x[0] for i, x in zip(bases, left)} == {4: 7, 5: 7, 6: None, 7: 9, 8: 9}


def test_large_near_copy_group(spark):
    r = random.Random(6)
    base = words(r, 120).split(" ")
    docs = []
    for i in range(700):
        w = list(base)
        w[r.randrange(len(w))] = f"edit{i}"
        docs.append((i, " ".join(w)))
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {x.component_id for x in got.collect()} == {0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# 3 ------------------------------------------------------------------------------------------------------------------------------------


def test_rules_compile_to_what_they_say(spark):
    r = np.random.default_rng(0)
    x = r.random((3000, len(quality.NAMES)))
    y = ((x[:, 2] > 0.7) | ((x[:, 5] > 0.5) & (x[:, 9] <= 0.3))).astype(float)
    m = quality.Model.fit(x, y)
    assert 0 < len(m.rules) < 60
    frame = spark.createDataFrame([tuple(map(float, row)) for row in x[:200]], ", ".join(f"{n} double" for n in quality.NAMES))
    got = [v.s for v in frame.select(m.column({n: frame[n] for n in quality.NAMES}).alias("s")).collect()]
    want = [1 / (1 + np.exp(-(m.intercept + sum(w for rule, w in zip(m.rules, m.weights) if quality.holds(rule, row[None])[0])))) for row in x[:200]]
    assert got == pytest.approx(want)
    assert ((np.array(got) > 0.5) == y[:200]).mean() > 0.97


# 4, 9 ---------------------------------------------------------------------------------------------------------------------------------


def test_cuts():
    for n in range(1, 5000, 7):
        parts = list(packing.cuts(n, 2048))
        assert sum(k for _, k in parts) == n and all(k & (k - 1) == 0 and k <= 2048 for _, k in parts)
        assert [s for s, _ in parts] == list(np.cumsum([0, *[k for _, k in parts]])[:-1])


def test_packed_ids(spark):
    got = packing.pack_documents(spark.createDataFrame([(1, "a few words of text")], "doc_id long, text string"), with_ids=True).orderBy("start").collect()
    whole = [i for r in got for i in r.ids]
    assert np.array(whole, "<u4").tobytes() == tokens.encode_texts(["a few words of text"], tokens.tokenizer_path(), 1)[0]


def test_tokens_equal_the_library():
    lib = tokens.library_of(tokens.tokenizer_path()).tokenizer
    r = random.Random(8)
    texts = ["", " ", "a  b", "\n\nx \n y", "don't we'll", "<|endoftext|> z", "é ü\tñ 12a b2 3,4", "a 　b", "%%% !! a.b-c"]
    texts += ["".join(r.choice([" ", "\n", "a", "B", "é", "ß", ".", "'s", "1", "漢", "😀", "\t", "%%", "ll", "\x1c", "\xa0"]) for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert tokens.encode_texts([t], tokens.tokenizer_path(), 7)[0] == np.array(lib.encode(t, add_special_tokens=False).ids + [7], "<u4").tobytes()


@pytest.mark.parametrize("kind", ["one", "two", "skewed", "all", "few"])
def test_rans(kind):
    r = np.random.default_rng(1)
    n = 300_001
    ids = {"one": np.full(n, 7), "two": r.integers(0, 2, n), "skewed": np.minimum(r.zipf(1.3, n), 50_256), "all": r.permutation(np.resize(np.arange(50_257), n)), "few": np.array([5])}[kind].astype("<u4")
    data = rans.encode_segment(ids)
    assert (rans.decode_segment(data) == ids).all()
    if kind != "few":
        assert (rans.decode_segment(data, range(1, 2)) == ids[rans.BLOCK : 2 * rans.BLOCK]).all()
    p = np.bincount(ids) / len(ids)
    ideal = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert len(data) < 1.03 * ideal + 2 * 4 * rans.LANES + 4 * len(p) + 200
    if kind == "skewed":
        broken = bytearray(data)
        broken[-5] ^= 1
        with pytest.raises(ValueError):
            rans.decode_segment(bytes(broken))


# 5 ------------------------------------------------------------------------------------------------------------------------------------


def test_decontamination_spans(spark):
    r = random.Random(9)
    item = words(r, 14, 90).split(" ")
    docs = [(1, "Before it, " + ", ".join(item).upper() + "! After."), (2, " ".join(item[:9])), (3, "tiny Item here"), (4, None), (5, " ".join(item[2:12]) + " " + " ".join(item[2:12]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(10, " ".join(item)), (9, "TINY item"), (9, "tiny item"), (8, "...")], "item_id long, text string")
    got = {x.doc_id: (x.n_hit, x.n_items) for x in decontaminate.report(d, b).collect()}
    assert got == {1: (14, 1), 2: (0, 0), 3: (2, 1), 4: (0, 0), 5: (20, 1)}
    assert sorted(x.doc_id for x in decontaminate.decontaminate(d, b).collect()) == [2, 4]
    cut = {x.doc_id: x.text for x in decontaminate.decontaminate(d, b, "spans").collect()}
    assert cut[1] == "Before it, After." or cut[1].replace(",", "").split() == ["Before", "it", "After."] or cut[1].startswith("Before it") and cut[1].endswith("After.")
    assert cut[3].split() == ["here"] and cut[2] == " ".join(item[:9])


def test_decontamination_in_blocks(spark, monkeypatch):
    """Windows in several blocks, and hits joined by shuffle: the same rows; no exchange carries texts or words while the hits are few."""
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.report(docs, benchmark).collect()))
    clean = decontaminate.decontaminate(docs, benchmark)
    kept = sorted(r.doc_id for r in clean.select("doc_id").collect())
    assert kept == sorted(r[0] for r in want if not r[5]) and len(kept) < len(want)
    assert "Exchange hashpartitioning" not in clean._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(decontaminate, "MAX_HITS", 3)
    assert len(decontaminate.window_blocks(benchmark)) > 3
    assert sorted(map(tuple, decontaminate.report(docs, benchmark).collect())) == want
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, benchmark).select("doc_id").collect()) == kept


# 6 ------------------------------------------------------------------------------------------------------------------------------------


def test_offending_sentences(spark):
    r = random.Random(10)
    rows, marks = [], []
    for i in range(600):
        sentences = [words(r, 8, 200) for _ in range(6)]
        bad = i % 4 == 0
        if bad:
            sentences[i % 6] += r.choice((" vile", " nasty"))
        rows.append((i, ". ".join(sentences) + "."))
        marks.append((i, 1, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, LABELS)
    for x in toxicity.locate(d, toxicity.train(d, y)).collect():
        assert (x.tox_score >= 0.5) == (x.doc_id % 4 == 0)
        found = [x.text[s.start : s.end] for s in x.tox_spans]
        assert all("vile" in f or "nasty" in f for f in found) and bool(found) == (x.doc_id % 4 == 0)
    assert toxicity.remove_toxic(d, y).count() == 450


# 7 ------------------------------------------------------------------------------------------------------------------------------------


LM_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def lm_texts(seed):
    """Texts of few words, so that pairs repeat, with odd ones."""
    r = random.Random(seed)
    texts = [words(r, r.randint(1, 60), 80) for _ in range(150)] + ["", None, "\x1c\xa0 A\x85b", " Aa\tBB\n ", "w1x"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "w1x w2x"), (3, "w5x w5x")]


def plain_scores(docs, model):
    """(n_tokens, n_known, N, base, score) of each text from the model's weights, word by word in plain Python."""
    tokens = [[*LM_WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()), lm.END] for _, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    kept = [ts for ts, h in zip(tokens, held) if not h]
    count = Counter(w for ts in kept for w in ts)
    pairs = Counter((a, b) for ts in kept for a, b in zip([None, *ts], ts))
    n, v = sum(count.values()), len(count)
    hashed = lambda w: xxhash.xxh3_64_intdigest(w) >> 32
    row = lambda x, k: ((x ^ k) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - lm.PLACE_BITS)
    kind = lambda w: int(model.class_of[zlib.crc32(w[-3:]) % lm.ENDINGS])
    room = Counter({k: 1 for k in range(lm.CLASSES)})
    for w, c in count.items():
        room[kind(w)] += c + 1
    out = []
    for ts in tokens:
        base = score = 0.0
        for i, w in enumerate(ts):
            base += math.log10((count[w] + 1) / (n + v + 1))
            x = model.bias.astype(float).copy()
            for k in range(1, lm.FEATURES + 1):
                x += model.weights[k - 1][row(hashed(ts[i - k]) if i >= k else int(lm.START[k - 1 - i]), k)]
            p = math.exp(x[kind(w)]) / np.exp(x).sum() * (count[w] + 1) / room[kind(w)]
            seen = count[ts[i - 1]] if i else len(kept)
            if seen:
                g = 1 / (1 + math.exp(-model.gate[seen.bit_length()]))
                p = (1 - g) * p + g * pairs[ts[i - 1] if i else None, w] / seen
            score += math.log10(p)
        out.append((len(ts), sum(w in count for w in ts), n, base, score))
    return held, out


def test_scores_equal_plain_python(spark):
    docs = lm_texts(14)
    got, model = lm.fitted(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    held, want = plain_scores(docs, model)
    rows = sorted(((g.doc_id is None, g.doc_id or 0, g.n_tokens, g.held_out, g.n_known, g.train_tokens, g.base_score, g.score) for g in got.collect()))
    plain = sorted((i is None, i or 0, w[0], h, *w[1:]) for (i, _), h, w in zip(docs, held, want))
    assert [r[:6] for r in rows] == [r[:6] for r in plain]
    assert np.array([r[6:] for r in rows]) == pytest.approx(np.array([r[6:] for r in plain]), rel=1e-5)


def test_scores_do_not_follow_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scores = [{x.doc_id: x.score for x in lm.report(docs.repartition(n)).collect()} for n in (2, 16)]
    assert scores[0] == pytest.approx(scores[1], rel=1e-6)


def test_choices_sum_to_one():
    """Classes, words and one unseen word within each, and what followed the word before share out all of the probability."""
    r = np.random.default_rng(3)
    counts = r.integers(1, 9, 400)
    endings = r.integers(0, lm.ENDINGS, 400)
    model = lm.Model(r.integers(0, lm.CLASSES, lm.ENDINGS), np.bincount(endings, counts, lm.ENDINGS), np.bincount(endings, minlength=lm.ENDINGS))
    model.weights = r.normal(size=model.weights.shape).astype(np.float32)
    p = model.shares([r.integers(0, lm.PLACES, 50).astype(np.uint16) for _ in range(lm.FEATURES)])
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    inside = np.bincount(model.class_of[endings], counts + 1, lm.CLASSES) + 1
    assert np.allclose(inside, np.exp(model.log_room))


def test_words_of_texts():
    texts = ["", None, " A\x1cb  c\n", "\t", "É ß\x85x\xa0y ZZ", "a" * 70_000 + " b"]
    place, found, sizes = lm.words_of(pa.array(texts))
    want = [LM_WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()) for t in texts]
    assert [found[i] for i in place] == [w for ws in want for w in ws] and sizes.tolist() == list(map(len, want))
    place, found, sizes = lm.words_of(pa.array([None, ""], pa.string()))
    assert (len(place), found, sizes.tolist()) == (0, [], [0, 0])


# 8 ------------------------------------------------------------------------------------------------------------------------------------


def test_held_out_pages():
    model, wrong, total = html_text.trained(), 0, 0
    for page in html_pages.labelled_pages(150, seed=12345):
        found = html_text.blocks(page)
        y = [b.text.startswith(html_pages.MARK) for b in found]
        for b in found:
            b.text = b.text.lstrip(html_pages.MARK) or "."
        wrong += sum(a != bool(b) for a, b in zip(y, model.decode(found)))
        total += len(y)
    assert wrong < 0.01 * total


def test_viterbi_equals_brute_force():
    model = html_text.trained()
    page = html_text.blocks("<nav><a href=x>menu</a></nav><article><h1>T</h1><p>Some text.<p>More</article><div class=comments><p>me too</div><footer>&copy; x</footer>")
    assert [b.text for b in page] == ["menu", "T", "Some text.", "More", "me too", "© x"]
    e = [model.emission(b, i == 0) for i, b in enumerate(page)]
    score = lambda y: sum(v for v, k in zip(e, y) if k) + sum(model.step[a][b] for a, b in zip(y, y[1:]))
    import itertools

    assert model.decode(page) == list(max(itertools.product((0, 1), repeat=len(page)), key=score)) == [0, 1, 1, 1, 0, 0]


def test_markup():
    b = html_text.blocks("<p>a&nbsp;&amp;\n b<br>c<script>if (a<b) x</script><!-- <p>no --><p>d <b>e</b>f<table><tr><td>g<td>h</table>&lt;i")
    assert [x.text for x in b] == ["a & b c", "d ef", "g", "h", "<i"]


# 10 -----------------------------------------------------------------------------------------------------------------------------------


def test_bounds_hold():
    r = np.random.default_rng(4)
    x, q = r.normal(size=(200, 50)), r.normal(size=(20, 50))
    turn = topk.axes(x.T @ x)
    assert np.allclose((q @ turn) @ (x @ turn).T, q @ x.T)
    last = np.inf
    for m in (0, 1, 25, 49, 50):
        a, b = q @ turn, x @ turn
        bound = a[:, :m] @ b[:, :m].T + topk.rest(a, m) @ topk.rest(b, m).T
        assert (bound >= q @ x.T - 1e-9).all() and bound.mean() < last + 1e-9
        last = bound.mean()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_few_vectors_survive_the_bounds(sf):
    """On the tables' vectors, whose directions are all alike, less than a fifth of all pairs come to an exact product."""
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet").combine_chunks()
    keep, x = topk.quantised(t.column("embedding").chunk(0))
    ids = t.column("vec_id").to_numpy()[keep]
    on = ids % 50 == 0
    left = [n for _, _, _, n in topk.best(x[on], ids[on], x, ids, 5, topk.axes(x.T @ x))]
    assert len(left) == on.sum() and np.mean(left) < 0.2 * len(x)


@pytest.mark.parametrize("tile", [16384, 64])
def test_topk_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE", tile)
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 12))
    x[10:60] = x[5]
    rows = [(i, [float(v) for v in x[i]], "t") for i in range(400)] + [(7, [float(v) for v in x[7]], "again"), (50, [float(v) for v in x[50]], "again")] + [(900, None, "t"), (901, [1.0, None], "t"), (902, [float("nan")] * 12, "t"), (950, [float("inf")] * 12, "t"), (None, [1.0] * 12, "t")]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string").repartition(6)).collect()
    n = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    every, want = [*range(400), 7, 50], []
    for q in sorted({q for q in every if q % 50 == 0}):
        found = sorted((-int(n[i] @ n[q]), i) for i in every if i != q)  # rows of equal id are candidates each
        ways = every.count(q)  # and queries each: the same rows twice, of which the ranking keeps five
        want += [(q, i, -s) for s, i in sorted(found * ways)[:5]]
    assert sorted((g.query_id, g.vec_id, g.score) for g in got) == sorted(want)
    assert all(sorted(g.rank for g in got if g.query_id == q) == [1, 2, 3, 4, 5] for q in {g.query_id for g in got})
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert {(g.query_id, g.vec_id) for g in topk.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).collect()} == {(0, 1)}


def test_tidy_passes_batches_on_and_frees():
    from rangeweave.llm import common

    def work(batches):
        held = [bytes(1000) for _ in range(1000)]
        for b in batches:
            yield b
        held.clear()

    made = [pa.RecordBatch.from_arrays([pa.array([i])], ["i"]) for i in range(3)]
    assert list(common.tidy(work)(iter(made))) == made
    assert list(common.tidy(work)(iter([]))) == []
