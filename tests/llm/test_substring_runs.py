"""A passage is cut only where one earlier document holds it in one piece."""

import random

import numpy as np

from rangeweave.llm import substrings

from test_llm_operators import words


def test_phrases_of_many_documents_stay(spark):
    """Every 15 words of a text occur in some earlier document, but no 30: it stays, and keeps its passage against later ones."""
    r = random.Random(21)
    w = words(r, 90, 50_000).split(" ")
    docs = [(i, " ".join([words(r, 20, 50_000), *w[3 * i : 3 * i + 15], words(r, 20, 50_000)])) for i in range(26)]
    docs += [(100, " ".join(w)), (200, " ".join([words(r, 20, 50_000), *w, words(r, 20, 50_000)]))]
    got = {x.doc_id: x for x in substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    before = dict(docs)
    for i in before:
        if i != 200:
            assert (got[i].text, got[i].n_cut, got[i].kept_by) == (before[i], 0, [])
    assert got[200].n_cut == 1 and got[200].kept_by == [100] and " ".join(w[20:70]) not in got[200].text
    assert got[200].cut_bytes > 0.8 * len(before[100])


def test_owners_are_those_of_the_whole_digest():
    """Groups of one 64-bit key that differ in the further bits do not meet."""
    key = lambda *k: np.array(k, np.uint64).tobytes()
    val = lambda *v: np.array(list(v), substrings.OWNER).tobytes()
    got = substrings.owners([key(1, 5), key(1, 9), key(1)], [val((7, 10), (8, 1)), val((3, 11), (2, 1)), val((4, 10))])
    assert [np.frombuffer(g, "<i8").tolist() for g in got] == [[4, 8], [3, 2], [4]]


def test_equals_a_search_for_words(spark):
    """Against plain search: whatever is cut stands, in 30 words or more, in one earlier document; each passage of 51 words that an earlier document holds loses its middle; all else stays."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = sorted(map(tuple, docs.collect()))
    got = {x.doc_id: x for x in substrings.dedup_substrings(docs.repartition(5)).collect()}
    spaced = lambda t: " " + " ".join((t or "").split()) + " "
    earlier, seen = [], set()
    for i, text in texts:
        w, left = (text or "").split(), spaced(got[i].text).split()
        if got[i].n_cut == 0:
            assert got[i].text == text and got[i].kept_by == []
        assert not seen.isdisjoint({tuple(w[k : k + 28]) for k in range(len(w) - 27)}) or got[i].n_cut == 0
        held = spaced(got[i].text)
        for k in range(0, len(w) - 50, 7):
            if tuple(w[k : k + 51]) in earlier_windows(earlier, 51):
                assert spaced(" ".join(w[k + 12 : k + 39])) not in held
        assert len(left) <= len(w)
        earlier.append(w)
        seen |= {tuple(w[k : k + 28]) for k in range(len(w) - 27)}


_windows: dict = {}


def earlier_windows(earlier, n):
    known, found = _windows.setdefault(n, (0, set()))
    for w in earlier[known:]:
        found |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    _windows[n] = (len(earlier), found)
    return found


def test_groups_are_the_shortest_runs():
    r = random.Random(22)
    text = (words(r, 200) + " \n " + "y" * 30_000 + " " + words(r, 50)).encode()
    ends = substrings.chunks([text])[0]
    at, got = [0, *ends.tolist()], substrings.groups(text, ends, 30)
    for j in range(len(ends)):
        want = next((k for k in range(j + 1, len(at)) if len(text[at[j] : at[k]].split()) >= 30), None)
        assert want == (got[j] if j < len(got) else None)
    whole = substrings.group_digests(substrings.digests(text, ends), got)
    a = int(ends[4])  # the digest of a group does not depend on what stands before it
    rest = substrings.group_digests(substrings.digests(text[a:], ends[5:] - a), substrings.groups(text[a:], ends[5:] - a, 30))
    assert (whole[5:] == rest).all() and len(np.unique(whole)) == len(whole)
