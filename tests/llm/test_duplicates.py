"""Operators across documents, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafmill.llm import components, jaccard_join, substring_runs, suffix_dedup
from leafmill.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = text(150), text(60)
    out = [(i, text(rng.choice([3, 30, 120, 300]))) for i in range(60)]
    out += [(100 + i, text(40) + " " + passage + "\n" + text(40)) for i in range(20)]
    for i in range(90):
        w = base.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(50)}"
        out.append((200 + i, " ".join(w)))
    out += [(400, None), (401, ""), (402, "ab " * 700), (403, "x" * 3000), (404, "ab " * 700), (405, "q w e r"), (406, "q  w e\nr"), (407, out[3][1]), (407, out[3][1]), (None, out[4][1]), (408, "z" * 300 + out[2][1] + "z" * 500), (409, " ".join(f"w{i % 36}" for i in range(500))), (410, base), (411, base)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in corpus()], "doc_id long, text string, start int, fp string")


def ordered(x):
    return sorted(x, key=str)


def words_removed(n):
    texts = [WORD.findall(t or "") for _, t in corpus()]
    count = Counter(tuple(w[i : i + n]) for w in texts for i in range(len(w) - n + 1))
    out = []
    for (doc, _), w in zip(corpus(), texts, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = True
        out.append((doc, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_substring_runs(docs, batches):
    assert ordered(tuple(r) for r in substring_runs.dedup(docs, batches=batches).collect()) == words_removed(35)


def test_cleaned_keeps_clean_texts(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    df = spark.createDataFrame([(1, "own words\nhere " + shared + " end", "a", "b", 5), (2, "other " + shared, "a", "b", 5), (3, "clean  text\n", None, None, None), (4, shared, "a", "b", 5), (5, None, "a", "b", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in substring_runs.cleaned(df).collect()}
    assert got[1]["text"] == "own words\nhere end" and got[1]["n_chars"] == 18 and got[2]["text"] == "other "
    assert got[3]["text"] == "clean  text\n" and got[3]["n_chars"] is None and set(got) == {1, 2, 3, 5}


def bytes_removed(n):
    texts = [(t or "").encode() for _, t in corpus()]
    count = Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    out = []
    for (doc, _), b in zip(corpus(), texts, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("wide", [2000, 0])
def test_suffix_dedup(docs, wide):
    assert ordered(tuple(r) for r in suffix_dedup.dedup(docs, wide=wide).collect()) == bytes_removed(400)


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for n in (0, 1, 2, 3, 4, 5, 6, 7, 50, 1001):
        s = np.array([rng.randrange(1, letters + 1) for _ in range(n)], np.int64)
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [512, 16])
def test_jaccard_join(docs, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    texts = corpus()
    sets = [shingles(t) for _, t in texts]
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            k = len(a & sets[j])
            if k and 5 * k >= 4 * (len(a) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    group = defaultdict(list)
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            group[find(i)].append(doc)
    want = ordered((doc, min(group[find(i)]), links[i]) for i, (doc, _) in enumerate(texts))
    assert ordered(tuple(r)[:3] for r in jaccard_join.join(docs).collect()) == want


def test_pruning_follows_the_posterior():
    from math import comb

    for n in (16, 160):
        m = jaccard_join.least_matches(0.8, 1e-9, n)
        tail = lambda m: sum(comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m + 1))  # noqa: B023, E731
        assert tail(m) >= 1e-9 and (m == 0 or tail(m - 1) < 1e-9)


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (102, 101), (100, 102)], "u long, v long")
    with Scratch(spark) as scratch:
        got = {r["node"]: r["component"] for r in components.components(edges, scratch, "c").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_runs.dedup(df).count() == suffix_dedup.dedup(df).count() == jaccard_join.join(df).count() == 0
