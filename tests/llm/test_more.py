"""Models against separate computations, the index over several calls, large groups, and odd tables for every operator."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from leafmill.llm import bpe, jaccard_join, langid, media_columns, packing, quality_lines, secret_scan, substring_runs, suffix_dedup, toxicity, webp
from leafmill.llm.common import DOC_COLUMNS

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, base0 int, block long, cut string, open string, score double"


def odd_rows():
    """Null ids, texts and columns, repeated rows, one id with two texts, a text far longer than a batch."""
    rng = random.Random(12)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400_000))
    texts = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "another text"), (None, "no id here"), (None, None), (2, None), (3, ""), (4, "  \n\t "), (5, long), (6, "password=abcd1234efgh é")]
    return [(i, t, None if k % 2 else "en", None if k % 3 else "s", k, "kept", k, k, "x", None, 0.5) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def models(df, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    return {
        "op1": lambda d: quality_lines.line_frequency(d),
        "op2": lambda d: media_columns.store(d),
        "op3": lambda d: secret_scan.secrets(d),
        "op4": lambda d: bpe.encode_decode(d),
        "op5": lambda d: substring_runs.dedup(d),
        "op6": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "op7": lambda d: suffix_dedup.dedup(d),
        "op8": lambda d: langid.predict(d, langid.train(d)),
        "op9": lambda d: jaccard_join.join(d),
        "op10": lambda d: packing.pack(d),
    }


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_odd_rows_and_empty_tables(spark, odd, empty, name):
    run = models(odd, spark)[name]
    got = run(odd).collect()
    if name != "op10":
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in odd_rows())
    else:
        assert {r["doc_id"] for r in got} == {r[0] for r in odd_rows()}
    same = [r for r in got if r["doc_id"] == 1]
    if name in ("op2", "op4"):  # rows of one text give one result
        assert len({tuple(r) for r in same}) == 2
    assert run(empty).count() == 0


def test_repeated_rows_are_packed_apart(spark):
    df = spark.createDataFrame([(7, "one two three")] * 5 + [(None, "four")], "doc_id long, text string")
    got = packing.pack(df).collect()
    assert len(got) == 6 and len({(r["sequence_id"], r["offset"]) for r in got}) == 6


def test_redaction_keeps_every_column(odd):
    out = secret_scan.redact(odd, secret_scan.fitted(odd.select("doc_id", "text")))
    assert out.columns == odd.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[6]["text"] == "[SECRET] é" and got[6]["found"] == "kept" and got[6]["base0"] == 9


def test_secret_models_on_held_out_strings(spark):
    """Random strings of several alphabets, and identifiers of words that no sample has."""
    rng = random.Random(21)
    alphabets = [secret_scan.ALPHABET[:62], secret_scan.ALPHABET[:64], secret_scan.ALPHABET[26:62], secret_scan.ALPHABET[:26] + "0123456789"]
    secrets = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (16, 20, 32, 40) for _ in range(25)]
    words = "abandon airport balcony biology blanket blossom bracket brother buffalo bundle butter cabbage captain century chapter chicken climate country courage cousin cricket crystal decade dolphin elegant evening explain fashion fitness gallery giraffe grocery harvest holiday hundred journey kitchen leopard library machine midnight morning orchard pattern penguin popular pottery problem purpose quarter rainbow romance science session shallow society spatial station strategy supreme theater thunder tobacco tragedy trumpet uniform utility vehicle venture village vintage volcano welcome whisper"
    words = [w for w in words.split() if w not in secret_scan.PARTS]
    plain = []
    for i in range(400):
        w = rng.sample(words, 3)
        plain.append(("_".join(w), "-".join(w), "/".join(w), w[0] + "".join(x.title() for x in w[1:]), "_".join(w).upper(), "_".join(w) + str(rng.randrange(1000)))[i % 6])
    df = spark.createDataFrame([(i, f"the value {t} stands here") for i, t in enumerate(secrets + plain)], "doc_id long, text string")
    model = secret_scan.train(secret_scan.made_samples(spark))
    hit = {r["doc_id"] for r in secret_scan.scan(df, model).collect() if any(s["kind"] == 3 for s in r["found"])}
    assert sum(i in hit for i in range(len(secrets))) >= 0.98 * len(secrets)
    assert sum(i in hit for i in range(len(secrets), len(secrets) + len(plain))) <= 0.03 * len(plain)


def test_secrets_of_many_matches(spark):
    many = " ".join(f"token=abcdefgh{i:05}" for i in range(3000))
    df = spark.createDataFrame([(1, many)], "doc_id long, text string")
    r = secret_scan.secrets(df).first()
    at, want = 0, []
    for i in range(3000):
        want.append(f"assign:{at}:{at + 19}")
        at += 20
    assert r["n_assign"] == 3000 and r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_risk_gradient():
    """Against differences of the non-negative risk itself, on both sides of its corner."""
    rng = np.random.default_rng(3)
    for shift in (-4.0, 0.0, 4.0):
        is_p = np.arange(12) < 4
        z, prior, n_p, n_u = rng.normal(size=12) + shift * is_p, 0.4, 4, 8
        soft = lambda x: np.log1p(np.exp(x))
        part = lambda z: soft(z[~is_p]).mean() - prior * soft(z[is_p]).mean()
        risk = lambda z: prior * soft(-z[is_p]).mean() + part(z)
        own = toxicity.risk_gradient(z, is_p, n_p, n_u, prior)
        for i in range(12):
            d = np.zeros(12)
            d[i] = 1e-5
            want = (risk(z + d) - risk(z - d)) / 2e-5 if part(z) >= 0 else -(part(z + d) - part(z - d)) / 2e-5
            assert own[i] == pytest.approx(want, abs=1e-7)


def test_language_against_brute_force(spark):
    """Counts, log-probabilities and posteriors by plain dictionaries."""
    rng = random.Random(2)
    data = [(i, " ".join("".join(rng.choice("abcé" if i % 2 else "bcdЖ") for _ in range(3)) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "!", " 1"]), "xx" if i % 2 else "yy") for i in range(40)]
    data += [(100, "zzz", None), (101, "q", "ww")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")

    def buckets(text):
        c = [ord(x.lower()) if x.isalpha() else 0 for x in text]
        for i in range(len(c)):
            for k in (1, 2, 3):
                run = c[i : i + k]
                if len(run) == k and (run[0] or run[-1]):
                    key = 0
                    for j, x in enumerate(run):
                        key = (key * 0x9E3779B97F4A7C15 + x) % (1 << 64) if j else x
                    yield ((key + k) * 0xD1B54A32D192ED03 % (1 << 64)) >> (64 - langid.BITS)

    counts = defaultdict(Counter)
    for i, t, lang in data:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            counts[lang].update(buckets(t))
    langs = sorted(counts)
    model = langid.train(df)
    assert model[0] == langs
    for r in langid.predict(df, model).collect():
        text = next(t for i, t, _ in data if i == r["doc_id"])
        total = [sum(math.log((counts[x][b] + 0.1) / (sum(counts[x].values()) + 0.1 * (1 << langid.BITS))) for b in buckets(text)) for x in langs]
        best = max(total)
        assert r["lang_pred"] == langs[total.index(best)] and r["score"] == pytest.approx(1 / sum(math.exp(x - best) for x in total), rel=1e-3)


def test_language_ties(spark):
    df = spark.createDataFrame([(i, "same text", k) for i, k in enumerate(["bb", "aa", "cc"] * 12)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(df, langid.train(df)).collect()} == {"aa"}


def test_images_side_by_side():
    """Images of all forms in one call come out as each by itself; damaged ones among them do no harm."""
    rng = np.random.default_rng(4)
    made = []
    for i in range(24):
        image = np.kron(rng.integers(0, 256, (rng.integers(1, 5), rng.integers(1, 6), 4)), np.ones((3, 2, 1))).astype(np.uint8)
        made.append((image, webp.encode(image, predictor=i % 14 if i % 3 else None, colour=0x0A1B2C if i % 4 == 1 else None, subtract=i % 5 == 2, cache_bits=i % 4, copies=bool(i % 2))))
    grey = rng.integers(97, 101, 640).astype(np.uint8)
    files = [f for _, f in made] + webp.encode_grey(np.tile(grey, 2), np.array([0, 640, 1280])) + [made[3][1][:-6], b"RIFF"]
    got = webp.decode_all(files)
    for (image, _), argb in zip(made, got, strict=False):
        assert (webp.rgba(argb) == image).all()
    assert all((x >> 8 & 255).ravel().tolist() == grey.tolist() for x in got[24:26])
    assert all(isinstance(x, ValueError) for x in got[26:])


def test_copies_make_files_smaller():
    rng = np.random.default_rng(5)
    line = rng.integers(32, 127, 300).astype(np.uint8)
    data = np.concatenate([line, rng.integers(32, 127, 40), line, line, rng.integers(32, 127, 20)]).astype(np.uint8)
    data = data[: len(data) // 64 * 64]
    at = np.array([0, len(data)])
    back, _ = webp.decode_grey(webp.encode_grey(data, at))
    assert (back == data).all() and len(webp.encode_grey(data, at)[0]) < len(data) * 0.75
    for n in (1, 2, 7, 40):  # nothing to copy from but itself
        own = np.tile(np.arange(n, dtype=np.uint8), 640 // n + 1)[:640]
        assert (webp.decode_grey(webp.encode_grey(own, np.array([0, 640])))[0] == own).all()


def words(text):
    return (text or "").split()


def test_index_over_several_calls(spark, tmp_path):
    """Each batch against all before it, in an index that is opened anew for every call."""
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    passage, other = text(60), text(45)
    batches = [
        [(1, text(50) + " " + passage), (2, text(80)), (3, other + " " + other)],
        [(4, passage + " " + text(30)), (5, text(70)), (None, None)],
        [(6, text(20) + " " + other + " tail"), (7, passage), (7, passage)],
        [(8, text(90)), (9, text(10))],
        [(10, text(40) + " " + text(40)), (11, passage + " " + other)],
    ]
    seen: list[tuple] = []
    for rows in batches:
        index = substring_runs.FingerprintIndex(spark, f"file://{tmp_path}/index", fan_out=2)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        history = spark.createDataFrame(seen, "doc_id long, text string") if seen else None
        got = defaultdict(set)
        for r in index.add(df, history).collect():
            got[r["doc_id"]] |= {s["start"] + k for s in r["cut"] for k in range(s["n"])}
        count = Counter(tuple(words(t)[i : i + 35]) for _, t in [*seen, *rows] for i in range(len(words(t)) - 34))
        for doc, t in rows:
            assert got[doc] == {i for i in range(len(words(t)) - 34) if count[tuple(words(t)[i : i + 35])] > 1}, doc
        index.close()
        seen += rows
    assert index.state["batches"] == 5 and len(index.state["runs"]) < 5


def test_index_survives_a_failed_call(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    index = substring_runs.FingerprintIndex(spark, at)
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80)))], "doc_id long, text string")
    assert index.add(df).count() == 0
    before = index.state
    with pytest.raises(Exception):
        index.add(df.selectExpr("doc_id", "raise_error('lost') AS text"), df)
    again = substring_runs.FingerprintIndex(spark, at)
    assert again.state == before
    assert sum(s["n"] for s in again.add(df, df).first()["cut"]) == 46
    with pytest.raises(ValueError):
        substring_runs.FingerprintIndex(spark, at, n=20)


def test_suffixes_of_a_long_string():
    rng = np.random.default_rng(0)
    s = rng.integers(1, 257, 4_200_000)
    order = suffix_dedup.suffix_array(s)
    head = np.zeros(len(s), np.int64)
    padded = np.append(s, np.zeros(6, np.int64))
    for k in range(6):
        head = head * 257 + padded[k : k + len(s)]
    assert (np.diff(head[order]) >= 0).all() and len(np.unique(order)) == len(s)
    small = np.array([2**40, 5, 2**41, 5, 2**40] * 7)
    assert suffix_dedup.suffix_array(small).tolist() == sorted(range(35), key=lambda i: small[i:].tolist())


def test_similar_sets_in_many_blocks(spark, monkeypatch):
    """A group of near copies over many small blocks: every link counts once, and the group is one class."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(150)] = f"q{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"v{i}x{k}" for k in range(40))) for i in range(20)] + [(200, rows[0][1])]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    near = {i: {j for j in sets if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    got = {r["doc_id"]: r for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in sets:
        reach, todo = {i}, [i]
        while todo:
            todo += (fresh := near[todo.pop()] - reach)
            reach |= fresh
        assert got[i]["n_links"] == len(near[i]) and got[i]["class_id"] == min(reach)


def test_pipeline_on_odd_tables(spark, odd, tmp_path):
    spark.createDataFrame([(1, 1, 0), (6, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, df in (("odd", odd), ("none", odd.where("false"))):
        now = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            assert k == 4 or out.columns == list(DOC_COLUMNS)
            out.write.parquet(f"{tmp_path}/{name}{k}")
            now = spark.read.parquet(f"{tmp_path}/{name}{k}")
        if name == "none":
            assert now.count() == 0
        else:
            assert {None, 1, 2, 3, 4, 5} <= {r["doc_id"] for r in now.select("doc_id").distinct().collect()} | {6}


def test_code_groups():
    """An image whose blocks take turns between two groups of codes, beside one without groups."""
    rng = np.random.default_rng(8)
    groups = [0, 1, 1, 0, 1, 0]  # three blocks of four pixels across, two down
    w = webp.Writer()
    webp.put_header(w, 10, 8, False)
    for value, n in ((0, 1), (0, 1), (1, 1), (0, 3)):  # no transform, no cache, groups, blocks of four pixels
        w.put(value, n)
    webp.put_pixels(w, [webp.BLACK | g << 8 for g in groups], 3, False)
    for first in (10, 30):
        webp.put_code(w, [int(s in (first, first + 10)) for s in range(webp.GREEN)])
        for only in (first + 1, first + 2, 255):
            webp.put_code(w, [int(s == only) for s in range(webp.OTHER)])
        webp.put_code(w, [0] * webp.DISTANCE)
    want = []
    for y in range(8):
        for x in range(10):
            first, bit = (10, 30)[groups[(y >> 2) * 3 + (x >> 2)]], int(rng.integers(0, 2))
            w.put(bit, 1)
            want.append((first + 1, first + 10 * bit, first + 2, 255))
    other = picture_of(9)
    got = webp.decode_all([webp.encode(other, cache_bits=2), webp.wrapped(w.bytes())])
    assert (webp.rgba(got[0]) == other).all() and [tuple(p) for p in webp.rgba(got[1]).reshape(-1, 4).tolist()] == want


def picture_of(seed):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 256, (3, 4, 4)), np.ones((4, 5, 1))).astype(np.uint8)
