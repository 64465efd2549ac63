"""The corpus pipeline, stage by stage, on planted documents."""

import random

import corpus_pipeline
from leafmill.llm.common import DOC_COLUMNS


def planted():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    vocab = [word() for _ in range(800)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bad = ["nastyword", "vileterm", "grimphrase"]
    docs, labels = [], []
    for i in range(300):
        t = text(80)
        toxic = i % 6 == 0
        if toxic:
            w = t.split()
            for k in rng.sample(range(80), 4):
                w[k] = rng.choice(bad)
            t = " ".join(w)
        docs.append((i, t))
        labels.append((i, int(toxic)))
    base = text(200)
    docs += [(1000, base), (1001, base), (1002, base.replace(base.split()[5], "changed"))]
    passage = text(60)
    docs += [(2000, text(30) + " " + passage), (2001, passage + " " + text(30))]
    docs += [(3000, text(40) + " password=abcd1234efgh " + text(10)), (4000, None), (4001, "")]
    return docs, labels


def test_stages(spark, tmp_path):
    docs, labels = planted()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "secret_scans", "packing"]
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == list(DOC_COLUMNS)
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"]: r for r in now.collect()})
    toxic = {i for i, t in labels if t}
    assert len(toxic & set(seen[0])) <= 3 and len(set(range(300)) - toxic - set(seen[0])) <= 3
    assert 1000 in seen[1] and 1001 not in seen[1] and 1002 not in seen[1] and {4000, 4001} <= set(seen[1])
    assert len(seen[2][2000]["text"].split()) == 30 and seen[2][1000]["text"] == docs[300][1]
    assert "abcd1234" not in seen[3][3000]["text"] and "[SECRET]" in seen[3][3000]["text"]
    assert {r["doc_id"] for r in now.collect()} == set(seen[3])
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, final.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, now.select("doc_id", "start", "length", "ids_crc32").collect()))
