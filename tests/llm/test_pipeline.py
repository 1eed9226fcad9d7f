"""The pipeline on a small corpus: what each stage keeps, and what it changes."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghijk", k=r.randint(2, 7))) for _ in range(n))


def test_stages(spark, tmp_path):
    r = random.Random(9)
    clean = {i: prose(r, 60) + "\n" + prose(r, 30) for i in range(40)}
    item = prose(r, 25)
    rows = [(i, t, "en", "big" if i % 4 else "small", len(t)) for i, t in clean.items()]
    rows += [(100 + i, clean[i], "en", "big", 1) for i in range(3)]  # exact copies
    rows += [(200, prose(r, 40) + " " + item + " " + prose(r, 5), "en", "big", 1), (300, "too short", "en", "big", 1), (301, None, "en", None, None), (302, "x y " * 50, "en", "big", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [x.doc_id for x in (docs if k < 4 else out).collect()]
    assert sorted(kept["quality_rules"]) == sorted([*clean, 100, 101, 102, 200])
    assert sorted(kept["near_duplicates"]) == sorted([*clean, 200])
    assert sorted(kept["decontaminate"]) == sorted(clean)
    assert set(kept["mix_sources"]) == set(clean)
    assert sorted(kept["tokenize"]) == sorted(kept["mix_sources"])
    total = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in total) == sorted(kept["tokenize"]) and all(x.verified for x in total)
