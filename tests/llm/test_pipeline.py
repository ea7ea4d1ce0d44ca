"""The pipeline's stages on a small corpus."""

import numpy as np
import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(["an", "the", "re", "in", "on", "er", "ti", "es"], rng.integers(1, 4)))
    texts = [". ".join(" ".join(word() for _ in range(9)) for _ in range(12)) + "." for _ in range(80)]
    texts = [t + "\nHosted by the same network." for t in texts]
    passage = " ".join(word() for _ in range(15))
    rows = [(i, t, "en", f"s{i % 12}", len(t)) for i, t in enumerate(texts)]
    rows += [(200, texts[3], "en", "s1", 1), (201, texts[4].replace(".", " extra.", 1), "en", "s2", 1), (202, "Intro words here. " + passage + ". " + texts[5][::-1], "en", "s3", 1), (204, None, "en", "s5", 0)]
    rows += [(300 + i, " ".join(word() + str(rng.choice(["%%%", "***", "&&&"])) for _ in range(60)), "en", f"s{i % 12}", 1) for i in range(20)]  # enough to learn from
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id: r for r in docs.collect()})
    quality, lines, near, clean = seen
    assert {204, *range(300, 320)}.isdisjoint(quality) and len(quality) == 83
    assert lines.keys() == quality.keys() and not any("Hosted by" in r.text for r in lines.values()) and all(r.n_chars == len(r.text) for r in lines.values() if r.doc_id < 80)
    assert set(lines) - set(near) == {200, 201}
    assert set(near) - set(clean) == {202}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(clean) and all(r.n_tokens > 0 for r in out)


def test_null_ids_repeats_clashing_names_and_empty_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone_id long, kept boolean"
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 6").orderBy("doc_id").collect()]
    rows = [(None, texts[0], "en", "a", 1, 7, True), (None, "So " + passage + " it goes.", "en", "a", 1, 7, True), (1, texts[1], "en", "a", 1, None, None), (1, texts[1], "en", "b", 1, None, None), (2, texts[1], "en", "b", 1, 2, False), (3, texts[3], "en", "a", 1, 3, True), (4, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    near = corpus_pipeline.near_dup_stage(spark, docs, sf_dir)
    assert near.columns == docs.columns and sorted((str(r.doc_id), r.text or "") for r in near.collect()) == sorted([("None", rows[0][1]), ("None", rows[1][1]), ("1", texts[1]), ("3", texts[3]), ("4", "")])
    clean = corpus_pipeline.decontamination_stage(spark, docs, sf_dir)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["1", "1", "2", "3", "4", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
