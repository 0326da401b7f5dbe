import hashlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def tables(spark, prose, tmp_path):
    """A folder with documents, labels and benchmark: clean texts, and one of each kind that a stage acts on."""
    rows, labels = [], []
    for i in range(240):
        w = prose(i, 60).split(" ")
        if i % 3 == 0:
            for k in range(3):
                w[10 * k + 5] = f"vilex{'abcdefgh'[(i + k) % 8]}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0), 1))
    near = prose(1, 60).split(" ")
    near[20] = "changed"
    rows += [(500, " ".join(near)), (501, rows[2][1]), (502, prose(900, 40) + " " + prose(901, 20)), (503, prose(800, 30) + " a@b.co"), (504, None), (505, "")]
    folder = f"file://{tmp_path}/sf"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(901, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows)


def test_stages_and_result(spark, tables, prose):
    tiktoken, names = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    folder, texts = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "decontamination", "private data", "tokens"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:5] == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    want = {i for i in range(240) if i % 3} | {503, 504}
    assert set(got) == want
    assert got[503].text == prose(800, 30) + " <email>" and got[4].text == texts[4]
    from stratiform.llm.bpe import read_ranks

    enc = tiktoken.Encoding("own", pat_str=names.PATTERN, mergeable_ranks=read_ranks(names.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in got.values():
        ids = enc.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_stages_keep_columns_and_empty_tables(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert out.count() == 0
