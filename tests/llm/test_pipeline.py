"""The pipeline, stage by stage, against what each stage must do to planted documents."""

import pyarrow as pa
from corpus import awkward, clashing, documents, prose, written

import corpus_pipeline
from tonegrid.llm.common import table


def test_planted_documents(spark, tmp_path):
    item = prose(40, 30)
    base = prose(41, 200).split()
    near = list(base)
    near[100] = "mirage"
    good = [prose(1000 + i, 40 + i) + "." for i in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in prose(i, 30).split()) for i in range(40)]
    texts = [*good, *junk, " ".join(base), " ".join(near), good[3] + " ", prose(42, 30) + " " + item + " " + prose(43, 30)]
    labels = pa.table({"doc_id": pa.array(range(100), pa.int64()), "quality": pa.array([1] * 60 + [0] * 40, pa.int32()), "toxic": pa.array([0] * 100, pa.int32())})
    bench = pa.table({"item_id": pa.array([0], pa.int64()), "text": [item]})
    folder = written(tmp_path, documents=clashing(documents(texts)), labels=labels, benchmark=bench)
    docs = table(spark, folder, "documents")
    columns, left = docs.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/out{n}")
        docs = spark.read.parquet(f"{tmp_path}/out{n}")
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns, name
    assert left[0] == {*range(60), 100, 101, 102, 103}
    assert len(left[1] & {3, 102}) == 1 and left[0] - left[1] <= {3, 102}
    assert left[2] == left[1] - {101}
    assert left[3] == left[2] - {103}
    assert left[4] <= left[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == left[4]


def test_awkward_documents_pass_all_stages(spark, tmp_path):
    labels = pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())})
    bench = pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    folder = written(tmp_path, documents=clashing(awkward()), labels=labels, benchmark=bench)
    assert 0 < corpus_pipeline.run(spark, folder).count() <= awkward().num_rows
    empty = tmp_path / "empty"
    empty.mkdir()
    folder = written(empty, documents=awkward().slice(0, 0), labels=labels, benchmark=bench)
    assert corpus_pipeline.run(spark, folder).count() == 0
