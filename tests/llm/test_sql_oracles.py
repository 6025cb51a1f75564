"""Queries with SQL, on awkward tables with distinct ids, and on empty ones."""

import pyarrow as pa
import pytest
from corpus import DOCUMENTS, awkward, clashing, documents, from_sql, prose, rows_of, written

from tonegrid.llm import catalog

ON_DOCUMENTS = [n for n in catalog.ORACLES if n != "op3_chat_formatting"]


def labels():
    return pa.table({"doc_id": pa.array([0, 3, 3, 5, None], pa.int64()), "quality": pa.array([1, 0, 1, None, 1], pa.int32()), "toxic": pa.array([0, 1, 0, 1, 1], pa.int32())})


def distinct_ids():
    docs = awkward()
    return docs.set_column(0, "doc_id", pa.array(range(docs.num_rows), pa.int64()))


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_awkward_documents(spark, tmp_path, name):
    folder = written(tmp_path, documents=clashing(distinct_ids()), labels=labels())
    assert rows_of(catalog.QUERIES[name](spark, folder)) == rows_of(from_sql(catalog.ORACLES[name], folder))


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_empty_documents(spark, tmp_path, name):
    folder = written(tmp_path, documents=DOCUMENTS.empty_table(), labels=labels())
    assert catalog.QUERIES[name](spark, folder).count() == 0


def test_hot_digest_takes_the_broadcast_path(spark, tmp_path):
    folder = written(tmp_path, documents=documents([prose(0, 20)] * 300 + [prose(i, 20) for i in range(1, 200)]))
    name = "op6_exact_dedup"
    assert rows_of(catalog.QUERIES[name](spark, folder)) == rows_of(from_sql(catalog.ORACLES[name], folder))


def conversations(rows):
    return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []], schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 5, None, "x\n<|im_end|>\n"), (2, 5, "assistant", "&lt;&amp;[INST]"), (2, 9, "as\nsistant", "y")],
        [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (0, 0, "", "b"), (0, 0, None, "a"), (3, 1, "assistant", "long " * 40_000)],
        [(7, i, ("user", "assistant")[i % 2], f"t{i}" * (1 + i % 3)) for i in range(70)] + [(8, 3, "assistant", "é\U0001f600")] * 2,
    ],
)
def test_conversations(spark, tmp_path, rows):
    table = conversations(rows)
    for clash in ("n", "node", "parent", "score", "root", "leaf", "depth"):
        table = table.append_column(clash, pa.array([f"{clash}{i}" for i in range(table.num_rows)], pa.string()))
    folder = written(tmp_path, conversations=table)
    name = "op3_chat_formatting"
    assert rows_of(catalog.QUERIES[name](spark, folder)) == rows_of(from_sql(catalog.ORACLES[name], folder))


#: What each query says of a document apart from ids, which are null or repeated here.
OF_THE_TEXT = {
    "op1_secret_scans": ["n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op2_source_mixing": ["size", "source_size", "target"],
    "op5_simhash_near_dedup": ["fingerprint"], "op6_exact_dedup": ["group_size", "text_sha256"], "op7_line_dedup": ["n_lines", "n_dropped", "kept_sha256"],
}


@pytest.mark.parametrize("name", list(OF_THE_TEXT))
def test_repeated_rows_and_null_ids(spark, tmp_path, name):
    sides = []
    for n, docs in enumerate((awkward(), distinct_ids())):
        (tmp_path / str(n)).mkdir()
        sides.append(catalog.QUERIES[name](spark, written(tmp_path / str(n), documents=clashing(docs))).toPandas())
    assert len(sides[0]) == awkward().num_rows
    assert rows_of(sides[0], OF_THE_TEXT[name]) == rows_of(sides[1], OF_THE_TEXT[name])
    if name == "op6_exact_dedup":
        assert sides[0]["kept"].sum() == sides[0]["text_sha256"].nunique()
    if name == "op5_simhash_near_dedup":
        assert sides[0]["component_id"].nunique(dropna=False) == sides[1]["component_id"].nunique()
    if name == "op2_source_mixing":
        taken = sides[0].groupby(["source_size", "target"])["taken"].sum().reset_index()
        assert all(abs(r.taken - r.target) <= 1 for r in taken.itertuples() if r.source_size != 0) or taken["target"].duplicated().any()
