"""Filter audit, token files and fill-in-middle against brute force."""

import gc
import hashlib
import json
import os
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpus import DOCUMENTS, awkward, clashing, documents, prose, written
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonegrid.llm import fill_middle, filter_audit, token_files
from tonegrid.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
STRANGE = [
    "plain words here", "tab\tand\x0bvertical\x0cform\rreturn\nline", "a\x1cb\x1fc \x85 next no-break em　wide", "é café ́lone ̸≮ ≠",
    "<|startoftext|>in<|endoftext|> <|endof text|>", "don't we'll 'S İstanbul ΣΑΣ ΣΑΣ. ŉ ǅ", "1234567890 3.14", "\U0001f600\U0001f468‍\U0001f469‍\U0001f467 flags \U0001f1e9\U0001f1ea", "日本語の文 中文 한국어 각",
    "﻿bom \x00nul \x7f", "x" * 5000, " lead and trail ", "‮rtl العربية",
]


# filter audit


def fails(rows):
    """For each (doc_id, text): the letters it fails."""
    out = []
    for doc, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t in rows)
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), copy)
        out.append("".join(f for f, failed in zip("ABCDE", tests, strict=True) if failed))
    return out


def plain_audit(rows, parts, good, toxic):
    expected = {}
    for part in {p or "" for p in parts}:
        own = [(f, g, t) for f, p, g, t in zip(fails(rows), parts, good, toxic, strict=True) if (p or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, letter in enumerate(order, 1):
                out = [d for d in left if letter in d[0]]
                redundant = sum(letter in d[0] for d in gone)
                left, gone = [d for d in left if letter not in d[0]], gone + out
                total[letter] += len(out)
                expected[part, "".join(order), step] = [len(left), len(out), redundant, sum(d[0] == letter for d in own), sum(d[1] for d in out), sum(d[2] for d in out)]
        for (p, order, step), counts in expected.items():
            if p == part:
                counts.append(total[order[step - 1]])
    return expected


def test_filter_audit_counts_every_order(spark, tmp_path):
    docs = awkward()
    varied = ["Word " * 10 + prose(70, 260), prose(71, 300) + " #", "ALL CAPS " * 120, prose(72, 250), prose(72, 250), None, " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(400))]
    docs = pa.concat_tables([docs, documents(varied, range(500, 508), [None, "", "s0", "s1", "s2", "", "s1", "s0"])])
    labels = pa.table({"doc_id": pa.array([0, 3, 3, 7, 500, 501, 502, 503, 503, None], pa.int64()), "quality": pa.array([1, 0, 1, None, 1, 1, 0, 1, 1, 1], pa.int32()), "toxic": pa.array([0, 0, 0, 1, 1, 0, 1, None, 0, 1], pa.int32()), "source": ["x"] * 10})
    good = {i for i, q in zip(labels["doc_id"].to_pylist(), labels["quality"].to_pylist(), strict=True) if q == 1 and i is not None}
    toxic = {i for i, t in zip(labels["doc_id"].to_pylist(), labels["toxic"].to_pylist(), strict=True) if t == 1 and i is not None}
    ids = docs["doc_id"].to_pylist()
    expected = plain_audit(list(zip(ids, docs["text"].to_pylist(), strict=True)), docs["source"].to_pylist(), [i in good for i in ids], [i in toxic for i in ids])
    found = filter_audit.query(spark, written(tmp_path, documents=clashing(docs), labels=labels)).collect()
    columns = (*filter_audit.COUNTS, "shapley")
    assert {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in found} == expected
    assert len(found) == len(expected) == 600 * len({s or "" for s in docs["source"].to_pylist()})


def test_interactions_of_other_filters(spark):
    rows = spark.createDataFrame([("p", 3, True, False)] * 5 + [("p", 1, False, True), ("p", 0, True, True)], "part string, mask int, good boolean, toxic boolean")
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.interactions(rows, "XY").collect()}
    assert found == {("XY", 1): (1, 6, 0, 1, 5, 1, 7), ("XY", 2): (1, 0, 5, 0, 0, 0, 5), ("YX", 1): (2, 5, 0, 0, 5, 0, 5), ("YX", 2): (1, 1, 5, 1, 0, 1, 7)}
    for wrong in ("", "ABCDEFG", ["long"]):
        with pytest.raises(ValueError):
            filter_audit.interactions(rows, wrong)


# token files


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 70), st.integers(0, 2**32 - 1))
def test_packing_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint32) if n else np.empty(0, np.uint32)
    raw = token_files.pack(ids, bits)
    assert len(raw) == -(-n // 8) * bits and token_files.unpack(raw, bits, n).tolist() == ids.tolist()
    assert sum(int(v) << bits * i for i, v in enumerate(ids)) == int.from_bytes(raw, "little")


def test_width_is_the_fewest_bits():
    assert [token_files.width(v) for v in (1, 2, 3, 256, 257, 32_000, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 15, 16, 16, 17]


def test_ids_by_words_are_those_of_whole_texts(spark):
    plain = Tokenizer.from_file(TOKENIZER)
    sample = table(spark, "/root/testdata/sf0.001", "documents").select("text").toPandas()["text"].tolist()
    texts = [t or "" for t in awkward()["text"].to_pylist()] + STRANGE + sample
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    with open(TOKENIZER) as f:
        definition = f.read()
    for by_words in (True, False):
        found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.encoded(rows, definition, 2, by_words).collect()}
        assert found == {i: [*e.ids, 2] for i, e in enumerate(plain.encode_batch(texts, add_special_tokens=False))}


def test_case_and_marks_after_words_need_no_ids_of_their_own():
    with open(TOKENIZER) as f:
        definition = f.read()
    plain, told = Tokenizer.from_file(TOKENIZER), json.loads(definition)
    assert token_files.separable(told)
    words = ["thertion", "Thertion", "THERTION.", "thertion,", "thertion$$$", "Thertion.%%%"]
    odd = ["it's", "IT'S.", "o'", "x1.", "a.b", ".a", "...", "J\u030c.", "É.", "İ.", "a<|endoftext|>", "<|endoftext|>", "<|startoftext|>.", "a<|", "a|>", "a_", "A\\", "a-", "\x00a.", "a\x7f", "ſ."]
    marks = [f"Word{chr(c)}" for c in range(33, 127)] + [f"word{chr(c)}'s" for c in range(33, 127)] + [f"word'{chr(c)}" for c in range(33, 127)]
    asked = []
    parts = token_files.Parts(plain, told["model"].get("end_of_word_suffix"), True)
    encode = parts.encoded
    parts.encoded = lambda texts: asked.extend(texts) or encode(texts)
    pooled = lambda texts: [x.tolist() for pool, sizes in [parts.pooled(pa.array(texts))] for x in np.split(pool, np.cumsum(sizes)[:-1])]
    assert pooled(words) == [plain.encode(w, add_special_tokens=False).ids for w in words]
    assert sorted(asked) == ["$$$", ",", ".", ".%%%", "thertion"]
    some = list(dict.fromkeys(odd + marks))
    assert pooled(some) == [plain.encode(w, add_special_tokens=False).ids for w in some]
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [{"content": "thertion."}]}):
        assert not token_files.separable(told | change)


def test_parts_are_known_without_an_object_for_each(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN", 3)
    monkeypatch.setattr(token_files, "LONG", 6)
    plain = Tokenizer.from_file(TOKENIZER)
    parts = token_files.Parts(plain, "</w>")
    for some in (["word", "é", "longer1"], ["É", "word", "x1"], [], ["longer1", "é", "a.b", "日本"], ["word", "日本"]):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in parts.known([t.encode() for t in some])] == [plain.encode(t, add_special_tokens=False).ids for t in some]
        assert all(len(t) <= 6 for t in [*parts.young, *parts.old])
    many = [f"{w}{n}" for w in ("word", "part") for n in "abcdefghijklmnop"] * 200
    many = [t + "q" * (i // 32) for i, t in enumerate(many)]
    monkeypatch.setattr(parts, "encoded", lambda texts: [b"0123"] * len(texts))
    seen = []
    gc.callbacks.append(lambda phase, info: seen.append(phase))
    parts.known([t.encode() for t in many])  # pairs for each unknown part set the collector of cycles going
    gc.callbacks.pop()
    assert not seen


def test_known_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN", 20)
    with open(TOKENIZER) as f:
        run = token_files._encode(f.read(), None, True)
    plain = Tokenizer.from_file(TOKENIZER)
    texts = [prose(i, 40) + " " + "y" * 100 + str(i) + f" own{i}" for i in range(6)]
    batch = pa.record_batch([pa.array(range(6)), pa.array(texts)], ["doc_id", "text"])
    token_files._LOADED.clear()
    monkeypatch.setattr(token_files, "PIECE", 500)
    out = list(run([batch]))
    assert len(out) > 3 and [i for b in out for i in b["doc_id"].to_pylist()] == list(range(6))
    assert [np.frombuffer(x, "<u4").tolist() for b in out for x in b["ids"].to_pylist()] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    ((_, parts),) = token_files._LOADED.values()
    assert len(parts.young) <= 40 and len(parts.old) <= 40 and max(map(len, [*parts.young, *parts.old])) <= token_files.LONG
    assert parts.old and b"own5" in parts.young and b"own5" not in parts.old
    token_files._LOADED.clear()


@pytest.mark.parametrize("file_ids", [token_files.FILE_IDS, 5000, 1])
def test_files_hold_all_documents_in_order(spark, tmp_path, file_ids):
    docs = clashing(pa.concat_tables([awkward(), documents(STRANGE, range(-3, len(STRANGE) - 3))]))
    (tmp_path / "in").mkdir()
    path = token_files.write_token_files(table(spark, written(tmp_path / "in", documents=docs), "documents").repartition(5), f"{tmp_path}/out", TOKENIZER, 2, file_ids=file_ids)
    plain = Tokenizer.from_file(TOKENIZER)
    expected = sorted(
        ((i is not None, i or 0), [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True)
    )
    found = token_files.read_token_files(spark, path).orderBy("start").collect()
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in found]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in found] == [k for k, _ in expected]
    assert sorted(zip([k for k, _ in expected], ids, strict=True)) == expected
    assert [r.start for r in found] == np.cumsum([0, *map(len, ids)])[:-1].tolist() and [r.n_tokens for r in found] == [*map(len, ids)]
    every = [t for d in ids for t in d]
    listed = token_files.manifest(path)
    assert listed["bits"] == 16 and listed["n_ids"] == len(every) and (file_ids > 1 or len(listed["files"]) == len(found))
    for start, n in ((0, 10), (4090, 12), (len(every) - 3, 99), (17, len(every)), (len(every), 5), (9000, 0)):
        assert token_files.read_ids(path, start, n).tolist() == every[start : start + n]
    with pytest.raises(Exception, match="append"):
        token_files.read_token_files(spark, path).write.format("packed_tokens").option("bits", 16).mode("overwrite").save(path)


def test_only_what_is_committed_is_read(spark, tmp_path):
    path = f"{tmp_path}/out"
    spark.dataSource.register(token_files.PackedTokens)
    rows = spark.range(0, 40, 1, 4).select(F.col("id").alias("doc_id"), F.unhex(F.lit("0100000002000000")).alias("ids"))
    bad = rows.withColumn("ids", F.when(F.col("doc_id") == 35, F.raise_error(F.lit("lost"))).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("packed_tokens").option("bits", 2).mode("append").save(path)
    assert not os.path.exists(f"{path}/{token_files.MANIFEST}")
    open(f"{path}/part-000000-999-00000.ids", "wb").write(b"of a lost task")
    rows.write.format("packed_tokens").option("bits", 2).mode("append").save(path)
    assert sorted(f for f in os.listdir(path) if not f.startswith(".")) == sorted([token_files.MANIFEST, *(f["name"] for f in token_files.manifest(path)["files"])])
    assert token_files.read_ids(path, 0, 80).tolist() == [1, 2] * 40
    open(f"{tmp_path}/other", "wb").write(b"\0" * 100)
    with pytest.raises(ValueError, match="no file of packed"):
        token_files.PackedFile(f"{tmp_path}/other")


def test_token_files_query(spark, tmp_path):
    texts = [prose(i, 30 + i) for i in range(40)] + [None, prose(1, 30_000)]
    docs = documents(texts, [97 * i % 131 for i in range(42)])
    found = {r.doc_id: r for r in token_files.query(spark, written(tmp_path, documents=docs)).collect()}
    plain, start = Tokenizer.from_file(TOKENIZER), 0
    for doc, text in sorted(zip(docs["doc_id"].to_pylist(), texts, strict=True)):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert found[doc].asDict() == {"doc_id": doc, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)
    assert len(found) == 42
    empty = tmp_path / "empty"
    empty.mkdir()
    assert token_files.query(spark, written(empty, documents=DOCUMENTS.empty_table())).count() == 0


# fill-in-middle


def units_of(text, unit):
    return re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab\né€\U0001f600\x8a", max_size=40), min_size=1, max_size=6), st.integers(0, 50), st.integers(0, 50), st.sampled_from(fill_middle.UNITS))
def test_cuts_lie_at_unit_ends(texts, h1, h2, unit):
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    n, first, second = fill_middle.cuts(data, at[:-1], at[1:], lambda n: np.minimum(h1 % (n + 1), h2 % (n + 1)), lambda n: np.maximum(h1 % (n + 1), h2 % (n + 1)), unit)
    for i, t in enumerate(texts):
        units = units_of(t, unit)
        lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        assert n[i] == len(units)
        assert (first[i] - at[i], second[i] - at[i]) == (len("".join(units[:lo]).encode()), len("".join(units[:hi]).encode()))


def plain_middle(doc, text, unit="line", seed=7, rate=100, spm=50):
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    units = units_of(text, unit)
    if not text or any(s in text for s in fill_middle.SENTINELS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(units[a:b]) for a, b in ((0, lo), (lo, hi), (hi, None)))
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("char", 100, 0), ("char", 60, 100)])
def test_fill_in_middle_of_awkward_documents(spark, tmp_path, unit, rate, spm):
    more = ["a<\nb<\nS>\n<<\n", "<P> in it", "x\n<M>\n", "\n", "\n\n\n", "no end", "é\n" * 9, "<\n<S\n>", *STRANGE, *(f"l{i}\n" * i for i in range(12))]
    docs = clashing(pa.concat_tables([awkward(), documents(more, range(100, 100 + len(more)))]))
    got = fill_middle.fill_in_middle(table(spark, written(tmp_path, documents=docs), "documents"), unit=unit, fim_rate=rate, spm_rate=spm)
    got = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    texts = list(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True))
    sort = lambda rows: sorted(rows, key=repr)
    assert sort((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == sort((i, *plain_middle(i, t, unit, 7, rate, spm)) for i, t in texts)
    assert sort((r.doc_id, r.back) for r in got) == sort((i, t or "") for i, t in texts)
    assert {r.form for r in got} >= {"plain"} | ({"spm", "psm"} if 0 < spm < 100 else set())


def test_sentinels_that_would_not_be_sure_are_refused(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for wrong in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P><", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs, sentinels=wrong)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, unit="page")


# the shared folder

ALONE = """
import json, os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master(sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
from tonegrid.llm import common
try:
    folder = common.shared_dir(spark)
    assert folder == common.shared_dir(spark)
    n = common.written(spark.range(7)).count()
    print("SAID", json.dumps([folder, n, os.listdir(folder.removeprefix("file://"))]))
except ValueError as e:
    print("SAID", json.dumps(str(e)))
spark.stop()
"""


@pytest.mark.parametrize("master", ["local[1]", "local-cluster[1,1,1024]"])
def test_shared_folder_without_a_setting(tmp_path, master):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    done = subprocess.run([sys.executable, "-c", ALONE, master], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    said = [json.loads(x[5:]) for x in done.stdout.splitlines() if x.startswith("SAID ")]
    assert said, done.stderr[-2000:]
    if master == "local[1]":
        folder, n, names = said[0]
        assert n == 7 and names == ["tonegrid"] and not os.path.exists(folder.removeprefix("file://"))
    else:
        assert "spark.checkpoint.dir must name a folder" in said[0]
