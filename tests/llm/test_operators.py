"""Operators against brute force, with awkward rows, repeated rows, empty tables and clashing columns."""

import os

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from corpus import DOCUMENTS, WORDS, awkward, clashing, components, documents, prose, rows_of, written
from pyspark.sql import functions as F

from tonegrid.llm import blocks, chat_format, decontaminate, exact_dedup, line_dedup, mixing, near_dedup, quality, secret_scan, simhash, substring_dedup, url_filter
from tonegrid.llm.common import table


def read(spark, folder, **tables):
    return table(spark, written(folder, **tables), next(iter(tables)))


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words(text)
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def plain_fingerprint(text, n):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


# exact dedup


def test_exact_dedup_keeps_one_row_of_each_group_with_all_columns(spark, tmp_path):
    docs = read(spark, tmp_path, documents=clashing(awkward()))
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    normal = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")
    texts = [r.text for r in kept.collect()]
    assert sorted(map(normal, texts)) == sorted({normal(r.text) for r in docs.collect()})


# SimHash


@pytest.mark.parametrize("block", [256, 8, 1])
def test_simhash_links_all_within_four_bits(spark, tmp_path, block):
    rng = np.random.default_rng(5)
    values = [int(v) for v in rng.integers(-(2**63), 2**63, 60)]
    for v in values[:30]:
        for n in (1, 2, 4, 5):
            values.append(int(np.int64(v) ^ np.int64(sum(1 << int(b) for b in rng.choice(62, n, replace=False)))))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, fp long")
    found = {r.fp: r.component_id for r in simhash.classes(rows, block=block).collect()}
    u = np.array(values, np.int64).view(np.uint64)
    edges = [(i, j) for i in range(len(u)) for j in range(i) if np.bitwise_count(u[i] ^ u[j]) <= 4]
    assert [found[v] for v in values] == components(len(values), edges)


def test_simhash_query_on_awkward_documents(spark, tmp_path):
    docs = awkward()
    docs = docs.set_column(0, "doc_id", pa.array(range(docs.num_rows), pa.int64()))
    got = {r.doc_id: r for r in simhash.query(spark, written(tmp_path, documents=clashing(docs))).collect()}
    texts = docs["text"].to_pylist()
    prints = [plain_fingerprint(t, 4) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == components(len(texts), edges)


@pytest.mark.parametrize("block", [256, 20])
def test_simhash_of_one_dense_group(spark, block):
    rng = np.random.default_rng(6)
    values = list({int(np.int64(0x1234567890ABCDEF) ^ np.int64(sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 8), replace=False)))) for _ in range(700)})
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, fp long")
    found = {r.fp: r.component_id for r in simhash.classes(rows, block=block).collect()}
    u = np.array(values, np.int64).view(np.uint64)
    edges = [(i, j) for i in range(len(u)) for j in range(i) if np.bitwise_count(u[i] ^ u[j]) <= 4]
    expected = components(len(values), edges)
    assert len(set(expected)) > 10
    assert [found[v] for v in values] == expected


def test_pivot_tables_bound_the_distance():
    fps = np.random.default_rng(1).integers(0, 1 << 64, 60, dtype=np.uint64)
    tables = simhash.pivot_tables(fps)
    far = np.bitwise_count(fps[:, None] ^ fps[None])
    low = np.abs(tables[:, None] - tables[None]).max(2)
    assert (low <= far).all() and (low > 4).any()
    for most in (20, 28, 64):
        assert [simhash.within(fps, tables, i, np.arange(60), most).tolist() for i in range(60)] == [np.flatnonzero(far[i] <= most).tolist() for i in range(60)]


def test_simhash_of_no_documents(spark, tmp_path):
    assert simhash.query(spark, written(tmp_path, documents=DOCUMENTS.empty_table())).count() == 0


# near-dedup of the pipeline


@pytest.mark.parametrize("block", [256, 8])
def test_near_dedup_keeps_one_of_each_group(spark, tmp_path, block):
    rng = np.random.default_rng(3)
    texts = []
    for i in range(12):
        base = prose(100 + i, 150).split()
        for c in range(20 if i == 0 else 4):
            copy = list(base)
            for at in rng.choice(150, c % 4, replace=False):
                copy[at] = str(rng.choice(WORDS)) + "x"
            texts.append(" ".join(copy))
    docs = read(spark, tmp_path, documents=clashing(documents(texts)))
    sets = [set(shingles(t, 5)) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    kept = near_dedup.near_dedup(docs, block=block)
    assert kept.columns == docs.columns
    assert len(set(components(len(texts), edges))) == 12 == kept.count()


def test_near_dedup_links_a_text_with_its_lines_repeated(spark, tmp_path):
    texts = []
    for i in range(20):
        base = [f"{w}{j}" for j, w in enumerate(prose(300 + i, 204).split())]
        texts += [" ".join(base), " ".join(base + base[40:59] * 60)]
    sets = [set(shingles(t, 5)) for t in texts]
    assert all(len(a & b) >= 0.9 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    kept = near_dedup.near_dedup(read(spark, tmp_path, documents=documents(texts)))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))


def loose_family(n, seed):
    """Texts of one family, at similarities of about 0.4 to 0.9 to each other."""
    rng = np.random.default_rng(seed)
    base, texts = [f"{w}{j}" for j, w in enumerate(prose(seed, 150).split())], []
    for _ in range(n):
        copy = list(base)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            copy[at] = f"{rng.choice(WORDS)}x{rng.integers(3)}"
        texts.append(" ".join(copy))
    return texts


def like_pairs(texts, similarity=0.8):
    sets = [set(shingles(t, 5)) for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]


@pytest.mark.parametrize("block", [10_000, 64])
def test_all_links_of_a_large_bucket_are_found_whatever_the_block(spark, tmp_path, block):
    texts = loose_family(1000, 31)
    links = like_pairs(texts)
    expected = components(1000, links)
    assert len(set(expected)) > 100  # many groups, and one large one
    docs = read(spark, tmp_path, documents=documents(texts)).select("doc_id", "text", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    sketched = docs.mapInArrow(near_dedup._sketch(5), "doc_id long, a long, b long, node long, fp long, keys array<long>, size long").withColumn("keys", F.array(F.lit(7).cast("long"))).cache()
    root = {r.node: r.root for r in near_dedup.like_components(docs, sketched, block=block).collect()}
    got = [root.get(r.node, r.node) for r in sketched.orderBy("doc_id").collect()]
    assert len(set(zip(got, expected, strict=True))) == len(set(got)) == len(set(expected))


def test_near_dedup_of_a_loose_family_finds_its_links(spark, tmp_path):
    texts = loose_family(600, 32) + loose_family(300, 33)
    expected = components(900, like_pairs(texts))
    docs = read(spark, tmp_path, documents=documents(texts))
    kept = [{r.doc_id for r in near_dedup.near_dedup(docs, block=block).collect()} for block in (256, 32)]
    assert kept[0] == kept[1]
    assert set(expected) <= kept[0] and len(kept[0] - set(expected)) <= 0.02 * len(set(expected))


def test_units_that_arrive_in_pieces_are_compared_whole():
    rng = np.random.default_rng(17)
    rows = []
    for unit in range(40):
        base = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
        for n in range(int(rng.integers(1, 9))):
            own = np.unique(np.concatenate((base[: 60 - n], rng.integers(0, 1 << 32, n, dtype=np.uint32))))
            rows.append((unit // 4, unit % 2, unit // 2 % 2, 1000 * unit + n, 1000 * unit + n, 0, 0, own.tobytes()))
    names = ["key", "block", "chunk", "node", "root", "rest", "fp", "shingles"]
    whole = pa.table([pa.array(c, pa.binary() if n == 7 else pa.int64()) for n, c in enumerate(zip(*rows, strict=True))], names=names)
    run = blocks.unit_links(near_dedup.like_links(0.8))
    links = [sorted(p for b in run(iter(whole.to_batches(max_chunksize=size))) for p in zip(*b.to_pydict().values(), strict=True)) for size in (1000, 7, 1)]
    assert links[0] == links[1] == links[2]
    assert len(links[0]) == len(rows) - 40 or len(links[0]) > 100


def test_near_dedup_of_awkward_and_no_documents(spark, tmp_path):
    docs = read(spark, tmp_path, documents=clashing(awkward()))
    kept = [r.text for r in near_dedup.near_dedup(docs).collect()]
    assert sum(1 for t in kept if not words(t)) == 1
    assert len({tuple(words(t)) for t in kept}) == len(kept) <= len({tuple(words(r.text)) for r in docs.collect()})
    assert near_dedup.near_dedup(docs.where("false")).count() == 0


# decontamination


def least_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def searched(item, text):
    """Least distance of a normalised item to a text, as whole words if it is short."""
    text = decontaminate.normalise(text or "")
    return least_distance(item, text) if len(item) >= 24 else least_distance(f" {item} ", f" {text} ")


def test_myers_equals_dynamic_programming():
    rng = np.random.default_rng(2)
    for _ in range(300):
        p, t = ("".join(rng.choice(list("ab "), rng.integers(1, n))) for n in (9, 16))
        assert min(decontaminate.myers(p, t, 99)[0], len(p)) == least_distance(p, t)


@pytest.mark.parametrize("block_chars", [4_000_000, 200])
def test_leaks_equal_brute_force(spark, tmp_path, block_chars):
    rng = np.random.default_rng(4)
    items = [prose(500 + i, 25) for i in range(8)] + [None, "", "tiny", prose(500, 25)]
    texts = [prose(i, 60) for i in range(10)]
    for i in range(16):
        item = list(items[i % 8])
        for at in rng.choice(len(item), i, replace=False):
            item[at] = "q"
        texts.append(prose(i, 20) + " " + "".join(item) + " " + prose(i + 40, 20))
    texts += [None, "", items[0].upper().replace(" ", ",\n"), items[1]]
    docs = read(spark, tmp_path, documents=clashing(documents(texts)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = []
    for i, t in enumerate(texts):
        for n, item in enumerate(items):
            p = decontaminate.normalise(item or "")
            if p and (far := searched(p, t)) <= decontaminate.budget(len(p)):
                expected.append((i, n, far))
    got = sorted(tuple(r) for r in decontaminate.leaks(docs, bench, block_chars=block_chars).collect())
    assert got == sorted(expected)
    clean = decontaminate.decontaminate(docs, bench, block_chars=block_chars)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(texts))) - {e[0] for e in expected})
    assert decontaminate.leaks(docs.where("false"), bench).count() == decontaminate.leaks(docs, bench.where("false")).count() == 0


def test_leaks_of_named_items_in_awkward_documents(spark, tmp_path):
    docs = awkward()
    long = docs["text"][7].as_py()
    bench = spark.createDataFrame([("first", long[1000:1200]), (None, long[-90:]), ("again", long[1000:1200]), ("none", prose(9999, 40))], "item_id string, text string")
    found = [sorted((str(r.doc_id), str(r.item_id), r.distance) for r in decontaminate.leaks(read(spark, tmp_path, documents=clashing(docs)), bench, block_chars=n).collect()) for n in (10**6, 100)]
    expected = sorted((str(docs["doc_id"][i].as_py()), item, 0) for i in range(docs.num_rows) if (docs["text"][i].as_py() or "").startswith(long) for item in ("first", "None", "again"))
    assert found[0] == found[1] == expected and len(expected) == 6


def test_discarded_windows_hold_no_item():
    rng = np.random.default_rng(15)
    for trial in range(300):
        item = prose(trial, 60)[: int(rng.integers(4, 200))].strip()
        spoiled = list(item)
        for _ in range(decontaminate.budget(len(item))):
            at = int(rng.integers(0, len(spoiled)))
            kind = int(rng.integers(0, 3))
            spoiled[at : at + 1] = [["q"], [], [spoiled[at], "q"]][kind]
        text = "z" * int(rng.integers(0, 9)) + "".join(spoiled) + "z" * int(rng.integers(0, 9))
        far = searched(item, text)  # what is around it may cost a short one the blanks at its ends
        assert decontaminate.Matcher([(7, item)]).matches(text) == ([(7, far)] if far <= decontaminate.budget(len(item)) else [])
        assert far <= decontaminate.budget(len(item)) or len(item) < 24


def test_a_tenth_of_an_item_may_be_edited_and_short_items_count(spark, tmp_path):
    items = [prose(700 + i, 200)[:m].strip() for i, m in enumerate((25, 29, 30, 80, 150, 224, 384, 10, 15, 20, 22, 23))]
    items += ["Blue, Moon", "x"]
    texts, expected = [], []
    for n, item in enumerate(items[:12]):
        for edits in (len(item) // 10, len(item) // 10 + 1):
            spoiled = list(item)
            for i in range(edits):  # evenly spread, so that pieces as long as an edit allows stay whole
                at = (2 * i + 1) * len(item) // (2 * edits)
                spoiled[at] = "9"
            texts.append(prose(40 + n, 30) + " " + "".join(spoiled) + " " + prose(50 + n, 30))
    texts += ["a blue moon rose", "a blue moonrise", "Blue\nMOON", "X"]
    for i, t in enumerate(texts):
        for n, item in enumerate(map(decontaminate.normalise, items)):
            far = searched(item, t)
            if far <= len(item) // 10:
                expected.append((i, n, far))
    docs = read(spark, tmp_path, documents=documents(texts))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {e[0] for e in expected} >= {*range(0, 24, 2), 24, 26, 27}
    assert sorted(tuple(r) for r in decontaminate.leaks(docs, bench).collect()) == sorted(expected)


# line dedup


def test_line_dedup_returns_the_kept_text(spark, tmp_path):
    docs = read(spark, tmp_path, documents=clashing(awkward()))
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[14].kept_text == prose(10, 40) and (got[14].n_lines, got[14].n_dropped) == (3, 2)
    assert got[0].kept_text == "" and got[0].n_lines == 1
    assert line_dedup.line_dedup(docs, min_docs=10**6).agg(F.sum("n_dropped")).first()[0] == 0


def test_line_dedup_without_broadcast_is_the_same(spark, tmp_path, monkeypatch):
    docs = read(spark, tmp_path, documents=awkward())
    before = rows_of(line_dedup.line_dedup(docs))
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", -1)
    assert rows_of(line_dedup.line_dedup(docs)) == before


# mixing


def test_mix_meets_its_targets_and_reruns_agree(spark, tmp_path):
    texts = [prose(i, 5 + i * 7 % 90) for i in range(300)] + [None, ""]
    docs = read(spark, tmp_path, documents=documents(texts, sources=[None if i % 50 == 0 else ("a", "b", "b", "b", "c", "b")[i % 6] for i in range(302)]))
    first, second = mixing.mix(mixing.sizes(docs)), mixing.mix(mixing.sizes(docs))
    assert rows_of(first) == rows_of(second)
    per = first.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"))
    rows = per.collect()
    assert all(abs(r.taken - r.target) <= 1 and r.over <= 0 and r.target <= 3 * r["size"] for r in rows)
    assert abs(sum(r.target for r in rows) - sum(r["size"] for r in rows)) < 1e-6


def test_water_filling_equals_its_iteration(spark):
    rng = np.random.default_rng(8)
    for _ in range(3):
        sizes, weights = [int(x) for x in rng.integers(0, 1000, 6)], [int(x) for x in rng.integers(1, 4, 6)]
        caps, left, fixed = [3 * s for s in sizes], float(sum(sizes)), {}
        while True:
            free = [i for i in range(6) if i not in fixed]
            level = left / sum(weights[i] for i in free) if free else 0
            over = [i for i in free if level * weights[i] > caps[i]]
            if not over:
                break
            for i in over:
                fixed[i] = caps[i]
                left -= caps[i]
        expected = {f"s{i}": fixed.get(i, level * weights[i]) for i in range(6)}
        df = spark.createDataFrame([(f"s{i}", weights[i], sizes[i]) for i in range(6)], "source string, weight int, size long")
        got = {r.source: r.target for r in mixing.water_fill(df, 3).collect()}
        assert got == pytest.approx(expected)


# quality


def test_quality_ranks_held_out_rows_and_survives_awkward_ones(spark, tmp_path):
    junk = [" ".join(w.upper() + "!!" for w in prose(i, 30).split()) for i in range(60)]
    texts = [*awkward()["text"].to_pylist(), *junk, *[prose(900 + i, 30 + i) + "." for i in range(120)]]
    n = len(texts) - 180
    labels = pa.table({"doc_id": pa.array(range(n, n + 180), pa.int64()), "quality": pa.array([0] * 60 + [1] * 119 + [None], pa.int32()), "toxic": pa.array([0] * 180, pa.int32())})
    folder = written(tmp_path, documents=clashing(documents(texts)), labels=labels)
    got = {r.doc_id: r for r in quality.query(spark, folder).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[n + i].predicted == (i >= 60) for i in range(180) if got[n + i].held_out)
    kept = quality.quality_filter(table(spark, folder, "documents"), table(spark, folder, "labels"))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    none = quality.fit(quality.measured(table(spark, folder, "documents")), quality.training_labels(table(spark, folder, "labels").where("false")))
    assert none.score(np.zeros((2, quality.WIDTH))).tolist() == [0.5, 0.5]


def test_quality_fit_equals_its_definition(spark, tmp_path):
    texts = [prose(i, 20 + i) + ("." if i % 3 else "!! #") for i in range(90)]
    labels = pa.table({"doc_id": pa.array([*range(90), 5], pa.int64()), "quality": pa.array([int(i % 3 > 0) for i in range(90)] + [0], pa.int32())})
    folder = written(tmp_path, documents=documents(texts), labels=labels)
    known = [(r.of, r.label) for r in quality.training_labels(table(spark, folder, "labels")).collect()]
    outside = spark.range(90).select("id", quality.held_out(F.col("id")).alias("out")).collect()
    assert sorted(known) == sorted((i, y) for i, y in zip(labels["doc_id"].to_pylist(), labels["quality"].to_pylist(), strict=True) if i in {r.id for r in outside if not r.out})
    model = quality.fit(quality.measured(table(spark, folder, "documents")), quality.training_labels(table(spark, folder, "labels")))
    stats = [np.array([quality.statistics(texts[i].encode()) for i, y in known if y == c]) for c in (0, 1)]
    covs = [np.cov(x.T, bias=True) for x in stats]
    pooled = sum(len(x) * c for x, c in zip(stats, covs, strict=True)) / len(known)
    pooled = (1 - quality.SHRINK_DIAGONAL) * pooled + quality.SHRINK_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(quality.WIDTH)
    for c in (0, 1):
        sigma = (1 - quality.SHRINK_CLASS) * covs[c] + quality.SHRINK_CLASS * pooled
        assert model.means[c] == pytest.approx(stats[c].mean(0))
        assert np.linalg.inv(model.factors[c].T @ model.factors[c]) == pytest.approx(sigma, abs=1e-9) and model.logdets[c] == pytest.approx(np.linalg.slogdet(sigma)[1])
    assert model.odds == pytest.approx(np.log(len(stats[1]) / len(stats[0])))
    assert quality.training_labels(table(spark, folder, "labels"), fit_rows=7).count() == 7


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_quality_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    scores = quality.query(spark, folder).where("held_out").join(table(spark, folder, "labels"), "doc_id").collect()
    assert len(scores) > 50
    assert sum(r.predicted == r.quality for r in scores) >= 0.97 * len(scores)


def test_quality_of_no_documents(spark, tmp_path):
    labels = pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32())})
    assert quality.query(spark, written(tmp_path, documents=DOCUMENTS.empty_table(), labels=labels)).count() == 0


def test_cholesky_scores_equal_gaussian_densities(spark):
    rng = np.random.default_rng(6)
    root = rng.normal(size=(2, quality.WIDTH, quality.WIDTH))
    covs = [r @ r.T + np.eye(quality.WIDTH) for r in root]
    means = rng.normal(size=(2, quality.WIDTH))
    low = [np.linalg.cholesky(c) for c in covs]
    model = quality.Model(means, np.array([np.linalg.inv(x) for x in low]), np.array([np.linalg.slogdet(c)[1] for c in covs]), 0.5)
    x = rng.normal(size=(9, quality.WIDTH))
    d = [-0.5 * (np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) + np.linalg.slogdet(c)[1]) for m, c in zip(means, covs, strict=True)]
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-(d[1] - d[0] + 0.5) / quality.TEMPERATURE)))


# substring dedup


def test_chains_are_the_best_of_all(spark):
    rng = np.random.default_rng(9)

    def worth(chain):
        k, c, total = substring_dedup.WORTH, substring_dedup.GAP_COST, float(substring_dedup.WORTH)
        for (a, b), (x, y) in zip(chain, chain[1:], strict=False):
            total += k - c * (x - a + y - b)
        return total

    for _ in range(40):
        met = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (9, 2))})
        best = 0.0
        for bits in range(1, 1 << len(met)):
            chain = [m for i, m in enumerate(met) if bits >> i & 1]
            if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(chain, chain[1:], strict=False)):
                best = max(best, worth(chain))
        found = substring_dedup.chains(met, min_span=0)
        if found:
            assert worth(found[0]) == pytest.approx(best)


def test_passages_are_found_and_clean_documents_left(spark, tmp_path):
    unique = lambda i, n: " ".join(f"{w}{i}" for w in prose(i, n).split())
    passage, fuzzy = prose(70, 60), prose(71, 80).split()
    copy = list(fuzzy)
    copy[20], copy[45] = "changed", "altered"
    texts = [unique(1, 200), unique(2, 50) + " " + passage + " " + unique(3, 50), passage.upper() + "\n" + unique(4, 30), unique(5, 9) + " " + " ".join(fuzzy), " ".join(copy) + " " + unique(6, 9), None, "", "word", *[unique(7, 90)] * 2, prose(72, 40) + " " + unique(8, 40), prose(72, 40)]
    docs = read(spark, tmp_path, documents=clashing(documents(texts)))
    got = substring_dedup.shared_passages(docs).collect()
    pairs = {tuple(sorted((r.doc_id, r.other_id))): r for r in got}
    assert set(pairs) == {(1, 2), (3, 4), (8, 9)}
    assert {(r.start, r.end) if r.doc_id == 1 else (r.other_start, r.other_end) for r in [pairs[1, 2]]} == {(50, 110)}
    assert pairs[3, 4].edits == 2 and pairs[8, 9].edits == 0
    assert substring_dedup.shared_passages(docs.where("false")).count() == 0


def test_passages_on_both_sides_of_a_gap_are_found(spark, tmp_path):
    unique = lambda i, n: [f"{w}{i}.{j}" for j, w in enumerate(prose(i, n).split())]
    texts, planted = [], []
    for n, (gap, size) in enumerate((g, s) for g in (20, 40, 100, 200, 600) for s in (60, 200)):
        one, two = unique(10 * n + 1, size), unique(10 * n + 2, size)
        texts += [" ".join(unique(1000 + 10 * n + d, 30) + one + unique(2000 + 10 * n + d, gap) + two + unique(3000 + 10 * n + d, 30)) for d in (1, 2)]
        planted += [(2 * n, range(30, 30 + size)), (2 * n, range(30 + size + gap, 30 + 2 * size + gap))]
    docs = read(spark, tmp_path, documents=documents(texts))
    got = [(min(r.doc_id, r.other_id), r) for r in substring_dedup.shared_passages(docs).collect()]
    lost = [(n, p) for n, p in planted if not any(n == d and r.start <= p[0] and p[-1] < r.end for d, r in got)]
    assert not lost
    assert all(r.edits <= 0.2 * (r.end - r.start) and r.start == r.other_start and r.end == r.other_end for _, r in got)


def test_every_repeated_run_in_mosaics_of_frequent_phrases_is_found(spark, tmp_path):
    rng = np.random.default_rng(21)
    phrases = [[f"{w}{i}.{j}" for j, w in enumerate(prose(i, 15).split())] for i in range(12)]
    filler = lambda i, n: [f"{w}f{i}.{j}" for j, w in enumerate(prose(i, n).split())]
    texts, at = [], 0
    for d in range(60):
        words = filler(1000 + d, 20)
        for _ in range(6):
            at = int(rng.integers(0, 12)) if d % 3 else (at + 1) % 12  # loose phrases, or some in the same order
            words = words + phrases[at] + ([] if d % 3 == 0 else filler(int(rng.integers(1e9)), 9))
        texts.append(" ".join(words))
    held = {}
    for d, text in enumerate(texts):
        w = text.split()
        for i in range(len(w) - 49):
            held.setdefault(tuple(w[i : i + 50]), set()).add((d, i))
    planted = {p for places in held.values() if len({d for d, _ in places}) > 1 for p in places}
    got = substring_dedup.shared_passages(read(spark, tmp_path, documents=documents(texts))).collect()
    spans = [(r.doc_id, r.start, r.end) for r in got] + [(r.other_id, r.other_start, r.other_end) for r in got]
    assert len(planted) > 100
    assert not [p for p in planted if not any(d == p[0] and s <= p[1] and p[1] + 50 <= e for d, s, e in spans)]

def test_predecessors_equal_their_definition():
    rng = np.random.default_rng(12)
    for rising in (True, False) * 60:
        n = int(rng.integers(1, 14))
        left = sorted(set(zip(np.cumsum(rng.integers(1, 40, n)).tolist(), (np.cumsum(rng.integers(1, 40, n)) if rising else rng.integers(0, 90, n)).tolist(), strict=True)))
        score, before = substring_dedup.predecessors(left, 8, 0.15)
        best = []
        for a, b in left:
            best.append(max([8.0, *(s + 8 - 0.15 * (a - x + b - y) for s, (x, y) in zip(best, left, strict=False) if x < a and y < b)]))
        assert score == pytest.approx(best) and all(j < 0 or left[j][0] < left[i][0] and left[j][1] < left[i][1] for i, j in enumerate(before))


def test_a_short_chain_hides_no_passage():
    dense = [(i, 1000 + i) for i in range(0, 16, 2)]
    sparse = [(100 + i, 300 + i) for i in (0, 12, 24, 31)]
    assert substring_dedup.chains(dense + sparse, min_span=28) == [sparse]
    assert sorted(substring_dedup.chains(dense + sparse)) == [dense, sparse]
    inside = [(500 + i, 2000 + i) for i in range(0, 60, 6)]
    around = [(300 + i, 100 + i) for i in range(0, 200, 5)] + [(570 + i, 370 + i) for i in range(0, 200, 5)]
    assert inside in substring_dedup.chains(around + inside)
    assert substring_dedup.chains([(5, 9)]) == [[(5, 9)]] and substring_dedup.chains([]) == []


def planted_pairs(rng, make, rate):
    """Texts with 40 pairs of passages of 60 to 100 words, in every second one that share of words replaced; and where they lie."""
    texts, places = [], []
    for n in range(40):
        one = make(int(rng.integers(60, 101)))
        other = list(one)
        for i in rng.choice(len(one), round(rate * len(one)), replace=False):
            other[i] = f"new{rng.integers(1 << 30)}"
        before = [make(int(rng.integers(20, 80))) for _ in range(2)]
        texts += [" ".join(before[0] + one + make(40)), " ".join(before[1] + other + make(40))]
        places.append([(2 * n + d, len(before[d]), len(before[d]) + len(one)) for d in (0, 1)])
    return texts, places


@pytest.mark.parametrize("kind", ["random words", "frequent phrases"])
@pytest.mark.parametrize("rate", [0.03, 0.06, 0.10, 0.15])
def test_passages_with_replaced_words_are_found(spark, tmp_path, kind, rate):
    rng = np.random.default_rng([int(100 * rate), len(kind)])
    phrases = [[f"p{i}x{j}" for j in range(12)] for i in range(15)]

    def make(n):
        if kind == "random words":
            return [f"w{i}" for i in rng.integers(0, 4000, n)]
        return [w for i in rng.integers(0, 15, n // 12 + 1) for w in phrases[i]][:n]

    texts, places = planted_pairs(rng, make, rate)
    covered = {}
    for r in substring_dedup.shared_passages(read(spark, tmp_path, documents=documents(texts))).collect():
        for d, s, e in ((r.doc_id, r.start, r.end), (r.other_id, r.other_start, r.other_end)):
            covered.setdefault(d, set()).update(range(s, e))
    found = sum(all(len(covered.get(d, set()) & set(range(s, e))) >= 0.8 * (e - s) for d, s, e in pair) for pair in places)
    assert found >= 36


def test_all_holders_of_a_passage_meet(spark, tmp_path):
    """Copies with edits of their own are all within the threshold of each other, and a holder of the seeds alone hides none of them."""
    rng = np.random.default_rng(33)
    make = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 30, n)]
    texts, wanted = [], set()
    for _ in range(5):
        base, first = make(70), len(texts)
        for _ in range(8):
            copy = list(base)
            for i in rng.choice(70, 4, replace=False):
                copy[i] = make(1)[0]
            texts.append(" ".join(make(30) + copy + make(30)))
        texts += [" ".join(make(30) + base[i : i + 14] + make(30)) for i in range(0, 56, 14)]  # short pieces are no passages
        wanted |= {(i, j) for j in range(first, first + 8) for i in range(first, j)}
    texts += [texts[0]] * 40  # copies of one text don't make its seeds frequent; they are reported with one of them
    got = {tuple(sorted((r.doc_id, r.other_id))) for r in substring_dedup.shared_passages(read(spark, tmp_path, documents=documents(texts))).collect()}
    assert got == wanted | {(0, i) for i in range(len(texts) - 40, len(texts))}


@pytest.mark.parametrize(("groups", "holders", "repeats"), [(5, 4, 4), (1, 60, 3)])
def test_every_place_of_a_passage_is_found(spark, tmp_path, groups, holders, repeats):
    """A text that holds its version of a passage several times shares each of them with the texts that hold other versions, be they few or many."""
    rng = np.random.default_rng(34)
    make = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 30, n)]
    texts, places = [], []
    for _ in range(groups):
        base = make(70)
        for _ in range(holders):
            version, words = list(base), []
            for i in rng.choice(70, 4, replace=False):
                version[i] = make(1)[0]
            for _ in range(repeats):
                words += make(30)
                places.append((len(texts), len(words), len(words) + 70))
                words += version
            texts.append(" ".join(words + make(30)))
    covered = {}
    for r in substring_dedup.shared_passages(read(spark, tmp_path, documents=documents(texts))).collect():
        for d, s, e in ((r.doc_id, r.start, r.end), (r.other_id, r.other_start, r.other_end)):
            covered.setdefault(d, set()).update(range(s, e))
    assert not [p for p in places if len(covered.get(p[0], set()) & set(range(*p[1:]))) < 0.8 * 70]


def test_a_chain_hides_no_other_place():
    one, other = [(i, i) for i in range(0, 60, 6)], [(i, 500 + i) for i in range(3, 57, 6)]
    for swapped in (False, True):
        met = [m[::-1] for m in one + other] if swapped else one + other
        assert sorted(substring_dedup.chains(met)) == sorted([met[: len(one)], met[len(one) :]])


def test_places_of_a_key_are_counted_and_periods_thinned():
    rng = np.random.default_rng(35)
    of, key = np.sort(rng.integers(0, 6, 300)), rng.integers(0, 40, 300)
    seen = {}
    want = [seen.setdefault((t, k), []).append(0) or min(len(seen[t, k]) - 1, substring_dedup.OFTEN) for t, k in zip(of.tolist(), key.tolist(), strict=True)]
    assert substring_dedup.nth(key, of).tolist() == want
    texts = [" ".join(["x"] * 300), " ".join(f"a b c d e f g{i % 2 + i // 20} h" for i in range(40)), " ".join(f"a b c d e f{i} g h" for i in range(9))]
    w, bounds = substring_dedup.word_hashes(pa.array(texts))
    seed, at, *_ = substring_dedup.winnowed(w, bounds, substring_dedup.K, substring_dedup.WINDOW)
    of = np.searchsorted(bounds, at, "right") - 1
    apart = substring_dedup.standing_apart(seed, at, of, bounds, w, 50)
    assert apart[of == 0].sum() == 13 and apart[of == 2].all()  # the first and the last place and 11 more, one every 25 words
    for n in np.flatnonzero(~apart):  # those dropped have alike words to either side, and one that stays within reach
        mine = np.flatnonzero((seed == seed[n]) & (of == of[n]))
        i = mine.tolist().index(n)
        before, here, after = at[mine[i - 1]], at[n], at[mine[i + 1]]
        assert here - before == after - here and w[before:here].tolist() == w[here:after].tolist() and np.abs(at[mine[apart[mine]]] - here).min() <= 25


def test_words_of_many_texts_at_once():
    texts = ["", " a b ", "Ab", "c", "aB\tab\x0bab\x1cx", None, "é É  " + "x" * 8 + " " + "x" * 9 + " " + "x" * 16, "x" * 17 + "\n", " ", "\x00 \x00\x00"]
    every, ends = [], [0]
    for t in texts:
        every += words(t)
        ends.append(len(every))
    for first in (0, 3):  # a slice of an array begins elsewhere in its buffers
        some = pa.array([t or "" for t in texts])[first:]
        hashes, bounds = substring_dedup.word_hashes(some)
        assert bounds.tolist() == [e - ends[first] for e in ends[first:]]
        mine = every[ends[first] :]
        assert len(hashes) == len(mine) and len(set(hashes.tolist())) == len(set(mine)) == len(set(zip(mine, hashes.tolist(), strict=True)))


def test_nothing_is_left_but_what_is_read_on(spark, tmp_path):
    """Chains, the words around them and the copies are read by the result; tables of the steps before are gone, and a passage is whole though its chains lie apart."""
    passage, other = prose(70, 400).split(), prose(70, 400).split()
    for i in range(100, 300, 3):
        other[i] = f"changed{i}"
    docs = read(spark, tmp_path, documents=documents([" ".join(passage), " ".join(other), *[prose(75, 90)] * 2]))
    since = len(substring_dedup.WRITTEN)
    found = substring_dedup.shared_passages(docs)
    assert len(substring_dedup.WRITTEN) - since == 3
    got = found.collect()
    assert {tuple(sorted((r.doc_id, r.other_id))) for r in got} == {(0, 1), (2, 3)}
    covered = {i for r in got for i in range(r.start, r.end) if {r.doc_id, r.other_id} == {0, 1}}
    assert covered >= {*range(100), *range(300, 400)}


def test_substring_dedup_of_awkward_documents(spark, tmp_path):
    docs = awkward()
    got = substring_dedup.query(spark, written(tmp_path, documents=clashing(docs))).collect()
    texts = {}
    for i, t in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
        texts.setdefault(i, set()).add(t or "")
    word = lambda t, a, b: t.encode().lower().split()[a:b]
    for r in got:  # what is reported is there, as alike as it says
        mine, theirs = ([t for t in texts[i] if len(t.split()) >= e] for i, e in ((r.doc_id, r.end), (r.other_id, r.other_end)))
        assert any(substring_dedup.edit_distance(word(a, r.start, r.end), word(b, r.other_start, r.other_end)) <= r.edits <= 0.2 * (r.end - r.start) for a in mine for b in theirs)
    pairs = {tuple(sorted((r.doc_id, r.other_id))) for r in got}
    linked = components(len(texts), [p for p in pairs if None not in p])
    assert len({linked[i] for i in (3, 4, 5, 6)}) == 1 and linked[7] == linked[8] != linked[3] and len(got) == len(set(got))


def test_word_edit_distance():
    rng = np.random.default_rng(10)
    for _ in range(200):
        a, b = (list(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(2))
        before = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            now = [i]
            for j, d in enumerate(b, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
            before = now
        assert substring_dedup.edit_distance(a, b) == before[-1]


# secrets


def test_weak_parts_need_their_complement(spark):
    far = "x " * 200
    texts = [
        "AKIA12345678 and token=abc", "AKIA12345678 alone", "token=abc alone", "https://a.example.org only", f"AKIA12345678 {far} token=abc",
        "AKIA12345678 token=abc https://a.example.org", f"login: bob {far}", None,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in secret_scan.secret_spans(docs).collect()}
    assert kinds[0] == ["weak_access", "weak_assign"] and kinds[5] == ["weak_access", "weak_assign", "endpoint"]
    assert all(not kinds[i] for i in (1, 2, 3, 4, 6, 7))


# URLs


def test_url_rules_and_method(spark, tmp_path):
    urls = [
        "https://www.example.net/en/1", "http://x.net", "http://x.net/", "http://NET/de/", "https://a.example.com/de/2", "https://b.org/fr/x?y", "https://b.org/FR/x", None, "no scheme", "",
        "ftp://badexample.net/en/", "http://h/p#://other/", "http://free-casino.example.com/en/1", "http://city-library.example.com/en/1", "http://" + "a" * 50_000 + ".org/" + "b" * 50_000,
    ]
    pages = pa.table({"page_id": pa.array([*range(len(urls)), None, 1, 1], pa.int64()), "url": [*urls, urls[0], urls[1], urls[1]], "host": ["clash"] * (len(urls) + 3), "score": [1.0] * (len(urls) + 3)})
    rows = url_filter.query(spark, written(tmp_path, pages=pages)).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(urls) + 3
    assert [got[i].rule for i in range(12)] == ["example.net/en/", None, "net/", "net/", "example.com/de/", "org/fr/", None, None, None, None, "net/", None]
    assert (got[0].verdict, got[2].verdict, got[4].verdict, got[5].verdict) == ("allow", "block", "block", "allow")
    assert (got[3].host, got[3].path, got[11].host, got[11].path) == ("net", "/de/", "h", "/p")
    assert (got[7].host, got[7].path, got[8].host) == ("", "", "")
    assert (got[12].verdict, got[13].verdict) == ("block", "allow")


def test_url_method_on_hosts_held_out(spark):
    hosts = url_filter.labelled_hosts()
    fold = [hosts[i] for i in range(len(hosts)) if i % 5 == 2]
    rest = [h for h in hosts if h not in fold]
    assert not {h for h, _ in fold} & {h for h, _ in rest}
    pages = spark.createDataFrame([(i, f"https://{h}.info/page/{i}") for i, (h, _) in enumerate(fold)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(pages, url_filter.labelled_urls(spark, rest), rules=()).collect()}
    right = [got[i] == ("allow", "block")[label] for i, (_, label) in enumerate(fold)]
    caught = [got[i] == "block" for i, (_, label) in enumerate(fold) if label]
    assert sum(right) >= 0.95 * len(right) and sum(caught) >= 0.9 * len(caught)


def test_url_query_of_no_pages(spark, tmp_path):
    pages = pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())})
    out = url_filter.query(spark, written(tmp_path, pages=pages))
    assert out.count() == 0 and {"page_id", "host", "path", "rule", "verdict"} <= set(out.columns)


def test_url_scores_equal_the_regression(spark):
    weights, intercept = url_filter.fit(url_filter.labelled_urls(spark))
    urls = ["http://cheap-casino.example.org/win", "https://museum.example.com/fr/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.score for r in url_filter.url_verdicts(df, url_filter.labelled_urls(spark)).collect()}
    for i, url in enumerate(urls):
        host, _, path = url.split("://")[1].partition("/")
        grams = [(part, f"^{text}$"[j : j + n]) for part, text in (("host", host), ("path", "/" + path)) for n in url_filter.NGRAMS for j in range(len(text) + 3 - n)]
        h = lambda part, g: xxhash.xxh64_intdigest(g.encode(), xxhash.xxh64_intdigest(part.encode(), 42))
        total = 0.0
        for part, g in grams:
            v = h(part, g)
            v = v - (1 << 64) if v >= 1 << 63 else v
            total += weights[v % url_filter.BUCKETS]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(intercept + total))))


# reply trees


def test_best_branch_of_a_reply_tree(spark):
    rows = [("r", None, 1.0, "user", "q"), ("a", "r", 1.0, "assistant", "<s>"), ("b", "r", 5.0, "assistant", "[INST]"), ("c", "b", 0.0, "user", "more"), ("d", "a", 0.5, "user", "less"), ("o", "gone", None, None, None), ("x", "y", 1.0, "user", "loop"), ("y", "x", 1.0, "user", "loop")]
    messages = spark.createDataFrame(rows, "node string, parent string, score double, role string, text string")
    out = chat_format.read_back(chat_format.formatted(chat_format.reply_paths(messages, branches=2), messages)).collect()
    paths = {(r.root, r["rank"]): [(t.role, t.text) for t in r.turns] for r in out}
    assert paths[("r", 1)] == [("user", "q"), ("assistant", "[INST]"), ("user", "more")]
    assert paths[("r", 2)] == [("user", "q"), ("assistant", "<s>"), ("user", "less")]
    assert paths[("o", 1)] == [("", "")] and len(paths) == 3
    assert {r.leaf: r.loss_text for r in out}["c"] == "[INST]"
    assert all("[INST]" not in r.formatted and "<s>" not in r.formatted for r in out)


def test_ranked_branches_equal_brute_force(spark):
    rng = np.random.default_rng(23)
    rows = []
    for t in range(30):
        size = int(rng.integers(1, 25))
        for i in range(size):
            parent = f"{t}.{rng.integers(max(0, i - 4), i):03d}" if i else None
            rows.append((f"{t}.{i:03d}", parent, float(rng.integers(0, 3)), "assistant" if i % 2 else "user", f"say {t} {i}"))
    by = {r[0]: r for r in rows}
    answered = {r[1] for r in rows}
    paths = {}
    for r in rows:
        if r[0] not in answered:
            path = [r]
            while path[0][1]:
                path.insert(0, by[path[0][1]])
            paths.setdefault(path[0][0], []).append((-sum(p[2] for p in path), -len(path), r[0], [p[4] for p in path]))
    assert max(-p[1] for ps in paths.values() for p in ps) > 6 and any(len({p[0] for p in ps}) < len(ps) for ps in paths.values())
    messages = spark.createDataFrame(rows, "node string, parent string, score double, role string, text string")
    for branches in (1, 3):
        out = chat_format.read_back(chat_format.formatted(chat_format.reply_paths(messages, branches), messages)).collect()
        got = sorted((r.root, r["rank"], r.leaf, [t.text for t in r.turns]) for r in out)
        assert got == sorted((root, n + 1, p[2], p[3]) for root, ps in paths.items() for n, p in enumerate(sorted(ps)[:branches]))
