"""Operators on pairs and on the corpus: near copies, repeats, packing, top-k, counts, the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import bpe, common, decontam, knn_join, near_dedup, packing, quality, queries, secrets, suffix_dedup, token_counts
from gridloom.llm.components import components
from tests.llm.conftest import words
from tests.oracle import connect, same


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1120)] + [(3, 3)]
    want = Union({x for e in edges for x in e})
    for e in edges:
        want.join(*e)
    frame = spark.createDataFrame([*edges, (None, 4)], "p long, q long").repartition(5)
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {x: want.root(x) for e in edges for x in e if e[0] != e[1]}
    assert components(frame.limit(0)).count() == 0


def sets_of(texts: dict, k: int) -> dict:
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, t in texts.items():
        w = (t or "").translate(low).encode().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def plain_groups(texts: dict, k: int, num: int, den: int) -> tuple[dict, dict]:
    sets = sets_of(texts, k)
    groups, ids = Union(texts), sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if i * den >= num * (len(sets[a]) + len(sets[b]) - i):
                    groups.join(a, b)
    return {i: groups.root(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def cluster(rng: random.Random, n: int, size: int, edits: int) -> list[str]:
    base = words(rng, size, 5000).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,threshold", [(3, 0.85), (5, 0.8)])
def test_near_duplicates(spark, odd_texts, odd_docs, no_docs, repeated_docs, monkeypatch, k, threshold):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # so that clusters are compared in several blocks
    rng = random.Random(11)
    texts = dict(odd_texts)
    for n, edits in ((60, 14), (30, 6), (25, 22)):
        texts |= {len(texts) + i: t for i, t in enumerate(cluster(rng, n, 150, edits))}
    rows = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, node string").repartition(4)
    want, size = plain_groups(texts, k, round(threshold * 100), 100)
    got = {r.doc_id: r for r in near_dedup.duplicates(rows, k, threshold).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == size
    assert all(r.kept == (r.component_id == r.doc_id) for r in got.values())
    kept = near_dedup.keep_first(rows, k, threshold)
    assert kept.schema == rows.schema and {r.doc_id for r in kept.collect()} == set(want.values())
    if k == 3:
        assert near_dedup.duplicates(no_docs, k, threshold).count() == 0
        assert near_dedup.duplicates(repeated_docs, k, threshold).count() == 8


def test_hot_buckets_and_hubs(spark, monkeypatch):
    """Thousands of near copies in the same buckets, and texts that share a boilerplate and are not alike, with all limits of pieces low."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    rng = random.Random(21)
    base, boiler = words(rng, 120, 5000), words(rng, 90, 5000)
    texts = [base + f" {i % 40}" for i in range(2500)]
    texts += [f"{boiler} {words(rng, 45, 10**6)}" for _ in range(150)]
    texts += [f"{boiler} {t} {words(rng, 4, 10**6)}" for t in (words(rng, 40, 10**6) for _ in range(40)) for _ in range(2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    # classes of equal texts stand for all, so that brute force has few to compare
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    want, _ = plain_groups({i: t for t, i in first.items()}, 5, 80, 100)
    got = {r.doc_id: r.component_id for r in near_dedup.duplicates(rows).collect()}
    assert got == {i: want[first[t]] for i, t in enumerate(texts)}
    assert len(set(got.values())) < 250


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    many = spark.createDataFrame([(k, v) for k, n in ((1, 500), (2, 3), (3, 25)) for v in range(n)], "k long, v long").repartition(3)
    one = spark.createDataFrame([(1, "a"), (3, "c"), (4, "d")], "k long, name string")
    got = common.salted_join(many, one, "k", "v", many.groupBy("k").agg(F.count("*").alias("n")), 528)
    assert sorted((r.k, r.v, r.name) for r in got.collect()) == sorted([(1, v, "a") for v in range(500)] + [(3, v, "c") for v in range(25)])


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(5)
    a, b, c = (words(rng, 80, 5000) for _ in range(3))
    rows = [(*r, 5, 6) for r in ((1, a), (1, a), (4, a), (None, b), (None, b), (None, c), (9, c), (9, c), (7, ""), (None, ""))]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone long, __ROW_key long").repartition(3)
    assert near_dedup.keep_first(df).columns == df.columns and near_dedup.keep_first(df.limit(0)).count() == 0
    kept = near_dedup.keep_first(df).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(1, a), (0, b), (9, c), (7, ""), (0, "")])


def test_signatures_estimate():
    rng = random.Random(1)
    pool = [rng.getrandbits(64) for _ in range(4000)]
    for n in (1, 20, 300):
        errors = []
        for _ in range(60):
            a = rng.sample(pool, n)
            b = a[: int(n * 0.8)] + rng.sample(pool, n - int(n * 0.8))
            both = [np.array(sorted(set(x)), np.uint64) for x in (a, b)]
            sig = near_dedup.super_minhash(np.concatenate(both), np.array([0, len(both[0]), len(both[0]) + len(both[1])]), 100)
            errors.append((sig[0] == sig[1]).mean() - len(set(a) & set(b)) / len(set(a) | set(b)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


# --- repeats -----------------------------------------------------------------------------------------


def plain_repeats(texts: dict, length: int) -> dict:
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(hash(d[j : j + length]) for d in data.values() for j in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        mask = bytearray(len(d))
        for j in range(len(d) - length + 1):
            if seen[hash(d[j : j + length])] > 1:
                mask[j : j + length] = b"\1" * length
        spans = sum(1 for j in range(len(mask)) if mask[j] and (j == 0 or not mask[j - 1]))
        kept = bytes(x for x, m in zip(d, mask, strict=True) if not m)
        out[i] = (len(d), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("bucket_bytes", [suffix_dedup.BUCKET_BYTES, 800, 1])
def test_repeats(spark, odd_texts, no_docs, repeated_docs, bucket_bytes):
    rng = random.Random(4)
    texts = dict(odd_texts)
    quoted = words(rng, 70, 5000)
    for i in range(12):
        left = words(rng, 30, 5000) if i % 3 else "shared left context of these documents " * 2 + words(rng, i, 50)
        texts[100 + i] = left + " " + quoted + " " + words(rng, 30, 5000)
    rows = spark.createDataFrame([(i, t, "c", 1) for i, t in texts.items()], "doc_id long, text string, a string, row int").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_report(rows, bucket_bytes=bucket_bytes).collect()}
    want = plain_repeats(texts, 200)
    assert got == want
    assert sum(x[1] for x in want.values()) > 10000
    if bucket_bytes > 800:
        assert suffix_dedup.removal_report(no_docs).count() == 0
        twice = suffix_dedup.removal_report(repeated_docs).collect()
        assert len(twice) == 8 and all(r.n_removed == r.n_bytes for r in twice)


def test_interval_expansion():
    rng = random.Random(2)
    for _ in range(150):
        length = rng.choice([3, 8, 17, 20, 30])
        letters = rng.choice([b"ab", b"abc", "aé".encode(), bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(80))
        parts = []
        for _ in range(rng.randrange(1, 9)):
            cuts = [rng.randrange(80) for _ in range(rng.randrange(5))]
            parts.append(b"".join(base[i : i + rng.randrange(50)] for i in cuts))
        seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        want = [(k, i) for k, p in enumerate(parts) for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1]
        start, at = suffix_dedup.repeated_starts(parts, length)
        of = np.searchsorted(at, start, "right") - 1
        assert [(int(k), int(s - at[k])) for k, s in zip(of, start, strict=True)] == want


# --- packing -----------------------------------------------------------------------------------------


def test_packing(spark, odd_texts, odd_docs, no_docs, repeated_docs):
    got = packing.pack(odd_docs, group_bytes=60000).collect()
    made = bpe.tokenizer(bpe.default_path()).tokenizer
    ids = {i: [*made.encode(t or "", add_special_tokens=False).ids, 1] for i, t in odd_texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(odd_texts)
    for i, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            part = np.array(ids[i][at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids[i])
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(no_docs).count() == 0
    assert packing.pack(repeated_docs).groupBy().agg(F.sum("length")).first()[0] == sum(len(ids[i]) for i in (5, 5, 9, 9, 1, 1, 5, 1))


def test_first_fit_decreasing():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 300):
        sizes = rng.integers(1, 101, n)
        bins, offsets, count = packing.first_fit_decreasing(sizes, 100)
        room: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            spot = next((b for b, free in enumerate(room) if free >= sizes[i]), None)
            if spot is None:
                room.append(100)
                spot = len(room) - 1
            assert bins[i] == spot and offsets[i] == 100 - room[spot]
            room[spot] -= sizes[i]
        assert count == len(room)


# --- top-k -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_top_k(spark, spread, monkeypatch):
    monkeypatch.setattr(knn_join, "DATA_BLOCK", 40)
    monkeypatch.setattr(knn_join, "QUERY_BLOCK", 6)
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(6, 8))
    vectors = {i: (centers[i % 6] + spread * rng.normal(size=8)).tolist() for i in range(500)}
    for i in range(200, 330):
        vectors[i] = vectors[200]  # a third of all rows is one vector
    rows = [(i, v, 0) for i, v in vectors.items()]
    rows += [(1000, None, 0), (1001, [], 0), (1002, [1.0, None] + [0.0] * 6, 0), (1003, [float("nan")] * 8, 0), (1050, [float("inf")] * 8, 0), (None, [9.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(5)
    got = defaultdict(list)
    for r in knn_join.top_k(df, F.col("vec_id") % 10 == 0, pivots=12).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    q = np.floor(np.array([vectors[i] for i in range(500)]) * 256).astype(np.int64)
    for i in range(0, 500, 10):
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(500) if j != i)[:5]
        assert sorted(got[i]) == [(n + 1, j, -x) for n, (x, j) in enumerate(best)]
    assert len(got) == 50


def test_bounds_spare_cells(spark):
    """Well apart clusters: queries need few cells, every other pair of query and cell is spared."""
    rng = np.random.default_rng(3)
    centers = 4 * rng.normal(size=(40, 16))
    rows = [(i, (centers[i % 40] + 0.05 * rng.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, queries, cells, _ = knn_join.needed_cells(df, F.col("vec_id") % 50 == 0, pivots=120)
    n, needed = queries.agg(F.count("*"), F.sum(F.size("needs"))).first()
    assert n == 60 and needed < 0.1 * n * len(cells)
    got = {(r.query_id, r["rank"]): r.vec_id for r in knn_join.top_k(df, F.col("vec_id") % 50 == 0, pivots=120).collect()}
    v = np.floor(256 * np.array([x for _, x in rows]))
    for i in range(0, 3000, 50):
        best = sorted((-int(s), j) for j, s in enumerate(v @ v[i]) if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [j for _, j in best]


def test_top_k_of_any_finite_components(spark):
    rng = np.random.default_rng(12)
    vectors = {i: rng.normal(size=4).tolist() for i in range(100)}
    vectors |= {3: [1e15, 2.0, 0.0, 1.0], 50: [3e10, -1e9, 0.5, 0.0], 7: [1e300, -1e300, 0.0, 0.0], 8: [-1.7e308, 0.0, 0.0, 0.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in knn_join.top_k(df, F.col("vec_id") % 10 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(Fraction(x) * 256 // 1) for x in v] for i, v in vectors.items()}
    for i in range(0, 100, 10):
        score = {j: min(max(sum(a * b for a, b in zip(whole[i], w, strict=True)), -(2**63)), 2**63 - 1) for j, w in whole.items() if j != i}
        best = sorted(score.items(), key=lambda e: (-e[1], e[0]))[:5]
        assert sorted(got[i]) == [(n + 1, j, s) for n, (j, s) in enumerate(best)]


def test_top_k_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0]), (3, [0.5, -1.0]), (3, [0.5, -1.0])], schema)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn_join.top_k(few, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 50, 65536), (0, 2, 3, -98304), (50, 1, 0, 65536), (50, 2, 3, 32768)]
    assert knn_join.top_k(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert knn_join.top_k(few.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


# --- counts ------------------------------------------------------------------------------------------


CHANGES = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def test_rollups_are_additive_and_idempotent(spark, tmp_path):
    changes = spark.createDataFrame([("insert", "s", "en", "v", 10, None), ("insert", "s", None, "v", 4, None)], CHANGES)
    store, other = (token_counts.RollupStore(spark, f"file://{tmp_path}/rollup") for _ in range(2))
    total = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert total() == {}
    assert store.commit("a", changes) and not store.commit("a", changes)
    assert total() == {("s", "en"): (1, 10), ("s", None): (1, 4)}
    assert store.commit("b", spark.createDataFrame([("revise", "s", "en", "v", 7, 10), ("delete", "s", None, "v", 4, None)], changes.schema))
    assert total() == {("s", "en"): (1, 7)}
    # two drivers with one id: both see it free, one of them gets it
    other.committed = lambda batch_id: False
    assert store.commit("c", changes) and not other.commit("c", changes)
    assert total() == {("s", "en"): (2, 17), ("s", None): (1, 4)}
    # what an attempt leaves that was lost before its rename
    token_counts.deltas(changes).write.parquet(f"file://{tmp_path}/rollup/staging/lost")
    assert total() == {("s", "en"): (2, 17), ("s", None): (1, 4)}
    # tokens without a document are shown
    assert store.commit("d", spark.createDataFrame([("revise", "t", "en", "v", 7, 10)], changes.schema))
    assert total()["t", "en"] == (0, -3)


def test_compaction(spark, tmp_path):
    changes = spark.createDataFrame([("insert", "s", "en", "v", 10, None)], CHANGES)
    store = token_counts.RollupStore(spark, f"file://{tmp_path}/rollup")
    assert store.compact() and store.totals().count() == 0
    for n in range(1, 7):
        assert store.commit(f"b{n}", changes)
        if n % 2:
            assert store.compact()
        assert not store.commit("b1", changes)  # ids stay taken
        assert [(r.n_docs, r.n_tokens) for r in store.totals().collect()] == [(n, 10 * n)]
    last, held, new = store._state()
    assert last == 4 and len(held) == 5 and len(new) == 1
    kept = [f for n in held for f in store._names(f"batches/{n}") if f.endswith(".parquet")]
    assert 0 < len(kept) <= 4  # of the two batches since the snapshot before
    # another driver that made the same snapshot first
    state = store._state()
    assert store.compact()
    store._state = lambda: state
    assert not store.compact()


@pytest.mark.parametrize("row", [("update", 1, 1), (None, 1, 1), ("insert", None, 1), ("revise", 1, None)])
def test_unknown_changes_raise(spark, tmp_path, row):
    bad = spark.createDataFrame([(row[0], "s", "en", "v", row[1], row[2])], CHANGES)
    store = token_counts.RollupStore(spark, f"file://{tmp_path}/rollup")
    with pytest.raises(Exception, match="not a change with its counts"):
        store.commit("a", bad)
    assert store.totals().count() == 0 and not store.committed("a")


def test_counts(spark, odd_docs, odd_texts, no_docs, repeated_docs):
    path = bpe.default_path()
    got = {(r.doc_id, r.tokenizer): r.n_tokens for r in token_counts.counts(odd_docs, ("words-1", path)).collect()}
    made = bpe.tokenizer(path).tokenizer
    for i, t in odd_texts.items():
        assert got[i, "words-1"] == len((t or "").encode().split())
        assert got[i, "byte_bpe_50k"] == len(made.encode(t or "", add_special_tokens=False).ids)
    assert token_counts.maintained_counts(no_docs).count() == 0
    total = token_counts.maintained_counts(repeated_docs).where("tokenizer = 'words-1'").agg(F.sum("n_docs")).first()[0]
    assert total == 8


WORDS_SQL = r"""
WITH counted AS (
  SELECT source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w1,
         len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS w2
  FROM documents
)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs, CAST(sum(w1) AS BIGINT) AS n_tokens FROM counted GROUP BY source, lang
UNION ALL
SELECT source, lang, 'words-2', count(*), CAST(sum(w2) AS BIGINT) FROM counted GROUP BY source, lang
"""


def test_maintained_counts_of_all_documents(spark, sf_dir):
    """Word versions against SQL, the tokenizer's against the tokenizer itself."""
    rows = queries.op9_token_counts(spark, sf_dir)
    same(rows.where("tokenizer LIKE 'words%'"), WORDS_SQL, connect(sf_dir))
    made = bpe.tokenizer(bpe.default_path()).tokenizer
    docs = queries.table(spark, sf_dir, "documents").collect()
    want = defaultdict(lambda: [0, 0])
    for d, e in zip(docs, made.encode_batch([d.text or "" for d in docs], add_special_tokens=False), strict=True):
        want[d.source, d.lang][0] += 1
        want[d.source, d.lang][1] += len(e.ids)
    assert {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in rows.where("tokenizer = 'byte_bpe_50k'").collect()} == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], connect(sf_dir))


# --- pipeline ----------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    """Every stage against a brute-force version of it on what the stage before kept; the classifier has its own."""
    docs = queries.table(spark, sf_dir, "documents")
    bench = [r for r in queries.table(spark, sf_dir, "benchmark").collect() if r.text]
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, given):
        made = stages[name](spark, given, sf_dir)
        assert [(f.name, f.dataType) for f in made.schema] == [(f.name, f.dataType) for f in docs.schema], name
        return {r.doc_id: r for r in made.collect()}

    frame = lambda rows: spark.createDataFrame(list(rows.values()), docs.schema)
    before = {r.doc_id: r for r in docs.collect()}
    good = stage("quality", docs)
    score = {r.doc_id: r.predicted for r in quality.score_documents(docs, queries.table(spark, sf_dir, "labels")).collect()}
    assert good == {i: r for i, r in before.items() if score[i]}
    groups, _ = plain_groups({i: r.text for i, r in good.items()}, 5, 80, 100)
    first = stage("near_dedup", frame(good))
    assert first == {i: good[i] for i in set(groups.values())}
    word_list = lambda t: hash_words(re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    items = [w for w in (word_list(b.text) for b in bench) if len(w)]
    holds = lambda w: any(decontam.align(x, w)[0] <= int(0.2 * len(x) + 1e-9) for x in items)
    clean = stage("decontaminate", frame(first))
    assert clean == {i: r for i, r in first.items() if not holds(word_list(r.text))} and len(clean) < len(first)
    left = stage("secrets", frame(clean))
    spans = {r.doc_id: r.found for r in secrets.find_secrets(frame(clean)).collect()}

    def without(text, found):
        covered = [False] * len(text)
        for x in found:
            covered[x.start : x.end] = [True] * (x.end - x.start)
        marks = [c for c, hid in zip(text, covered, strict=True) if not hid]
        return "".join(marks), any(covered)

    for i, r in left.items():
        want, some = without(clean[i].text or "", spans[i])
        assert (r.text or "").replace("[SECRET]", "") == want.replace("[SECRET]", "") and ("[SECRET]" in (r.text or "")) >= some
    assert set(left) == set(clean)
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id].append(r)
    assert set(got) == set(left)
    made = bpe.tokenizer(bpe.default_path()).tokenizer
    for i, pieces in got.items():
        ids = np.array([*made.encode(left[i].text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def hash_words(found: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) for w in found], np.uint64)


def test_pipeline_without_documents(spark, tmp_path, sf_dir):
    for name in ("labels", "benchmark"):
        queries.table(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    queries.table(spark, sf_dir, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
