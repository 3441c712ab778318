"""Operators with one result a row: personal data, secrets, quality, language model, contamination."""

from __future__ import annotations

import hashlib
import math
import resource
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontam, lm_scoring, pii, quality, secrets
from tests.llm.conftest import words


def luhn(digits: str) -> bool:
    return sum((d - 9 if (d := int(c) * (1 + i % 2)) > 9 else d) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_pii(text: str) -> list[tuple]:
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    out = []
    for order, (kind, rule) in enumerate(rules):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def plain_secrets(text: str) -> list[tuple]:
    rules = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.I | re.A),
        ("access", "AKIA[A-Z0-9]+", 0, 18, 0),
        ("hex", "[0-9a-f]+", 0, 16, 0),
    ]
    return sorted((m.start(), o, k, m.end()) for o, (k, rule, g, n, flags) in enumerate(rules) for m in re.finditer(rule, text, flags) if len(m[g]) >= n)


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def noise(parts: list[str], n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(n)]


PII_PARTS = ["a", "b.c", "@", "x.org", ".", "-", "_", "1", "23", "255", "256", "10.0.0.1", "4111111111111111", " ", "+1", "(743)", "555-3824", "é", "日", "\n", "\x01", "0", "%"]
SECRET_PARTS = ["password", "passwd", "SECRET", "token", "api_key", "APIKEY", ":", "=", " ", "'", '"', "a", "abc", "0123456789abcdef", "AKIA", "A9", "ABCDEFGHIJKLMNOP", "é", "-", "\n", ".", "ſecret"]


@pytest.mark.parametrize("report,plain,parts,kinds", [(pii.pii_report, plain_pii, PII_PARTS, pii.KINDS), (secrets.secrets_report, plain_secrets, SECRET_PARTS, secrets.BASE)])
def test_base_spans(spark, odd_texts, odd_docs, no_docs, repeated_docs, report, plain, parts, kinds):
    texts = dict(odd_texts) | {1000 + i: t for i, t in enumerate(noise(parts, 1500, 3))}
    more = spark.createDataFrame([(i, t) for i, t in texts.items() if i >= 1000], "doc_id long, text string")
    got = {r.doc_id: r for r in report(odd_docs.select("doc_id", "text").union(more)).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        want = plain(t or "")
        assert got[i].base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), (t, got[i].spans)
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(w[2] == k for w in want) for k in kinds]
        assert set(joined(want).split(",")) <= set(got[i].spans.split(","))
    assert report(odd_docs).count() == len(odd_texts)
    assert report(no_docs).count() == 0 and report(repeated_docs).count() == 8


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"something {i} please call {'+1 555 010 0' + str(1000 + i)} soon") for i in range(12)]
    rows += [(50, "you may call 555-0199-77 now"), (51, "in room 555-0199-77 now"), (52, "say call maybe now")]
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50].spans == "phone:13:24" and got[50].n_phone == 0
    assert got[51].spans == "" and got[52].spans == ""


def test_unseen_numbers_with_blanks_and_labels(spark):
    rows = [(i, f"something {i} please call {'+1 555 010 0' + str(1000 + i)} soon") for i in range(24)]
    rows += [(100 + i, f"at {i} Tel:+1 555 010 0{1000 + i} soon") for i in range(24)]
    rows += [(50, "you may call 020 7946 0958 now"), (51, "or call (310) 555-4510, then"), (52, "in room 020 7946 0958 now"), (53, "home Tel:555-0199-77 now"), (54, "home Tel:020 7946 0958 now")]
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].spans for i in range(50, 55)] == ["phone:13:26", "phone:8:22", "", "phone:9:20", "phone:9:22"]


def test_discovered_instances_give_new_patterns(spark):
    rows = [("phone", f"+1 555 010 {1000 + i}", ["1 call"]) for i in range(400)]
    rows += [(None, f"555-01{10 + i}-77", ["1 call", "1 ring"]) for i in range(40)]
    rows += [(None, f"555-02{10 + i}-77", ["1 ring", "1 dial"]) for i in range(6)]  # known from the second generation only
    rows += [(None, f"555-01{10 + i}-77", ["1 dial"]) for i in range(20)]
    rows += [(None, f"v{i}", ["1 call", "1 version"]) for i in range(8)]  # not plausible
    spans = spark.createDataFrame(rows, "kind string, value string, patterns array<string>").repartition(3)
    got = {r.pattern: r.found_kind for r in pii.confident_patterns(spans).collect()}
    assert got == {"1 call": "phone", "1 ring": "phone", "1 dial": "phone"}


def test_hidden_seeds_are_found_again(spark):
    """A fifth of all identifiers is hidden from the base patterns; contexts and shapes find most of them, and nothing else."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        local = f"{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}-{rng.randrange(10, 99)}"
        rows.append((i, f"{words(rng, 9)} {rng.choice(['Phone:', 'phone number is', 'please call', 'Telephone: home'])} +1 555 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} {words(rng, 5)}"))
        rows.append((1000 + i, f"{words(rng, 9)} write to u{rng.randrange(10**6)}@mail{i % 3}.example.com {words(rng, 5)} {rng.randrange(10**5)}"))
        rows.append((2000 + i, f"{words(rng, 9)}\nhost: the one at 10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)} {words(rng, 5)}"))
        rows.append((3000 + i, f"{words(rng, 9)} part {local} in room {rng.randrange(10**7, 10**8)} {words(rng, 5)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    flat = lambda df, c: {(r.doc_id, r.s.kind, r.s.start, r.s.end) for r in df.select("doc_id", F.explode(c).alias("s")).collect()}
    hide = lambda s: F.pmod(F.xxhash64(s["value"]), F.lit(5)) == 1
    every, part = flat(pii.find_pii(docs), "base"), pii.find_pii(docs, hide)
    shown, found = flat(part, "base"), flat(part, "found")
    hidden = every - shown
    assert len(hidden) > 120 and shown <= every and found <= every
    assert len(hidden & found) > 0.9 * len(hidden)


def test_scanner_additions_and_redaction(spark, odd_docs):
    key = "ghp_" + "a1B2" * 9 + " and -----BEGIN RSA PRIVATE KEY-----"
    docs = spark.createDataFrame([(1, key), (2, "é 0123456789abcdef0123 z"), (3, None), (4, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secrets_report(docs).collect()}
    assert got == {1: "github:0:40,pem:45:76", 2: "hex:2:22", 3: "", 4: ""}
    left = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    assert left == {1: "[SECRET] and [SECRET]", 2: "é [SECRET] z", 3: None, 4: "clean"}
    assert secrets.redact_secrets(odd_docs).schema == odd_docs.schema


def test_secrets_in_no_rows_and_long_texts(spark, no_docs, repeated_docs):
    assert secrets.redact_secrets(no_docs).schema == no_docs.schema and secrets.redact_secrets(no_docs).count() == 0
    assert secrets.redact_secrets(repeated_docs).count() == 8
    text = "é 0123456789abcdef0123 " * 5000
    (row,) = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(x.start, x.end) for x in row.found] == [(23 * i + 2, 23 * i + 22) for i in range(5000)]


def test_private_keys_go_with_their_bodies(spark):
    head, end, line = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "MIIEpAIBAAKCAQEA+/" * 3
    texts = [
        f"a {head}\n{line}\n{line}\nAb3/==\n{end} z",
        f"a {head}\r\nProc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-128-CBC,0A\r\n\r\n{line}\r\nAb3=\r\n{end}\n{head}\n{line}\n{end} z",
        f"a {head}\n{line}\n{line}\nAb3=\nand more words",
        f'a "{head}\\n{line}\\n{end}\\n" z',
        f"é {head} {line} {line} {end} z",
        f"a {head}\nonly words follow here",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    want = ["a [SECRET] z", "a [SECRET]\n[SECRET] z", "a [SECRET]\nand more words", 'a "[SECRET]\\n" z', "é [SECRET] z", "a [SECRET]\nonly words follow here"]
    assert [left[i] for i in range(6)] == want
    spans = {r.doc_id: r.spans for r in secrets.secrets_report(docs).collect()}
    assert spans[4] == f"pem:2:{len(texts[4]) - 2}"


def test_automaton_is_minimal_and_deterministic():
    made = secrets.compile_rules([secrets._Parser("a(b|c)*d").parse()], False)
    assert len(made.masks) == 4  # start, middle, end, sink


# --- quality -----------------------------------------------------------------------------------------


def test_quality_learns(spark, no_docs, odd_docs, odd_texts):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + "."))
        labels.append((i, int(not bad), 0, "clash"))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, "a b")], "doc_id long, text string")
    truth = spark.createDataFrame(labels + [(1, None, 0, ""), (None, 1, 0, "")], "doc_id long, quality int, toxic int, text string")
    got = quality.score_documents(docs, truth).collect()
    assert len(got) == 503
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 500:
            assert r.predicted == int(r.doc_id % 4 != 0)
    assert quality.score_documents(no_docs, truth).count() == 0
    unlabelled = quality.score_documents(odd_docs, truth.where("doc_id < 0"))
    assert {r.score for r in unlabelled.collect()} == {0.5}
    kept = quality.keep_good(docs, truth)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(500) if i % 4}
    assert not {r.doc_id for r in kept.collect()} & {i for i in range(0, 500, 4)}
    assert quality.score_documents(odd_docs, truth).count() == len(odd_texts)


def test_fit_equals_direct_solution(spark, repeated_docs):
    """The distributed fit against one matrix of all rows, and out-of-fold scores calibrated by the min-max formula."""
    rng = np.random.default_rng(4)
    f = rng.normal(size=(240, quality.N_FEATURES)).astype(np.float32)
    y = (f[:, 0] + 0.5 * rng.normal(size=240) > 0).astype(float)
    rows = spark.createDataFrame([(i, f[i].tolist(), float(y[i])) for i in range(240)], "doc_id long, f array<float>, y double").repartition(5)
    model = quality.fit(rows, n_random=20)
    fold = np.array([r.k for r in rows.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(quality.FOLDS)).alias("k")).orderBy("doc_id").collect()])
    x = f.astype(np.float64)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    z = model.expand(x)
    ridge = np.diag(np.append(np.ones(z.shape[1] - 1), 1e-6))
    solve = lambda on: np.linalg.solve(z[on].T @ z[on] + ridge, z[on].T @ y[on])
    assert np.allclose(model.beta, solve(np.ones(240, bool)), atol=1e-8)
    raw = np.array([z[i] @ solve(fold != fold[i]) for i in range(240)])
    at = np.clip((raw - quality._LOW) / (quality._HIGH - quality._LOW) * quality.CALIBRATION_BINS, 0, quality.CALIBRATION_BINS - 1).astype(int)
    bins = np.unique(at)
    n, good = np.array([(at == b).sum() for b in bins]), np.array([y[at == b].sum() for b in bins])
    centre = quality._LOW + (bins + 0.5) * (quality._HIGH - quality._LOW) / quality.CALIBRATION_BINS
    fit = [max(min(good[j : k + 1].sum() / n[j : k + 1].sum() for k in range(i, len(bins))) for j in range(i + 1)) for i in range(len(bins))]
    assert np.allclose(model.calibrated(centre), fit)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality.score_documents(docs, labels).where("held_out").join(labels, "doc_id").where("quality is not null")
    right = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert right[1] > 50 and right[0] > 0.93


def test_quality_of_repeated_and_no_rows(spark, no_docs, repeated_docs):
    labels = spark.createDataFrame([(5, 1), (9, 0), (9, 1), (1, 0)], "doc_id long, quality int")
    rows = quality.score_documents(repeated_docs, labels).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    assert quality.keep_good(repeated_docs, labels, threshold=0.0).count() == 8
    for table in (labels, labels.limit(0)):
        kept = quality.keep_good(no_docs, table)
        assert kept.schema == no_docs.schema and kept.count() == 0
    # clashing names, and more labels than a fit takes
    clash = spark.createDataFrame([(i, "some text " * (i % 7 + 1), i, i, i) for i in range(300)], "doc_id long, text string, y long, f long, id long")
    many = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    assert quality.score_documents(clash, many, max_train=50).count() == 300
    assert quality.keep_good(clash, many, threshold=0.0, max_train=50).count() == 300
    assert 10 < quality.training_labels(many, "quality", 5, 50).count() < 90


def test_isotonic():
    rng = np.random.default_rng(1)
    x, y, w = np.arange(40.0), rng.random(40), rng.integers(1, 5, 40).astype(float)
    knots, values = quality.isotonic(x, y, w)
    assert (np.diff(values) >= 0).all()
    fit = np.interp(x, knots, values)
    assert abs((fit * w).sum() - (y * w).sum()) < 1e-9
    assert ((fit - y) ** 2 * w).sum() <= ((np.average(y, weights=w) - y) ** 2 * w).sum()


# --- language model ----------------------------------------------------------------------------------


def some_weights(rng, dtype=np.float32):
    classes = lm_scoring.Classes.by_frequency(np.sort(rng.integers(1, 900, 300))[::-1])
    counts = rng.integers(1, 9, classes.short)
    w = lm_scoring.new_weights(classes, counts, rng.integers(1, 9, lm_scoring.TAIL_CLASSES), 3)
    return classes, {k: v.astype(dtype) for k, v in w.items()}


def test_classes_cover_the_short_list():
    for n in (0, 1, 2, 50, 3000):
        classes = lm_scoring.Classes.by_frequency(1000 // np.arange(1, n + 1) + 1)
        assert classes.short == n and len(classes.of) == n + lm_scoring.TAIL_CLASSES + 1
        assert (np.diff(classes.of) >= 0).all() and (np.diff(classes.cuts) > 0).all()


def test_gradients():
    rng = np.random.default_rng(2)
    classes, w = some_weights(rng, np.float64)
    tokens = rng.integers(0, classes.end + 1, (5, 3))
    fresh = rng.random((5, 3)) < 0.3
    live = np.ones((5, 3), bool)
    live[3:, 2] = False
    h = rng.normal(size=(3, lm_scoring.HIDDEN))
    assert lm_scoring.bounded(w, classes)
    grads = {"w": np.zeros_like(w["w"]), "x": np.zeros_like(w["x"])}
    _, _, dense, (symbols, rows) = lm_scoring._window_gradients(w, classes, h, tokens, fresh, live, grads["w"], True)
    grads |= dense
    grads["x"][symbols] = rows

    def loss() -> float:
        before, _, _ = lm_scoring._steps(w, h, tokens, fresh)
        on = live.reshape(-1)
        return -lm_scoring._output(w, classes, before.reshape(-1, lm_scoring.HIDDEN + 1)[on], tokens.reshape(-1)[on])[0].sum()

    for k, v in w.items():
        flat, g = v.reshape(-1), grads[k].reshape(-1)
        for i in np.argsort(-np.abs(g))[:3].tolist() + rng.integers(0, len(flat), 3).tolist():
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = loss()
            flat[i] = keep - 1e-5
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-5 - g[i]) < 1e-3 * max(1, abs(g[i])), k


def test_lm_base_and_gain(spark, odd_docs, odd_texts, no_docs, repeated_docs):
    got = {r.doc_id: r for r in lm_scoring.score_documents(odd_docs).collect()}
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*(t or "").translate(low).encode().split(), None] for i, t in odd_texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    assert lm_scoring.score_documents(no_docs).count() == 0
    assert lm_scoring.score_documents(repeated_docs).count() == 8


def test_scores_without_training_documents(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = lm_scoring.score_documents(spark.createDataFrame([(i, f"a b {i}") for i in held], "doc_id long, text string")).collect()
    assert len(rows) == len(held) and all(r.score == r.base_score and r.train_tokens == r.n_known == 0 for r in rows)


@pytest.fixture
def many_shards(monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_ROOT", 12)  # so that small tables have several


def test_network_learns_from_all_training_documents(spark, many_shards):
    rows = [(i, f"w{i % 7} x y{i % 3}" if i else "long " * 5000) for i in range(400)] + [(None, "x y"), (None, "x y"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    vocabulary, _ = lm_scoring.build_vocabulary(lm_scoring.word_counts(docs), 403)
    keyed = docs.select("doc_id", F.lit(False), F.pmod("doc_id", F.lit(3)).cast("int"), F.coalesce("doc_id", F.lit(0)) * (1 << 31), "text")
    texts = lm_scoring.coded(keyed, spark.sparkContext.broadcast(vocabulary)).select(F.coalesce("shard", F.lit(0)).alias("shard"), "u", "tokens")
    _, learnt = lm_scoring.fit_network(texts, vocabulary)
    assert learnt == vocabulary.total == 399 * 4 + 5001 + 3 + 3 + 1


def test_scores_do_not_depend_on_partitions(spark, odd_docs, many_shards):
    one, two = ({r.doc_id: r for r in lm_scoring.score_documents(odd_docs.repartition(n)).collect()} for n in (1, 6))
    assert all(abs(one[i].score - two[i].score) < 1e-3 + 1e-5 * abs(two[i].score) for i in one)


def test_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = lm_scoring.score_documents(docs).where("held_out").agg(F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens"), F.count("*")).first()
    assert held[1] > 1000 and held[0] > 0.48


def test_training_carries_state_over_batches():
    """A document fed alone, and after others, in batches: every token is learnt once, and lanes stay apart."""
    rng = np.random.default_rng(6)
    classes, w = some_weights(rng)
    tokens = rng.integers(0, classes.end + 1, 900)
    at = np.array([0, 500, 501, 620, 900])
    run = lm_scoring.Training(w, classes, 2, 0.01, 900)
    seen = []
    run._window = lambda h, t, fresh, live, real=run._window: (seen.append((t, fresh, live)), real(h, t, fresh, live))[1]
    for a, b in ((0, 1), (1, 3), (3, 4)):
        run.feed(tokens[at[a] : at[b]], at[a : b + 1] - at[a])
    run.finish()
    assert run.done == 900 and sum(int(f[v].sum()) for _, f, v in seen) == 4
    assert sorted(np.concatenate([t[v] for t, _, v in seen]).tolist()) == sorted(tokens.tolist())


def test_every_shard_has_its_task(spark):
    """Also shards of very unequal sizes, and ones without documents."""
    rows = [(22 if i % 10 else i // 10 % 23, i, [1, 2]) for i in range(3000)]
    texts = spark.createDataFrame([r for r in rows if r[0] != 7], "shard int, u long, tokens array<int>")
    got = lm_scoring.by_shard(texts, 23).groupBy(F.spark_partition_id().alias("p")).agg(F.collect_set("shard").alias("shards")).collect()
    assert sorted(r.shards for r in got) == [[k] for k in range(23) if k != 7]


def test_common_words_are_looked_up():
    rng = np.random.default_rng(8)
    crowd = (np.uint64(5) << np.uint64(60)) + np.arange(50, dtype=np.uint64) * np.uint64(3)  # equal leading bits
    for hashes in (crowd[:1], crowd, np.unique(np.concatenate([crowd, rng.integers(0, 1 << 63, 900).astype(np.uint64) * np.uint64(2)]))):
        n = len(hashes)
        known = lm_scoring.Vocabulary(hashes, np.arange(n) + 1, np.where(np.arange(n) % 2, -1, np.arange(n)), np.arange(65536) % 3, np.zeros(3), lm_scoring.Classes(np.array([0, n])), 1, 1, 1)
        asked = np.concatenate([hashes, hashes + np.uint64(1), hashes - np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
        suffix = rng.integers(0, 65536, len(asked))
        place = {h: i for i, h in enumerate(hashes.tolist())}
        for h, s, symbol, count in zip(asked.tolist(), suffix.tolist(), *known.look_up(asked, suffix), strict=True):
            i = place.get(h, -1)
            assert count == (i + 1 if i >= 0 else -1) and symbol == (i if i >= 0 and i % 2 == 0 else n + s % 3)


def test_windows_reuse_their_memory():
    """Windows of full width, in training and in scoring, don't take memory from the system anew each time."""
    rng = np.random.default_rng(7)
    classes, w = some_weights(rng)
    tokens = rng.integers(0, classes.end + 1, (lm_scoring.WINDOW, 512))
    fresh, live, h = tokens == classes.end, np.ones(tokens.shape, bool), np.zeros((512, lm_scoring.HIDDEN), np.float32)
    words = np.zeros_like(w["w"])

    def faults(windows: int) -> int:
        begin = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        for _ in range(windows):
            lm_scoring._window_gradients(w, classes, h, tokens, fresh, live, words, True)
            lm_scoring._steps(w, h, tokens, fresh)
        return resource.getrusage(resource.RUSAGE_SELF).ru_minflt - begin

    faults(3)
    assert faults(20) < 20 * 300


def test_state_is_carried():
    rng = np.random.default_rng(4)
    classes, w = some_weights(rng)
    tokens = rng.integers(0, classes.end + 1, 300)
    at = np.array([0, 100, 101, 101, 300])
    one = lm_scoring.token_scores(w, classes, tokens, at, 3)
    for a, b in zip(at[:-1], at[1:], strict=True):
        alone = lm_scoring.token_scores(w, classes, tokens[a:b], np.array([0, b - a]), 1)
        assert np.allclose(one[a:b], alone, atol=1e-4)


# --- decontamination ---------------------------------------------------------------------------------


def least_edits(item: list[bytes], text: list[bytes]) -> int:
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != w), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng: random.Random, item: list[str], edits: int) -> list[str]:
    copy = list(item)
    for _ in range(edits):
        k, how = rng.randrange(len(copy)), rng.randrange(3)
        copy[k : k + (how < 2)] = [] if how == 0 else ["other"]
    return copy


def test_contamination(spark, no_docs, odd_docs, odd_texts, repeated_docs, monkeypatch):
    rng = random.Random(5)
    pool = [f"v{i}" for i in range(60)]
    items = [[rng.choice(pool) for _ in range(n)] for n in (1, 3, 6, 9, 14, 20, 33, 50)]
    docs = []
    for i in range(160):
        w = [rng.choice(pool) for _ in range(rng.randrange(0, 80))]
        if i % 2:
            copy = rng.choice(items[2:])
            at = rng.randrange(len(w) + 1)
            w[at:at] = edited(rng, copy, rng.randrange(0, len(copy) // 4 + 1))
        docs.append((i, " ".join(w).replace("v1 ", "V1, ")))
    bench = spark.createDataFrame([(100 + i, " ".join(x)) for i, x in enumerate(items)] + [(7, None), (8, " "), (None, "x")], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    report = lambda **options: sorted(tuple(r) for r in decontam.contamination_report(frame, bench, **options).collect())
    rows = report()
    got = {r[0]: {int(x) for x in r[3].split(",") if x} for r in rows}
    near = missed = 0
    for i, t in docs:
        w = re.findall("[a-z0-9]+", t.lower())
        want = {100 + k for k, x in enumerate(items) if least_edits(x, w) <= int(0.2 * len(x) + 1e-9)}
        assert got[i] <= want
        near += len(want)
        missed += len(want - got[i])
    assert near > 100 and missed <= (1 - decontam.RECALL) * near
    assert [r[:4] for r in report(prefilter=False)] == [r[:4] for r in rows]  # the q-gram lemma saves work and decides nothing
    assert decontam.contamination_report(no_docs, bench).count() == 0
    assert decontam.contamination_report(odd_docs, bench).count() == len(odd_texts)
    assert decontam.contamination_report(odd_docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination_report(repeated_docs, bench).count() == 8
    clean = {i for i, x in got.items() if not x}
    assert {r.doc_id for r in decontam.keep_clean(frame, bench).collect()} == clean
    assert decontam.keep_clean(no_docs, bench).schema == no_docs.schema and decontam.keep_clean(no_docs, bench).count() == 0
    # a benchmark of several slices
    monkeypatch.setattr(decontam, "SLICE_BYTES", 300)
    assert report() == rows
    assert {r.doc_id for r in decontam.keep_clean(frame, bench).collect()} == clean


def test_recall_at_the_limit_of_edits():
    """Windows with all the edits allowed become candidates, each item alone, at least as often as RECALL says."""
    rng = random.Random(8)
    found = total = 0
    for n in (10, 15, 25, 40, 60):
        for _ in range(40):
            item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            text = [f"x{rng.randrange(10**6)}" for _ in range(30)] + edited(rng, item, n // 5) + [f"x{rng.randrange(10**6)}" for _ in range(30)]
            index = decontam.ItemIndex([1], [" ".join(item)])
            total += 1
            found += bool(decontam._found(index, pa.array([" ".join(text)]))[0])
    assert found >= decontam.RECALL * total


def test_alignment():
    rng = random.Random(3)
    for _ in range(300):
        item, text = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (9, 20))
        cost, a, b = decontam.align(np.array(item, np.uint64), np.array(text, np.uint64))
        assert cost == least_edits(item, text) and 0 <= a <= b <= len(text)
        m = [[i + j if not i or not j else 0 for j in range(b - a + 1)] for i in range(len(item) + 1)]
        for i in range(1, len(item) + 1):
            for j in range(1, b - a + 1):
                m[i][j] = min(m[i - 1][j - 1] + (item[i - 1] != text[a + j - 1]), m[i - 1][j] + 1, m[i][j - 1] + 1)
        assert m[-1][-1] == cost


def test_contamination_spans(spark):
    bench = spark.createDataFrame([(1, "Alpha beta gamma, delta epsilon zeta eta.")], "item_id long, text string")
    text = "é lead in. alpha BETA gamma delta epsilon zeta eta! and more"
    (r,) = decontam.contamination_report(spark.createDataFrame([(5, text)], "doc_id long, text string"), bench).collect()
    _, a, b = map(int, r.spans.split(":"))
    assert text[a:b] == "alpha BETA gamma delta epsilon zeta eta"
    assert r.contaminated and r.n_items == 1
