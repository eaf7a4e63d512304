"""Byte-level BPE, whitening and the filter audit against brute force, on awkward input."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rescora.llm import audit, bpe, queries, whitening

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- byte-level BPE


@pytest.fixture(scope="module")
def lines():
    with open(RANKS, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(lines):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(lines), special_tokens={})


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def test_ids_of_documents(spark, docs, rows, library):
    made = docs.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    out = bpe.decode(bpe.encode(made, RANKS, public_tokenizers.PATTERN), RANKS)
    assert set(out.columns) == set(made.columns)
    got = out.withColumn("n", bpe.n_ids(F.col("ids"))).withColumn("a", bpe.as_array(F.col("ids"))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode_ordinary(r["text"] or "")
        assert bytes(r["ids"]) == as_bytes(want) and r["n"] == len(want) and r["a"] == want
        assert bytes(r["decoded"]).decode() == (r["text"] or "")


def test_awkward_texts(lines, library):
    encoder, decoder = bpe.Encoder(lines, public_tokenizers.PATTERN), bpe.Decoder(lines)
    rng = random.Random(0)
    signs = "abcdefghABCD éüß日本語한ñ\n\t\x1c\x85 　 0123.,!'s’😀﻿٣Ⅷ"
    parts = [*signs, "the", "ing", "tion", " un", "'re", "<|endoftext|>"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)]
    made += ["a" * 5000, "ab" * 5000, "日" * 3000, " " * 3000, "".join(rng.choice("abcdefghijkl") for _ in range(20_000))]
    for t in made:
        assert encoder.encode(t) == as_bytes(library.encode_ordinary(t)), t[:80]
        assert decoder.decode(encoder.encode(t)) == t.encode()


def test_long_texts_and_full_memories(lines, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    encoder = bpe.Encoder(lines, public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(50):
        t = " ".join("".join(rng.choice("abcdeilmnorst") for _ in range(rng.randrange(1, 12))) for _ in range(80))
        assert encoder.encode(t) == as_bytes(library.encode_ordinary(t))
        assert len(encoder) <= 50 and len(encoder.pairs) <= 50


def test_ranks_out_of_order_follow_the_definition():
    """Random ranks: tokens that merges don't arrive at, any split of a token, and ranks below those of the parts."""
    for seed in range(40):
        rng = random.Random(seed)
        tokens = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))).encode() for _ in range(25)}
        order = sorted(tokens)
        rng.shuffle(order)
        ranks = {t: k for k, t in enumerate(order)} | {bytes([b]): 100 + b for b in range(256)}
        file = b"\n".join(bpe.base64.b64encode(t) + b" %d" % k for t, k in ranks.items())
        encoder = bpe.Encoder(file, r"\p{L}+|\P{L}+")
        own = tiktoken.Encoding("own", pat_str=r"\p{L}+|\P{L}+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(60):
            t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
            assert encoder.encode(t) == as_bytes(own.encode_ordinary(t))


def test_no_rows_and_nulls(spark, none, nulls):
    for df in (none, nulls):
        out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
        assert len(out) == df.count() and all(not r["ids"] and not r["decoded"] for r in out)
    wrong = spark.createDataFrame([(b"\x01\x02",), (b"\xff\xff\xff\xff",)], "ids binary")
    for k in (0, 1):
        with pytest.raises(Exception, match="buffer size|KeyError"):
            bpe.decode(wrong.limit(1) if k == 0 else wrong.where("hex(ids) = 'FFFFFFFF'"), RANKS).collect()


def test_the_query_encodes_once(spark):
    plan = queries.op11_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ids(text") == 1


def test_bpe_query(spark, library):
    got = {r["doc_id"]: r for r in queries.op11_bpe(spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids = library.encode_ordinary(text or "")
        r = got[doc_id]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(as_bytes(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


# --- whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string"


def brute_whitening(rows, components=4):
    kept = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, sums = len(fit), fit.sum(0)
    x = fit.astype(float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1], vectors.T[::-1]
    for k, v in kept:
        off = [n * a - s for a, s in zip(v, sums, strict=True)]
        for c in range(min(components, len(values))):
            white = float(np.array([o / n for o in off]) @ vectors[c] / np.sqrt(values[c])) if values[c] > 1e-9 else None
            yield k, c + 1, n, sum(o * o for o in off), white, values[c] / values.sum()


def made_vectors(n=300, d=9, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * np.linspace(0.2, 3, d)) @ rng.normal(size=(d, d))
    rows = [(i, [float(np.float32(c)) for c in v], 1, "clash") for i, v in enumerate(x)]
    bad = [(900, None, 1, ""), (901, [1.0] * 8 + [None], 1, ""), (902, [1.0] * 8 + [float("nan")], 1, ""), (903, [float("-inf")] + [0.0] * 8, 1, "")]
    return rows + bad + [(904, rows[0][1], 1, ""), (904, rows[0][1], 1, ""), (None, rows[5][1], None, None), (905, [-0.0] * 9, 1, "")]


def test_whitening(spark):
    rows = made_vectors()
    table = spark.createDataFrame(rows, VECTORS)
    got = sorted(map(tuple, whitening.whiten(table).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = sorted(brute_whitening(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert len(got) == len(want) == 4 * 304
    flip = {c: np.sign(next(g[4] * w[4] for g, w in zip(got, want, strict=True) if g[1] == c)) for c in range(1, 5)}
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4]
        assert g[4] * flip[g[1]] == pytest.approx(w[4], abs=1e-9) and g[5] == pytest.approx(w[5], rel=1e-10)
        assert g[6] < 1e-10
    again = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(table.repartition(7)).collect()}
    assert all(abs(abs(again[g[0], g[1]]) - abs(g[4])) < 1e-9 for g in got)


def test_small_eigenvalues_are_accurate():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    scale = 10.0 ** -np.linspace(0, 6, 30)
    b = (rng.normal(size=(30, 30)) + 30 * np.eye(30)) * 0.01
    a = scale[:, None] * (b @ b.T) * scale  # graded: small eigenvalues are well defined entry by entry
    values, vectors = whitening.jacobi(a)
    assert np.allclose((vectors * 1.0) @ vectors.T, np.eye(30), atol=1e-13)
    # the inverse has them as its largest
    inverse = np.linalg.eigvalsh(np.linalg.inv((b @ b.T)) / scale[:, None] / scale)
    assert 1 / inverse[-1] == pytest.approx(values[-1], rel=1e-9)
    given = 10.0 ** -np.arange(30)
    values, _ = whitening.jacobi(np.diag(given[::-1]))
    assert values.tolist() == given.tolist()
    full = (q * np.arange(1, 31)) @ q.T
    values, vectors = whitening.jacobi(full)
    assert np.allclose(values, np.arange(30, 0, -1), rtol=1e-13) and np.allclose(vectors @ full, values[:, None] * vectors, atol=1e-11)


def test_vectors_without_variance(spark):
    same = [(i, [1.0, 2.0], 0, "") for i in range(3)]
    got = whitening.whiten(spark.createDataFrame(same, VECTORS)).collect()
    assert len(got) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] == 0 for r in got)
    line = [(i, [float(i), 2.0 * i, 5.0], 0, "") for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(line, VECTORS)).collect()
    assert len(got) == 150 and all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert all(r["explained"] == pytest.approx(1.0 if r["component"] == 1 else 0.0, abs=1e-12) and r["identity_error"] < 1e-9 for r in got)


def test_deviations_are_exact_beyond_a_long(spark):
    rows = [(i, [float(i * 2**30), 1.0], 0, "") for i in range(5)] + [(9, [2.0**43, 0.0], 0, ""), (10, [3e38, 0.0], 0, "")]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, VECTORS), components=1).collect()}
    want = {r[0]: r[3] for r in brute_whitening(rows[:-1], 1)}
    assert got == {k: v if v < 2**63 else None for k, v in want.items()} and None in got.values()


def test_lengths_and_no_vectors(spark):
    rows = [*made_vectors(20), (1, [1.0], 0, ""), (2, [], 0, "")]
    assert {r["vec_id"] for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()} == {*range(20), 904, 905, None}
    for some in ([], [(1, None, None, None)], [(1, [], 0, ""), (2, [], 0, "")]):
        out = whitening.whiten(spark.createDataFrame(some, VECTORS))
        assert out.collect() == [] and len(out.columns) == 7


# --- filter audit


def brute_audit(rows, labels):
    smallest = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    per = collections.defaultdict(list)
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text))]
        fails = "".join(f for f, v in zip("ABCDE", [*own, doc_id is not None and doc_id > smallest[text]], strict=True) if v)
        marks = [(q, t) for k, q, t in labels if k == doc_id and k is not None]
        per[source or ""].append((fails, any(q == 1 for q, _ in marks), any(t == 1 for _, t in marks)))
    for part, docs in per.items():
        total, out = collections.Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                fail = sum(f in d[0] for d in docs)
                total[f] += len(gone)
                out.append((part, order, step, len(left), len(gone), fail - len(gone), sum(d[0] == f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        yield from (r + (total[r[1][r[2] - 1]],) for r in out)


def test_audit(spark, docs, rows):
    more = [(200 + i, "Some # words " * i + "end", "en", f"s{i % 3}", 0) for i in range(40)] + [(300, "One Two", "en", "", 1), (299, "One Two", "en", None, 1), (None, "One Two", "en", "s1", 1)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 320, 3)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (6, None, None), (6, 0, 0)]
    all_docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("mask", F.lit("clash")).withColumn("_n", F.lit(1))
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, audit.audit(all_docs, marked).collect()))
    assert got == sorted(brute_audit(rows + more, labels))
    assert got == sorted(map(tuple, audit.audit(all_docs.repartition(9), marked).collect()))


def test_audit_of_nothing(spark, none, nulls):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = audit.audit(none, labels)
    assert out.collect() == [] and len(out.columns) == 10
    got = sorted(map(tuple, audit.audit(nulls, labels).collect()))
    assert got == sorted(brute_audit([(None,) * 5] * 3, [])) and len(got) == 600


def test_the_audit_is_native(spark):
    plan = queries.op13_audit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
