"""Each operator against a brute-force version, on documents with every awkward case."""

import base64
import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rescora.llm import chat, decontam, fingerprints, linededup, mixing, quality, sharding, simhash, tokenids, warc


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- mixing


def brute_mix(rows):
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(word_list(t))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(size.values())), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 3 * size[s]]
        if not full:
            return size, target | share
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.remove(s)
        if not open_:
            return size, target


def test_mix(spark, docs, rows):
    got = mixing.mix(docs.withColumn("size", F.lit("clash"))).collect()
    size, target = brute_mix(rows)
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(word_list(r["text"])) and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["positions"])
        assert list(r["positions"]) == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        largest = max(len(word_list(r[1])) for r in rows if r[3] == s)
        assert abs(taken[s] - t) <= max(largest, 1)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"] or -1, r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    order = [r["position"] for r in mixing.training_order(mixing.mix(docs)).collect()]
    assert order == sorted(order) and len(order) == sum(len(r["positions"]) for r in got)


@pytest.mark.parametrize("schedules", [mixing.CURRICULUM, [((0.0, 1.0), (1.0, 1.0)), ((0.0, 19.0), (1.0, 19.0))]])
def test_a_source_with_one_dominating_document_is_filled(spark, schedules):
    least = min(range(200), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    made = [(i, "long" if i < 200 else "other", "w " * (1000 if i == least else 10)) for i in range(500)]
    made += [(600 + i, "few", "w " * (1000 if i == 0 else 10)) for i in range(40)] + [(700 + i, "few", "") for i in range(9)]
    rows = spark.createDataFrame(made, "doc_id long, source string, text string")
    got = mixing.mix(rows, schedules)
    for source in ("long", "other", "few"):
        own = got.where(F.col("source") == source).agg(F.first("target").alias("t"), F.sum("taken").alias("n")).first()
        assert 0 <= own["t"] - own["n"] < 10


def test_the_probe_of_39_short_rows_and_a_long_one(spark):
    first = min(range(40), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    made = [(i, "b", "w " * (1000 if i == first else 10)) for i in range(40)] + [(100 + i, "a", "w " * 7) for i in range(60)]
    got = mixing.mix(spark.createDataFrame(made, "doc_id long, source string, text string")).where("source = 'b'")
    own = got.agg(F.first("target").alias("t"), F.sum("taken").alias("n")).first()
    assert 0 <= own["t"] - own["n"] < 10


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    late = [((0.0, 0.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0))]
    rows = mixing.training_order(mixing.mix(docs, late)).collect()
    a = sorted(r["position"] for r in rows if r["source"] == "a")
    assert np.quantile(a, 0.25) == pytest.approx(0.5, abs=0.03) and np.quantile(a, 0.5) == pytest.approx(0.707, abs=0.03)


# --- sharding


def test_shards(spark, docs, rows):
    got = sharding.shard(docs.withColumn("slot", F.lit(None)), 8).collect()
    assert len(got) == len(rows)
    by, texts = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        t = (r["text"] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
        by[r["shard"]].append(r)
        texts[t].add(r["shard"])
    assert all(len(s) == 1 for s in texts.values())
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values())
    a, b = (sorted((r["doc_id"] or -1, r["shard"], r["size"]) for r in sharding.shard(docs.repartition(k), 8).collect()) for k in (1, 6))
    assert a == b


def test_shards_are_even_and_hot_groups_are_cut(spark):
    rows = [(i, f"text {i} " * (i % 7 + 1)) for i in range(3000)] + [(5000 + i, "the same text again and again") for i in range(1500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16, compact=True)
    sizes = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.08 * sum(sizes) / 16
    odd = [r["b"] for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(odd) == 5 and max(odd) < 1.1 * sum(odd) / 5


def test_the_cut_digit_is_found_alike_here_and_in_spark(spark):
    rng = np.random.default_rng(3)
    rows = [(n, int(d), int(rng.integers(1, 50)), float(rng.integers(1, 900)), int(rng.integers(1, 4))) for n in range(5) for d in rng.choice(90, 30, replace=False)]
    goal = {n: g for n, _, _, g, _ in rows}
    sums = spark.createDataFrame([(n, d, w, c, goal[n], 7) for n, d, w, _, c in rows], "_node long, d long, w long, c long, goal double, before long")
    assert sorted(sharding._where_reached(sums, True)) == sorted(sharding._where_reached(sums, False))


def test_groups_stay_whole_where_asked(spark):
    rows = [(i, f"text {i} " * (i % 7 + 1)) for i in range(600)] + [(5000 + i, "the same text again and again") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, 8, cohesion=float("inf"))
    assert got.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert got.count() == len(rows)


def test_both_forms_give_the_same_shards(spark, docs):
    a, b = (sorted((r["doc_id"] or -1, r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(docs, 7, compact=c).collect()) for c in (True, False))
    assert a == b


def test_written_shards(spark, docs, tmp_path):
    assert sharding.write_shards(docs.limit(0), str(tmp_path / "none"), 40_000).count() == 0
    out = sharding.write_shards(docs, str(tmp_path / "s"), 40_000)
    assert out.count() == docs.count() and out.select("shard").distinct().count() > 1


# --- sketches


def brute_sketch(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in word_list(text)]
    return set(itertools.islice((tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))), None))


def test_sketches_estimate_containment(spark, docs, rows):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(rows) and all(len(r["sketch"]) >= 1 and list(r["sketch"]) == sorted(r["sketch"]) for r in got)
    whole = "a b c d e f g h i j k l m n o p q r s t u v w x y z "
    a, b = " ".join(f"u{i}" for i in range(8000)), " ".join(f"u{i}" for i in range(7000, 9000))
    df = spark.createDataFrame([(1, a, b, whole.upper(), whole)], "k int, a string, b string, c string, d string")
    for c in "abcd":
        df = fingerprints.add_sketch(df, c, f"s{c}")
    r = df.select(fingerprints.containment("sb", "sa").alias("x"), fingerprints.likeness(F.col("sc"), F.col("sd")).alias("same"), F.size("sa").alias("n"), fingerprints.merge(F.col("sa"), F.col("sb")).alias("m")).first()
    assert r["x"] == pytest.approx(0.5, abs=0.08) and r["same"] == 1.0 and r["n"] == pytest.approx(2000, rel=0.1)
    assert len(r["m"]) == pytest.approx(2250, rel=0.1)
    by = collections.defaultdict(set)
    for x in got:
        by[tuple(x["sketch"])].add(x["doc_id"])
    assert {3, 104, 105} <= next(v for v in by.values() if 3 in v)


def test_next_documents_wrap_around(spark, docs, rows):
    ids, order = fingerprints.in_ranges(docs, 5)
    got = ids.withColumn("n", F.lead("text").over(order)).where("_guest = 0").select("doc_id", "text", "n").collect()
    want = sorted(((r[0] if r[0] is not None else -(1 << 63), r[1] or "") for r in rows), key=lambda r: (-r[0], r[1].encode()))
    nexts = {(i, t): want[(k + 1) % len(want)][1] for k, (i, t) in enumerate(want) if i != 105}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] != 105:
            assert r["n"] == nexts[(r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["text"])]
    one, order = fingerprints.in_ranges(docs.where("doc_id = 1"))
    assert one.withColumn("n", F.lead("text").over(order)).where("_guest = 0").first()["n"] == rows[1][1]


def test_the_sketch_query_against_brute_force(spark, docs, rows, tmp_path):
    """Its columns: edited texts, fingerprints as text, and both likenesses, for all documents."""
    from rescora.llm import queries

    own = [r for r in rows if r[0] not in (None, 105)]  # equal ids have no one order
    docs.where("doc_id IS NOT NULL AND doc_id <> 105").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op3_sketch(spark, str(tmp_path)).collect()}
    text = {r[0]: r[1] or "" for r in own}
    order = sorted(text, reverse=True)
    assert sorted(got) == sorted(text)

    def sketch(t):
        low = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = word_list(low)
        each = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        signed = lambda h: h - (1 << 64) if h >> 63 else h

        def chained(own):
            h = 42
            for e in own:
                h = xxhash.xxh64_intdigest(signed(e).to_bytes(8, "little", signed=True), h)
            return signed(h)

        all_ = {chained(each[i : i + 5]) for i in range(max(1, len(each) - 4))}
        low = sorted(h for h in all_ if h < -(1 << 63) + (1 << 62))
        return low or [min(all_)]

    def like(a, b):
        return len(set(a) & set(b)) / min(len(a), len(b))

    for k, i in enumerate(order):
        r, t, after = got[i], text[i], text[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = sketch(t), sketch(edited), sketch(after)
        digits = lambda s: "".join(f"{h + (1 << 63):016x}"[:12] for h in s)
        assert r["fingerprint"] == digits(a) and r["edited_fingerprint"] == digits(b)
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, c))


# --- quality


def test_quality_on_held_out_rows(spark):
    import random

    rng = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(["stone", "river", "cloud", "meadow", "lantern"]) for _ in range(40)]
        bad = i % 4 == 0
        rows.append((i, "!! ".join(w.upper() for w in words) if bad else " ".join(words)))
        labels.append((i, 0 if bad else 1))
    rows += [(900, None), (901, ""), (None, "stone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(1, None), (None, 1), (5, 1)], "doc_id long, quality int")
    model = quality.fit(docs, known, F.col("doc_id") % 3 != 1)
    scores = {r["doc_id"]: r["score"] for r in quality.with_score(docs, model).collect()}
    assert len(scores) == 403 and all(0 <= s <= 1 for s in scores.values())
    assert all((scores[i] >= 0.5) == bool(q) for i, q in labels if i % 3 == 1)
    assert scores[900] == scores[901] == pytest.approx(model.prior)


def test_votes_are_exact(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random((60, quality.WIDTH)).astype(np.float32), np.arange(60) % 2
    m = quality.fit_vectors(x, y, 0.5)
    z = rng.random((5, quality.WIDTH)).astype(np.float32)
    near = m.latent(z) @ m.vectors.T
    for row, got in zip(near, m.scores(z), strict=True):
        top = np.argsort(row)[-quality.K :]
        w = np.maximum(row[top], 0).astype(float) ** quality.SHARPNESS
        assert got == pytest.approx((w * y[top]).sum() / w.sum(), abs=1e-5)


def test_scores_of_texts_are_votes_of_their_nearest_labelled_texts(spark, rows):
    """From texts to scores by plain loops: terms, space, cosines with every labelled text, votes."""
    texts = [(r[0], r[1] or "") for r in rows if r[0] is not None and r[0] < 80]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = {i: int(i % 3 > 0) for i, _ in texts if i % 2}
    model = quality.fit(docs, spark.createDataFrame(list(known.items()), "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.with_score(docs, model).collect()}
    latent = {i: model.latent(quality.shares(t.encode())[None])[0].astype(float) for i, t in texts}
    for i, _ in texts:
        near = sorted(((float(latent[i] @ latent[k]), k) for k in known), reverse=True)[: quality.K]
        w = [max(c, 0.0) ** quality.SHARPNESS for c, _ in near]
        assert got[i] == pytest.approx(sum(a * known[k] for a, (_, k) in zip(w, near, strict=True)) / sum(w), abs=2e-3)


def test_held_out_accuracy_by_label(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from rescora.llm.queries import held_out

    scored = quality.with_score(docs, quality.fit(docs, labels, ~held_out())).where(held_out()).join(labels.select("doc_id", "quality"), "doc_id")
    per = {r["quality"]: r["right"] / r["n"] for r in scored.groupBy("quality").agg(F.count_if((F.col("score") >= 0.5) == (F.col("quality") == 1)).alias("right"), F.count("*").alias("n")).collect() if r["quality"] is not None}
    assert per[0] >= 0.95 and per[1] >= 0.98


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 3)
    docs = spark.createDataFrame([(i % 4, f"text number {i} of one id") for i in range(400)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    a, b = (quality.fit(docs.repartition(k), known) for k in (1, 5))
    assert len(a.votes) == 12 and np.allclose(a.vectors, b.vectors, atol=1e-4)


def test_quality_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.with_score(docs, quality.fit(docs, empty)).collect()} == {0.5}


# --- simhash


def brute_fp(text, k):
    w = [x.encode().lower() for x in word_list(text)]
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(spark, docs, rows):
    got = simhash.components(docs.withColumn("fp", F.lit("clash")), 3).collect()
    fps = [brute_fp(r[1], 3) for r in rows]
    assert sorted((r["doc_id"] or -1, r["fp"] & (1 << 64) - 1) for r in got) == sorted(((r[0] or -1) if r[0] != 0 else -1, f) for r, f in zip(rows, fps, strict=True))
    top = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            a, b = top[i], top[j]
            top = [min(a, b) if t in (a, b) else t for t in top]
    least = {}
    for r, t in zip(rows, top, strict=True):
        if r[0] is not None:
            least[t] = min(least.get(t, 1 << 60), r[0])
    want = collections.Counter((r[0], least.get(t)) for r, t in zip(rows, top, strict=True))
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in got) == want


def test_lists_of_five_positions_hold_every_byte_of_six():
    assert len(simhash.LISTS) < 30 and all(len(t) == 5 for t in simhash.LISTS)
    for n in (6, 7, 8):
        for equal in itertools.combinations(range(8), n):
            inside = [t for t in simhash.LISTS if set(t) <= set(equal)]
            assert {p for t in inside for p in t} == set(equal)


@pytest.mark.parametrize("most", [256, 3])
def test_links_are_all_pairs_at_two_bits(spark, most):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    # a ball: all at one or two bits in two bytes
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(16)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    nodes = spark.createDataFrame(signed, "fp long")
    got = [(r["a"], r["b"]) for r in simhash.links(nodes, most).collect()]
    want = {(a, b) for (a,), (b,) in itertools.combinations(sorted(signed), 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert len(got) == len(set(got)) and set(got) == want
    sizes = [r["count"] for r in simhash.postings(nodes, most).groupBy("mask", "key").count().collect()]
    assert max(sizes) <= 256


def test_two_sets_of_one_name_are_not_one_document(spark, monkeypatch):
    made = [(1, "a b c d e f g h"), (2, "other words than these are here now"), (3, "a b c d e f g h")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    whole = simhash.shingle_sets

    def same_sig(text):
        out = whole(text)
        import pyarrow as pa

        fields = [pa.array([7] * len(out), pa.int64()) if n == "sig" else out.field(n) for n in ("set", "sig", "check", "cells")]
        return pa.StructArray.from_arrays(fields, names=["set", "sig", "check", "cells"])

    monkeypatch.setattr(simhash, "shingle_sets", same_sig)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [1, 2]


def test_near_copies_go(spark, docs, rows):
    import random

    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(30)]
    made = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        words = t.split()
        for k in (60, 200):
            words[k] = "changed"
        made += [(100 + i, " ".join(words)), (200 + i, t), (200 + i, t)]
    kept = simhash.keep_one(spark.createDataFrame(made, "doc_id long, text string").withColumn("sig", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "sig"]
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30))
    ids = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert 3 in ids and 104 not in ids and 105 not in ids and set(range(80)) <= set(ids)


def shingles(text):
    w = [x.encode().lower() for x in word_list(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def damaged(rng, text, likeness, how):
    """A copy whose Jaccard similarity in five-word shingles is just at or above `likeness`."""
    w, own = text.split(), shingles(text)
    out = w
    for k in range(1, len(w)):
        if how == "truncated":
            new = w[:-k]
        elif how == "appended":
            new = w + [f"n{rng.randrange(10**9)}" for _ in range(k)]
        else:
            new = list(out)
            new[rng.randrange(len(new))] = f"n{rng.randrange(10**9)}"
        got = shingles(" ".join(new))
        if len(own & got) < likeness * len(own | got):
            return " ".join(out)
        out = new


@pytest.mark.parametrize("group", [256, 3])
def test_near_copies_are_those_of_exact_similarity(spark, monkeypatch, group):
    import random

    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(3)
    line = " ".join(f"common{k}" for k in range(12))
    made = []
    for how, likeness in itertools.product(["truncated", "appended", "edited"], [0.7, 0.75, 0.8, 0.85, 0.9]):
        for n in (15, 40, 120, 300):
            base = " ".join(f"w{rng.randrange(9000)}" for _ in range(n)) + (" " + line if n > 20 else "")
            # a chain, so that some are alike only over others
            made += [base, damaged(rng, base, likeness, how), damaged(rng, damaged(rng, base, likeness, how), likeness, how)]
    made += [line, line + " x", "", "one two", "one two", None]
    sets = [shingles(t) for t in made]
    top = list(range(len(made)))
    for i, j in itertools.combinations(range(len(made)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            top = [min(top[i], top[j]) if t in (top[i], top[j]) else t for t in top]
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(top))


def test_only_sets_under_the_similarity_are_ruled_out():
    rng = np.random.default_rng(5)
    most = 1 << 48
    for n, other in ((4, 4), (30, 33), (200, 200), (2000, 2300), (1000, 1024)):
        a = np.unique(rng.integers(0, most, n).astype(np.uint64))
        for shared in np.linspace(0, n, 40).astype(int):
            b = np.unique(np.concatenate([rng.permutation(a)[:shared], rng.integers(0, most, max(other - shared, 1)).astype(np.uint64)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = (a, b) if len(a) <= len(b) else (b, a)
            cells = [simhash.cell_counts(v).tobytes() for v in (x, y)]
            got = simhash.may_be_alike(*cells, len(x), len(y), 0.8)
            assert (got or true < 0.8) and (n < 200 or true > 0.5 or not got)
            assert simhash.candidates(cells, np.array([len(x), len(y)]), np.array([0, 1]), 0.8).all() == got
            assert bool(simhash.linked([a, b], np.array([0, 1]), 0.8)) == (true >= 0.8)


@pytest.mark.parametrize("n,shared,alike", [(6, 5, False), (20, 17, False), (100, 86, False), (300, 257, False), (9, 8, True), (90, 80, True), (270, 240, True)])
def test_similarity_is_decided_exactly(spark, n, shared, alike):
    """Shared runs of words give 0.714, 0.739, 0.754 and 0.749, or 0.8 exactly."""
    words = [f"w{k}" for k in range(n + 4)]
    other = words[: shared + 4] + [f"x{k}" for k in range(n - shared)]
    kept = simhash.keep_one(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string"))
    assert kept.count() == 2 - alike


# --- lines


def brute_lines(rows, least_docs, least_chars):
    keys = [[x.encode().strip(b" \t\n\x0b\x0c\r").lower() for x in (r[1] or "").split("\n")] for r in rows]
    df = collections.Counter(k for own in keys for k in set(own))
    out = []
    for r, own in zip(rows, keys, strict=True):
        gone = [df[k] >= least_docs and len(k.decode()) >= least_chars for k in own]
        out.append((r[0], "\n".join(x for x, g in zip((r[1] or "").split("\n"), gone, strict=True) if not g), len(own), sum(gone)))
    return out


@pytest.mark.parametrize("least,chars", [(2, 1), (3, 0), (10**6, 1), (2, 8)])
def test_common_lines(spark, rows, least, chars):
    from conftest import KIND

    rows = rows + [(300 + i, f"own {i}\n  SHARED Line\t\nÉtat\n\nshared line\nlast{i % 3}", "en", "s", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, KIND)
    got = linededup.drop_common_lines(docs.withColumn("n_lines", F.lit("clash")), least, chars).collect()
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == collections.Counter(brute_lines(rows, least, chars))
    odd = docs.withColumns({"t": F.lit(1), "_c": F.lit("mine"), "u": F.lit(2)})
    split = linededup.drop_common_lines(odd, least, chars, held_bytes=0, shard_keys=3)
    assert split.columns == [*odd.columns, "n_lines", "n_dropped"] and {r["_c"] for r in split.select("_c").distinct().collect()} == {"mine"}
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in split.collect()) == collections.Counter(brute_lines(rows, least, chars))


def test_a_line_of_every_document_is_probed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PART_LINES", 50)
    rows = [(k, f"of all\nown {k}\n" if k % 3 else "copy\nof all", "en", "s", 1) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    _, shard_lines, keys = linededup.line_index(docs, 10, 1, 1)
    # "of all" is in 900 documents, "copy" in 300; the empty key has no code points
    assert keys == 2 and sum(shard_lines) == 1200
    assert max(linededup._parts(shard_lines)) >= linededup.LEAST_PARTS + 900 // 50
    got = linededup.drop_common_lines(docs, 10, 1, held_bytes=0, shard_keys=1).collect()
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == collections.Counter(brute_lines(rows, 10, 1))


def test_lines_of_copies_are_given_once_while_they_are_remembered(monkeypatch):
    def given(texts):
        t = np.array([hash(x) for x in texts])
        batches = [pa.RecordBatch.from_arrays([pa.array(t[k : k + 3]), pa.array(t[k : k + 3]), pa.array(texts[k : k + 3])], names=["t", "u", "text"]) for k in range(0, len(texts), 3)]
        return sum(len(b) for b in linededup._lines_of(iter(batches)))

    assert given(["a\nb"] * 50 + ["c"]) == 3
    monkeypatch.setattr(linededup, "MET_TEXTS", 2)
    # a text that keeps coming stays; others come again once they are forgotten
    assert given(["hot", "a", "hot", "b", "hot", "a", "hot"]) == 4
    assert given([]) == 0


def test_perfect_hash_in_small_shards(tmp_path):
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    # keys that share one half, and counts beyond 32 bits
    keys[1::10] = keys[::10]
    prints, counts = rng.integers(0, 1 << 63, 5000).astype(np.uint64), np.arange(5000)
    prints[3::10] = prints[2::10]
    counts[7] = 1 << 40
    h = linededup.PerfectHash.load(linededup.PerfectHash.build(keys, prints, counts).dump())
    assert sorted(h.index(keys, prints)) == list(range(5000)) and (h.count(keys, prints) == counts).all()
    assert linededup.PerfectHash.build(keys, prints, np.ones(5000, np.int64)).nbytes() < 5000 * linededup.KEY_BYTES
    other = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    assert (h.count(other, other) == 0).all()
    for k in range(4):
        own = linededup.shard_of(keys, 4) == k
        (tmp_path / f"{k:06d}.npz").write_bytes(linededup.PerfectHash.build(keys[own], prints[own], counts[own]).dump())
    shards = linededup.Shards(f"file://{tmp_path}", 4, cache_bytes=1)
    assert (shards.count(np.stack([keys, prints], 1)) == counts).all() and len(shards.held) == 1 and shards.loads == 4
    held = linededup.Shards(f"file://{tmp_path}", 4)
    for _ in range(3):
        held.count(np.stack([keys, prints], 1))
    assert held.loads == 4


# --- token ids


def test_token_files(spark, docs, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"file://{tmp_path}/ids"
    tokenids.write_ids(docs, folder, path, 2)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenids.read_ids(spark, folder).collect())
    tok = Tokenizer.from_file(path)
    want, start = [], 0
    enc = {r[1]: tok.encode(r[1] or "", add_special_tokens=False).ids + [2] if r[1] else [2] for r in rows}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(np.array(enc[r[1]], "<u2").tobytes()))):
        ids = enc[r[1]]
        want.append((start, r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    name = sorted((tmp_path / "ids").glob("*.zids"))[-1].name
    f = tokenids.IdFile(folder, name)
    assert f.ids(0)[-1] == 2
    (tmp_path / "ids" / "dictionary").write_bytes(b"other")
    with pytest.raises(ValueError):
        tokenids.IdFile(folder, name)


def test_remembered_chunks_equal_whole_texts(rows, monkeypatch):
    import public_tokenizers

    e = tokenids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(tokenids, "REMEMBERED", 300)
    texts = [r[1] or "" for r in rows] + ["a\nb", "it's!!!", "don't 'tis ''", "x<|endoftext|>y", "tab\there", "end\n", " lead", "\0 nul", "a.b.c... d", "ß. é, ñ%"]
    for k in range(0, len(texts), 9):
        got = list(e(texts[k : k + 9]))
        want = [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts[k : k + 9]]
        assert got == want


# --- dialogues


def test_rotation(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "hey é"), (1, 3, "ann", None), (2, 0, "system", "alone"),
        (3, 5, "bob", "b"), (3, 5, "ann", "a"), (3, 5, "ann", "a"), (None, 1, None, "who"), (4, None, "c d", "x"), (4, 0, "ann", ""),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(0))
    got = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "ann"), (3, "bob"), (None, "unknown"), (4, "c_d"), (4, "ann")}
    r = got[1, "ann"]
    o, c = "<|im_start|>", "<|im_end|>"
    assert r["text"] == f"{o}system\nbe kind{c}\n{o}assistant\nhi < |im_end|>{c}\n{o}user name=bob\nhey é{c}\n{o}assistant\n{c}\n"
    assert [r["text"][m["start"] : m["end"]] for m in r["mask"]] == [f"hi < |im_end|>{c}", c]
    assert [got[3, "ann"]["text"].count(x) for x in ("assistant", "user name=bob")] == [2, 1]
    assert got[4, "ann"]["text"].startswith(f"{o}user name=c_d")


def test_long_dialogues_are_rendered_in_parts(spark):
    df = spark.range(25).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'a', 'b') AS role", "concat('t', id) AS text")
    got = chat.rotate(df, part=10).orderBy("part", "speaker").collect()
    assert [(r["part"], r["speaker"], r["n_turns"]) for r in got] == [(0, "a", 10), (0, "b", 10), (1, "a", 10), (1, "b", 10), (2, "a", 5), (2, "b", 5)]
    assert sum(r["n_spoken"] for r in got) == 25
    assert chat.rotate(df.limit(0)).count() == 0


def test_a_participant_who_speaks_once_gets_the_whole_dialogue(spark):
    turns = [(1, k, "ann" if k == 700 else ("bob", "cy")[k % 2], f"t{k}") for k in range(1030)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole = {r["speaker"]: r for r in chat.rotate(df).collect()}
    assert {k: (r["part"], r["n_turns"], r["n_spoken"]) for k, r in whole.items()} == {"ann": (0, 1030, 1), "bob": (0, 1030, 514), "cy": (0, 1030, 515)}
    parts = chat.rotate(df, part=100).orderBy("part").collect()
    for who in whole:
        own = [r for r in parts if r["speaker"] == who]
        assert [r["part"] for r in own] == list(range(11)) and "".join(r["text"] for r in own) == whole[who]["text"]


def test_parts_have_all_participants_and_the_system_turn(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, 1000 * k, "ann" if k < 12 else "bob", f"t{k}") for k in range(1, 25)] + [(1, 5500, "system", "later")]
    got = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), part=10).orderBy("part", "speaker").collect()
    assert [(r["part"], r["speaker"], r["n_turns"], r["n_spoken"]) for r in got] == [
        (0, "ann", 10, 8), (0, "bob", 10, 0), (1, "ann", 10, 3), (1, "bob", 10, 7), (2, "ann", 6, 0), (2, "bob", 6, 6)
    ]
    for r in got:
        assert r["text"].startswith("<|im_start|>system\nbe kind<|im_end|>\n") and r["text"].count("be kind") == 1
        assert ("later" in r["text"]) == (r["part"] == 0)
        spoken = [r["text"][m["start"] : m["end"]] for m in r["mask"]]
        own = [f"{t[3]}<|im_end|>" for t in sorted(turns, key=lambda t: t[1])[10 * r["part"] : 10 * r["part"] + 10] if t[2] == r["speaker"]]
        assert spoken == own


# --- decontamination

FOLD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return FOLD.findall((text or "").encode().lower())


def brute_hits(text, items, window):
    w = plain_words(text)
    hit, found = set(), set()
    for key, item in items:
        v = plain_words(item)
        n = min(window, len(v))
        for s in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == s:
                    hit |= set(range(i, i + n))
                    if key is not None:
                        found.add(str(key))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("window,block,short", [(4, 100_000, True), (4, 10, True), (3, 100_000, False)])
def test_hits(spark, docs, rows, window, block, short):
    t = rows[5][1].split()
    items = [(1, " ".join(t[2:9]).upper()), (2, "!! ".join(t[8:12])), (10, rows[9][1]), (None, " ".join(rows[11][1].split()[1:6])), (3, None), (4, "..."), (2, "the of the of the")]
    items += [(5, "the of"), (6, "one"), (7, "a b a b a c")] if short else []
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = spark.createDataFrame([(400, "a b a b a b a c the of one", "en", "s", 1), (401, rows[9][1] + " x " + rows[9][1], "en", "s", 1)], docs.schema)
    got = decontam.decontaminate(docs.unionByName(more).withColumns({"items": F.lit("clash"), "_c": F.lit("mine")}), bench, window, block).collect()
    assert {r["_c"] for r in got} == {"mine"}
    texts = {r[0]: r[1] for r in rows} | {400: "a b a b a b a c the of one", 401: rows[9][1] + " x " + rows[9][1]}
    for r in got:
        n, hit, found = brute_hits(texts[r["doc_id"]], items, window)
        assert (r["n_words"], r["n_hit"], list(r["items"])) == (n, hit, found), r["doc_id"]
        assert len(plain_words(r["text"])) == n - hit
        if not hit:
            assert r["text"] == (texts[r["doc_id"]] or "")
    assert 401 not in [r["doc_id"] for r in decontam.mostly_clean(spark.createDataFrame([(401, 5, 9)], "doc_id long, n_hit long, n_words long")).collect()]


def test_automata_are_loaded_for_texts_that_may_match_only(spark, monkeypatch):
    monkeypatch.setattr(decontam, "HELD_BLOCKS", 2)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(30))) for k in range(40)] + [(99, " ".join(f"long{j}" for j in range(500)))]
    folder, gates = decontam.build_blocks(spark.createDataFrame(items, "item_id long, text string"), 5, 100)
    assert len(gates) == 1 and len(gates[0]) > 12
    held = decontam.Held(folder, gates)
    clean = [b"nothing of the kind is here at all today", b"", b"i3x1 i3x2 i3x3 i3x4"]
    assert [r[2] for r in held.match(clean * 50)] == [0] * 150 and held.loads <= 1
    dirty = [b"a i7x1 i7x2 i7x3 i7x4 i7x5 b", b"long%d " * 6 % tuple(range(198, 204))]
    got = list(held.match(clean + dirty))
    assert [r[1:] for r in got[3:]] == [(7, 5, ["7"]), (6, 6, ["99"])] and held.loads <= 5
    # a text without a window is streamed through no automaton at all
    none = decontam.Held(folder, gates)
    list(none.match(clean))
    assert none.loads == 0


def test_gates_beyond_those_held(spark):
    items = [(k, " ".join(f"i{k}x{j}" for j in range(30))) for k in range(40)] + [(50, "two words")] + [(k, " ".join(f"both{j}" for j in range(8))) for k in (60, 61)]
    folder, gates = decontam.build_blocks(spark.createDataFrame(items, "item_id long, text string"), 5, 100, gate_windows=120)
    assert len(gates) > decontam.HELD_GATES + 3
    held = decontam.Held(folder, gates)
    texts = [b"i%dx3 i%dx4 i%dx5 i%dx6 i%dx7 end" % ((k,) * 5) for k in range(40)] + [b"in two words", b"both1 both2 both3 both4 both5", b""]
    got = [r[1:] for r in held.match(texts)]
    assert got == [(6, 5, [str(k)]) for k in range(40)] + [(3, 2, ["50"]), (5, 5, ["60", "61"]), (0, 0, [])]
    assert len(held.gates) == decontam.HELD_GATES and len(held.automata) == decontam.HELD_BLOCKS


def test_no_items(spark, docs, rows):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, bench).where("n_hit > 0").count() == 0


# --- archives


def test_archives(spark, tmp_path):
    rows = [
        (5, "http://a/x y", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (9, None, None), (2, "u", ""), (7, "u", "long " * 40_000), (None, "u", "<p>é</p>"),
        (8, "u", "other\r\n\r\nWARC/1.1"), (8, "u", "other\r\n\r\nWARC/1.1"), (None, "v", "only null ids"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write_warc(pages, f"file://{tmp_path}/w")
    got = warc.read_warc(index).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 1 << 60), i)
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and (i is None or i > f)
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    some = warc.read_warc(index.where("page_id IN (7, 8)")).collect()
    assert {r["html"] for r in some} == {"long " * 40_000, "other\r\n\r\nWARC/1.1"}
    small = warc.write_warc(pages, f"file://{tmp_path}/v", least_bytes=100)
    assert small.where("record_type = 'revisit'").count() == 0


def test_pages_of_one_payload_are_dealt_out(spark, monkeypatch):
    """Payloads of many and of some pages, repeated page_ids, null ids: the smallest page_id answers for all."""
    made = [(i, f"u{i}", "hot" if i % 3 == 0 else f"warm {i % 9}" if i % 2 else f"own {i}") for i in range(400)]
    made += [(5, "again", "hot"), (None, "no id", "hot"), (None, None, "warm 1"), (1, "twice", "warm 1"), (900, "only", None), (None, "none", "never else")]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    first = {}
    for i, _, h in made:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted(str((i, u, first[h or ""] if (h or "") in first and (i is None or i > first[h or ""]) else None)) for i, u, h in made)
    for hot in (1024, 3, 1):
        monkeypatch.setattr(warc, "HOT", hot)
        got = sorted(str((r["page_id"], r["url"], r["refers_to"])) for r in warc.classified(pages).collect())
        assert got == want


def test_the_arrays_of_a_tree_are_made_once():
    cuts = {n: sharding.Cut(n % 3, (n % 7, 0, 0)) for n in range(1, 1 << 12)}
    tree = sharding.Tree(cuts, {n: n - (1 << 12) for n in range(1 << 12, 1 << 13)}, [])
    rng = np.random.default_rng(0)
    x = [rng.integers(0, 7, 500) for _ in range(3)] + [np.zeros(500, np.int64), np.zeros(500, np.int64)]
    got = tree.walk(x)
    held = tree.arrays
    assert tree.walk(x).tolist() == got.tolist() and tree.arrays is held
    for k in range(0, 500, 50):
        n = 1
        while n < 1 << 12:
            v = cuts[n].bound[0]
            n = 2 * n + (0 if (x[n % 3][k], 0, 0) < (v, 0, 0) else 1)
        assert got[k] == n - (1 << 12)


def test_reads_are_coalesced():
    near = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP, 5), ("a", 26 + 3 * warc.GAP, 5), ("b", 0, 5), ("b", warc.STRETCH, 9)]
    assert [(f, o, a, z) for f, o, _, a, z in warc._ranges(near)] == [("a", 0, 0, 3), ("a", 26 + 3 * warc.GAP, 3, 4), ("b", 0, 4, 5), ("b", warc.STRETCH, 5, 6)]
    assert list(warc._ranges([])) == []


# --- all operators


def operators(spark, tmp):
    import public_tokenizers

    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")

    def ids(d):
        folder = f"file://{tmp}/ids{len(list(tmp.iterdir()))}"
        tokenids.write_ids(d, folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
        return tokenids.read_ids(spark, folder)

    return {
        "mix": mixing.mix, "shard": lambda d: sharding.shard(d, 4), "sketch": fingerprints.fingerprints, "quality": lambda d: quality.with_score(d, quality.fit(d, labels)),
        "simhash": simhash.components, "lines": linededup.drop_common_lines, "ids": ids, "decontaminate": lambda d: decontam.decontaminate(d, bench),
        "warc": lambda d: warc.read_warc(warc.write_warc(d.selectExpr("doc_id AS page_id", "source AS url", "text AS html"), f"file://{tmp}/w{len(list(tmp.iterdir()))}")),
    }


def test_empty_tables_and_null_rows(spark, none, nulls, tmp_path):
    for name, op in operators(spark, tmp_path).items():
        assert op(none).count() == 0, name
        assert op(nulls).count() == 3, name
    assert simhash.keep_one(none).count() == 0 and simhash.keep_one(nulls).count() == 1
