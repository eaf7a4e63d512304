"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words and its runs of three bytes, lower-cased in A-Z and hashed to WORDS and TRIGRAMS numbers,
and two shares that no hash shows: of words, and of neighbouring pairs of words, that repeat earlier ones. Terms weigh by
the square root of their share times inverse document frequency; a truncated singular value decomposition of a sample
of labelled rows gives the latent space. Every document is compared with every labelled vector by exact cosine, in
blocks, and its K nearest vote with similarity ** SHARPNESS as weight.

Bounds: at most SAMPLE rows of each label, the first by md5 of doc_id, are fitted and broadcast; RANK numbers each. Where
their ids have several rows, 4 * SAMPLE rows are fitted at most, the first by a hash of id and terms.
A null or empty text, or one unlike all labelled rows, gets the share of label 1 among all training labels; without
labels 0.5. Null labels are ignored; repeated equal labels count once. Extra columns are kept; `score` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches
from .common import texts

SAMPLE, RANK, K, SHARPNESS, BLOCK = 1024, 48, 24, 8, 64


TRIGRAMS, WORDS = 4096, 4096
WIDTH = TRIGRAMS + WORDS + 2


def _repeated(h: np.ndarray) -> float:
    return np.sqrt(1 - len(np.unique(h)) / len(h)) if len(h) else 0.0


def shares(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed trigrams and words in a whole text, and of repeated words and pairs."""
    out, text = np.zeros(WIDTH, np.float32), text.lower()
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) > 2:
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        slot = (code * np.uint32(2654435761)) >> np.uint32(20)
        out[:TRIGRAMS] = np.sqrt(np.bincount(slot, minlength=TRIGRAMS) / len(code))
    words = text.split()
    if words:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        out[TRIGRAMS:-2] = np.sqrt(np.bincount((h % np.uint64(WORDS)).astype(np.int64), minlength=WORDS) / len(h))
        with np.errstate(over="ignore"):
            out[-2:] = _repeated(h), _repeated(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return _unit(_unit(x * self.idf) @ self.basis)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of a block of vectors against all labelled vectors."""
        if not len(self.votes):
            return np.full(len(x), self.prior)
        near = self.latent(x) @ self.vectors.T
        k = min(K, near.shape[1])
        top = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0.0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        vote = (weight * self.votes[top]).sum(1)
        return np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior)


def fit_vectors(x: np.ndarray, y: np.ndarray, prior: float, in_place: bool = False) -> Model:
    """Fit the space on labelled vectors; a seeded randomised decomposition. in_place: x is overwritten, to save its size."""
    if not len(y):
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y, prior)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    a = np.multiply(x, idf, out=x if in_place else None)
    a /= np.maximum(np.sqrt(np.einsum("ij,ij->i", a, a)), 1e-12)[:, None]
    rng = np.random.default_rng(0)
    q = np.linalg.qr(a.T @ (a @ rng.standard_normal((WIDTH, RANK + 16)).astype(np.float32)))[0]
    q = np.linalg.qr(a.T @ (a @ q))[0]
    basis = (q @ np.linalg.svd(a @ q, full_matrices=False)[2].T)[:, :RANK].astype(np.float32)
    return Model(idf, basis, _unit(a @ basis), y.astype(np.float64), prior)


def _packed(x: np.ndarray) -> bytes:
    """Places and values of what isn't 0; most terms are in few texts."""
    at = np.flatnonzero(x).astype("<u2")
    return at.tobytes() + x[at].astype("<f2").tobytes()


def _unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), WIDTH), np.float32)
    for x, packed in zip(out, rows, strict=True):
        n = len(packed) // 4
        x[np.frombuffer(packed, "<u2", n)] = np.frombuffer(packed, "<f2", n, 2 * n)
    return out


def _vectors(batches):
    for b in batches:
        x = [_packed(shares(t)) for t in texts(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(x, pa.binary())], names=["doc_id", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows: Column | None = None) -> Model:
    """Fit on labels.quality of the documents for which `rows` (a condition on doc_id) holds."""
    bounded_batches(docs.sparkSession)
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    own = (own if rows is None else own.where(rows)).select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).distinct()
    ones, n = own.agg(F.sum("quality"), F.count(F.lit(1))).first()
    h = F.md5(F.col("doc_id").cast("string"))
    picked = [own.where(F.col("quality") == v).orderBy(h, "doc_id").limit(SAMPLE) for v in (0, 1)]
    # at most 2 * SAMPLE ids
    ids = F.broadcast(picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "_id"))
    found = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).select("doc_id", "quality", "text")
    h = F.xxhash64("doc_id", "quality", "x")
    rows_ = found.mapInArrow(_vectors, "doc_id long, quality int, x binary").orderBy(h, "doc_id", "quality", "x").limit(4 * SAMPLE).collect()
    x, y = _unpacked([r["x"] for r in rows_]), np.array([r["quality"] for r in rows_])
    del rows_
    return fit_vectors(x, y, ones / n if n else 0.5, in_place=True)


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with score: 0 to 1, higher where label 1 is likelier."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out, block = [], []
        for t in texts(text):
            block.append(shares(t))
            if len(block) == BLOCK:
                out.append(held.value.scores(np.stack(block)))
                block = []
        if block:
            out.append(held.value.scores(np.stack(block)))
        return pa.array(np.round(np.concatenate(out), 6) if out else np.zeros(0), pa.float64())

    return docs.withColumn("score", score(F.col("text")))
