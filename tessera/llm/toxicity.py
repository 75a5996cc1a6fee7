"""Toxicity scores from a factorization machine over hashed terms.

Every hashed term of the sample may have a weight and factors; shrinkage, not a choice beforehand, leaves most at
zero. Weights come first, by logistic regression with an absolute penalty in proportion to the deviation
that chance gives each term. What is left unexplained is searched for pairs: for all terms with enough
support, the two-by-two contrast of residuals with both, one and none of them. It sees an interaction whose terms
tell nothing by themselves. The leading eigenvectors of the contrasts are where the factors start from,
and weights and factors are then fitted jointly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_batches, replace_columns, replaced_schema, sample_ids, slices

HASH_BITS = 20
#: Lengths of the word beginnings that count as terms: inflected and compounded forms share them.
PREFIXES = (4, 5)
#: Training documents of each class at most: a bounded sample, drawn by id hash.
SAMPLE_PER_CLASS = 4000
#: Penalty of a weight, in standard deviations of the term's gradient under chance.
SHRINKAGE = 1.5
#: A pair interacts from so many standard deviations of its contrast on; a term takes part if as many documents
#: as that number's square have it, and as many lack it.
PAIR_DEVIATIONS = 8.0
#: Terms of a block of the search for pairs: bounds the memory of the fit.
BLOCK_TERMS = 512
#: Ridge of weights and of factors in the joint fit, and its steps: what a weight can say is left to it.
RIDGE, FACTOR_RIDGE, STEPS, RATE = 0.1, 1.0, 300, 0.03
FACTORS = 8
#: Distinct white-space-free chunks whose terms a worker remembers.
CACHE_CHUNKS = 200_000
_WORD = re.compile(r"\w+")


def chunk_terms(chunk: str) -> tuple[int, ...]:
    """Hashed terms of a lower-case stretch without white space: its words and their beginnings."""
    terms = []
    for word in _WORD.findall(chunk):
        terms.append("w" + word)
        terms += [f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n]
    return tuple({zlib.crc32(t.encode()) & ((1 << HASH_BITS) - 1) for t in terms})


@dataclass
class FactorizationMachine:
    """score(x) = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, with x_i telling if term i is there."""

    terms: np.ndarray  # sorted hashed terms; position = row of w and v
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Raw scores of documents given as concatenated rows of w and v."""
        w, v = np.append(self.w, 0.0), np.vstack([self.v, np.zeros((1, self.v.shape[1]))])
        flat = np.append(flat, len(self.w))  # an end marker keeps reduceat in range for empty last rows
        ends = np.append(starts[1:], len(flat) - 1)
        filled = ends > starts
        out = np.full(len(starts), self.w0)
        if filled.any():
            at = starts[filled]
            x = v[flat]
            inner = np.add.reduceat(x, at, axis=0) ** 2 - np.add.reduceat(x * x, at, axis=0)
            out[filled] += np.add.reduceat(w[flat], at) + 0.5 * inner.sum(axis=1)
        return out


def logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


@dataclass
class Incidence:
    """Which terms documents have, by term: ``docs[starts[k]:ends[k]]`` are the documents of term k."""

    docs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    n_docs: int

    @classmethod
    def of(cls, documents: list[np.ndarray]) -> tuple[np.ndarray, Incidence]:
        """The distinct terms, sorted, and their incidence."""
        flat = np.concatenate([np.zeros(0, np.int64), *documents])
        terms, flat = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
        ends = np.cumsum(np.bincount(flat, minlength=len(terms)))
        return terms, cls(owner[np.argsort(flat, kind="stable")], np.append(0, ends)[: len(terms)], ends, len(documents))

    def of_term(self, k: int) -> np.ndarray:
        return self.docs[self.starts[k] : self.ends[k]]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """By term, the sum of its documents' values."""
        total = np.append(0.0, np.cumsum(values[self.docs]))
        return total[self.ends] - total[self.starts]

    def rows(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``terms``, document) of every occurrence of these terms."""
        found = [self.of_term(k) for k in terms.tolist()]
        return np.repeat(np.arange(len(terms)), [len(d) for d in found]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *found])

    def dense(self, terms: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n_docs, len(terms)), np.float32)
        for col, k in enumerate(terms.tolist()):
            out[self.of_term(k), col] = 1
        return out


def fit_weights(x: Incidence, y: np.ndarray, penalty: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic regression with absolute penalties, by coordinate steps over the terms that it moves."""
    w, w0 = np.zeros(len(x.starts)), float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(x.n_docs, w0)
    for _ in range(60):
        slope = x.sums(logistic(margin) - y)
        excess = np.where(w == 0, np.abs(slope) - penalty, np.abs(slope + np.sign(w) * penalty)) / penalty
        worst = np.argsort(-excess, kind="stable")[:300]
        worst = worst[excess[worst] > 1e-3]
        if not len(worst):
            break
        active = np.union1d(np.flatnonzero(w), worst).tolist()
        columns = [x.of_term(k) for k in active]
        for _ in range(20):
            step = -4 * (logistic(margin) - y).mean()
            w0, margin, largest = w0 + step, margin + step, 0.0
            for k, docs in zip(active, columns, strict=True):
                p = logistic(margin[docs])
                curve = max(float((p * (1 - p)).sum()), 0.02 * len(docs))
                to = w[k] - float((p - y[docs]).sum()) / curve
                to = np.sign(to) * max(abs(to) - penalty[k] / curve, 0.0)
                step = min(2.0, max(-2.0, to - w[k]))
                if step:
                    w[k] += step
                    margin[docs] += step
                    largest = max(largest, abs(step))
            if largest < 1e-2:
                break
    return w0, w


def interacting_pairs(x: Incidence, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of terms whose residuals show an interaction: both terms, and the contrast in standard deviations."""
    support = x.ends - x.starts
    least = PAIR_DEVIATIONS**2
    terms = np.flatnonzero((support >= least) & (x.n_docs - support >= least))
    r = residual.astype(np.float32)
    n, s, total, spread = support[terms].astype(np.float32), x.sums(residual)[terms].astype(np.float32), float(residual.sum()), float((residual**2).mean())
    power = residual**2
    powers = x.sums(power)[terms]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(terms), BLOCK_TERMS):
        one = x.dense(terms[i : i + BLOCK_TERMS])
        weighted = one * r[:, None]
        n1, s1 = n[i : i + BLOCK_TERMS, None], s[i : i + BLOCK_TERMS, None]
        for j in range(i, len(terms), BLOCK_TERMS):
            other = one if i == j else x.dense(terms[j : j + BLOCK_TERMS])
            n2, s2 = n[None, j : j + BLOCK_TERMS], s[None, j : j + BLOCK_TERMS]
            n11, s11 = one.T @ other, weighted.T @ other
            counts = (n11, n1 - n11, n2 - n11, x.n_docs - n1 - n2 + n11)
            sums = (s11, s1 - s11, s2 - s11, total - s1 - s2 + s11)
            with np.errstate(divide="ignore", invalid="ignore"):
                contrast = sum(sign * b / a for sign, a, b in zip((1, -1, -1, 1), counts, sums, strict=True))
                z = contrast / np.sqrt(spread * sum(1 / a for a in counts))
            z[np.minimum.reduce(counts) < 1] = 0
            p, q = np.nonzero(np.abs(z) >= PAIR_DEVIATIONS)
            inside = terms[i + p] < terms[j + q]
            p, q = p[inside], q[inside]
            # Residuals do not spread alike everywhere: each of the four groups by its own spread, or that of all if less.
            both = np.array([power[np.intersect1d(x.of_term(a), x.of_term(b), assume_unique=True)].sum() for a, b in zip(terms[i + p], terms[j + q], strict=True)])
            one_power, other_power = powers[i + p], powers[j + q]
            squares = (both, one_power - both, other_power - both, power.sum() - one_power - other_power + both)
            own = contrast[p, q] / np.sqrt(sum(np.maximum(sq / a[p, q], spread) / a[p, q] for sq, a in zip(squares, counts, strict=True)))
            strong = np.abs(own) >= PAIR_DEVIATIONS
            found.append((terms[i + p[strong]], terms[j + q[strong]], own[strong].astype(np.float64)))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64 if k < 2 else np.float64) for k in range(3))


def leading_factors(a: np.ndarray, b: np.ndarray, z: np.ndarray, n: int) -> np.ndarray:
    """Factors (n, FACTORS) along the most positive eigenvectors of the symmetric matrix with entries z at (a, b)."""
    shift = float((np.bincount(a, np.abs(z), n) + np.bincount(b, np.abs(z), n)).max()) + 1e-9

    def times(v: np.ndarray) -> np.ndarray:
        out = shift * v
        np.add.at(out, a, z[:, None] * v[b])
        np.add.at(out, b, z[:, None] * v[a])
        return out

    v = np.random.default_rng(42).normal(size=(n, min(n, FACTORS)))
    for _ in range(60):
        v = np.linalg.qr(times(v))[0]
    strength = np.sqrt(np.maximum((v * times(v)).sum(axis=0) - shift, 0))
    v = np.pad(v * strength, ((0, 0), (0, FACTORS - v.shape[1])))
    return 0.5 * v / max(float(np.abs(v).max()), 1e-9)


def fit_jointly(flat: np.ndarray, owner: np.ndarray, y: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weights and factors of the machine by Adam on the whole sample; ``flat`` has the rows of w and v of each document."""
    at = [np.array([w0]), w, v]
    mean, square = [np.zeros_like(p) for p in at], [np.zeros_like(p) for p in at]

    def by(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(keys, column, n) for column in values.T], axis=1)

    for step in range(1, STEPS + 1):
        x = at[2][flat]
        total = by(owner, x, len(y))
        margin = at[0][0] + np.bincount(owner, at[1][flat], len(y)) + 0.5 * ((total**2).sum(axis=1) - np.bincount(owner, (x * x).sum(axis=1), len(y)))
        slope = logistic(margin) - y
        slopes = [
            np.array([slope.sum()]),
            np.bincount(flat, slope[owner], len(w)) + RIDGE * at[1],
            by(flat, slope[owner][:, None] * (total[owner] - x), len(w)) + FACTOR_RIDGE * at[2],
        ]
        for k, g in enumerate(slopes):
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            at[k] = at[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return float(at[0][0]), at[1], at[2]


def fit(documents: list[np.ndarray], labels: np.ndarray, prior: float) -> FactorizationMachine:
    """The machine for documents given by their terms; ``prior`` is the share of label 1 among all labelled rows.

    All terms of the sample are fitted; those left without weight and factors are not kept.
    """
    y = labels.astype(np.float64)
    if not len(documents) or y.min() == y.max():
        share = np.clip(prior if len(documents) else 0.0, 1e-3, 1 - 1e-3)
        return FactorizationMachine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    terms, x = Incidence.of(documents)
    share = y.mean()
    w0, w = fit_weights(x, y, SHRINKAGE * np.sqrt(share * (1 - share) * (x.ends - x.starts)))
    active = np.flatnonzero(w)
    # What the penalty took from the weights is given back before pairs are looked for, or it would look like interactions.
    w0, w, v = fit_jointly(*x.rows(active), y, w0, w[active], np.zeros((len(active), FACTORS)))
    flat, owner = x.rows(active)
    a, b, z = interacting_pairs(x, y - logistic(w0 + np.bincount(owner, w[flat], len(y))))
    if len(a):
        grown = np.unique(np.concatenate([a, b, active]))
        more = np.zeros(len(grown))
        more[np.searchsorted(grown, active)] = w
        active, w = grown, more
        v = leading_factors(np.searchsorted(active, a), np.searchsorted(active, b), z, len(active))
        w0, w, v = fit_jointly(*x.rows(active), y, w0, w, v)
    # The sample holds the classes in other shares than the labelled rows do.
    prior = float(np.clip(prior, 1e-6, 1 - 1e-6))
    w0 += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return FactorizationMachine(terms[active], float(w0), w, v)


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of the sampled documents; of rows that repeat an id the one with the least text hash."""
    least: dict[int, tuple[str, list[int], int]] = {}
    for part in slices(batches):
        for i, text, label in zip(*(part.column(n).to_pylist() for n in ("id", "text", "label")), strict=True):
            rank = xxhash.xxh3_128_hexdigest((text or "").encode())
            if i not in least or rank < least[i][0]:
                least[i] = (rank, sorted({t for c in set((text or "").lower().split()) for t in chunk_terms(c)}), label)
    columns = [list(least), *([x[k] for x in least.values()] for k in range(3))]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int32()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "rank", "terms", "label"])


def train(docs: DataFrame, labels: DataFrame, trainable: Column, label_col: str = "toxic") -> FactorizationMachine:
    """Fit on labelled documents for which ``trainable`` (of ``labels``' doc_id) holds.

    Labels are 0 or 1; other values and nulls are passed over, repeated label rows of an id count as 1 if
    any says so; of repeated documents the one with the least text hash counts. The fit itself sees
    ``SAMPLE_PER_CLASS`` documents of each class at most (lowest id hashes); class shares come from all
    labels. With no label, or one class only, the model is a constant. What reaches the driver is bounded by
    the sample, whatever the number of rows and repeats.
    """
    known = labels.filter(trainable & F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("class"))
    shares = {r["class"]: r["n"] for r in known.groupBy("class").agg(F.count("*").alias("n")).collect()}
    # At most twice SAMPLE_PER_CLASS ids of a few bytes: a bounded side.
    sample = F.broadcast(sample_ids(known, SAMPLE_PER_CLASS).withColumnRenamed("class", "label"))
    joined = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(sample, "id")
    rows = map_batches(joined.select("id", "text", "label"), _document_terms, "id long, rank string, terms array<int>, label int")
    rows = rows.groupBy("id").agg(F.min_by("terms", "rank").alias("terms"), F.max("label").alias("label")).toArrow().sort_by("id")
    found = [np.asarray(t, np.int64) for t in rows.column("terms").to_numpy()]
    return fit(found, np.array(rows.column("label").to_pylist(), dtype=np.int64), shares.get(1, 0) / max(1, sum(shares.values())))


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """Adds ``score`` double (0 to 1) and ``predicted`` int (1 if score >= 0.5) for each whole text.

    Null, empty and blank texts get the score of a document without terms. Input columns named like the
    output are replaced. There is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        row = {int(t): k for k, t in enumerate(fm.terms)}
        known: dict[str, tuple[int, ...]] = {}
        none: tuple[int, ...] = ()
        for part in slices(batches):
            docs_rows = []
            for text in part.column(text_col).to_pylist():
                active: set[int] = set()
                for chunk in set((text or "").lower().split()):
                    found = known.get(chunk)
                    if found is None:
                        found = tuple(row[t] for t in chunk_terms(chunk) if t in row) or none
                        if len(known) >= CACHE_CHUNKS:
                            known.clear()
                        known[chunk] = found
                    active.update(found)
                docs_rows.append(sorted(active))
            lens = np.array([len(r) for r in docs_rows], dtype=np.int64)
            starts = np.concatenate(([0], np.cumsum(lens)[:-1])) if len(lens) else lens
            flat = np.fromiter((x for r in docs_rows for x in r), np.int64, int(lens.sum()))
            scores = 1 / (1 + np.exp(-np.clip(fm.margins(flat, starts), -500, 500)))
            yield replace_columns(part, {"score": pa.array(scores), "predicted": pa.array((scores >= 0.5).astype(np.int32))})

    return map_batches(docs, run, replaced_schema(docs, fields))
