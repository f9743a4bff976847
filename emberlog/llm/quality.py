"""Document quality by regularised quadratic discriminant analysis.

Each class is a normal density over transformed document statistics, with a mean and a covariance shrunk towards the
pooled one and its diagonal. The score is the class-1 probability, from the difference of the log densities, whose
Mahalanobis terms use Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .textvec import LOWER, chunks, mix, words

#: The statistics, in order.
STATISTICS = (
    "log_words", "word_length", "word_length_spread", "distinct_words", "distinct_pairs", "top_word", "upper", "digit",
    "symbol", "marked_words", "line_words", "repeated_lines", "byte_entropy", "long_words",
)
_KIND = np.zeros(256, np.int64)  # 0 lower case and bytes of other letters, 1 upper, 2 digit, 3 common marks, 4 symbols
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[[x for x in range(33, 127) if not chr(x).isalnum()]] = 4
_KIND[[ord(x) for x in ".,;:'\"-?()"]] = 3
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _logit(share: np.ndarray, least: float = 0.002) -> np.ndarray:
    p = np.clip(share, least, 1 - least)
    return np.log(p / (1 - p))


def _runs(doc: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document and the count of its most frequent one."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(d))))
    return np.bincount(d[at], minlength=docs), most


def statistics(text: pa.Array) -> np.ndarray:
    """Transformed statistics of whole texts, a row each. Null and empty texts count as having no words."""
    out = []
    for c in chunks(text):
        docs = len(c.end)
        w = words(c, LOWER[c.data])
        n = np.diff(w.first).astype(float)
        safe = np.maximum(n, 1)
        length = (w.end - w.start).astype(float)
        mean = np.bincount(w.doc, length, docs) / safe
        spread = np.sqrt(np.maximum(np.bincount(w.doc, length**2, docs) / safe - mean**2, 0))
        distinct, top = _runs(w.doc, w.hash, docs)
        pair = np.flatnonzero(w.doc[1:] == w.doc[:-1])
        pairs, _ = _runs(w.doc[pair], mix(w.hash[pair] * np.uint64(3) + w.hash[pair + 1]), docs)
        at = np.repeat(np.arange(docs), c.end - c.start)
        kinds = np.bincount(at * 5 + _KIND[c.data], minlength=docs * 5).reshape(docs, 5)
        counts = np.bincount(at * 256 + c.data, minlength=docs * 256).reshape(docs, 256)
        solid = np.maximum((c.end - c.start) - counts[:, [9, 10, 11, 12, 13, 32]].sum(axis=1), 1)
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
        marked = np.bincount(w.doc, _KIND[c.data[w.end - 1]] == 4, docs)
        lines = words(c, None, _NEWLINE)
        line_n = np.maximum(np.diff(lines.first), 1)
        line_distinct, _ = _runs(lines.doc, lines.hash, docs)
        long_words = np.bincount(w.doc, length > 18, docs)
        out.append(
            np.stack(
                [
                    np.log1p(n), np.log1p(mean), np.log1p(spread), np.log1p(distinct) - np.log1p(n), np.log1p(pairs) - np.log1p(np.maximum(n - 1, 0)), _logit(top / safe),
                    _logit(kinds[:, 1] / solid), _logit(kinds[:, 2] / solid), _logit(kinds[:, 4] / solid), _logit(marked / safe),
                    np.log1p(n / line_n), _logit(1 - np.maximum(line_distinct, 1) / line_n), entropy, _logit(long_words / safe),
                ],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


@dataclass
class QualityModel:
    """Means, Cholesky factors (inverted), log determinants and log prior of classes 0 and 1."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.inverse[k].T
            logs.append(self.log_prior[k] - 0.5 * ((z**2).sum(axis=1) + self.log_det[k]))
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) * self.temper, -700, 700)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) with the statistics of every row's whole text."""
    d = len(STATISTICS)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float64()))], [id_col, "x"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(stats, StructType([rows.schema[0], StructField("x", ArrayType(DoubleType()))]))


def fit(docs: DataFrame, labels: DataFrame, shrink: float = 0.3, ridge: float = 0.005, temper: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on all rows of ``docs`` that ``labels`` (doc_id, quality) names and whose crc32 of the id modulo 4 isn't 2.

    ``docs`` may be what ``measured`` has made of them. Only sums go to the driver: two classes times the squared number
    of statistics. ``shrink`` moves each covariance towards the pooled one, ``ridge`` adds to its diagonal a part of the
    pooled variances; ``temper`` flattens the log-density difference, as the statistics aren't normal in fact. Null ids
    have no label; rows that repeat an id count each; of several labels of an id the greatest counts. Without labels of
    both classes, or without rows, the score is the smoothed share of class 1.
    """
    d = len(STATISTICS)
    wanted = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("did")).agg(F.max("quality").alias("y"))
    held = F.crc32(F.col(id_col).cast("string")) % 4 == 2
    known = docs.where(F.col(id_col).isNotNull() & ~held)
    known = known if text_col not in docs.columns else measured(known, id_col, text_col)
    joined = known.select(F.col(id_col).cast("long").alias("did"), "x").join(wanted, "did").select("y", "x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k in (0, 1):
                m = x[y == k]
                total[k] += np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()])
        k, at = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(at.ravel()), pa.array(total.ravel())], ["k", "at", "v"])

    got = np.zeros((2, 1 + d + d * d))
    for r in joined.mapInArrow(sums, "k long, at long, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).collect():  # 2 x (1 + d + d*d) numbers
        got[r.k, r["at"]] = r.v
    n = got[:, 0]
    if not n.all():
        share = np.log((n + 1) / (n.sum() + 2))
        return QualityModel(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), share, 1.0)
    mean = got[:, 1 : 1 + d] / n[:, None]
    cov = got[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    inverse, log_det = [], []
    for k in (0, 1):
        s = (1 - shrink) * cov[k] + shrink * pooled + ridge * np.diag(np.diag(pooled) + 1e-6)
        factor = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return QualityModel(mean, np.array(inverse), np.array(log_det), np.log(n / n.sum()), temper)


def with_score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All rows and columns of ``docs`` and the score of each whole text, 0 to 1; ``docs`` may be what ``measured`` has made
    of them. Null and empty texts get one too, repeated rows the same one; an empty table gives an empty one. A column
    named like the score is replaced."""
    docs = docs.drop(score_col)
    given = text_col not in docs.columns  # rows that are measured already
    at = docs.columns.index("x" if given else text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)) if given else statistics(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))
