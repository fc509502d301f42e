"""Language ID: TF-IDF n-gram vectors against several centroids per language, with rejection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import checkpoint, in_fold, small_join, text_bytes

#: Hashed byte n-grams (of lengths 1 to 3) fall into so many dimensions.
DIMENSIONS = 4096
#: Labelled texts per language that the centroids are fitted on (in expectation), and centroids per language.
ROWS_A_LANGUAGE, CENTROIDS = 400, 4
#: A text whose best cosine is below this is rejected (reported; the nearest language is still named).
REJECT_BELOW = 0.2
UNKNOWN = "und"

# Digits, punctuation and spaces all become one space; upper-case A-Z is folded before.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a text that are counted at a time.
_PIECE = 1 << 18


def counts(data: bytes) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    out = np.zeros(DIMENSIONS)
    text = b" " + b" ".join(data.lower().translate(_LETTERS).split()) + b" "
    for at in range(0, max(1, len(text) - 2), _PIECE):
        b = np.frombuffer(text[at : at + _PIECE + 2], np.uint8).astype(np.uint32)
        grams = [b[: _PIECE if at + _PIECE + 2 < len(text) else None] + np.uint32(1 << 24)]
        if len(b) > 1:
            grams.append((b[:-1] << np.uint32(8) | b[1:])[:_PIECE] + np.uint32(2 << 24))
        if len(b) > 2:
            grams.append((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:])[:_PIECE] + np.uint32(3 << 24))
        for g in grams:
            out += np.bincount((g * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=DIMENSIONS)
    return out


def vector(data: bytes, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector; zeros where nothing has weight."""
    v = np.log1p(counts(data)) * idf
    return v / (np.linalg.norm(v) or 1.0)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """idf of every dimension over all of ``texts`` (one binary column): a fixed-size sum per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total[:-1] += counts(t.as_py() or b"") > 0
                total[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["dim", "n"])

    rows = texts.mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(DIMENSIONS + 1)
    n[rows["dim"]] = rows["n"]
    return np.log((1 + n[-1]) / (1 + n[:-1]))


def _cluster(idf):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means of one language's bounded sample, from spread-out starts."""
        rows = rows.sort_values("text")
        x = np.stack([vector(t, idf) for t in rows["text"]])
        centers = x[:1]
        while len(centers) < min(CENTROIDS, len(x)):
            centers = np.concatenate([centers, x[[np.argmin((x @ centers.T).max(axis=1))]]])
        for _ in range(8):
            own = np.argmax(x @ centers.T, axis=1)
            sums = np.stack([x[own == k].sum(axis=0) for k in range(len(centers))])
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(length > 0, sums / np.where(length > 0, length, 1), centers)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "center": list(centers)})

    return run


def train(docs: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE):
    """(languages of the centroids, centroid matrix, idf), from rows outside the fold crc32 mod 4 = 2.

    The idf covers all training texts. The centroids are fitted on a sample, thinned by a hash to about
    ``rows_a_language`` texts of each language; sizes are counted first, on narrow columns.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(~in_fold(F.col("doc_id"), 4, 2))
    rows = rows.where(F.col("text").rlike("\\p{L}"))
    sizes = checkpoint(rows.groupBy("lang").agg(F.count("*").alias("n")))
    idf = inverse_frequencies(rows.select(text_bytes().alias("text")))
    share = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1_000_000)) / 1e6
    drawn = small_join(rows, sizes, "lang", "inner", sizes.count()).where(share < rows_a_language / F.col("n"))
    found = drawn.select("lang", text_bytes().alias("text")).groupBy("lang").applyInPandas(_cluster(idf), "lang string, center array<double>")
    found = found.toPandas().sort_values("lang", kind="stable")
    return found["lang"].tolist(), np.stack(found["center"].tolist()) if len(found) else np.zeros((0, DIMENSIONS)), idf


def identify(docs: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs``.

    lang_pred is the language of the nearest centroid, `und` if the text is null or has no letter or
    nothing was learned; score its cosine, between 0 and 1. rejected marks texts too far from all
    centroids. Ties go to the language first in order. Rows stay in place.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, rows_a_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, centers, idf = shared.value
        for batch in batches:
            names, scores = [], []
            for letters, t in zip(batch.column(2).to_pylist(), batch.column(3)):
                if not letters or not languages:
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                near = centers @ vector(t.as_py(), idf)
                best = int(np.argmax(near))
                names.append(languages[best]), scores.append(float(min(1.0, max(0.0, near[best]))))
            far = pa.array([s < REJECT_BELOW for s in scores], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), far],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = docs.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), letters.alias("letters"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the language of all documents."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
