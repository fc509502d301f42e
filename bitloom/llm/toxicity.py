"""Toxicity from class-conditional Kneser-Ney models of words, with shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import kernels
from bitloom.llm.common import checkpoint, in_fold, text_bytes

#: Labelled training rows of each class that are drawn (in expectation; fewer if a class has fewer), by
#: a hash of the id.
ROWS_A_CLASS = 6000
#: Absolute discount of counts of texts.
DISCOUNT = 2
#: Share of the drawn rows that calibrate the scores instead of being counted.
CALIBRATE = 0.25
#: Lengths in bytes of the beginnings that a word's probability passes through.
STEMS = (2, 3, 4, 5, 6, 7, 8, 10, 12)
#: Share of a toxic text's words that the toxic model gives; the ordinary model gives the others.
TOXIC_WORDS = 0.01
#: Most that a text's typical word may shift its log-ratios by: what language and form say of the class.
SHIFT = 1.0
#: Share of toxic documents that calibration takes as usual; scores from TOXIC_FROM on count as toxic.
USUAL, TOXIC_FROM = 0.1, 0.3

# Bytes that stay: letters and digits, spaces and all of non-ASCII; the rest separates words.
_PLAIN = bytes(b if b >= 0x80 or bytes([b]).isalnum() or b in b"\t\n\v\f\r " else 0x20 for b in range(256))


def _nodes(data: bytes):
    """(number of words, [(which words, nodes, parents), ...]) of each piece of a text.

    A node is a beginning of a word or the whole word; its parent is the next shorter one, the root 0.
    """
    for n, found in kernels.stems(data.lower().translate(_PLAIN), STEMS):
        last, out = np.zeros(n, np.uint64), []
        for which, nodes in found:
            out.append((which, nodes, last[which]))
            last[which] = nodes
        yield n, out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, parent, toxic, n): how many labelled texts of each batch hold the node."""
    for batch in batches:
        parts = []
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = [np.stack([nodes, parents]) for _, out in _nodes(text.as_py() or b"") for _, nodes, parents in out]
            if own:
                nodes, once = np.unique((own := np.concatenate(own, axis=1))[0], return_index=True)
                parts.append(np.stack([nodes, own[1][once], np.full(len(nodes), toxic, np.uint64)]))
        if parts:
            rows, n = np.unique(np.concatenate(parts, axis=1), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.view(np.int64)) for x in np.ascontiguousarray(rows)), pa.array(n)], names=["node", "parent", "toxic", "n"]
            )


class KneserNey:
    """Log-ratios log P(node | toxic) - log P(node | plain), as sorted hashes, and what a node's rare followers get.

    A word's probability is the product over its beginnings of P_c(node | parent) =
    (max(n_c(node) - D, 0) + R_c * B(node | parent)) / N_c, where c is the class, n_c the number of distinct
    texts of the class that the node continues its parent in, N_c the sum of n_c over the parent's nodes,
    R_c what the discounts take off there (and one pseudo-count), and B the share of the node in both
    classes' counts together. B is shared, so a node that neither class has more than D times has the ratio
    R_1 / N_1 to R_0 / N_0 of its parent, whatever B is: such nodes need no place in the model, and nor do
    those that training lacks. What follows a rare node says nothing, as all of its counts are taken off.
    """

    def __init__(self, nodes: np.ndarray, ratios: np.ndarray, rest: np.ndarray):
        self.nodes, self.ratios, self.rest = nodes, ratios, rest

    def log_ratios(self, data: bytes) -> np.ndarray:
        """Log-likelihood ratio of each word of a text."""
        parts = [np.empty(0)]
        for n, out in _nodes(data):
            words = np.zeros(n)
            last = np.full(n, np.searchsorted(self.nodes, np.uint64(0)))  # where the word's beginning so far is; -1: rare
            for which, nodes, _ in out:
                on = last[which] >= 0
                which, nodes = which[on], nodes[on]
                at = np.minimum(np.searchsorted(self.nodes, nodes), len(self.nodes) - 1)
                hit = self.nodes[at] == nodes
                words[which[hit]] += self.ratios[at[hit]]
                last[which[hit]] = at[hit]
                rare = which[~hit]
                words[rare] += self.rest[last[rare]]
                last[rare] = -1
            parts.append(words)
        return np.concatenate(parts)


def training_rows(docs: DataFrame, labels: DataFrame, rows_a_class: int = ROWS_A_CLASS) -> DataFrame:
    """(toxic, text) of a bounded, repeatable sample of the labelled rows outside the held-out fold.

    Class sizes are counted on the labels; each class is thinned by a hash to about ``rows_a_class`` rows at
    most. The ids that are broadcast, and the model, thus stay bounded however many labels there are.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~in_fold(F.col("doc_id"), 4, 2))
    known = known.select("doc_id", "toxic").distinct()
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) / 1e6
    keep = F.lit(False)
    for c, n in counts.items():
        keep = keep | ((F.col("toxic") == c) & (share < min(1.0, rows_a_class / n)))
    drawn = known.where(keep).withColumnRenamed("doc_id", "_labelled")
    rows = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("_labelled"))
    return rows.select(F.col("toxic").cast("int").alias("toxic"), "text")


def _logs(node: DataFrame) -> DataFrame:
    """(parent, all, rest, and N_c and R_c of each class) of all parents of nodes (node, parent, one, zero)."""
    sums = [F.sum(c).alias(f"n_{c}") for c in ("one", "zero")] + [(F.sum(F.least(c, F.lit(float(DISCOUNT)))) + 1).alias(f"r_{c}") for c in ("one", "zero")]
    by = node.groupBy("parent").agg(*sums).withColumns({"n_one": F.col("n_one") + 1, "n_zero": F.col("n_zero") + 1})
    return by.withColumn("rest", F.log("r_one") - F.log("n_one") - F.log("r_zero") + F.log("n_zero"))


def model_table(counts: DataFrame) -> DataFrame:
    """(node, ratio, rest) of the root 0 and of all nodes that a class has more than DISCOUNT times."""
    nodes = counts
    by = _logs(nodes)
    p = lambda c: (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + F.col(f"r_{c}") * F.col("b")) / F.col(f"n_{c}")
    known = nodes.where(F.greatest("one", "zero") > DISCOUNT).join(by.drop("rest"), "parent")
    known = known.withColumn("b", (F.col("one") + F.col("zero")) / (F.col("n_one") + F.col("n_zero") - 2))
    known = known.select("node", (F.log(p("one")) - F.log(p("zero"))).alias("ratio")).unionByName(nodes.sparkSession.range(1).select(F.col("id").alias("node"), F.lit(0.0).alias("ratio")))
    rest = by.select(F.col("parent").alias("node"), "rest")
    return known.join(rest, "node", "left").select("node", "ratio", F.coalesce("rest", F.lit(0.0)).alias("rest"))


def train(rows: DataFrame) -> tuple[KneserNey, tuple[float, float]] | None:
    """The model and its calibration (slope, offset); None without counts of both classes.

    ``rows`` is bounded (see training_rows), and so is what comes to the driver: the nodes that more than
    DISCOUNT texts of a class hold, 16 bytes each. All others are in the backoff of their parents.
    """
    held = F.pmod(F.xxhash64(F.lit("calibrate"), "text"), F.lit(1_000_000)) < CALIBRATE * 1e6
    counts = rows.where(~held).mapInArrow(_counts, "node long, parent long, toxic long, n long")
    n = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).cast("double")
    counts = checkpoint(counts.groupBy("node", "parent").agg(n(1).alias("one"), n(0).alias("zero")))
    seen = counts.agg(F.max("one").alias("one"), F.max("zero").alias("zero")).first()
    if not (seen.one and seen.zero):
        return None
    got = model_table(counts).withColumns({c: F.col(c).cast("float") for c in ("ratio", "rest")}).toPandas()
    nodes = got["node"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(nodes)
    model = KneserNey(nodes[order], *(got[c].to_numpy(np.float32)[order] for c in ("ratio", "rest")))
    return model, _calibrate(rows.where(held), model)


def feature(words: np.ndarray) -> float:
    """Signed root of the difference of length-normalised log-likelihoods, toxic less ordinary; 0 without words.

    Few words make a text toxic: in the toxic class a word comes from the toxic model with probability
    TOXIC_WORDS and else from the ordinary one, so ordinary words count against toxicity, each a little.
    What language and form say of the class is in the median word; it is taken off up to SHIFT, which
    leaves words of a wholly toxic text far above it.
    """
    if not len(words):
        return 0.0
    shift = np.clip(np.median(words), -SHIFT, SHIFT)
    mean = np.log1p(TOXIC_WORDS * np.expm1(np.minimum(words - shift, 20.0))).mean()
    return float(np.sign(mean) * np.sqrt(abs(mean)))


def _calibrate(rows: DataFrame, model: KneserNey) -> tuple[float, float]:
    """Logistic regression of the class on the feature, over bounded rows that the model hasn't counted.

    Two numbers a row come to the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            f = [feature(shared.value.log_ratios(t.as_py() or b"")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.float64())], names=["toxic", "f"])

    got = rows.mapInArrow(run, "toxic int, f double").toPandas()
    x, y = got["f"].to_numpy(), got["toxic"].to_numpy(float)
    if not len(x) or y.min() == y.max():
        return 1.0, float(np.log(USUAL / (1 - USUAL)))
    scale = float(x.std()) or 1.0
    x = x / scale
    w = np.where(y == 1, USUAL / y.mean(), (1 - USUAL) / (1 - y.mean()))
    a, b = 0.0, float(np.log(USUAL / (1 - USUAL)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + 1e-2 * a, (w * (p - y)).sum()])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a - float(step[0]), b - float(step[1])
    return a / scale, b


def toxicity(docs: DataFrame, labels: DataFrame, rows_a_class: int = ROWS_A_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Only rows outside the fold crc32(doc_id) mod 4 = 2 teach; a score depends on the text alone.
    Null and empty texts get the score of a text that says nothing. Without labels of both classes all
    scores are 0; no documents give no rows. Rows stay in place, so repeated and null ids do no harm and other
    columns are not looked at; repeated labels count once, an id labelled both ways counts in both classes.
    """
    fitted = train(training_rows(docs, labels, rows_a_class))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        model, (a, b) = shared.value or (None, (0.0, 0.0))
        for batch in batches:
            f = np.array([feature(model.log_ratios(t.as_py() or b"")) if model else 0.0 for t in batch.column(2)], float)
            score = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30))) if model else f
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= TOXIC_FROM).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: toxicity of all documents."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
