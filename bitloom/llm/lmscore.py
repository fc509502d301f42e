"""LM scoring: marginal probability of a document over all segmentations into subwords."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import checkpoint, in_fold, text_bytes

#: Public vocabulary whose piece scores weigh the segmentations; a parameter of ``score``.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The end of a text as a token; no word holds a line feed.
END = b"\n"
#: Start of a word in the vocabulary.
MARK = "▁".encode()
#: Words that are broadcast with their scores, at most; the others are joined.
FREQUENT = 1 << 17
#: Weight of the vocabulary's own scores against expected counts, in pieces.
PRIOR_PIECES = 10_000.0
#: Distinct words that a task gathers before it passes their counts on.
FLUSH = 200_000


def load_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces and log-probabilities from the scores of a public vocabulary.

    Such scores order the pieces by merge rank, not by probability; as frequency falls about with the
    rank, a piece of score -r weighs 1 / (r + 1). Byte pieces (one for each byte, so that every word has
    a segmentation) share the weight of the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, weights = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        pieces.append(model.id_to_piece(i).encode())
        weights.append(1.0 / (1.0 + abs(model.get_score(i))))
    single = {p for p in pieces if len(p) == 1}
    for b in range(256):
        if bytes([b]) not in single:
            pieces.append(bytes([b]))
            weights.append(min(weights) if weights else 1.0)
    w = np.array(weights)
    return pieces, np.log(w / w.sum())


class Lattice:
    """All segmentations of a word, with pieces in a prefix table."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.table: dict[bytes, tuple[int, float] | None] = {}
        for i, p in enumerate(pieces):
            for n in range(1, len(p)):
                self.table.setdefault(p[:n], None)
            self.table[p] = (i, float(logs[i]))

    def arcs(self, word: bytes) -> list[tuple[int, int, int, float]]:
        """(start, end, piece, log-probability), by start."""
        data, get, out = MARK + word, self.table.get, []
        table = self.table
        for s in range(len(data)):
            for e in range(s + 1, len(data) + 1):
                part = data[s:e]
                if part not in table:
                    break
                hit = get(part)
                if hit:
                    out.append((s, e, *hit))
        return out

    @staticmethod
    def forward(arcs, n: int) -> list[float]:
        """Log of the summed weight of all ways to each position."""
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        exp, log1p = math.exp, math.log1p
        for s, e, _, w in arcs:
            x, a = alpha[s] + w, alpha[e]
            alpha[e] = x if a == -math.inf else a + log1p(exp(x - a)) if a > x else x + log1p(exp(a - x))
        return alpha

    def log10(self, word: bytes) -> float:
        """Marginal log10-probability of a word."""
        n = len(MARK) + len(word)
        return self.forward(self.arcs(word), n)[n] / math.log(10)

    def expect(self, word: bytes, times: float, into: np.ndarray) -> None:
        """Adds the expected uses of each piece in ``times`` occurrences of a word."""
        arcs, n = self.arcs(word), len(MARK) + len(word)
        alpha = self.forward(arcs, n)
        beta = [-math.inf] * (n + 1)
        beta[n] = 0.0
        exp, log1p = math.exp, math.log1p
        for s, e, i, w in reversed(arcs):
            x, b = beta[e] + w, beta[s]
            if x > -math.inf:
                into[i] += times * exp(alpha[s] + x - alpha[n])
                beta[s] = x if b == -math.inf else b + log1p(exp(x - b)) if b > x else x + log1p(exp(b - x))


def words_of(data: bytes | None) -> list[bytes]:
    """A-Z lower-cased words of a text."""
    return data.lower().split() if data else []


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c): occurrences in training texts, summed in the task; 0 for words of held-out texts only."""
    total: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "c"])
        total.clear()
        return out

    for batch in batches:
        for held, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = [*words_of(text.as_py()), END]
            if held:
                for w in set(words):
                    total.setdefault(w, 0)
            else:
                total.update(words)
            if len(total) > FLUSH:
                yield flush()
    yield flush()


def _expectations(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logs = vocabulary.value
        lattice, into = Lattice(pieces, logs), np.zeros(len(pieces))
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lattice.expect(w, c, into)
        used = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(into[used])], names=["piece", "n"])

    return run


def _marginals(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logs, end = vocabulary.value
        lattice = Lattice(pieces, logs)
        for batch in batches:
            marginal = [end if w == END else lattice.log10(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marginal, pa.float64())], names=["word", "c", "lattice"])

    return run


def learn(rows: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, int, int]:
    """(word table: word, c, lattice; N; V) from ``rows`` (held_out, text as bytes).

    Counts of all training tokens are grouped by word. Since no piece spans a space, the marginal of a
    text is the product of those of its words, so the lattices are run once per distinct word, on the
    executors. The vocabulary's scores weigh the segmentations of all training words; the expected uses
    of its (fixed) pieces then give their probabilities, with the scores as prior. Only sums by piece,
    as many as the vocabulary has, come to the driver.
    """
    sc = rows.sparkSession.sparkContext
    table = rows.mapInArrow(_word_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    table = checkpoint(table)
    size = table.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"),
        F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0)).alias("ends"),
    ).first()
    pieces, logs = load_vocabulary(vocabulary)
    words = table.where((F.col("c") > 0) & (F.col("word") != F.lit(END)))
    found = words.mapInArrow(_expectations(sc.broadcast((pieces, logs))), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    uses = PRIOR_PIECES * np.exp(logs)
    uses[found["piece"].to_numpy(int)] += found["n"].to_numpy(float)
    total = uses.sum() + size.ends + 1
    model = sc.broadcast((pieces, np.log(uses / total), math.log10((size.ends + 1) / total)))
    return checkpoint(table.mapInArrow(_marginals(model), "word binary, c long, lattice double")), size.n, size.v


def _score_rows(frequent, n: int, v: int):
    """A row of sums for each text, and one for each word that is not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = frequent.value.get
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            sums: list[list] = [[], [], [], []]
            for k, text in enumerate(batch.column(3)):
                known, base, lattice, tokens = 0, 0.0, 0.0, 0
                own = Counter(words_of(text.as_py()))
                own[END] += 1
                for w, m in own.items():
                    tokens += m
                    hit = get(w)
                    if hit is None:
                        out[0].append(k), out[1].append(w), out[2].append(m)
                        for x, zero in zip(sums, (0, 0, 0.0, 0.0)):
                            x.append(zero)
                    else:
                        known += m * hit[0]
                        base += m * hit[1]
                        lattice += m * hit[2]
                # The text's own row has a key that is no word, so that such rows spread evenly.
                out[0].append(k), out[1].append(b" %d %d" % (batch.column(1)[k].as_py(), k)), out[2].append(0)
                for x, y in zip(sums, (tokens, known, base, lattice)):
                    x.append(y)
            at = pa.array(out[0], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(at) for i in range(3)), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()),
                 pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), pa.array(sums[2], pa.float64()), pa.array(sums[3], pa.float64())],
                names=["doc_id", "h", "held_out", "word", "m", "tokens", "known", "base", "lattice"],
            )

    return run


def score(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Texts of the fold crc32(doc_id) mod 7 = 2 teach nothing. score is the log10-probability of the text
    under the subword lattice with an end; base_score that of add-one word counts. Null texts are empty:
    the end alone. Words of up to FREQUENT most frequent ones (whole powers of two of the count) are
    broadcast with their scores, the others are joined by word, so no frequent word gathers its texts in
    one task. Rows of one id and text are summed together and shared out again, so repeated rows and
    null ids keep their number.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), in_fold(F.col("doc_id"), 7, 2).alias("held_out"), text_bytes().alias("text")
    )
    words, n, v = learn(rows.select("held_out", "text"), vocabulary)
    levels = words.groupBy(F.floor(F.log2(F.col("c") + 1)).alias("level")).agg(F.count("*").alias("n")).collect()
    floor, held = 64, 0
    for r in sorted(levels, key=lambda r: -r.level):
        held += r.n
        if held > FREQUENT:
            break
        floor = r.level
    often = F.floor(F.log2(F.col("c") + 1)) >= floor
    base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    worth = words.select("word", (F.col("c") > 0).cast("long").alias("k"), base.alias("b"), F.col("lattice").alias("l"), often.alias("often"))
    top = worth.where("often").select("word", "k", "b", "l").toPandas()
    frequent = docs.sparkSession.sparkContext.broadcast({bytes(w): (k, b, l) for w, k, b, l in top.itertuples(index=False)})
    parts = rows.mapInArrow(
        _score_rows(frequent, n, v),
        "doc_id long, h long, held_out boolean, word binary, m long, tokens long, known long, base double, lattice double",
    )
    joined = parts.join(worth.where("not often").drop("often"), "word", "left")
    add = lambda c, w: F.sum(F.col(c) + F.coalesce(F.col("m") * F.col(w), F.lit(0)))
    sums = joined.groupBy("doc_id", "h", "held_out").agg(
        F.sum("tokens").alias("tokens"), F.count(F.when(F.col("m") == 0, 1)).alias("rows"),
        add("known", "k").alias("known"), add("base", "b").alias("base"), add("lattice", "l").alias("lattice"),
    )
    each = lambda c: (F.col(c) / F.col("rows")).alias(c)
    one = sums.select("doc_id", "held_out", *map(each, ("tokens", "known", "base", "lattice")), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return one.select(
        "doc_id", "held_out", F.col("tokens").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lattice").alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op4: log10-probabilities of all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
