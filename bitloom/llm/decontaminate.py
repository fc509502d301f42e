"""Benchmark decontamination: Wu-Manber search for windows of benchmark words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import checkpoint, text_bytes

#: Words of the benchmark that one matcher holds; a larger benchmark is searched for in blocks.
BLOCK_WORDS = 1_000_000
#: Blocks that are searched for in one pass over the documents.
BLOCKS_A_PASS = 4

# Bytes of words: digits, lower-case letters (upper case is folded before) and all of non-ASCII.
_TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased; none for null."""
    return data.lower().translate(_TO_WORDS).split() if data else []


class WuManber:
    """Multi-pattern search in which words are the symbols.

    All patterns of one length share a shift table over blocks of two words (one for patterns of one
    word). A block that ends no pattern prefix lets the search jump by up to length-1 words; a block
    that ends a pattern selects its bucket, and the words are then compared directly.
    """

    def __init__(self, patterns: Iterable[tuple[tuple[bytes, ...], int]]):
        by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for words, item in patterns:
            owners = by_length.setdefault(len(words), {}).setdefault(words, [])
            if item not in owners:
                owners.append(item)
        self.groups = []
        for length, found in sorted(by_length.items()):
            width = min(2, length)
            shift: dict[bytes, int] = {}
            buckets: dict[bytes, dict[bytes, list[tuple[list[bytes], list[int]]]]] = {}
            for words, owners in found.items():
                for end in range(width, length + 1):
                    block = b" ".join(words[end - width : end])
                    shift[block] = min(shift.get(block, length), length - end)
                last = b" ".join(words[length - width :])
                buckets.setdefault(last, {}).setdefault(words[0], []).append((list(words), owners))
            self.groups.append((length, width, shift, buckets))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, number of words, items) of every occurrence of every pattern."""
        n = len(text)
        for length, width, shift, buckets in self.groups:
            far, at, get = length - width + 1, length - 1, shift.get
            while at < n:
                block = text[at - 1] + b" " + text[at] if width == 2 else text[at]
                jump = get(block, far)
                if jump:
                    at += jump
                    continue
                first = at - length + 1
                for words, owners in buckets[block].get(text[first], ()):
                    if text[first : at + 1] == words:
                        yield first, length, owners
                at += 1


def windows(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """All windows of ``width`` consecutive words; a shorter non-empty text is one window."""
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


_HITS = "n_words long, spans array<long>, items array<string>"


def _scan(blocks):
    """Adds n_words, covered word spans (start, end, start, end ...) and items to each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [b.value for b in blocks]
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("_bytes"))
            old_spans, old_items = batch.column(names.index("spans")), batch.column(names.index("items"))
            counts, spans, items = [], [], []
            for k, text in enumerate(texts):
                words = words_of(text.as_py())
                hits, found = [], set()
                for matcher, ids in matchers:
                    for first, length, owners in matcher.search(words):
                        hits.append((first, first + length))
                        found.update(ids[o] for o in owners if ids[o] is not None)
                before = old_spans[k].as_py()
                hits += zip(before[::2], before[1::2])
                counts.append(len(words))
                spans.append(_merged(hits))
                items.append(sorted(found.union(old_items[k].as_py())))
            new = {
                "n_words": pa.array(counts, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.int64())),
                "items": pa.array(items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

    return run


def _merged(hits: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(hits):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _searched(docs: DataFrame, benchmark: DataFrame, width: int, block_words: int) -> DataFrame:
    """(row: all columns of docs, n_words, spans, items)."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), text_bytes().alias("words"))
    size = bench.agg(F.sum(F.octet_length("words")).alias("b")).first()["b"] or 0
    n_blocks = max(1, -(-size // (6 * block_words)))
    bench = bench.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)))
    out = docs.select(
        F.struct("*").alias("row"),
        text_bytes().alias("_bytes"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for first in range(0, n_blocks, BLOCKS_A_PASS):
        blocks = []
        for b in range(first, min(first + BLOCKS_A_PASS, n_blocks)):
            rows = bench.where(F.col("block") == b).distinct().select("item", "words").collect()
            patterns = ((w, k) for k, r in enumerate(rows) for w in windows(words_of(bytes(r.words or b"")), width))
            blocks.append(spark.sparkContext.broadcast((WuManber(patterns), [r.item for r in rows])))
        out = out.mapInArrow(_scan(blocks), out.schema)
        if first + BLOCKS_A_PASS < n_blocks:
            out = checkpoint(out)
    return out.drop("_bytes")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` with n_words, spans (array: start, end, ... of covered words) and items (sorted ids as text).

    Row-wise: no row of ``docs`` is moved, dropped or merged, whatever its id. The benchmark is split
    into blocks of about ``block_words`` words by a hash of its rows; each block becomes one broadcast
    matcher of bounded size, and the documents are scanned by up to BLOCKS_A_PASS blocks at a time,
    with a checkpoint after each such pass. Null texts have no words; an item without words matches
    nothing; an item with a null id covers words but is not listed; an empty benchmark hits nothing.
    Columns of ``docs`` named like the new ones are replaced.
    """
    new = ("n_words", "spans", "items")
    return _searched(docs, benchmark, width, block_words).select(
        *(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new), *new
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op6: one row per document with its hit words and the benchmark items that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    pairs = F.sequence(F.lit(0), F.greatest(F.size("spans") - 2, F.lit(0)), F.lit(2))
    hit = F.when(
        F.size("spans") > 0,
        F.aggregate(pairs, F.lit(0).cast("long"), lambda a, i: a + F.get("spans", i + 1) - F.get("spans", i)),
    ).otherwise(F.lit(0).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark window go; all others stay as they are."""
    found = _searched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, BLOCK_WORDS)
    return found.where(F.size("spans") == 0).select("row.*")


#: The same rows from DuckDB, by joining all windows of documents with those of the benchmark.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS l, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lengths WHERE len(w) >= l)),
hits AS (SELECT doc_id, dw.l AS l, i, item FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
