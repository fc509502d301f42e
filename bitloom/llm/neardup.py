"""MinHash near-duplicates: band candidates, b-bit estimates, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm import kernels
from bitloom.llm.common import checkpoint, text_bytes
from bitloom.llm.components import connected_components

#: 50 bands of 7 rows: two sets of similarity 0.8 share no band in about 1 of 100,000 cases.
BANDS, ROWS = 50, 7
HASHES = 352  # BANDS * ROWS, up to a multiple of 32 for packing
#: Standard deviations of the b-bit estimate by which a candidate may fall short and still be confirmed.
MARGIN = 4.5
#: Buckets of more members are crowded: they are compared in blocks of about BLOCK members or BLOCK_SHINGLES
#: shingles, whichever is less, texts at hand, so that a block gives links only and not all its candidate pairs.
CROWDED, BLOCK, BLOCK_SHINGLES = 32, 250, 500_000


def _fingerprint(width: int):
    hashes = kernels.MinHash(HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, sigs, bands = [], [], [], [], []
            for text in batch.column(1):
                data = text.as_py()
                found = kernels.shingle_set(data.lower(), width) if data else ()
                n.append(len(found))
                if not len(found):
                    d1.append(None), d2.append(None), sigs.append(None), bands.append(None)
                    continue
                one, two = kernels.digest(found)
                minima = hashes.minima(found)
                d1.append(one), d2.append(two)
                sigs.append(kernels.pack_two_bits(minima))
                bands.append(kernels.band_keys(minima, BANDS, ROWS))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), pa.array(sigs, longs), pa.array(bands, longs)],
                names=["doc_id", "h", "n_shingles", "d1", "d2", "sig", "bands"],
            )

    return run


def _confirm(width: int, percent: int):
    """Keeps the pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, known = [], None, None
            for a, b in zip(batch.column("text_u"), batch.column("text_v")):
                one = kernels.shingle_set(a.as_py().lower(), width)
                raw = b.as_py()
                if raw != last:
                    last, known = raw, kernels.shingle_set(raw.lower(), width)
                common = len(np.intersect1d(one, known, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(known) - common))
            batch = batch.filter(pa.array(keep, pa.bool_()))
            yield batch.select(["u", "v"])

    return run


def _agreement(one: Column, two: Column) -> Column:
    """Number of equal two-bit lanes of two packed signatures."""

    def lanes(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        mask = F.lit(0x5555555555555555).cast("long")
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(mask)).cast("int")

    return F.lit(HASHES) - F.aggregate(F.zip_with(one, two, lanes), F.lit(0), lambda a, x: a + x)


def least_agreement(percent: int) -> int:
    """Equal lanes that a pair of exactly that similarity has, less MARGIN standard deviations.

    Two-bit values also agree by chance in a quarter of the other lanes: E = s + (1 - s) / 4.
    """
    s = percent / 100
    p = s + (1 - s) / 4
    return int(HASHES * p - MARGIN * (HASHES * p * (1 - p)) ** 0.5)


def _cross_block(least: int):
    """Pairs of one block of outsiders and one block of members that may be similar; other roots only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for out, all_ in zip(batch.column("outs"), batch.column("members")):
                o, m = _columns(out), _columns(all_)
                for at in range(0, len(o[0]), 64):
                    x = o[2][at : at + 64, None, :] ^ m[2][None, :, :]
                    x = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
                    same = HASHES - np.bitwise_count(x).sum(axis=2, dtype=np.int32)
                    i, j = np.nonzero((same >= least) & (o[1][at : at + 64, None] != m[1][None, :]))
                    us.append(np.maximum(o[0][at + i], m[0][j]))
                    vs.append(np.minimum(o[0][at + i], m[0][j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _columns(entries: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = entries.values
    sig = s.field("sig").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return s.field("node").to_numpy(), s.field("root").to_numpy(), sig.reshape(len(s), -1)


def _common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of 0/1 matrices over slices of the hashes."""
    sizes = [len(x) for x in (*one, *two)]
    codes = np.unique(np.concatenate((*one, *two)), return_inverse=True)[1]
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(codes, kind="stable")
    codes, row = codes[order], row[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for low in range(0, int(codes[-1]) + 1, 4096):
        i, j = np.searchsorted(codes, (low, low + 4096))
        cell = np.zeros((len(sizes), 4096), np.float32)
        cell[row[i:j], codes[i:j] - low] = 1
        out += cell[: len(one)] @ cell[len(one) :].T
    return out


def _crowded_block(least: int, width: int, percent: int):
    """Links between outsiders and members of one block, one for each outsider and root of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for out, all_ in zip(batch.column("outs"), batch.column("members")):
                o, m = _columns(out), _columns(all_)
                x = o[2][:, None, :] ^ m[2][None, :, :]
                x = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
                likely = (HASHES - np.bitwise_count(x).sum(axis=2, dtype=np.int32) >= least) & (o[1][:, None] != m[1][None, :])
                if not likely.any():
                    continue
                rows, columns = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
                sets = [[kernels.shingle_set(t.as_py().lower(), width) for t in e.values.field("text").take(pa.array(k))] for e, k in ((out, rows), (all_, columns))]
                common = _common(*sets)
                size = [np.array([len(x) for x in y]) for y in sets]
                link = likely[np.ix_(rows, columns)] & (100 * common >= percent * (size[0][:, None] + size[1][None, :] - common))
                for i, j in zip(*np.nonzero(link)):
                    found.append((o[0][rows[i]], m[0][columns[j]], m[1][columns[j]]))
            first = {(u, root): v for u, v, root in found}
            yield pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in first], pa.int64()), pa.array(list(first.values()), pa.int64())], names=["u", "v"]
            )

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) that are links, by their full texts."""
    both = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    both = both.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
    return both.select("u", "v", "text_u", "text_v").mapInArrow(_confirm(width, percent), "u long, v long")


def _cells(left: DataFrame, *columns: str) -> DataFrame:
    """(outs, members) for each block of outsiders and block of members of each bucket.

    Every outsider meets every member of its bucket in one cell; a cell has about 2 * BLOCK rows at most
    and, where the caller counts them, 2 * BLOCK_SHINGLES shingles.
    """
    entry = F.struct(*columns).alias("e")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    members = left.select("key", slot("g").alias("j"), spread("h").alias("i"), entry, F.lit(False).alias("out"))
    outs = left.where("root <> main").select("key", spread("g").alias("j"), slot("h").alias("i"), entry, F.lit(True).alias("out"))
    cells = members.unionByName(outs).groupBy("key", "i", "j").agg(
        F.collect_list(F.when(F.col("out"), F.col("e"))).alias("outs"),
        F.collect_list(F.when(~F.col("out"), F.col("e"))).alias("members"),
    )
    return cells.where("size(outs) > 0 and size(members) > 0").select("outs", "members")


def _same_document(named: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): the node of each class with the least among the classes of a doc_id that several classes hold."""
    sets = F.struct("d1", "d2")
    several = named.groupBy("doc_id").agg(F.min(sets).alias("low"), F.max(sets).alias("high")).where("low <> high").select("doc_id")
    held = named.join(several, "doc_id").join(classes, ["d1", "d2"]).select("doc_id", "node").distinct()
    least = held.groupBy("doc_id").agg(F.min("node").alias("least"))
    return held.join(least, "doc_id").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of ``width``-word
    shingles; component_id is the smallest doc_id that links reach. Equal sets form one class first,
    whose smallest doc_id stands for it. Classes that share a band are candidates: in each bucket one
    member, drawn by the bucket's key, is compared with the others (as many pairs as members, not all
    pairs). Buckets whose members are then still in different components are compared fully, outsiders
    against members, in blocks. Candidates that the two-bit estimate rules out by MARGIN deviations
    are dropped; the rest is confirmed on the full sets.

    Null or empty texts have no shingles and are their own component. Rows with a null doc_id are
    linked with nothing: component_id null, kept true. Rows that share a doc_id are one document
    whose links are those of all its texts.
    """
    doc, digest = F.col("doc_id").cast("long"), F.xxhash64("text")
    prints = checkpoint(
        docs.select(doc.alias("doc_id"), text_bytes().alias("text"), digest.alias("h")).mapInArrow(
            _fingerprint(width), "doc_id long, h long, n_shingles long, d1 long, d2 long, sig array<long>, bands array<long>"
        )
    )
    named = prints.where("doc_id is not null and n_shingles > 0")
    # A row for each class, whatever the number of its documents and of their repeats: equal sets have equal
    # minima. (node, h) tell the text that stands for it.
    one = F.min(F.struct("doc_id", "h")).alias("m")
    reps = checkpoint(named.groupBy("d1", "d2").agg(one, F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    reps = reps.select("d1", "d2", F.col("m.doc_id").alias("node"), F.col("m.h").alias("h"), "n", "sig", "bands")
    classes = reps.select("d1", "d2", "node")
    sigs = reps.select("node", "sig")

    # One member of each bucket of two or more, drawn by the least node after mixing with the key.
    rows = reps.select("node", F.col("n").alias("size"), F.explode("bands").alias("key")).withColumn("drawn", F.col("node").bitwiseXOR(F.xxhash64("key")))
    buckets = rows.groupBy("key").agg(F.min("drawn").alias("low"), F.max("drawn").alias("high")).where("low <> high")
    buckets = checkpoint(buckets.select("key", F.col("low").bitwiseXOR(F.xxhash64("key")).alias("center")))
    members = checkpoint(rows.select("key", "node", "size").join(buckets, "key"))
    stars = members.where("node <> center").select(F.greatest("node", "center").alias("u"), F.least("node", "center").alias("v")).distinct()
    least = least_agreement(percent)
    stars = (
        stars.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u")
        .join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v")
        .where(_agreement(F.col("su"), F.col("sv")) >= least)
    )
    stars = checkpoint(stars.select("u", "v").distinct())
    # Texts of documents that share a band with another are moved once; of a document's repeats one is.
    wanted = checkpoint(reps.join(members.select("node").distinct(), "node", "left_semi").select("node", "h"))
    texts = docs.where("doc_id is not null and text is not null").select(doc.alias("node"), digest.alias("h"), text_bytes().alias("text"))
    texts = _maybe(texts, wanted).groupBy("node", "h").agg(F.first("text").alias("text"))
    texts = checkpoint(texts.join(wanted.distinct(), ["node", "h"], "left_semi").select("node", "text"))
    links = checkpoint(_confirmed(stars, texts, width, percent).union(_same_document(named, classes)).distinct())
    roots = checkpoint(connected_components(links))

    # Buckets that still hold several components: everyone outside the largest against everyone. The star has
    # compared all there is in a bucket of two, and of buckets with the same members one is enough.
    labelled = members.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    by_root = labelled.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("x"))
    mixed = by_root.groupBy("key").agg(
        F.max_by(F.struct("root", "n", "size"), F.struct("n", "root")).alias("m"), F.sum("n").alias("all"), F.sum("size").alias("size"), F.count("*").alias("roots"),
        F.sum("x").alias("x"),
    )
    mixed = mixed.where("roots > 1 and all > 2").groupBy("x", "all", "size", "m").agg(F.min("key").alias("key"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES))
    mixed = checkpoint(
        mixed.select(
            "key", F.col("m.root").alias("main"), "all", blocks(F.col("all"), F.col("size")).alias("g"),
            blocks(F.col("all") - F.col("m.n"), F.col("size") - F.col("m.size")).alias("h"),
        )
    )
    left = labelled.drop("size").join(mixed, "key").join(sigs, "node")
    few = _cells(left.where(F.col("all") <= CROWDED), "node", "root", "sig")
    cross = few.mapInArrow(_cross_block(least), "u long, v long").distinct()
    cross = checkpoint(cross.join(stars, ["u", "v"], "left_anti"))
    more = _confirmed(cross, texts, width, percent)
    many = _cells(left.where(F.col("all") > CROWDED).join(texts, "node"), "node", "root", "sig", "text")
    more = checkpoint(more.union(many.mapInArrow(_crowded_block(least, width, percent), "u long, v long")).distinct())
    for side in ("u", "v"):
        more = more.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
        more = more.withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    again = connected_components(more.select(F.col("ru").alias("u"), F.col("rv").alias("v")))
    again = checkpoint(again.select(F.col("node").alias("top"), F.col("root").alias("final")))
    first = classes.join(roots, "node", "left").withColumn("top", F.coalesce("root", "node"))
    final = first.join(again, "top", "left").select("d1", "d2", F.coalesce("final", "top").alias("component"))

    out = prints.select("doc_id", "n_shingles", "d1", "d2").join(checkpoint(final), ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op7: components of all documents under four-word shingles and similarity 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Words of the map of wanted keys: a fixed size (about 4 MB as a table), whatever the input.
MAP_WORDS = 1 << 18


def _maybe(rows: DataFrame, wanted: DataFrame, keep: bool = True) -> DataFrame:
    """The ``rows`` that the columns of ``wanted`` may match (or, with ``keep`` false, that they surely don't).

    The map is a table of at most MAP_WORDS rows of 64 bits, so it may be broadcast at any size of the
    input. As it fills up, more rows pass; none is missed.
    """
    slot = F.pmod(F.xxhash64(*wanted.columns), F.lit(MAP_WORDS * 64))
    at = wanted.select(slot.alias("s"))
    words = at.groupBy(F.expr("s div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("bits"))
    marked = rows.withColumns({"_slot": slot}).withColumn("_word", F.expr("_slot div 64"))
    marked = marked.join(F.broadcast(words), F.col("_word") == F.col("word"), "left")
    on = F.coalesce(F.expr("shiftrightunsigned(bits, cast(_slot % 64 as int)) & 1L") == 1, F.lit(False))
    return marked.where(on if keep else ~on).select(*rows.columns)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays (words and similarity as for all such stages: 5 and 0.8).

    Of repeated rows (equal in all columns) one stays; rows with a null doc_id all stay, as do null and empty
    texts; no rows give no rows. Ties: a group's least doc_id stays. The caller's columns travel in one
    struct, so their names don't matter. Only rows whose doc_id goes or occurs twice, as a fixed-size map
    tells, are shuffled with their texts; repeats are dropped in their task first.
    """
    found = near_duplicates(docs.select("doc_id", "text"), width=5).where("doc_id is not null").groupBy("doc_id")
    found = checkpoint(found.agg(F.count("*").alias("n"), F.bool_or(~F.col("kept")).alias("gone")).where("gone or n > 1"))
    ids = found.select(F.col("doc_id").alias("node"))
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.struct("*").alias("row"))
    gone = found.where("gone").select(F.col("doc_id").alias("node"))
    look = _maybe(rows.where("node is not null"), ids).groupBy("node", "row").agg(F.lit(1).alias("one"))
    look = look.join(gone, "node", "left_anti").select("row.*")
    return look.union(rows.where("node is null").select("row.*")).union(_maybe(rows.where("node is not null"), ids, False).select("row.*"))


#: The same rows from DuckDB: all pairs of different sets that share a shingle, then reachability.
ORACLE_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM s GROUP BY 1),
c AS (SELECT min(doc_id) AS node, h, any_value(n) AS n FROM n GROUP BY h),
rs AS (SELECT node, n, s FROM c JOIN s ON node = doc_id),
e AS (SELECT a.node AS u, b.node AS v FROM rs a JOIN rs b ON a.s = b.s AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e2 AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT node AS node, node AS root FROM c UNION SELECT e2.v, r.root FROM r JOIN e2 ON r.node = e2.u),
m AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id,
       w.doc_id = coalesce(m.root, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.h = n.h LEFT JOIN m ON m.node = c.node
"""
