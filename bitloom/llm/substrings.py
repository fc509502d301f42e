"""Substring dedup: MinHash banding of lines and content-anchored chunks, exact check, removals by component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bitloom.llm import kernels
from bitloom.llm.common import checkpoint, shuffles_removed, text_bytes
from bitloom.llm.components import connected_components
from bitloom.llm.neardup import _cells, _common

#: Words of a paragraph, and of its shingles.
LENGTH, WIDTH = 20, 5
#: A paragraph starts where a three-word hash is the least of WINDOW neighbours. Every passage of
#: LENGTH + WINDOW words or more that occurs twice thus holds the same whole paragraph at each place.
WINDOW = 29
#: 11 bands of 2 rows: a pair of units of similarity exactly 0.8 is missed once in about 75,000. Units that are
#: little alike share no five-word shingle as a rule, so short bands bring few candidates here.
BANDS, ROWS = 11, 2
#: Sets of fewer shingles are 0.8 similar only to equal ones, which are the same node: they need no band.
SMALL = 4
PERCENT = 80
#: Words beside a chunk that it may grow by: a repeated passage of LENGTH + WINDOW words or more holds a
#: whole chunk that starts at most WINDOW - 1 words late, and one that ends at most WINDOW - 1 early.
BESIDE = WINDOW
#: Rows and shingles of each side of a cell in which units that share a rare shingle are compared.
BLOCK, BLOCK_SHINGLES = 1000, 250_000
#: Chunks that share their first or last 19 words are linked if these hold so many different shingles.
SURE = 8


#: Texts are put together for the kernel up to about so many bytes; a longer one goes alone, whole.
TOGETHER = 1 << 18
#: Low bits of a hash that give way to a place, for leftmost minima.
_PLACE = np.uint64((1 << 20) - 1)


def _read(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased texts with newlines between them, the words' first bytes, their hashes, each text's first word and at last the number of words)."""
    data = b"\n".join(texts).lower()
    starts, words = kernels.words_at(data)
    return data, starts, words, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def paragraphs(texts: list[bytes], read: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of texts, first words, content hashes, shingle hashes as rows) of the texts' paragraphs.

    The texts' words are anchored wherever their order is the same, so that a passage gets the same
    paragraphs in whatever document, line or place it stands. No paragraph spans two texts. ``read`` is
    what _read gives, where the caller has it.
    """
    _, _, words, begin = read or _read(texts)
    size = np.diff(begin)
    rows = np.empty((0, LENGTH - WIDTH + 1), np.uint64)
    if not (size >= LENGTH).any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), rows
    text = np.repeat(np.arange(len(texts)), size)
    three = kernels.shingles(words, 3)
    least = (three & ~_PLACE) | (np.arange(len(three), dtype=np.uint64) & _PLACE)
    found = [_minima(least, begin[:-1][size >= WINDOW + 2], begin[1:][size >= WINDOW + 2])]
    short = (size >= LENGTH) & (size < WINDOW + 2)
    if short.any():  # one window over all its three-word hashes
        low, high = begin[:-1][short], begin[1:][short] - 2
        bounds = np.stack((low, high), axis=1).ravel()
        best = np.minimum.reduceat(np.append(least, ~np.uint64(0)), bounds)[::2]
        found.append(low + ((best - low.astype(np.uint64)) & _PLACE).astype(np.int64))
    at = np.sort(np.concatenate(found))
    at = at[at + LENGTH <= begin[1:][text[at]]]
    five = kernels.shingles(words, WIDTH)
    rows = five[at[:, None] + np.arange(LENGTH - WIDTH + 1)]
    content = np.full(len(at), LENGTH, np.uint64)
    for i in range(0, LENGTH - WIDTH + 1, WIDTH):
        content = kernels.mix(content ^ rows[:, i])
    return text[at], at - begin[text[at]], kernels.mix(content ^ rows[:, -1]).view(np.int64), rows


def _minima(least: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places of the minima of all windows of WINDOW values that lie in one text's words [low, high)."""
    if not len(low):
        return np.empty(0, np.int64)
    best, span = least, 1
    while span < WINDOW:  # minima of windows of twice the width, at last of WINDOW
        step = min(span, WINDOW - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    change = np.zeros(len(best) + 1, np.int8)
    change[low] += 1
    np.subtract.at(change, high - WINDOW - 1, 1)
    window = np.flatnonzero(np.cumsum(change[:-1]))
    return np.unique(window + ((best[window] - window.astype(np.uint64)) & _PLACE).astype(np.int64))


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts) of neighbouring texts of about TOGETHER bytes; null is empty."""
    first, size, now = 0, 0, []
    for k, text in enumerate(texts):
        data = text.as_py() or b""
        if now and size + len(data) > TOGETHER:
            yield first, now
            first, size, now = k, 0, []
        now.append(data)
        size += len(data)
    if now:
        yield first, now


def units(texts: list[bytes], chunks: tuple | None = None, read: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of texts, first words, ends, nodes, bounds, shingles): lines, whatever their length, and odd chunks.

    A line under WIDTH words is one shingle. Chunks (of ``paragraphs``) are odd if they hold a shingle twice;
    the others are linked by their keys. Shingles are distinct and ascending in each unit, from bounds[i] to
    bounds[i + 1].
    """
    read = data, starts, words, begin = read or _read(texts)
    if not len(words):
        return (*(np.empty(0, np.int64) for _ in range(4)), np.zeros(1, np.int64), np.empty(0, np.uint64))
    line = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), starts)
    low = np.flatnonzero(np.diff(line, prepend=-1))
    high = np.append(low[1:], len(words))
    which, value = [], []
    for n in range(1, WIDTH):
        own = np.flatnonzero(high - low == n)
        which.append(own)
        value.append(kernels.shingles(words, n)[low[own]] if len(own) else np.empty(0, np.uint64))
    five = kernels.shingles(words, WIDTH)
    number = np.repeat(np.arange(len(low)), high - low)
    inside = np.flatnonzero(np.arange(len(words)) + WIDTH <= high[number])
    which.append(number[inside])
    value.append(five[inside])
    text = np.searchsorted(begin, low, side="right") - 1
    chunk_text, chunk_at, content, rows = chunks or paragraphs(texts, read)
    odd = np.flatnonzero((np.diff(np.sort(rows, axis=1), axis=1) == 0).any(axis=1))
    which.append(np.repeat(len(low) + np.arange(len(odd)), rows.shape[1]))
    value.append(rows[odd].ravel())
    which, value = np.concatenate(which), np.concatenate(value)
    order = np.argsort(value)
    kind = np.uint16 if len(low) + len(odd) <= 1 << 16 else np.int64  # short ones are sorted faster
    order = order[np.argsort(which[order].astype(kind), kind="stable")]
    which, value = which[order], value[order]
    once = np.append(True, (which[1:] != which[:-1]) | (value[1:] != value[:-1]))
    which, value = which[once], value[once]
    bounds = np.searchsorted(which, np.arange(len(low) + len(odd) + 1))
    total = np.add.reduceat(kernels.mix(value ^ np.uint64(0x2545F4914F6CDD1D)), bounds[:-1])
    node = kernels.mix(total ^ np.diff(bounds).astype(np.uint64)).view(np.int64)
    node[len(low) :] = content[odd]
    first = np.concatenate((low - begin[text], chunk_at[odd]))
    end = np.concatenate((high - begin[text], chunk_at[odd] + LENGTH))
    return np.concatenate((text, chunk_text[odd])), first, end, node, bounds, value


def _chunk_keys(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, keys) of the first and the last LENGTH - 1 words of chunks.

    Chunks without a repeated shingle are 0.8 similar if and only if they share one of them: 15 of 16
    shingles must be common. Shared words with SURE shingles or more make any two chunks that similar.
    """
    out = []
    for at in (0, 1):
        key = np.full(len(rows), LENGTH - 1, np.uint64)
        for i in (0, 5, 10, 14):
            key = kernels.mix(key ^ rows[:, at + i])
        held = np.sort(rows[:, at : at + 15], axis=1)
        sure = np.flatnonzero((np.diff(held, axis=1) != 0).sum(axis=1) + 1 >= SURE)
        out.append((sure, key[sure].view(np.int64)))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


_HASH = kernels.MinHash(BANDS * ROWS, seed=11)

#: Bits of the maps of wanted values, and bits of a value, all in one word: a fixed size, whatever the input. Such
#: a map spares the shuffle rows that cannot match; as it fills up it lets more pass, and what follows decides.
BITS, PROBES = 1 << 25, 3


#: 64-bit words of a part of such a map, as it comes to the driver.
PART = 1 << 14


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for words in batch.column("words"):
            part = np.zeros(PART, np.int64)
            part[words.values.field("word").to_numpy() % PART] = words.values.field("bits").to_numpy()
            parts.append(part.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(parts, pa.binary())], names=["part", "bits"])


def _bitmap(values: DataFrame, name: str):
    """A broadcast map of a column of hashes; BITS / 8 bytes come to the driver, in parts."""
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({name}, {63 - 6 * (i + 1)}) & 63 as int))" for i in range(PROBES))
    words = values.groupBy(F.col(name).bitwiseAND(BITS // 64 - 1).alias("word")).agg(F.expr(f"bit_or({bits})").alias("bits"))
    parts = words.groupBy(F.expr(f"word div {PART}").alias("part")).agg(F.collect_list(F.struct("word", "bits")).alias("words"))
    out = np.zeros(BITS // 64, np.uint64)
    with shuffles_removed(values.sparkSession):
        found = parts.mapInArrow(_parts, "part long, bits binary").collect()  # BITS / 8 bytes in all
    for part in found:
        out[part.part * PART : (part.part + 1) * PART] = np.frombuffer(part.bits, np.uint64)
    return values.sparkSession.sparkContext.broadcast(out)


def _in(bitmap, values: np.ndarray) -> np.ndarray:
    """True where a value may be wanted; without a map everywhere."""
    if bitmap is None:
        return np.ones(len(values), bool)
    values = values.view(np.uint64)
    word, bits = bitmap.value[values & np.uint64(BITS // 64 - 1)], np.zeros(len(values), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << (values >> np.uint64(63 - 6 * (i + 1)) & np.uint64(63))
    return word & bits == bits


#: Slots of the table of counts of shingles, a byte each: a fixed size, whatever the input.
SLOTS = 1 << 22


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a column of sets."""
    size = pc.binary_length(sets).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    return np.frombuffer(b"".join(sets.to_pylist()), np.uint64), size


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot, n = np.unique(_flat(batch.column("s"))[0] & np.uint64(SLOTS - 1), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), pa.array(n)], names=["slot", "n"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for slots in batch.column("slots"):
            part = np.zeros(PART, np.uint8)
            part[slots.values.field("slot").to_numpy() % PART] = np.log2(slots.values.field("n").to_numpy())
            parts.append(part.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(parts, pa.binary())], names=["part", "levels"])


def _counts(sets: DataFrame):
    """A broadcast table of the binary logarithm of how many of the ``sets`` have a shingle of a slot; SLOTS bytes come to the driver, in parts.

    Shingles may share a slot: a count may be too large, never too small.
    """
    slots = sets.select("s").mapInArrow(_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    parts = slots.groupBy(F.expr(f"slot div {PART}").alias("part")).agg(F.collect_list(F.struct("slot", "n")).alias("slots"))
    out = np.zeros(SLOTS, np.uint8)
    with shuffles_removed(sets.sparkSession):
        found = parts.mapInArrow(_levels, "part long, levels binary").collect()  # SLOTS bytes in all
    for part in found:
        out[part.part * PART : (part.part + 1) * PART] = np.frombuffer(part.levels, np.uint8)
    return sets.sparkSession.sparkContext.broadcast(out)


def _rare(counts):
    """(node, size, s, keys): the shingles that other sets may have too, and those of them among the set's rarest.

    Two sets of similarity PERCENT share one of the rarest size - ceil(PERCENT * size / 100) + 1 shingles of each,
    if all sets have them in one order, here by the table's count and then by value. A shingle that the table
    counts once is in no other set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, size = _flat(batch.column("s"))
            which, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            level = counts.value[value & np.uint64(SLOTS - 1)]
            order = np.lexsort((value, level, which))
            rank = np.arange(len(value)) - np.repeat(first, size)
            key = order[(rank < (size - (PERCENT * size + 99) // 100 + 1)[which]) & (level[order] > 0)]
            lists = []
            for at in (np.flatnonzero(level), key):
                bounds = np.searchsorted(which[at], np.arange(len(size) + 1))
                lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value[at].view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(size), *lists], names=["node", "size", "s", "keys"])

    return run


#: Nodes are keys of their own beside those of the chunks and the bands.
_NODE = np.uint64(0x52DCE729DA3E39CB)


def _node_key(node: np.ndarray) -> np.ndarray:
    return kernels.mix(node.view(np.uint64) ^ _NODE).view(np.int64)


def _bands(node: np.ndarray, bounds: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units, band keys) of the distinct units of SMALL shingles or more, BANDS keys for each."""
    on = np.unique(node, return_index=True)[1]
    on = on[np.diff(bounds)[on] >= SMALL]
    size = np.diff(bounds)[on]
    ends = np.cumsum(size)
    own = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(bounds[on], size)
    keys = kernels.band_keys(_HASH.each(value[own], np.append(0, ends)), BANDS, ROWS)
    return np.repeat(on, BANDS), keys.ravel()


def _grouped(run):
    """A function of mapInArrow from one of (batch, number of the first text, texts) to columns by name."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _groups(batch.column("text")):
                found = run(batch, begin, texts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.values()], names=list(found))

    return over


def _keys(batch, begin, texts):
    """(key, tag): chunk keys and units with the documents that hold them, band keys with the units that have them."""
    read = _read(texts)
    chunks = paragraphs(texts, read)
    chunk, key = _chunk_keys(chunks[3])
    text, _, _, node, bounds, value = units(texts, chunks, read)
    ids = batch.column("doc_id").to_numpy()[begin : begin + len(texts)]
    on, bands = _bands(node, bounds, value)
    keys = np.concatenate((key, _node_key(node), bands))
    return {"key": keys, "tag": np.concatenate((ids[chunks[0][chunk]], ids[text], node[on]))}


def _held(bitmap):
    """(key, node, sure) of the chunks (sure: an equal key links them) and of the distinct units' bands, if the key may be shared."""

    def run(batch, begin, texts):
        read = _read(texts)
        chunks = paragraphs(texts, read)
        number, key = _chunk_keys(chunks[3])
        on = np.flatnonzero(_in(bitmap, key))
        _, _, _, node, bounds, value = units(texts, chunks, read)
        unit, bands = _bands(node, bounds, value)
        too = np.flatnonzero(_in(bitmap, bands))
        return {
            "key": np.concatenate((key[on], bands[too])), "node": np.concatenate((chunks[2][number[on]], node[unit[too]])),
            "sure": np.arange(len(on) + len(too)) < len(on),
        }

    return _grouped(run)


def _sets(bitmap):
    """(node, shingles) of the distinct units whose node may be wanted."""

    def run(batch, begin, texts):
        _, _, _, node, bounds, value = units(texts)
        on = np.flatnonzero(_in(bitmap, node))
        on = on[np.unique(node[on], return_index=True)[1]]
        return {"node": node[on], "shingles": pa.array([value[bounds[i] : bounds[i + 1]].tobytes() for i in on], pa.binary())}

    return _grouped(run)


def _places(bitmap, node_map):
    """(doc_id, first, end, node, chunk) of the chunks and units that may be another document's too, or like one of it."""

    def run(batch, begin, texts):
        read = _read(texts)
        chunks = number, at, node, rows = paragraphs(texts, read)
        chunk, key = _chunk_keys(rows)
        on = np.unique(chunk[_in(bitmap, key)])
        text, first, end, name, bounds, value = units(texts, chunks, read)
        too = np.flatnonzero(_in(node_map, name) | _in(bitmap, _node_key(name)))
        ids = batch.column("doc_id").take(pa.array(begin + np.concatenate((number[on], text[too]))))
        return {
            "doc_id": ids, "first": np.concatenate((at[on], first[too])), "end": np.concatenate((at[on] + LENGTH, end[too])),
            "node": np.concatenate((node[on], name[too])), "chunk": np.arange(len(on) + len(too)) < len(on),
        }

    return _grouped(run)


def _place(doc_id: np.ndarray, first: np.ndarray) -> np.ndarray:
    return kernels.mix(kernels.mix(doc_id.view(np.uint64)) ^ first.view(np.uint64)).view(np.int64)


def _beside(bitmap, by_place: bool):
    """(doc_id, first, node, place, before, after): hashes of up to BESIDE words beside chunks that may be wanted.

    A chunk is wanted by its place or by its node. The nearest words come first, four bytes each.
    """

    def run(batch, begin, texts):
        read = _, _, words, bounds = _read(texts)
        number, at, node, _ = paragraphs(texts, read)
        ids = batch.column("doc_id").take(pa.array(begin + number))
        place = _place(ids.to_numpy(zero_copy_only=False).astype(np.int64), at)
        on = np.flatnonzero(_in(bitmap, place if by_place else node))
        words = (words >> np.uint64(32)).astype(np.uint32)
        before, after = [], []
        for text, i in zip(number[on], at[on]):
            low, high = bounds[text], bounds[text + 1]
            i += low
            before.append(words[max(low, i - BESIDE) : i][::-1].tobytes())
            after.append(words[i + LENGTH : min(high, i + LENGTH + BESIDE)].tobytes())
        return {
            "doc_id": ids.take(pa.array(on)), "first": at[on], "node": node[on], "place": place[on],
            "before": pa.array(before, pa.binary()), "after": pa.array(after, pa.binary()),
        }

    return _grouped(run)


_BESIDE = "doc_id long, first long, node long, place long, before binary, after binary"


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, first, root, left, right): equal words beside a chunk and its component's kept one."""
    for batch in batches:
        grown = []
        for sides in (("before", "kept_before"), ("after", "kept_after")):
            words, least = [], np.full(len(batch), BESIDE)
            for side in sides:
                column = batch.column(side)
                size = pc.binary_length(column).to_numpy(zero_copy_only=False) // 4
                flat = np.frombuffer(b"".join(column.to_pylist()) + bytes(4), np.uint32)
                at = (np.cumsum(size) - size)[:, None] + np.arange(BESIDE)
                words.append(flat[np.minimum(at, len(flat) - 1)])
                least = np.minimum(least, size)
            equal = (words[0] == words[1]) & (np.arange(BESIDE) < least[:, None])
            grown.append(pa.array(np.minimum.accumulate(equal, axis=1).sum(axis=1), pa.int64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "first", "root")), *grown], names=["doc_id", "first", "root", "left", "right"])


def _growth(named: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, first, root, left, right) of the reported ``chunks`` (doc_id, first, node, root).

    Each is compared word by word with its component's kept occurrence, the least place of its least
    document; that one grows as far as it is equal to any other.
    """
    kept = chunks.groupBy("root").agg(F.min(F.struct("doc_id", "first")).alias("k"))
    kept = checkpoint(kept.select("root", F.col("k.doc_id").alias("kept_id"), F.col("k.first").alias("kept_first")))
    at = kept.select(F.col("kept_id").alias("doc_id"), F.col("kept_first").alias("first"))
    places = at.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(_place(b.column(0).to_numpy(), b.column(1).to_numpy()))], names=["place"]) for b in batches), "place long")
    text = named.mapInArrow(_beside(_bitmap(places, "place"), True), _BESIDE)
    text = text.select(F.col("doc_id").alias("kept_id"), F.col("first").alias("kept_first"), F.col("before").alias("kept_before"), F.col("after").alias("kept_after"))
    # Rows of one doc_id with different texts may hold several chunks at one place: one of them is taken.
    text = text.join(kept, ["kept_id", "kept_first"]).groupBy("root", "kept_id", "kept_first").agg(F.min(F.struct("kept_before", "kept_after")).alias("t"))
    nodes = checkpoint(chunks.select("node", "root").distinct().join(text, "root").select("node", "root", "kept_id", "kept_first", "t.*"))
    beside = named.mapInArrow(_beside(_bitmap(nodes, "node"), False), _BESIDE).drop("place").join(nodes, "node")
    others = beside.where("doc_id <> kept_id or first <> kept_first")
    others = others.select("doc_id", "first", "root", "before", "after", "kept_before", "kept_after")
    grown = checkpoint(others.mapInArrow(_grow, "doc_id long, first long, root long, left long, right long"))
    most = grown.groupBy("root").agg(F.max("left").alias("left"), F.max("right").alias("right")).join(kept, "root")
    return grown.union(most.select(F.col("kept_id").alias("doc_id"), F.col("kept_first").alias("first"), "root", "left", "right"))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("su"), batch.column("sv")):
            one, two = (set(np.frombuffer(x.as_py(), np.uint64).tolist()) for x in (a, b))
            common = len(one & two)
            keep.append(100 * common >= PERCENT * (len(one) + len(two) - common))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])


def _forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of as many true cells of ``link`` as it takes to join all that they join."""
    rows, columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    row_left, column_left = link.any(axis=1), link.any(axis=0)
    while row_left.any():
        new = np.flatnonzero(row_left)[:1]
        while len(new):
            row_left[new] = False
            reach = link[new] & column_left
            found = np.flatnonzero(reach.any(axis=0))
            if not len(found):
                break
            rows.append(new[reach[:, found].argmax(axis=0)])
            columns.append(found)
            column_left[found] = False
            reach = link[:, found] & row_left[:, None]
            new = np.flatnonzero(reach.any(axis=1))
            rows.append(new)
            columns.append(found[reach[new].argmax(axis=1)])
    return np.concatenate(rows), np.concatenate(columns)


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of outsiders and members of other components, in each batch as many as it takes to join those components."""
    for batch in batches:
        us, vs, above = [], [], {}

        def top(root: int) -> int:
            while (up := above.get(root, root)) != root:
                above[root] = above.get(up, up)
                root = up
            return root

        for out, all_ in zip(batch.column("outs"), batch.column("members")):
            sides = [out.values, all_.values]
            nodes, roots, size = ([e.field(c).to_numpy() for e in sides] for c in ("node", "root", "size"))
            # No more can be common than what either shares with any set.
            most = np.minimum.outer(*(e.field("s").value_lengths().to_numpy() for e in sides))
            total = np.add.outer(*size)
            link = (roots[0][:, None] != roots[1]) & (100 * most >= PERCENT * (total - most))
            rows, columns = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
            if not len(rows):
                continue
            sets = [[x.values.to_numpy() for x in e.field("s").take(pa.array(on))] for e, on in zip(sides, (rows, columns))]
            at = np.ix_(rows, columns)
            common = _common(*sets)
            link[at] &= 100 * common >= PERCENT * (total[at] - common)
            for i, j in zip(*_forest(link)):
                one, two = top(int(roots[0][i])), top(int(roots[1][j]))
                if one != two:
                    above[one] = two
                    us.append(nodes[0][i])
                    vs.append(nodes[1][j])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _members(rows: DataFrame) -> DataFrame:
    """The members of each bucket of two or more of the distinct ``rows`` (key, node, ...) with center, one drawn by the key."""
    drawn = F.col("node").bitwiseXOR(F.xxhash64("key"))
    ends = rows.groupBy("key").agg(F.min(drawn).alias("low"), F.max(drawn).alias("high")).where("low <> high")
    return checkpoint(rows.join(checkpoint(ends.select("key", F.col("low").bitwiseXOR(F.xxhash64("key")).alias("center"))), "key"))


def _stars(members: DataFrame) -> DataFrame:
    """(u, v): the centre of each bucket with the others."""
    pairs = members.where("node <> center")
    return checkpoint(pairs.select(F.greatest("node", "center").alias("u"), F.least("node", "center").alias("v")).distinct())


def _unit_links(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(u, v): units that share a band and are similar, as many as it takes to join their components."""
    pairs = _stars(members)
    wanted = checkpoint(members.select("node").distinct())
    sets = texts.mapInArrow(_sets(_bitmap(wanted, "node")), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("s"))
    sets = checkpoint(sets.join(wanted, "node", "left_semi"))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    size = [F.length(c) for c in ("su", "sv")]
    both = both.where(100 * F.least(*size) >= PERCENT * F.greatest(*size))  # else no overlap is enough
    links = checkpoint(both.select("u", "v", "su", "sv").mapInArrow(_confirm, "u long, v long"))
    roots = checkpoint(connected_components(links))

    # A star compares a bucket's members with its centre only: what else is similar shares a rare shingle. Of those
    # that share one, everyone outside the largest component meets everyone.
    rows = checkpoint(sets.mapInArrow(_rare(_counts(sets)), "node long, size long, s array<long>, keys array<long>"))
    keyed = rows.select("node", "size", F.explode("keys").alias("key")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = keyed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"))
    mixed = by_root.groupBy("key").agg(
        F.max_by(F.struct("root", "n", "size"), F.struct("n", "root")).alias("m"), F.sum("n").alias("all"), F.sum("size").alias("size"), F.count("*").alias("roots"),
        F.bit_xor("x").alias("x"),
    )
    mixed = mixed.where("roots > 1").groupBy("x", "all", "size", "m").agg(F.min("key").alias("key"))  # one of those with the same members
    blocks = lambda n, size: F.least(n, F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES)))
    mixed = checkpoint(
        mixed.select(
            "key", F.col("m.root").alias("main"), blocks(F.col("all"), F.col("size")).alias("g"),
            blocks(F.col("all") - F.col("m.n"), F.col("size") - F.col("m.size")).alias("h"),
        )
    )
    left = keyed.select("node", "root", "key").join(mixed, "key").join(rows.select("node", "size", "s"), "node")
    more = _cells(left, "node", "root", "size", "s").mapInArrow(_cross, "u long, v long")
    return checkpoint(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more).distinct())


def shared_keys(named: DataFrame):
    """A broadcast map of the keys that two documents or more have (bands: two different units), from one pass."""
    keys = named.mapInArrow(_grouped(_keys), "key long, tag long").groupBy("key").agg(F.min("tag").alias("low"), F.max("tag").alias("high"))
    return _bitmap(checkpoint(keys.where("low <> high").select("key")), "key")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, component_id, kept): passages that repeat across documents.

    Words are runs of non-spaces, A-Z lower-cased; end is exclusive. Lines, whatever their length, are
    units: those that share a MinHash band are candidates, confirmed if the Jaccard similarity of their
    five-word shingles is 0.8 or more. In each bucket one member is compared with the others; units that
    are then still in different components are compared, in blocks, wherever they share one of the
    shingles that are rarest in each, as any two of that similarity do. Chunks (LENGTH words from a content anchor) find passages inside longer lines: they are
    linked by their first or last 19 words, and those that hold a shingle twice as lines are. Components
    with units in two documents or more are reported. Chunks grow word by word as long as they are equal
    to their component's kept one; touching spans of a document and component are merged. A chunk that
    differs in its first or last word only is reported with that word.
    component_id is the component's least doc_id; that document keeps the passage, the others may drop
    it. Null and empty texts and repeats inside one document give no rows, nor do rows with a null
    doc_id; rows of one doc_id count as one document.
    """
    named = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    texts = named.select("text")
    bitmap = shared_keys(named)
    members = _members(checkpoint(texts.mapInArrow(_held(bitmap), "key long, node long, sure boolean").distinct()))
    units_ = _unit_links(texts, members.where("not sure").drop("sure"))
    roots = checkpoint(connected_components(_stars(members.where("sure")).union(units_)))
    node_map = _bitmap(units_.select(F.explode(F.array("u", "v")).alias("node")), "node")

    schema = "doc_id long, first long, end long, node long, chunk boolean"
    places = named.mapInArrow(_places(bitmap, node_map), schema).join(roots, "node", "left")
    places = checkpoint(places.withColumn("root", F.coalesce("root", "node")).distinct())
    span = places.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("last"))
    span = checkpoint(span.where("component_id <> last").select("root", "component_id"))
    found = checkpoint(places.join(span, "root"))
    grown = _growth(named, found.where("chunk").select("doc_id", "first", "node", "root"))
    grown = grown.join(span, "root").select("doc_id", "component_id", (F.col("first") - F.col("left")).alias("first"), (F.col("first") + LENGTH + F.col("right")).alias("end"))
    found = found.select("doc_id", "component_id", "first", "end").union(grown)
    over = Window.partitionBy("doc_id", "component_id").orderBy("first", "end")
    new = F.coalesce(F.col("first") > F.max("end").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    grouped = found.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    runs = grouped.groupBy("doc_id", "component_id", "run").agg(F.min("first").alias("start_word"), F.max("end").alias("end_word"))
    return runs.select("doc_id", "start_word", "end_word", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all passages of the documents that repeat across documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
