"""Near-duplicates: repeated rows, clashing names, long texts in one bucket."""

import time

import pytest

from bitloom.llm import neardup

SCHEMA = "doc_id long, text string"


def near(n):
    words = [f"w{i}" for i in range(80)]
    return " ".join(words), " ".join([*words[:-1], f"x{n}"])


def test_repeats_of_two_near_copies_are_compared_once(spark):
    one, two = near(0)
    few = spark.createDataFrame([(1, one), (2, two)], SCHEMA)
    neardup.near_duplicates(few).collect()
    began = time.time()
    neardup.near_duplicates(few).collect()
    alone = time.time() - began
    many = spark.createDataFrame([(1, one), (2, two)] * 3_000, SCHEMA)
    began = time.time()
    got = {(r.doc_id, r.component_id, r.kept): r["count"] for r in neardup.near_duplicates(many).groupBy("doc_id", "component_id", "kept").count().collect()}
    assert got == {(1, 1, True): 3_000, (2, 1, False): 3_000}
    assert time.time() - began < 3 * alone + 30
    assert neardup.stage(spark, many, "").count() == 1


@pytest.mark.parametrize("names", [["_look", "_s", "_word", "_bits", "_slot"], ["node", "row", "h", "word", "bits", "one", "s"]])
def test_stage_with_clashing_columns(spark, names):
    one, two = near(1)
    rows = [(1, one), (1, one), (2, two), (3, "else"), (None, one), (None, one), (4, None)]
    docs = spark.createDataFrame([(*r, *names) for r in rows], SCHEMA + "".join(f", {n} string" for n in names))
    out = neardup.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, *(r[n] for n in names)) for r in out.collect()) == sorted((i, *names) for i in (0, 0, 1, 3, 4))
    assert neardup.stage(spark, docs.where("false"), "").count() == 0
    assert neardup.near_duplicates(docs).count() == len(rows)


def test_cells_are_bounded_in_shingles(spark, monkeypatch):
    """A crowded bucket of long texts, cut into cells of about two members, gives the same components."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        own = list(base)
        for e in range(i % 12):
            own[(31 * i + 7 * e) % 400] = f"x{i}-{e}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(neardup.near_duplicates(docs).collect())
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 800)
    assert sorted(neardup.near_duplicates(docs).collect()) == whole
