"""The dictionary's queries: one pass over the texts, in time linear in each."""

import random
import re
import time

import pytest

from bitloom.functions import tokens
from bitloom.plans import catalogue


@pytest.mark.parametrize("name", ["term_members", "phrase_members", "global_dictionary"])
def test_texts_are_read_once(spark, monkeypatch, name):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    texts = [None, "", *(f"the word{i % 7} fooBar_{i % 3}" for i in range(98))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
    monkeypatch.setattr(catalogue, "_t", lambda spark, d, table: docs)
    assert catalogue.QUERIES[name](spark, "").collect()
    assert seen.value == len(texts)


def test_pieces_against_a_plain_splitter(spark):
    r = random.Random(5)
    texts = ["", " ", "a", "é/ü", "\U0001f600 x\n#y ", *("".join(r.choice("ab/ #-_.\n1A\U0001f600") for _ in range(r.randrange(30))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words, phrases = {}, {}
    for t in texts:
        p = re.findall(r"[^/ #]*[/ #]+", t)
        for i in range(0, len(p) - 1, 2):
            phrases[p[i] + p[i + 1][:-1]] = phrases.get(p[i] + p[i + 1][:-1], 0) + 1
        cut = re.sub(r"([A-Za-z])([0-9])", "\\1\1\\2", re.sub(r"([a-z])([A-Z])", "\\1\1\\2", re.search(r"[^/ #]*\Z", t)[0]))
        tail = [x[:-1] for x in re.findall("[^-_.\1]*(?:\1|[-_.]+)", cut)] + [re.search("[^-_.\1]*\\Z", cut)[0]]
        for w in [x[:-1] for x in p] + tail if t else []:
            words[w] = words.get(w, 0) + 1
    assert {r.word: r.cnt for r in tokens.word_counts(df, "t").collect()} == words
    assert {r.phrase: r.cnt for r in tokens.phrase_counts(df, "t").collect()} == phrases


def test_a_long_tail_is_searched_once(spark):
    """Half a million characters without a delimiter: a search from each of them would take minutes."""
    df = spark.createDataFrame([("x" * 500_000,)], "t string")
    began = time.time()
    assert [(len(r.word), r.cnt) for r in tokens.word_counts(df, "t").collect()] == [(500_000, 1)]
    assert df.select(tokens.split_words(df.t).alias("w")).selectExpr("size(w)").first()[0] == 1
    assert time.time() - began < 30
