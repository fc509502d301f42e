"""The numbered operators against brute force, on small tables with awkward rows."""

import re
import time
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitloom.llm import common, components, decontaminate, kernels, language, lmscore, mixing, neardup, pii, quality, registry, secrets, substrings, toxicity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], SCHEMA)


PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old tall trees near a calm river bend"
AWKWARD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, PROSE, "b"), (4, PROSE, "b"), (None, PROSE, None),
    (5, PROSE.upper(), "b"), (6, "word " * 30_000, "c"), (7, "é" * 40_000, "c"), (8, "x", "c"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, AWKWARD)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, FOLDER).toPandas(), c.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda f: sorted(map(tuple, f[columns].astype(str).values.tolist()))
    assert rows(ours) == rows(theirs)


def test_quality_statistics(spark, awkward):
    words = re.compile("[^\x20\x09-\x0d]+")
    got = Counter((r.doc_id, r.n_words, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.text_statistics(awkward).collect())
    want = Counter()
    for i, t, _ in AWKWARD:
        w = words.findall(t or "")
        seen = Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words.search(x)]
        want[i, len(w), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 2 * len(cover) > len(w)] += 1
    assert got == want


def test_label_model_trusts_agreeing_rules(spark):
    rows = [([1, 1, 1], 900), ([-1, -1, 1], 80), ([1, 1, 0], 20)]
    got = {tuple(r.votes): r.posterior for r in quality.label_model(spark.createDataFrame(rows, "votes array<int>, n long"), 3).collect()}
    assert got[1, 1, 1] > 0.9 > 0.1 > got[-1, -1, 1]
    assert quality.label_model(spark.createDataFrame([], "votes array<int>, n long"), 3).count() == 0


def test_secrets(spark):
    body = b"A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = b"ghp_" + body + secrets.checksum_62(body)
    text = f"é password = hunter22 AKIA{'Q' * 16} {'0a' * 14} {good.decode()} ghp_{'x' * 36} token: abc secret=token=abcdef"
    found = secrets.secret_spans(table(spark, [(1, text, "a"), (2, None, "a")])).collect()
    kinds = {r.doc_id: [(s.kind, text[s.start : s.end]) for s in r.found] for r in found}
    assert kinds[2] == []
    assert kinds[1] == [
        ("assign", "password = hunter22"), ("access", "AKIA" + "Q" * 16), ("hex", "0a" * 14), ("github", good.decode()), ("assign", "secret=token=abcdef"),
    ]


def test_pii_keeps_base_spans_and_carries_labels(spark, awkward):
    text = "Write to ana@mail.org or +1 (499) 555-6503. Later: (499) 555-6503 again, 10.0.0.1 and 300.1.1.1"
    docs = table(spark, [(k, text, "a") for k in range(20)] + AWKWARD)
    row = next(r for r in pii.pii_spans(docs).collect() if r.doc_id == 9)
    base = [(s.kind, text[s.start : s.end]) for s in row.found if s.base]
    assert base == [("email", "ana@mail.org"), ("ip", "10.0.0.1"), ("phone", "+1 (499) 555-6503")]
    assert ("phone", "(499) 555-6503") in [(s.kind, text[s.start : s.end]) for s in row.found if not s.base]
    out = pii.stage(spark, docs, None)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert "555-6503" not in next(r.text for r in out.collect() if r.doc_id == 9)


def test_lm_scores(spark, awkward):
    got = lmscore.score(awkward).collect()
    assert len(got) == len(AWKWARD)
    counts = Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    for i, t, _ in AWKWARD:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(t))
    for r in got:
        if r.doc_id is not None:
            t = next(t for i, t, _ in AWKWARD if i == r.doc_id)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), counts.total())
        assert r.score < 0


def test_lattice_sums_over_segmentations():
    import math

    lattice = lmscore.Lattice([lmscore.MARK, b"a", b"b", b"ab"], [math.log(x) for x in (0.4, 0.3, 0.2, 0.1)])
    assert abs(10 ** lattice.log10(b"ab") - 0.4 * (0.3 * 0.2 + 0.1)) < 1e-12


def test_language_and_rejection(spark, awkward):
    rows = language.identify(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source").join(
        spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "n_chars"), "doc_id")).toPandas()
    true = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").toPandas()
    held = rows.merge(true, on="doc_id").query("held_out")
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
    odd = {(r.doc_id, r.lang_pred) for r in language.identify(awkward).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en")} <= odd


def test_decontamination_in_blocks(spark, awkward):
    bench = spark.createDataFrame([(1, PROSE), (2, "Old tall"), (3, None), (None, "a calm river bend"), (2, "Old tall")], "item_id long, text string")
    one = decontaminate.find_contamination(awkward, bench).collect()
    many = decontaminate.find_contamination(awkward, bench, block_words=1).collect()
    key = lambda rows: sorted((str(r.doc_id), r.n_words, r.spans, r.items) for r in rows)
    assert key(one) == key(many)
    assert next(r.items for r in one if r.doc_id == 5) == ["1", "2"]
    assert all(not r.spans for r in decontaminate.find_contamination(awkward, bench.where("false")).collect())


def _jaccard_components(texts, width):
    sets = {i: kernels.shingle_set(t.encode().lower(), width) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i]) and len(sets[j]):
                common = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = root[i], root[j]
                    root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    return root


def test_near_duplicates_in_a_crowded_group(spark):
    words = [f"w{k}" for k in range(150)]
    texts = {}
    for i in range(120):
        own = list(words)
        for e in range(i % 9):
            own[(37 * i + 17 * e) % 150] = f"x{i}-{e}"
        texts[i] = " ".join(own)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, [(i, t, "a") for i, t in texts.items()])).collect()}
    assert got == _jaccard_components(texts, 4)


def test_near_duplicates_of_awkward_rows(spark, awkward):
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(awkward).collect()), key=str)
    want = [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (None, None, True), (5, 4, False), (6, 6, True), (7, 7, True), (8, 8, True)]
    assert got == sorted(want, key=str)
    assert neardup.stage(spark, awkward, None).count() == 8
    assert neardup.near_duplicates(awkward.where("false")).count() == 0


def test_toxicity(spark, awkward):
    rows = [(i, PROSE + (" you vile toad" if i % 3 == 0 else "") + f" n{i}", "a") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark, rows + AWKWARD), labels).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id > 10]
    assert sum((r.predicted == 1) == (r.doc_id % 3 == 0) for r in held) > 0.95 * len(held)
    assert len(got) == len(rows) + len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in toxicity.toxicity(awkward, labels.where("false")).collect())


def test_repeated_passages_wherever_they_stand(spark):
    filler = lambda i, n: " ".join(f"f{i}-{k}" for k in range(n))
    passage = " ".join(f"p{k}" for k in range(51))
    rows = [(i, f"{filler(i, 7 + 5 * i)} {passage}\n{filler(-i, 30)}", "a") for i in range(1, 6)] + [(i, filler(i, 90), "a") for i in range(6, 12)]
    got = substrings.repeated_passages(table(spark, rows)).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5} and {r.component_id for r in got} == {1}
    assert [r.doc_id for r in got if r.kept] == [1] * sum(r.kept for r in got)


def test_mix_comes_near_its_targets(spark, awkward):
    rows = [(i, "w " * (1 + i % 50), ["a", "b", "c", None][min(i % 7, 3)]) for i in range(700)]
    got = mixing.mixed(table(spark, rows)).toPandas()
    assert (got["copies"] <= 2).all()
    got["taken"] = got["copies"] * got["size"]
    for _, g in got.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 50
    again = mixing.mixed(table(spark, rows)).toPandas()
    assert again.sort_values("doc_id")["copies"].tolist() == got.sort_values("doc_id")["copies"].tolist()
    assert mixing.mixed(awkward).count() == len(AWKWARD)
    assert mixing.mixed(awkward.where("false")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.run(spark, FOLDER)
    assert set(docs.columns) < set(out.columns)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    judged = quality.quality(docs).toPandas().set_index("doc_id")["good"]
    assert ids and ids <= set(judged[judged].index)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5




def test_op9_texts_together_give_what_each_gives_alone():
    words = [f"w{i * i % 97}" for i in range(400)]
    texts = [" ".join(words[a:b]).encode() for a, b in [(0, 400), (0, 19), (3, 23), (5, 36), (0, 0), (50, 110), (0, 31)]]
    number, at, node, _ = substrings.paragraphs(texts)
    for k, text in enumerate(texts):
        _, alone, nodes, _ = substrings.paragraphs([text])
        assert at[number == k].tolist() == alone.tolist() and node[number == k].tolist() == nodes.tolist()
    whole = {tuple(x) for x in zip(at[number == 0].tolist(), node[number == 0].tolist())}
    assert {(a + 50, n) for a, n in zip(at[number == 5].tolist(), node[number == 5].tolist())} & whole


def test_near_dedup_stage_drops_repeats_and_keeps_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text), (3, "other"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in neardup.stage(spark, docs, "").collect())
    assert kept == sorted([(0, text), (0, text), (1, text), (3, "other"), (4, "")])


def test_op9_links_lines_of_any_length_that_are_similar_as_a_whole(spark):
    """A 60-word line with its middle word changed (0.836), an equal 7-word line, and a line at 0.5."""
    rows, near = [], {}
    for k in range(60):
        words = [f"l{k}-{i}" for i in range(60)]
        rows.append((2 * k, f"own{k} a b\n{' '.join(words)}", "a"))
        words[30] = "changed"
        rows.append((2 * k + 1, f"{' '.join(words)}\nother{k} c", "a"))
        near |= {2 * k: (3, 63), 2 * k + 1: (0, 60)}
    short = "one short line of just seven words"
    rows += [(200, f"{short}\nx200", "a"), (201, f"x201 y\n{short.upper()}", "a")]
    half = [f"h{i}" for i in range(40)]
    rows += [(300, " ".join(half[:18] + ["p"] + half[19:]), "a"), (301, " ".join(half[:9] + ["q"] + half[10:18] + ["r", "s"] + half[20:29] + ["t"] + half[30:]), "a")]
    got = {(r.doc_id, r.start_word, r.end_word, r.component_id) for r in substrings.repeated_passages(table(spark, rows)).collect()}
    assert got >= {(i, *near[i], i - i % 2) for i in near} | {(200, 0, 7, 200), (201, 2, 9, 200)}
    assert not [x for x in got if x[0] >= 300]


def test_op9_links_members_of_a_bucket_that_both_differ_from_its_centre(spark):
    """Lines in one crowded group, against all pairs."""
    words = [f"w{k}" for k in range(44)]
    texts = {}
    for i in range(90):
        own = list(words)
        for e in range(i % 6):
            own[(7 * i + 11 * e) % 44] = f"x{i // 3}-{e}"
        texts[i] = " ".join(own)
    root = _jaccard_components(texts, 5)
    docs = table(spark, [(i, t, "a") for i, t in texts.items()]).select("doc_id", "text")
    lines = docs.select(docs.text.cast("binary").alias("text"))
    held = lines.mapInArrow(substrings._held(substrings.shared_keys(docs.select("doc_id", docs.text.cast("binary").alias("text")))), "key long, node long, sure boolean")
    links = [(r.u, r.v) for r in substrings._unit_links(lines, substrings._members(held.where("not sure").drop("sure").distinct())).collect()]
    node = {i: int(substrings.units([t.encode()])[3][0]) for i, t in texts.items()}
    top = {n: n for n in node.values()}
    for u, v in links:
        a, b = top[u], top[v]
        top = {k: min(a, b) if x in (a, b) else x for k, x in top.items()}
    same = lambda f: {(i, j) for i in texts for j in texts if f(i) == f(j)}
    assert same(lambda i: top[node[i]]) == same(lambda i: root[i])


def test_op9_compares_no_lines_that_share_only_a_common_passage(spark, monkeypatch):
    """60 lines hold one passage of 20 words and 20 own words each, two more are alike: bands are shared by most, rare shingles by the two."""
    passage, sizes, cells = " ".join(f"c{k}" for k in range(20)), [], substrings._cells

    def counted(*args):
        out = cells(*args)
        sizes.extend(len(r.outs) + len(r.members) for r in out.collect())
        return out

    monkeypatch.setattr(substrings, "_cells", counted)
    texts = [f"{' '.join(f'{i}-{k}' for k in range(20))} {passage}" for i in range(60)]
    texts += [f"{' '.join(f'e-{k}' for k in range(40))} {end}" for end in ("one", "two")]
    lines = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    held = lines.mapInArrow(substrings._held(None), "key long, node long, sure boolean")
    links = {(r.u, r.v) for r in substrings._unit_links(lines, substrings._members(held.where("not sure").drop("sure").distinct())).collect()}
    near = [int(substrings.units([t.encode()])[3][0]) for t in texts[60:]]
    assert links == {(max(near), min(near))}
    assert sum(sizes) == 0


def test_op9_finds_every_similar_pair_by_its_rare_shingles(spark):
    """Sets of 5 to 40 values out of frequent and rare ones, against all pairs; none is left without a shared key."""
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        own = rng.choice(400, rng.integers(5, 41), replace=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sets.append(np.unique(own))
        for _ in range(3):
            change = rng.integers(0, 4)
            sets.append(np.unique(np.concatenate((own[change:], rng.integers(0, 1 << 62, change).astype(np.uint64)))))
    rows = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "node long, s binary").repartition(3)
    got = {r.node: r for r in rows.mapInArrow(substrings._rare(substrings._counts(rows)), "node long, size long, s array<long>, keys array<long>").collect()}
    assert [got[i].size for i in range(len(sets))] == [len(x) for x in sets]
    similar = 0
    for i, j in combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        assert len({*got[i].s} & {*got[j].s}) == common
        if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            similar += 1
            assert {*got[i].keys} & {*got[j].keys}
    assert similar > 60


def test_components_of_chains_stars_and_random_edges(spark, monkeypatch):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(9)] + [(200 + int(a), 200 + int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    top = {n: n for e in edges for n in e}
    for u, v in edges:
        a, b = sorted((top[u], top[v]))
        top = {k: a if x == b else x for k, x in top.items()}
    got = {(r.node, r.root) for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(n, r) for n, r in top.items() if n != r}
    seen, checkpoint = [], components.checkpoint
    monkeypatch.setattr(components, "checkpoint", lambda df: seen.append(1) or checkpoint(df))
    stars = spark.createDataFrame([(1, i) for i in range(2, 9)] + [(20, 21)], "u long, v long")
    assert len(components.connected_components(stars).collect()) == 8
    assert len(seen) == 1  # stars need no round


def test_checkpoints_leave_no_shuffle_files(spark):
    sc = spark.sparkContext
    folder = Path(sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen, before = {*folder.rglob("shuffle_*")}, spark.conf.get(key)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    got = common.checkpoint(df)
    end = time.time() + 20  # the files go a little later
    while {*folder.rglob("shuffle_*")} - seen and time.time() < end:
        time.sleep(0.1)
    assert not {*folder.rglob("shuffle_*")} - seen
    assert spark.conf.get(key) == before
    assert got.collect() and got.count() == df.count() == 7


@pytest.mark.parametrize("length", [51, 60, 100])
def test_op9_spans_cover_the_whole_repeated_passage(spark, length):
    """Exact passages inside longer lines: one span a copy covers all of it, and a changed end word at most."""
    rows, where = [], {}
    for k in range(20):
        passage = " ".join(f"p{k}-{i}" for i in range(length))
        for c in range(3):
            first = 5 + 13 * c + k
            filler = [f"f{k}-{c}-{i}" for i in range(first + 40)]
            rows.append((10 * k + c, f"{' '.join(filler[:first])} {passage} {' '.join(filler[first:])}", "a"))
            where[10 * k + c] = [(first, first + length, 10 * k)]
    got = {}
    for r in substrings.repeated_passages(table(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word, r.component_id))
    assert got.keys() == where.keys()
    for i, ((first, end, component),) in where.items():
        ((a, b, c),) = got[i]
        assert first - 1 <= a <= first and end <= b <= end + 1 and c == component


def test_near_duplicates_of_a_doc_id_with_several_texts(spark):
    """A doc_id's links are those of all its texts: 5 and 9 meet through 7."""
    one, two = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near = " ".join([*two[:-1], "changed"])
    rows = [(5, " ".join(one), "a"), (7, " ".join(one), "a"), (7, " ".join(two), "a"), (9, near, "a"), (11, "other words", "a")]
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got == {(5, 5, True), (7, 5, False), (9, 5, False), (11, 11, True)}


def test_op9_reads_the_texts_six_times(spark):
    """Once for the keys, the held rows, the sets and the places, twice for the words beside chunks; small lines have no bands."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"line {i}\n{long}\none two three four five six" + (" seven" if i % 2 else ""), "a") for i in range(20)]
    got = substrings.repeated_passages(table(spark, rows).select("doc_id", "text").mapInArrow(count, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(20))
    assert seen.value == 6 * len(rows)
    _, _, _, node, bounds, value = substrings.units([b"one two three four five six\n" + long.encode()])
    assert set(substrings._bands(node, bounds, value)[0]) == {1}
