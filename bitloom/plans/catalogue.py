"""The library's queries on the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions import tokens
from bitloom.operators import blocks, categorical, dictionary, numeric, sampling, sequences
from bitloom.plans import registry
from bitloom.plans.lineage import checkpoint
from bitloom.sources import documents

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def _t(spark, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# Dictionaries.
_DICT = "d AS (SELECT p_type AS value, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS BIGINT) AS code FROM part GROUP BY 1)"


@query("enum_dictionary", f"WITH {_DICT} SELECT value, code FROM d")
def _(spark, d):
    return dictionary.build(_t(spark, d, "part"), "p_type", "p_partkey")


@query("enum_encode", f"WITH {_DICT} SELECT p_partkey, code AS p_type FROM part JOIN d ON p_type = value")
def _(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_type")
    return dictionary.encode(part, "p_type", dictionary.build(part, "p_type", "p_partkey"))


@query("enum_decode", "SELECT p_partkey, p_type FROM part")
def _(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_type")
    known = dictionary.build(part, "p_type", "p_partkey")
    return dictionary.decode(dictionary.encode(part, "p_type", known), "p_type", known)


# Categorical models.
def _weights_sql(table: str, code: str, preds: list[str]) -> str:
    p = "".join(f"{x}, " for x in preds)
    over = "PARTITION BY " + ", ".join(preds) if preds else ""
    return f"""WITH h AS (SELECT {p}{code}, count(*) AS cnt FROM {table} GROUP BY ALL),
r AS (SELECT *, sum(cnt) OVER ({over}) AS total, cnt * 65536 // sum(cnt) OVER ({over}) AS w0 FROM h),
l AS (SELECT *, 65536 - sum(w0) OVER ({over}) AS leftover, count(*) FILTER (w0 = 0) OVER ({over}) AS n_rare,
      row_number() OVER ({over} ORDER BY w0 DESC, {code}) AS top FROM r)
SELECT {p}{code}, cnt, CAST(total AS BIGINT) AS total,
  CAST(CASE WHEN top = 1 AND n_rare = 0 THEN w0 + leftover WHEN top = 1 AND leftover = 0 THEN w0 - 1 ELSE w0 END AS BIGINT) AS w,
  CAST(CASE WHEN n_rare > 0 THEN CASE WHEN leftover = 0 THEN 1 ELSE leftover END ELSE 0 END AS BIGINT) AS rare_w, n_rare FROM l"""


_COST_SQL = """SELECT round(sum(cnt * -log2(CASE WHEN w > 0 THEN w ELSE rare_w * 1.0 / greatest(n_rare, 1) END / 65536.0)) + (count(*) - 1) * 16 + 32, 4) AS bits FROM ({})"""


@query("cat_histogram", "SELECT l_returnflag, count(*) AS cnt FROM lineitem GROUP BY 1")
def _(spark, d):
    return categorical.histogram(_t(spark, d, "lineitem"), "l_returnflag")


@query("cat_weights", _weights_sql("lineitem", "l_returnflag", []))
def _(spark, d):
    return categorical.weights(categorical.histogram(_t(spark, d, "lineitem"), "l_returnflag"), "l_returnflag")


@query("cat_rare_branch", _weights_sql("customer", "c_name", []))
def _(spark, d):
    return categorical.weights(categorical.histogram(_t(spark, d, "customer"), "c_name"), "c_name")


@query("cat_model_cost", _COST_SQL.format(_weights_sql("part", "p_name", [])))
def _(spark, d):
    return categorical.model_cost(categorical.weights(categorical.histogram(_t(spark, d, "part"), "p_name"), "p_name"), None)


@query("cond_histogram", "SELECT l_returnflag, l_linestatus, count(*) AS cnt FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return categorical.histogram(_t(spark, d, "lineitem"), "l_linestatus", "l_returnflag")


@query("cond_weights", _weights_sql("lineitem", "l_linestatus", ["l_returnflag"]))
def _(spark, d):
    return categorical.weights(categorical.histogram(_t(spark, d, "lineitem"), "l_linestatus", "l_returnflag"), "l_linestatus", "l_returnflag")


_PAIR = ["l_returnflag", "l_linestatus", "l_linenumber"]
_PAIR_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS target, '{p or ""}' AS predictor, round(sum(n * log2(n) - i), 4) AS bits FROM (
    SELECT sum(c * log2(c)) AS i, sum(c) AS n FROM (SELECT {p or 0} AS p, {t}, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY p)"""
    for t in _PAIR
    for p in [None, *[c for c in _PAIR if c != t]]
)


@query("cond_cost_pairs", _PAIR_SQL)
def _(spark, d):
    return categorical.pair_costs(_t(spark, d, "lineitem"), _PAIR)


@query("column_order")
def _(spark, d):
    """Rows only: the greedy search is no single SQL statement; tests hold it against enumeration."""
    order = categorical.structure(_t(spark, d, "lineitem").select(*_PAIR), dict(zip(_PAIR, (3, 2, 7))))
    return spark.createDataFrame([(c, ",".join(p), round(bits, 4)) for c, p, bits in order], "column_name string, predictors string, bits double")


@query("encoded_bits", f"SELECT round(sum(cnt * (16 - log2(w))), 4) AS bits FROM ({_weights_sql('lineitem', 'l_returnflag', [])})")
def _(spark, d):
    w = categorical.weights(categorical.histogram(_t(spark, d, "lineitem"), "l_returnflag"), "l_returnflag")
    return w.agg(F.round(F.sum(F.col("cnt") * (16 - F.log2("w"))), 4).alias("bits"))


@query("tree_groups", "SELECT l_partkey >> 13 AS grp, l_partkey & 8191 AS term, count(*) AS cnt FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return sequences.tree_groups(_t(spark, d, "lineitem"), "l_partkey")


# Numeric models.
def _sketch_sql(table: str, value: str, order: str, bin_size: float, group: str | None = None) -> str:
    g, part = (f"{group}, ", f"PARTITION BY {group}") if group else ("", "")
    mid = "floor((p05 + p95) / 2)" if bin_size == 1 else "(p05 + p95) / 2"
    return f"""p AS (SELECT * FROM (SELECT {g}CAST({value} AS DOUBLE) AS v, row_number() OVER ({part} ORDER BY {order}) AS r FROM {table}) WHERE r <= 5000),
k AS (SELECT *, row_number() OVER ({part} ORDER BY v) - 1 AS i, count(*) OVER ({part}) AS n FROM p),
q AS (SELECT {g}any_value(n) AS n, max(v) FILTER (i = CAST(floor(n * 0.05) AS BIGINT)) AS p05, max(v) FILTER (i = CAST(floor(n * 0.95) AS BIGINT)) AS p95 FROM k {"GROUP BY " + group if group else ""}),
s AS (SELECT *, CAST(CAST({mid} AS FLOAT) AS DOUBLE) AS mid, CAST(floor(1.5 * (p95 - p05) / {bin_size}) AS BIGINT) // 510 AS per FROM q),
sk AS (SELECT {g}n, p05, p95, mid, CAST(CASE WHEN per <= 1 THEN 1 ELSE pow(2, ceil(log2(per))) END AS BIGINT) AS bb FROM s)"""


_PRICE = ("lineitem", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], 0.01)
_PRICE_SK = _sketch_sql(_PRICE[0], _PRICE[1], ", ".join(_PRICE[2]), _PRICE[3])
_FLAG_SK = _sketch_sql(_PRICE[0], _PRICE[1], ", ".join(_PRICE[2]), _PRICE[3], "l_returnflag")
_BUCKET = "CAST(CASE WHEN i <= -255 * bb THEN 0 WHEN i >= 255 * bb THEN 511 ELSE floor(i / bb) + 256 END AS BIGINT)"
_HIST = f"""x AS (SELECT {_BUCKET} AS bucket FROM (SELECT CAST(floor((l_extendedprice - mid) / 0.01) AS BIGINT) AS i, bb FROM lineitem, sk)),
h AS (SELECT b.bucket, count(x.bucket) + 1 AS freq FROM (SELECT unnest(range(512)) AS bucket) b LEFT JOIN x USING (bucket) GROUP BY 1)"""


def _price_sketch(spark, d, *groups):
    return numeric.quantile_sketch(_t(spark, d, "lineitem"), "l_extendedprice", _PRICE[2], _PRICE[3], *groups)


@query("num_quantile_sketch", f"WITH {_PRICE_SK} SELECT * FROM sk")
def _(spark, d):
    return _price_sketch(spark, d)


@query("num_cond_sketch", f"WITH {_FLAG_SK} SELECT * FROM sk")
def _(spark, d):
    return _price_sketch(spark, d, "l_returnflag")


@query("num_bin_index", f"WITH {_PRICE_SK} SELECT CAST(floor((l_extendedprice - mid) / 0.01) AS BIGINT) AS bin, count(*) AS cnt FROM lineitem, sk GROUP BY 1")
def _(spark, d):
    rows = _t(spark, d, "lineitem").join(F.broadcast(_price_sketch(spark, d)))
    return rows.groupBy(numeric.bin_index(F.col("l_extendedprice"), F.col("mid"), 0.01).alias("bin")).agg(F.count("*").alias("cnt"))


@query("num_histogram512", f"WITH {_PRICE_SK}, {_HIST} SELECT bucket, freq FROM h")
def _(spark, d):
    return numeric.bucket_histogram(_t(spark, d, "lineitem"), "l_extendedprice", _price_sketch(spark, d), 0.01)


@query("num_weights", f"""WITH {_PRICE_SK}, {_HIST},
a AS (SELECT *, greatest(1, freq * 65536 // sum(freq) OVER ()) AS w0 FROM h),
b AS (SELECT *, 65536 - sum(w0) OVER () AS residue, row_number() OVER (ORDER BY w0 DESC, bucket) AS top FROM a)
SELECT bucket, freq, CAST(CASE WHEN top = 1 THEN w0 + residue ELSE w0 END AS BIGINT) AS w FROM b""")
def _(spark, d):
    return numeric.bucket_weights(numeric.bucket_histogram(_t(spark, d, "lineitem"), "l_extendedprice", _price_sketch(spark, d), 0.01))


def _mad_sql(group: str | None) -> str:
    g, on = (f"{group}, ", f"JOIN sk USING ({group})") if group else ("", ", sk")
    by = f"GROUP BY {group}" if group else ""
    return f"""m AS (SELECT {g}count(*) AS n, sum(abs(l_extendedprice - mid)) AS s FROM lineitem {on} {by}),
v AS (SELECT *, CASE WHEN s < 0.01 THEN 0.0 ELSE s / n END AS mad FROM m)
SELECT {g}n, round(mad, 6) AS mad, round(CASE WHEN mad = 0 THEN 0.0 ELSE n * (log2(mad) + 1 + log2(exp(1.0)) - log2(0.01)) END + 32 * 517 + {16 if group else 0} + 40, 2) AS bits FROM v"""


@query("num_mad_cost", f"WITH {_PRICE_SK}, {_mad_sql(None)}")
def _(spark, d):
    return numeric.deviation(_t(spark, d, "lineitem"), "l_extendedprice", _price_sketch(spark, d), 0.01)


@query("num_cond_stats", f"WITH {_FLAG_SK}, {_mad_sql('l_returnflag')}")
def _(spark, d):
    return numeric.deviation(_t(spark, d, "lineitem"), "l_extendedprice", _price_sketch(spark, d, "l_returnflag"), 0.01, "l_returnflag")


_TOTAL_SK = _sketch_sql("orders", "o_totalprice", "o_orderkey", 0.005)


@query("num_outliers", f"""WITH {_TOTAL_SK} SELECT o_orderkey, i > -255 * bb AND i < 255 * bb AS in_range
FROM (SELECT o_orderkey, CAST(floor((o_totalprice - mid) / 0.005) AS BIGINT) AS i, bb FROM orders, sk)""")
def _(spark, d):
    orders = _t(spark, d, "orders")
    sketch = numeric.quantile_sketch(orders, "o_totalprice", ["o_orderkey"], 0.005)
    return numeric.outliers(orders, "o_totalprice", sketch, 0.005).select("o_orderkey", "in_range")


@query("num_quantise_roundtrip", "SELECT l_tax, l_discount, count(*) AS cnt FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    back = lambda c: numeric.quantise(F.col(c), F.lit(0.05), 0.005, 2).alias(c)
    return _t(spark, d, "lineitem").select(back("l_tax"), back("l_discount")).groupBy("l_tax", "l_discount").agg(F.count("*").alias("cnt"))


# Strings.
_D = "'[^/ #]*[/ #]+'"
_WORDS = rf"""t AS (SELECT doc_id, text, regexp_extract_all(text, {_D}) AS p, regexp_extract(text, '[^/ #]*\z') AS tail FROM documents),
u AS (SELECT *, regexp_replace(regexp_replace(tail, '([a-z])([A-Z])', '\1' || chr(1) || '\2', 'g'), '([A-Za-z])([0-9])', '\1' || chr(1) || '\2', 'g') AS cut FROM t),
v AS (SELECT *, regexp_extract_all(cut, '[^-_.\x01]*(?:\x01|[-_.]+)') AS q, regexp_extract(cut, '[^-_.\x01]*\z') AS rest FROM u WHERE text <> ''),
w AS (SELECT doc_id, x[:-2] AS word, x[-1] AS delimiter FROM (SELECT doc_id, unnest(p) AS x FROM v)
      UNION ALL SELECT doc_id, x[:-2], CASE WHEN x[-1] = chr(1) THEN '' ELSE x[-1] END FROM (SELECT doc_id, unnest(q) AS x FROM v)
      UNION ALL SELECT doc_id, rest, '' FROM v)"""


@query("token_counts", f"WITH {_WORDS} SELECT word, count(*) AS cnt FROM w GROUP BY 1")
def _(spark, d):
    return tokens.word_counts(_t(spark, d, "documents"), "text")


@query("frequent_terms", f"WITH {_WORDS} SELECT word, count(*) AS cnt FROM w GROUP BY 1 HAVING (count(*) > 3 AND strlen(word) > 3) OR count(*) > 10")
def _(spark, d):
    return tokens.frequent_words(tokens.word_counts(_t(spark, d, "documents"), "text"))


_PHRASES = f"""p AS (SELECT p FROM (SELECT regexp_extract_all(text, {_D}) AS p FROM documents) WHERE len(p) >= 2),
f AS (SELECT p[i] || p[i + 1][:-2] AS phrase FROM (SELECT p, unnest(range(1, len(p), 2)) AS i FROM p))"""


@query("phrase_counts", f"WITH {_PHRASES} SELECT phrase, count(*) AS cnt FROM f GROUP BY 1")
def _(spark, d):
    return tokens.phrase_counts(_t(spark, d, "documents"), "text")


_DICTIONARY = f"""{_WORDS}, wc AS (SELECT word, count(*) AS cnt FROM w GROUP BY 1),
pp AS (SELECT p FROM (SELECT regexp_extract_all(text, {_D}) AS p FROM documents) WHERE len(p) >= 2),
fc AS (SELECT a, b, c, a || b || c AS phrase, count(*) AS n FROM (SELECT p[i][:-2] AS a, p[i][-1] AS b, p[i + 1][:-2] AS c
       FROM (SELECT p, unnest(range(1, len(p), 2)) AS i FROM pp)) GROUP BY ALL),
pc AS (SELECT phrase, sum(n) AS cnt FROM fc GROUP BY 1),
top AS (SELECT * FROM pc WHERE cnt > 10 AND strlen(phrase) >= 3),
used AS (SELECT word, sum(n) AS u FROM (SELECT a AS word, n FROM fc SEMI JOIN top USING (phrase) UNION ALL SELECT c, n FROM fc SEMI JOIN top USING (phrase)) GROUP BY 1),
l AS (SELECT wc.word, cnt - coalesce(u, 0) AS cnt FROM wc LEFT JOIN used USING (word)),
dict AS (SELECT 0 AS kind, phrase AS term, CAST(cnt AS BIGINT) AS cnt FROM top
         UNION ALL SELECT 1, word, CAST(cnt AS BIGINT) FROM l WHERE (cnt > 3 AND strlen(word) > 3) OR cnt > 10)"""


def _pieces(spark, d):
    return tokens.piece_counts(_t(spark, d, "documents"), "text")


@query("global_dictionary", f"WITH {_DICTIONARY} SELECT kind, term, cnt FROM dict")
def _(spark, d):
    pieces = checkpoint(_pieces(spark, d))
    return tokens.global_dictionary(tokens.words_of(pieces), tokens.phrases_of(pieces))


@query("term_members", f"WITH {_DICTIONARY} SELECT word, word IN (SELECT term FROM dict WHERE kind = 1) AS known FROM wc")
def _(spark, d):
    pieces = _pieces(spark, d)
    words = checkpoint(tokens.words_of(pieces))
    return tokens.term_members(words, tokens.global_dictionary(words, tokens.phrases_of(pieces)))


@query("phrase_members", f"WITH {_DICTIONARY} SELECT phrase, phrase IN (SELECT term FROM dict WHERE kind = 0) AS known FROM pc")
def _(spark, d):
    pieces = _pieces(spark, d)
    phrases = checkpoint(tokens.phrases_of(pieces))
    return tokens.phrase_members(phrases, tokens.global_dictionary(tokens.words_of(pieces), phrases))


@query("delimiter_histogram", f"WITH {_WORDS} SELECT CASE WHEN delimiter = '' THEN 6 ELSE instr('/ #-_.', delimiter) - 1 END AS delimiter, count(*) AS cnt FROM w GROUP BY 1")
def _(spark, d):
    return tokens.delimiter_histogram(_t(spark, d, "documents"), "text")


@query("words_per_string", f"WITH {_WORDS}, n AS (SELECT d.doc_id, count(w.doc_id) AS n_words FROM documents d LEFT JOIN w USING (doc_id) GROUP BY 1) SELECT n_words, count(*) AS cnt FROM n GROUP BY 1")
def _(spark, d):
    return tokens.words_per_text(_t(spark, d, "documents"), "text")


@query("word_length", f"WITH {_WORDS} SELECT strlen(word) AS bytes, count(*) AS cnt FROM w GROUP BY 1")
def _(spark, d):
    return tokens.word_lengths(_t(spark, d, "documents"), "text")


@query("char_markov", _WORDS.replace("documents", "(SELECT p_partkey AS doc_id, p_name AS text FROM part)").join(["WITH ", """,
c AS (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM w WHERE word <> ''),
b AS (SELECT word[i] AS chr, lower(word[i - 1]) AS b, i FROM c)
SELECT CASE WHEN i > 1 AND regexp_full_match(b, '[a-z]') THEN ascii(b) - 96 ELSE 0 END AS context, chr, count(*) AS cnt FROM b GROUP BY 1, 2"""]))
def _(spark, d):
    return tokens.char_transitions(_t(spark, d, "part"), "p_name")


_CHARS = _WORDS.replace("documents", "(SELECT p_partkey AS doc_id, p_name AS text FROM part)").join(["(WITH ", """,
c AS (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM w WHERE word <> ''), b AS (SELECT word[i] AS chr, lower(word[i - 1]) AS b, i FROM c)
SELECT CASE WHEN i > 1 AND regexp_full_match(b, '[a-z]') THEN ascii(b) - 96 ELSE 0 END AS context, chr FROM b)"""])


@query("char_weights", _weights_sql(_CHARS, "chr", ["context"]))
def _(spark, d):
    return categorical.weights(tokens.char_transitions(_t(spark, d, "part"), "p_name"), "chr", "context")


_ROW = "CAST(row_number() OVER (ORDER BY {}) - 1 AS BIGINT) AS row_id"


@query("prefix_delta", f"""WITH r AS (SELECT c_custkey, c_name, {_ROW.format('c_custkey')} FROM customer),
l AS (SELECT *, lag(c_name) OVER (PARTITION BY row_id // 1024 ORDER BY row_id) AS b FROM r),
x AS (SELECT c_custkey, coalesce(list_max(list_filter(range(1, 130), lambda i: i <= length(c_name) AND i <= length(b) AND left(c_name, i) = left(b, i))), 0) AS k FROM l)
SELECT c_custkey, CAST(CASE WHEN k < 5 THEN 0 ELSE k END AS BIGINT) AS delta FROM x""")
def _(spark, d):
    return sequences.prefix_deltas(_t(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey")


@query("prefix_roundtrip", "SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    return sequences.prefix_decode(sequences.prefix_encode(_t(spark, d, "customer"), "c_name", "c_custkey"), "c_name", "c_custkey")


@query("markov_transitions", f"""WITH r AS (SELECT event_type, {_ROW.format('event_id')} FROM events)
SELECT prev, cur, count(*) AS cnt FROM (SELECT coalesce(lag(event_type) OVER (PARTITION BY row_id // 1024 ORDER BY row_id), '') AS prev, event_type AS cur FROM r) GROUP BY 1, 2""")
def _(spark, d):
    return sequences.markov_transitions(_t(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")


# JSON and series.
@query("json_type_counts", """SELECT path, CASE json_type(props, '$.' || path) WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' ELSE lower(json_type(props, '$.' || path)) END AS kind,
count(*) AS cnt FROM (SELECT props, unnest(json_keys(props)) AS path FROM events) GROUP BY 1, 2""")
def _(spark, d):
    return sequences.json_members(_t(spark, d, "events"), "props")


@query("json_existence", """SELECT path, count(*) AS present, (SELECT count(*) FROM events WHERE json_keys(props) IS NOT NULL) - count(*) AS absent
FROM (SELECT unnest(json_keys(props)) AS path FROM events) GROUP BY 1""")
def _(spark, d):
    return sequences.json_existence(_t(spark, d, "events"), "props")


@query("ts_residual_hist", "SELECT CAST(floor(CAST(x AS DOUBLE) / 0.00499) AS BIGINT) AS bin, count(*) AS cnt FROM (SELECT unnest(embedding) AS x FROM embeddings) GROUP BY 1")
def _(spark, d):
    return sequences.series_residuals(_t(spark, d, "embeddings"), "embedding", 0.00499)


_AR = (0.01, [0.4, 0.2, 0.1, 0.05, 0.05])


@query("ts_ar_residuals", f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, unnest(range(len(embedding))) AS t FROM embeddings)
SELECT vec_id, CAST(t AS INTEGER) AS t, round(x[t + 1] - CASE WHEN t >= 5 THEN {_AR[0]} + {' + '.join(f'x[t - {k}] * {c}' if k else f'x[t] * {c}' for k, c in enumerate(_AR[1]))} ELSE {_AR[0]} END, 6) AS residual FROM e""")
def _(spark, d):
    rows = sequences.autoregression(_t(spark, d, "embeddings"), "vec_id", "embedding", *_AR)
    return rows.withColumn("residual", F.round("residual", 6))


# Blocks.
def _blocks(spark, d, table, *order):
    return blocks.encode(_t(spark, d, table), *order)


@query("block_index", f"SELECT row_id // 1024 AS block_id, min(row_id) AS first_row, count(*) AS n_rows FROM (SELECT {_ROW.format('o_orderkey')} FROM orders) GROUP BY 1")
def _(spark, d):
    return blocks.index(_blocks(spark, d, "orders", "o_orderkey"))


@query("locate_block", f"SELECT o_orderkey, row_id // 1024 AS block_id, row_id % 1024 AS place FROM (SELECT o_orderkey, {_ROW.format('o_orderkey')} FROM orders)")
def _(spark, d):
    from bitloom.plans.lineage import with_row_id

    return blocks.locate(with_row_id(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey"), "row_id").drop("row_id")


@query("point_lookup", f"SELECT * FROM (SELECT {_ROW.format('o_orderkey')}, * FROM orders) WHERE row_id IN (0, 7, 1023, 1024, 1400)")
def _(spark, d):
    return blocks.lookup(_blocks(spark, d, "orders", "o_orderkey"), _t(spark, d, "orders").schema, [0, 7, 1023, 1024, 1400])


@query("random_lookups", f"""WITH r AS (SELECT {_ROW.format('o_orderkey')}, * FROM orders),
i AS (SELECT DISTINCT CAST('0x' || left(md5('0:' || draw), 8) AS BIGINT) % (SELECT count(*) FROM orders) AS row_id FROM (SELECT unnest(range(300000)) AS draw))
SELECT r.* FROM r SEMI JOIN i USING (row_id)""")
def _(spark, d):
    """300,000 draws of row numbers, found through their blocks."""
    orders = _t(spark, d, "orders")
    packed = blocks.encode(orders, "o_orderkey")
    total = F.broadcast(orders.agg(F.count("*").alias("total")))  # one row
    drawn = F.conv(F.left(F.md5(F.concat(F.lit("0:"), F.col("id").cast("string"))), F.lit(8)), 16, 10).cast("long")
    ids = spark.range(300_000).join(total).where("total > 0").select((drawn % F.col("total")).alias("row_id"))
    return blocks.rows(packed, orders.schema, ids)


@query("cond_bucketed", """SELECT CAST((l_quantity >= 10) AS BIGINT) + CAST((l_quantity >= 25) AS BIGINT) + CAST((l_quantity >= 40) AS BIGINT) AS l_quantity,
l_returnflag, count(*) AS cnt FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    coded = _t(spark, d, "lineitem").withColumn("l_quantity", registry.bucket(F.col("l_quantity"), [10, 25, 40]))
    return categorical.histogram(coded, "l_returnflag", "l_quantity")


_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"],
    "events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"],
}
for _table, _order in _KEYS.items():

    @query(f"roundtrip_{_table}", f"SELECT * FROM {_table}")
    def _(spark, d, table=_table, order=_order):
        return blocks.decode(_blocks(spark, d, table, *order), _t(spark, d, table).schema)


@query("sample_prefix", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20000")
def _(spark, d):
    """The bounded prefix that structure learning reads: the limit is the feature."""
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(20000)


# Samples, costs of rows, and the other layouts.
@query("sample_replacement", """WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
d AS (SELECT draw, CAST('0x' || left(md5('0:' || draw), 8) AS BIGINT) % (SELECT count(*) FROM orders) AS i FROM (SELECT unnest(range(5000)) AS draw))
SELECT draw, o_orderkey, o_totalprice FROM d JOIN r USING (i)""")
def _(spark, d):
    return sampling.with_replacement(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("sample_share", "SELECT event_id, props FROM events WHERE CAST('0x' || left(md5('0:' || event_id), 8) AS BIGINT) < CAST(floor(0.4 * 4294967296) AS BIGINT)")
def _(spark, d):
    return sampling.share(_t(spark, d, "events").select("event_id", "props"), "event_id", 0.4)


@query("cond_coded_bits", f"SELECT CAST(sum(cnt) AS BIGINT) AS n, round(sum(cnt * (16 - log2(w))), 4) AS bits FROM ({_weights_sql('lineitem', 'l_linestatus', ['l_returnflag'])})")
def _(spark, d):
    lines = _t(spark, d, "lineitem")
    w = categorical.weights(categorical.histogram(lines, "l_linestatus", "l_returnflag"), "l_linestatus", "l_returnflag")
    return categorical.coded_bits(lines, w, "l_linestatus", "l_returnflag")


@query("cat_cumulative", """SELECT p_brand, cnt, CAST((run - cnt) * 65536 // total AS BIGINT) AS low, CAST(run * 65536 // total AS BIGINT) AS high
FROM (SELECT p_brand, cnt, sum(cnt) OVER (ORDER BY p_brand) AS run, sum(cnt) OVER () AS total FROM (SELECT p_brand, count(*) AS cnt FROM part GROUP BY 1))""")
def _(spark, d):
    return categorical.cumulative(categorical.histogram(_t(spark, d, "part"), "p_brand"), "p_brand")


@query("num_median_sketch", """WITH p AS (SELECT o_totalprice AS v FROM orders ORDER BY o_orderkey LIMIT 5000),
k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM p),
m AS (SELECT v AS median, n FROM k WHERE i = n // 2), s AS (SELECT avg(abs(v - median)) AS spread FROM p, m)
SELECT n, median, round(spread, 4) AS spread, CAST(greatest(1, floor(floor(12 * spread / 0.005) / 254)) AS BIGINT) AS per_branch FROM m, s""")
def _(spark, d):
    return numeric.median_sketch(_t(spark, d, "orders"), "o_totalprice", ["o_orderkey"], 0.005, sigmas=6, branches=256)


@query("encoding_methods", f"""WITH {_WORDS}, c AS (SELECT word, count(*) AS cnt FROM w GROUP BY 1)
SELECT CASE WHEN (cnt > 3 AND strlen(word) > 3) OR cnt > 10 THEN 2 ELSE 0 END AS method, CAST(sum(cnt) AS BIGINT) AS cnt FROM c GROUP BY 1""")
def _(spark, d):
    return tokens.encoding_methods(tokens.word_counts(_t(spark, d, "documents"), "text"))


@query("clamped_lengths", "SELECT least(strlen(url), 63) AS bytes, count(*) AS cnt FROM pages GROUP BY 1")
def _(spark, d):
    return tokens.clamped_lengths(_t(spark, d, "pages"), "url")


@query("ts_detect", "SELECT count(*) AS n, count(*) FILTER (len(embedding) > 0) AS series, min(len(embedding)) AS shortest, max(len(embedding)) AS longest FROM embeddings")
def _(spark, d):
    size = F.size("embedding").cast("long")
    return _t(spark, d, "embeddings").agg(F.count("*").alias("n"), F.count(F.when(size > 0, 1)).alias("series"), F.min(size).alias("shortest"), F.max(size).alias("longest"))


@query("json_int_leaf", "SELECT count(*) AS n, min(k) AS least, max(k) AS most, CAST(sum(k) AS BIGINT) AS total FROM (SELECT CAST(props ->> '$.k' AS BIGINT) AS k FROM events) WHERE k IS NOT NULL")
def _(spark, d):
    leaf = _t(spark, d, "events").select(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")).where("k is not null")
    return leaf.agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"), F.sum("k").alias("total"))


@query("json_paths", """SELECT '' AS path, 'object' AS kind, count(*) AS cnt FROM events WHERE props IS NOT NULL GROUP BY ALL
UNION ALL SELECT '.' || k, CASE json_type(props, '$.' || k) WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' ELSE lower(json_type(props, '$.' || k)) END, count(*)
FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL""")
def _(spark, d):
    return documents.paths(_t(spark, d, "events").select(F.try_parse_json("props").alias("doc")))


@query("role_transitions", """SELECT prev, role AS cur, count(*) AS cnt FROM (SELECT coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prev, role FROM conversations) GROUP BY ALL""")
def _(spark, d):
    return sequences.group_transitions(_t(spark, d, "conversations"), "role", "conv_id", "turn")


# Nested JSON: a document for each conversation, texts only at even turns.
_TALKS = """n AS (SELECT conv_id, count(*) AS k FROM conversations GROUP BY 1),
l AS (SELECT '.id' AS path, 'int' AS kind, CAST(conv_id AS DOUBLE) AS x FROM n WHERE conv_id IS NOT NULL
      UNION ALL SELECT '.turns[].turn', 'int', turn FROM conversations WHERE turn IS NOT NULL
      UNION ALL SELECT '.turns[].role', 'string', strlen(role) FROM conversations WHERE role IS NOT NULL
      UNION ALL SELECT '.turns[].text', 'string', strlen(text) FROM conversations WHERE turn % 2 = 0 AND text IS NOT NULL),
e AS (SELECT path, count(*) AS present, (SELECT count(*) FROM conversations) - count(*) AS absent FROM l WHERE path <> '.id' GROUP BY 1
      UNION ALL SELECT '.id', count(conv_id), count(*) - count(conv_id) FROM n UNION ALL SELECT '.turns', count(*), 0 FROM n)"""


def _talks(spark, d) -> DataFrame:
    each = F.struct("turn", "role", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"))
    talks = _t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("turns"))
    return documents.nodes(talks.select(F.parse_json(F.to_json(F.struct(F.col("conv_id").alias("id"), "turns"))).alias("doc")))


@query("json_members_existence", f"WITH {_TALKS} SELECT path, present, absent FROM e")
def _(spark, d):
    return documents.existence(_talks(spark, d))


@query("json_array_lengths", f"WITH {_TALKS} SELECT '.turns' AS path, k AS elements, count(*) AS cnt FROM n GROUP BY 2")
def _(spark, d):
    return documents.lengths(_talks(spark, d))


@query("json_leaves", f"WITH {_TALKS} SELECT path, kind, count(*) AS cnt, min(x) AS least, max(x) AS most, sum(x) AS total FROM l GROUP BY 1, 2")
def _(spark, d):
    return documents.leaves(_talks(spark, d))


@query("json_node_costs", f"""WITH {_TALKS}, h AS (SELECT path, 'existence' AS model, unnest([present, absent]) AS c FROM e
UNION ALL SELECT path, 'kind', present FROM e UNION ALL SELECT '', 'kind', count(*) FROM n UNION ALL SELECT '.turns[]', 'kind', count(*) FROM conversations
UNION ALL SELECT '.turns', 'length', count(*) FROM n GROUP BY k)
SELECT path, model, round(sum(c) * log2(sum(c)) - sum(c * log2(c)) + 16 * (count(*) - 1) + 32, 4) AS bits FROM h WHERE c > 0 GROUP BY 1, 2""")
def _(spark, d):
    return documents.costs(_talks(spark, d))


@query("json_schema", """SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS place, name, code
FROM (VALUES ('id', 6), ('turns', 4), ('turns[]', 3), ('turns[]role', 5), ('turns[]text', 5), ('turns[]turn', 6)) v(name, code)""")
def _(spark, d):
    return documents.schema(_talks(spark, d)).select("place", F.concat_ws("", "parts").alias("name"), "code")
