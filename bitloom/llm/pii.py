"""PII by a skip-chain conditional random field over the candidate tokens of each document."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import text_bytes
from bitloom.llm.secrets import to_code_points

# Kinds in the order of the digest, and the characters of an address on UTF-8 bytes.
KINDS = ("email", "ip", "card", "phone")
LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
#: Candidates: what stands around an at sign, and digits with what joins the parts of a number.
AROUND = re.compile(rb"@[A-Za-z0-9.-]+")
NUMBER = re.compile(rb"[+(]?[0-9](?:[\x20().0-9-]*[0-9])?")
LABELS = ("none", *KINDS)
#: Rounds of loopy message passing, and the marginal from which a candidate is added to the base spans.
ROUNDS, ADD_FROM = 8, 0.6
#: Smoothing of the learned potentials.
SMOOTH = 1.0
#: Digits that a candidate without an at sign has at least if it is to be added.
LEAST_DIGITS = 7
N = len(LABELS)
#: Links whose messages are worked out together.
TOGETHER = 1 << 17


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(b: bytes) -> bytes:
    return re.sub(rb"[^0-9]", b"", b)


def _addresses(data: bytes, after: re.Pattern) -> Iterator[tuple[int, int]]:
    """Leftmost spans of address characters and what ``after`` matches from the next at sign on.

    Each at sign extends to both sides once, so a long run without one costs nothing: an expression
    that starts at each character of the run would take quadratic time.
    """
    free, at = 0, data.find(b"@")
    while at >= 0:
        m = after.match(data, at)
        start = free + len(data[free:at].rstrip(LOCAL))
        if m and start < at:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = data.find(b"@", free)


def _parts(data: bytes) -> Iterator[tuple[int, int]]:
    """Four numbers joined by single dots, leftmost in each chain of numbers; each is 255 at most."""
    for chain in CHAIN.finditer(data):
        numbers = chain[0].split(b".")
        if len(numbers) < 4:
            continue
        start = chain.start()
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            end = start + sum(map(len, four)) + 3
            # The length is looked at first: Python refuses to read numbers of thousands of digits.
            if all(len(p.lstrip(b"0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield start, end
            start = end + 1


def base_spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes: leftmost without overlaps per kind; failing matches are dropped.

    Linear in the text, whatever runs it holds.
    """
    out = []
    if b"@" in data:
        out += [(s, e, "email") for s, e in _addresses(data, DOMAIN)]
    out += [(s, e, "ip") for s, e in _parts(data)]
    for m in CARD.finditer(data):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
    if b"+" in data:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(data) if 8 <= len(_digits(m[0])) <= 15]
    return out


def form(token: bytes) -> int:
    """The surface form that the unary potential depends on, one of a fixed number of codes.

    Of an address: whether its domain has a dot. Of a number: its digits (20 at
    most), groups (6), the digits of the first and the last group (5 each), which joining characters it
    has and whether it begins with a plus sign or a bracket. Whole tokens are read.
    """
    if b"@" in token:
        return -1 - (b"." in token.partition(b"@")[2].strip(b"."))
    groups = [len(g) for g in re.split(rb"[^0-9]+", token.strip(b"+(")) if g]
    marks = sum(1 << i for i, c in enumerate(b" ().-") if c in token[1:])
    head = 1 if token[:1] == b"+" else 2 if token[:1] == b"(" else 0
    out = min(sum(groups), 20)
    for value, size in ((min(len(groups), 6), 7), (min(groups[0], 5), 6), (min(groups[-1], 5), 6), (marks, 32), (head, 3)):
        out = out * size + value
    return out


def keys(token: bytes) -> tuple[bytes, bytes]:
    """Tokens that share the first key name the same thing, those that share the second are similar.

    A number's last ten and its last seven digits; an address's local part and its domain.
    """
    if b"@" in token:
        local, _, domain = token.lower().partition(b"@")
        return b"@" + local, b"." + domain
    d = _digits(token)
    return (d[-10:], b"-" + d[-7:]) if len(d) >= LEAST_DIGITS else (b"", b"")


def candidates(data: bytes) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int, str]]]:
    """Candidate spans, the base label of each (0: none), and the base spans."""
    base = base_spans(data)
    spans = list(_addresses(data, AROUND)) if b"@" in data else []
    if spans:
        at, numbers = 0, []
        for m in NUMBER.finditer(data):
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            if at == len(spans) or spans[at][0] >= m.end():
                numbers.append(m.span())
        spans = sorted(spans + numbers)
    else:
        spans = [m.span() for m in NUMBER.finditer(data)]
    labels = [0] * len(spans)
    if base:
        order = sorted(base)
        at = 0
        for i, (s, e) in enumerate(spans):
            while at < len(order) and order[at][1] <= s:
                at += 1
            # The first base span that overlaps; at most one of each kind begins before it and ends after s.
            for bs, be, kind in order[at : at + len(KINDS)]:
                if bs < e and be > s:
                    labels[i] = LABELS.index(kind)
                    break
    return spans, labels, base


def _edges(names: list[bytes]) -> list[tuple[int, int]]:
    """Skip links: each token with the last earlier one of the same key."""
    last: dict[bytes, int] = {}
    out = []
    for i, k in enumerate(names):
        if k:
            if k in last:
                out.append((last[k], i))
            last[k] = i
    return out


def _links(tokens: list[bytes]) -> dict[str, list[tuple[int, int]]]:
    """Pairs of tokens that share a potential: neighbours, the same thing named again, similar ones."""
    named = [keys(t) for t in tokens]
    same = _edges([k for k, _ in named])
    held = set(same)
    return {"next": [(i, i + 1) for i in range(len(tokens) - 1)], "same": same, "like": [x for x in _edges([k for _, k in named]) if x not in held]}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, a, b, n): forms with labels, and labels of linked tokens, of all documents."""
    total: dict[tuple[str, int, int], int] = {}

    def add(*k):
        total[k] = total.get(k, 0) + 1

    for batch in batches:
        for text in batch.column(0):
            data = text.as_py() or b""
            spans, labels, base = candidates(data)
            tokens = [data[s:e] for s, e in spans]
            if base:
                # A mention that the base misses is no counterexample where the document names it elsewhere.
                named = [keys(t)[0] for t in tokens]
                sure = {k: x for k, x in zip(named, labels) if k and x}
                labels = [x or sure.get(k, 0) for k, x in zip(named, labels)]
            for t, x in zip(tokens, labels):
                add("form", form(t), x)
            for what, pairs in _links(tokens).items():
                for i, j in pairs:
                    add(what, labels[i], labels[j])
    rows = list(total.items())  # forms and labels are of a fixed number
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k, _ in rows], pa.string()), *(pa.array([k[i] for k, _ in rows], pa.int64()) for i in (1, 2)), pa.array([n for _, n in rows], pa.int64())],
        names=["what", "a", "b", "n"],
    )


class SkipChain:
    """Log-potentials of forms, neighbours and skip links, and loopy sum-product over one document."""

    def __init__(self, forms: dict[int, np.ndarray], rest: np.ndarray, tables: dict[str, np.ndarray]):
        self.forms, self.rest, self.tables = forms, rest, tables

    def marginals(self, tokens: list[bytes], labels: list[int]) -> np.ndarray:
        """P(label) of each token; tokens with a base label are observed."""
        unary = np.stack([self.forms.get(form(t), self.rest) for t in tokens])
        seen = np.flatnonzero(labels)
        unary[seen] = -20.0
        unary[seen, np.array(labels)[seen]] = 0.0
        # Both directions of every link; a message leaves out what came back over its own link.
        source, target, table, all_tables = [], [], [], []
        for what, pairs in _links(tokens).items():
            if pairs:
                p = np.array(pairs)
                source += [p[:, 0], p[:, 1]]
                target += [p[:, 1], p[:, 0]]
                table += [np.full(len(p), len(all_tables)), np.full(len(p), len(all_tables) + 1)]
                all_tables += [self.tables[what], self.tables[what].T]
        if not source:
            return _normal(unary)
        back = np.concatenate([x + len(a) * (1 - 2 * (k % 2)) for k, (a, x) in enumerate(zip(source, np.split(np.arange(sum(map(len, source))), np.cumsum([len(x) for x in source])[:-1])))])
        source, target, table = np.concatenate(source), np.concatenate(target), np.concatenate(table)
        tables = np.stack(all_tables)
        messages = np.zeros((len(source), N))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, messages)
            new = np.empty_like(messages)
            for at in range(0, len(source), TOGETHER):  # a long text's tables are not made at once
                part = slice(at, at + TOGETHER)
                out = belief[source[part]] - messages[back[part]]
                joint = out[:, :, None] + tables[table[part]]
                top = joint.max(axis=1, keepdims=True)
                sent = np.log(np.exp(joint - top).sum(axis=1)) + top[:, 0]
                new[part] = sent - sent.max(axis=1, keepdims=True)
            messages = 0.5 * messages + 0.5 * new
        belief = unary.copy()
        np.add.at(belief, target, messages)
        return _normal(belief)


def _normal(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(texts: DataFrame) -> SkipChain:
    """Potentials from counts over all ``texts`` (one binary column), labelled by the base expressions.

    Piecewise training: log P(label | form), and log-ratios of label pairs to independence for
    neighbours and for both kinds of skip links. Counts are summed per task and grouped; all of them come
    to the driver, as forms and labels are of a fixed number. A form that training lacks gets the shares
    of all forms together. Skip links of agreeing labels keep a positive potential even in a corpus
    without repeated tokens.
    """
    counts = texts.mapInArrow(_counts, "what string, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    forms: dict[int, np.ndarray] = {}
    tables = {"next": np.ones((N, N)), "same": np.ones((N, N)) + 50 * np.eye(N), "like": np.ones((N, N)) + 5 * np.eye(N)}
    for r in sorted(counts):
        if r.what == "form":
            forms.setdefault(r.a, np.full(N, SMOOTH / N))[r.b] += r.n
        else:
            tables[r.what][r.a, r.b] += r.n
    rest = sum(forms.values(), np.full(N, SMOOTH / N))
    out = {}
    for what, t in tables.items():
        p = t / t.sum()
        out[what] = np.clip(np.log(p / (p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True))), -3, 3)
    return SkipChain({k: np.log(x / x.sum()) for k, x in forms.items()}, np.log(rest / rest.sum()), out)


def find_pii(data: bytes, model: SkipChain) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, spans that the field adds), each (start, end, kind) in bytes.

    The field runs wherever it may add a span: on every document with a candidate that has no base label
    and has an at sign or LEAST_DIGITS digits.
    """
    spans, labels, base = candidates(data)
    open_ = [not k and (b"@" in data[s:e] or e - s >= LEAST_DIGITS and len(_digits(data[s:e])) >= LEAST_DIGITS) for (s, e), k in zip(spans, labels)]
    if not any(open_):
        return base, []
    p = model.marginals([data[s:e] for s, e in spans], labels)
    best = p.argmax(axis=1)
    sure = (best > 0) & (p[np.arange(len(p)), best] >= ADD_FROM) & np.array(open_)
    return base, [(*spans[i], LABELS[best[i]]) for i in np.flatnonzero(sure)]


def _model(docs: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(train(docs.select(text_bytes().alias("text"))))


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, found: array of kind, start, end in code points, base) for every row of ``docs``.

    Ordered by kind, then start. Null texts are empty; no rows give no rows. The field carries labels from
    sure mentions to unsure ones of the same document. Rows stay in place, so repeated or null ids do no
    harm and columns of any other name are not looked at; a text is read whole, in linear time.
    """
    model = _model(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = text.as_py() or b""
                base, added = find_pii(data, model.value)
                spans = [(*x, True) for x in base] + [(*x, False) for x in added]
                at = to_code_points(data, [o for s in spans for o in s[:2]]) if spans else {}
                spans.sort(key=lambda s: (KINDS.index(s[2]), s[0]))
                rows.append([{"kind": k, "start": at[s], "end": at[e], "base": b} for s, e, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], names=["doc_id", "found"])

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(
        run, "doc_id long, found array<struct<kind string, start long, end long, base boolean>>"
    )


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x or [] for x in batch.column(1).to_pylist()]
        joined = lambda found: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in found)
        base = [[s for s in r if s["base"]] for r in rows]
        count = lambda kind: pa.array([sum(s["kind"] == kind for s in r) for r in base], pa.int64())
        sha = pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *map(count, KINDS), sha, pa.array([joined(r) for r in rows], pa.string())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def query(spark, sf_dir: str) -> DataFrame:
    """op3: counts and digests of the personal data in all documents."""
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.mapInArrow(_digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(data: bytes, spans: list[tuple[int, int, str]]) -> bytes:
    """The text with every span (overlaps merged) replaced by its kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for s, e, kind in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, kind])
    for s, e, kind in merged:
        out += [data[at:s], b"[" + kind.upper().encode() + b"]"]
        at = e
    return b"".join([*out, data[at:]])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: found spans are masked in the text, n_chars is set anew where a text changed.

    All documents stay, repeated rows too; null texts stay null, empty ones empty; no rows give no rows.
    The caller's columns travel in one struct, so their names don't matter.
    """
    model = _model(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text in batch.column(1):
                data = text.as_py()
                spans = sum(find_pii(data, model.value), []) if data else []
                new.append(masked(data, spans) if spans else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.binary())], names=["row", "masked"])

    packed = docs.select(F.struct("*").alias("row"), text_bytes().alias("_text"))
    schema = packed.select("row", F.col("_text").alias("masked")).schema
    out = packed.mapInArrow(run, schema)
    text = F.coalesce(F.col("masked").cast("string"), F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("masked").isNotNull(), F.length(text).cast("long")).otherwise(F.col("row").getField("n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
