"""Secrets and personal data against the contract's expressions, read naively, and on texts with long runs."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from bitloom.llm import pii, secrets, substrings

SCHEMA = "doc_id long, text string, _text string, row string"

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    doubled = [int(x) * (1 + k % 2) for k, x in enumerate(reversed(s))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def naive_secrets(text):
    found = [("assign", m) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def naive_pii(text):
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda x: (pii.KINDS.index(x[0]), x[1]))


def texts():
    r = random.Random(3)
    parts = ["é", "password", "TOKEN", "api_key", "=", ": ", "'", "abcdef", "a1b2c3", "AKIA" + "Q7" * 8, "AKIA", "0af" * 8, " ", "\n", "x", "secret", "hunter-22"]
    parts2 = ["a", "@", ".", "1", "255", "300", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "4111111111111111", "+1 (499) 555-6503", "me@x.org", "10.0.0.1", "é", "%", "9" * 30]
    out = ["".join(r.choice(p) for _ in range(r.randrange(40))) for p in (parts, parts2) for _ in range(400)]
    return [*out, None, "", " ", "7" * 5000, "7" * 5000 + ".1.1.1", "1.1.1." + "0" * 5000 + "1 x@y.zz", *out[:3]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "a", "b") for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "me@x.org", None, None), *rows[-3:]], SCHEMA)


def same_base(rows, naive, columns):
    held = dict(enumerate(texts())) | {None: "me@x.org"}
    assert len(rows) == len(held) + 3
    for r in rows:
        want = naive(held[r.doc_id] or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in columns] == [sum(x[0] == k for x in want) for k in columns]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_secrets_hold_the_contract_s_spans(spark, docs):
    digest = secrets.secret_spans(docs).mapInArrow(secrets._digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    same_base(digest.collect(), naive_secrets, secrets.KINDS[:3])
    assert secrets.secret_spans(docs.where("false")).count() == 0


def test_pii_holds_the_contract_s_spans(spark, docs):
    digest = pii.pii_spans(docs).mapInArrow(pii._digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    same_base(digest.collect(), naive_pii, pii.KINDS)
    assert pii.pii_spans(docs.where("false")).count() == 0


def test_pii_stage_keeps_rows_and_clashing_columns(spark, docs):
    out = pii.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or -1, r._text or "", r.row or "") for r in out.collect()))
    assert got == sorted(((r.doc_id or -1, r._text or "", r.row or "") for r in docs.collect()))
    assert pii.stage(spark, docs.where("false"), "").count() == 0


@pytest.mark.parametrize("unit", ["7", "a", "@", "a@", "eyJ", "eyJaa.eyJbb.", "abC9+/", "1.1.", "+1(", "1-", "token = ", "A ", "a@b.c", "12345678 x "])
def test_long_runs_take_linear_time(unit):
    """A quarter of a megabyte of one run: a quadratic scan takes minutes."""
    data = (unit * (250_000 // len(unit))).encode()
    model = pii.SkipChain({}, pii.np.zeros(pii.N), {k: pii.np.zeros((pii.N, pii.N)) for k in ("next", "same", "like")})
    began = time.time()
    pii.find_pii(data, model)
    secrets.find_secrets(data, secrets.automaton())
    assert time.time() - began < 20


def test_deeply_nested_token_parts_are_no_json():
    import base64

    part = base64.urlsafe_b64encode(b'{"a":' + b"[" * 100_000).rstrip(b"=")
    assert secrets.find_secrets(b"eyJ" + part[3:] + b"." + part + b".x", secrets.automaton()) is not None


def test_message_passing_is_exact_on_a_chain():
    """Without skip links the field is a chain, where sum-product gives the marginals of full enumeration."""
    import itertools

    r = pii.np.random.default_rng(1)
    chain = r.normal(size=(pii.N, pii.N))
    forms = {pii.form(t): r.normal(size=pii.N) for t in (b"12", b"345", b"6-7")}
    model = pii.SkipChain(forms, pii.np.zeros(pii.N), {"next": chain, "same": chain, "like": chain})
    tokens = [b"12", b"345", b"6-7"]
    total = pii.np.zeros((3, pii.N))
    for x in itertools.product(range(pii.N), repeat=3):
        w = pii.np.exp(sum(forms[pii.form(t)][k] for t, k in zip(tokens, x)) + chain[x[0], x[1]] + chain[x[1], x[2]])
        for i, k in enumerate(x):
            total[i, k] += w
    want = total / total.sum(axis=1, keepdims=True)
    assert pii.np.abs(model.marginals(tokens, [0, 0, 0]) - want).max() < 0.02


def test_forest_joins_what_the_links_join():
    """As many links as nodes less components, all of them true cells, and the same components."""
    rng = np.random.default_rng(0)

    def components(pairs, rows, columns):
        name = list(range(rows + columns))
        for i, j in pairs:
            old, new = name[rows + j], name[i]
            name = [new if x == old else x for x in name]
        return [name.index(x) for x in name]

    for _ in range(200):
        link = rng.random(rng.integers(1, 9, 2)) < rng.random() / 2
        rows, columns = substrings._forest(link)
        assert link[rows, columns].all()
        want = components(zip(*np.nonzero(link)), *link.shape)
        assert components(zip(rows, columns), *link.shape) == want
        assert len(rows) == sum(link.shape) - len(set(want))
