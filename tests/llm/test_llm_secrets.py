import hashlib
import math
import random
import re
from collections import Counter

import pytest

from netloom.llm import secrets

ASSIGN = re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    t = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, b, k in sorted(out)]


def entropy(s):
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def entropy_spans(text):
    """Every window of every candidate on its own."""
    out = []
    for m in re.finditer(secrets.CANDIDATE, text or ""):
        hit = m[0]
        if re.search(secrets.ALLOW.replace("(?i)example", "(?i:example").replace("your_?", "your_?)"), hit):
            continue
        if all(re.fullmatch("[A-Z]?[a-z]*|[A-Z]*|[0-9]*", p) for p in re.split(secrets.SEPARATORS, hit)):
            continue
        cs = next(c for c in secrets.CHARSETS if re.search(c.pattern, hit))
        if any(entropy(hit[i:i + secrets.WINDOW]) >= cs.bits - 1e-10 for i in range(len(hit) - secrets.WINDOW + 1)):
            out.append((cs.kind, m.start(), m.end()))
    return out


RNG = random.Random(11)
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
rand = lambda n, chars=B64: "".join(RNG.choice(chars) for _ in range(n))
TEXTS = [
    None, "", "plain words only", 'token = "' + rand(40) + '"', "token=short then token=" + rand(30), "secret=password:abcdefghijklmnop",
    "PassWord':  'abcdefghijkl x", "api_key=abcdefghijk", "apikey:abcdefghijkl", "token==abcdefghijkl", "AKIA" + "Z" * 14, "AKIA" + "Z" * 13,
    "AKIAAKIA" + "Q" * 12 + " AKIA1", "0123456789abcdef", "0123456789abcde g", "F" + "0" * 16, "\U0001f600é token=" + rand(20) + " \U0001f600" + "deadbeef" * 3,
    "x" + rand(64) + "\n" + rand(24) + " " + rand(23), rand(60, "0123456789ABCDEF") + " " + "0123456789ABCDEF" * 3, "a" * 30 + rand(30) + "a" * 30 + rand(25),
    "123e4567-E89B-12D3-A456-426614174000", "internationalisationsfreundlichkeitsbeauftragter", "path/to/some/very/long/directory/name/here",
    "exampleKEY" + rand(40), "token=" + rand(12) + " " * 5 + "secret='" + rand(13) + "' password: " + rand(5), (rand(50) + " word ") * 40,
    "token token: token token=abcdefghijklmnopq token", "9" * 5000, rand(3000), "a/" * 3000, rand(30) + "==", "session_id=" + rand(40),
    "2023/10/11/some-article-title-in-a-long-slug-2", rand(40, B64[:52]), rand(30, "abcdefghijklmnopqrstuvwxyz0123456789"), rand(32, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "ab1" * 20 + rand(24), "deadbeef" * 3 + " " + ("0f" * 8 + " ") * 300]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "old", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string, n_chars long")


def test_rule_spans_match_the_patterns(docs):
    for r in secrets.secret_report(docs).collect():
        want = base_spans(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (r.doc_id, want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in want) for x in ("assign", "access", "hex"))


def test_entropy_spans_match_every_window(docs):
    some = 0
    for r in secrets.scan(docs).collect():
        got = [(s.kind, s.start, s.stop) for s in r.spans if s.kind.startswith("entropy")]
        assert sorted(got) == sorted(entropy_spans(TEXTS[r.doc_id])), r.doc_id
        some += bool(got)
        order = [s.kind for s in secrets.RULES] + [c.kind for c in secrets.CHARSETS]
        keys = [(s.start, order.index(s.kind)) for s in r.spans]
        assert keys == sorted(keys) and [s for s in r.spans if not s.kind.startswith("entropy")] == r.base_spans
    assert some >= 5


def test_redaction(docs):
    found = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        t, cover = TEXTS[r.doc_id], set()
        if t is None:
            assert r.text is None
            continue
        for s in found[r.doc_id]:
            cover |= set(range(s.start, s.stop))
        want, at = "", 0
        while at < len(t):
            if at in cover:
                want += "[SECRET]"
                while at in cover:
                    at += 1
            else:
                want += t[at]
                at += 1
        assert r.text == want, r.doc_id


@pytest.mark.parametrize("name,chars", [("base64", B64), ("base36", "abcdefghijklmnopqrstuvwxyz0123456789"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
                                        ("letters", B64[:52]), ("hex", "0123456789ABCDEF")])
def test_random_secrets_are_found_and_covered_whole(spark, name, chars):
    rng = random.Random(name)
    texts = [f"see {''.join(rng.choice(chars) for _ in range(n))} here" for n in (24, 32, 40) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sum(any(s.start <= 4 and s.stop >= len(texts[r.doc_id]) - 5 for s in r.spans) for r in secrets.scan(df).collect())
    assert whole >= 0.98 * len(texts), whole / len(texts)


def test_long_candidates_of_every_allowed_shape(spark):
    n = 1 << 20
    shapes = ["a/" * (n // 2), "word-" * (n // 5), "Word_" * (n // 5), "xyz" * (n // 3), "7" * n, "/" * n, "A" * n, "12/" * (n // 3), "=" * n, "example" + "aB3" * (n // 3),
              "0123456789abcdef" * (n // 16), ("0123456789abcdef" + "\n") * (n // 17)]
    df = spark.createDataFrame(list(enumerate(shapes)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    assert [len(got[i]) for i in range(len(shapes))] == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, n // 17]  # long runs of hex digits are a rule's
    hidden = {r.doc_id: r.text for r in secrets.redact(df.where("doc_id >= 10")).collect()}
    assert hidden == {10: "[SECRET]", 11: "[SECRET]\n" * (n // 17)}


def test_empty_and_repeated(spark, docs):
    assert secrets.secret_report(docs.limit(0)).count() == 0
    assert secrets.secret_report(docs.union(docs)).count() == 2 * len(TEXTS)
