import random
import re
from collections import Counter

import pytest

from netloom.llm import quality


def slow(text):
    t = text or ""
    w = re.findall(quality.WORD, t)
    lines = [x for x in t.split("\n") if re.search(quality.WORD, x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if n[g] > 1 for o in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


RNG = random.Random(9)
TEXTS = [None, "", " \t\n", "one", "a b", "a b c", "a b c a b c", "x x x x x", "a b a b a b a", "<p>#1 & 2|3</p> $ % * é ü 　z", "l\nl\n \nm\nl\n", "\na\x0bb\x1cc\n"]
TEXTS += [" ".join(RNG.choice("abcdef") for _ in range(n)) for n in (4, 30, 60, 200, 5000)]
TEXTS += [" ".join(f"w{RNG.randint(0, 10 ** 6)}" for _ in range(n)) for n in (49, 50, 400)] + ["w " * 40_000]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, None if i % 5 == 0 else f"s{i % 3}", "old", 3) for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, source string, n_words string, kept int")


def test_measures(docs):
    got = quality.measure(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert tuple(r[m] for m in quality.MEASURES) == slow(TEXTS[r.doc_id]), r.doc_id


def test_report_on_edge_cases(docs):
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, r in got.items():
        w, _, _, _, again = slow(TEXTS[i])
        assert r.base_failed == (w < 50 or 100 * again > 50 * w) and (not r.kept if r.base_failed else r.kept is not None)
    assert quality.report(docs.limit(0)).count() == 0
    assert quality.report(docs.union(docs)).count() == 2 * len(TEXTS)


def test_host_verdicts_are_shrunk(spark):
    counts = {"good": (400, 10), "fair": (300, 30), "mixed": (250, 90), "bad": (300, 285), "small_bad": (1, 1), None: (5, 0)}
    rows = [(h, i < k) for h, (n, k) in counts.items() for i in range(n)]
    got = {r.host: r for r in quality.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()}
    assert not got["bad"].verdict and got["good"].verdict and got["small_bad"].rate < 0.95 and got[None].n == 5
    n, k = sum(n for n, _ in counts.values()), sum(k for _, k in counts.values())
    for h, (m, b) in counts.items():  # between the host's own rate and the common one
        lo, hi = sorted((b / m, k / n))
        assert lo - 1e-9 <= got[h].rate <= hi + 1e-9
    alike = [(h, i < 3) for h in "abc" for i in range(30)]
    assert {r.rate for r in quality.host_verdicts(spark.createDataFrame(alike, "source string, base_failed boolean")).collect()} == {0.1}


def test_a_bad_host_takes_its_good_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good if i % 10 == 0 or i >= 100 else "short", "bad" if i < 100 else f"h{i % 4}") for i in range(300)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.kept == (r.doc_id >= 100) for r in got)
