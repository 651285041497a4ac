import hashlib
import random
import re

import pytest

from netloom.llm import infill

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, text string, form string, n string"


def plain(key, text):
    t = text or ""
    units = re.findall(UNIT, t)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    alphabet = ["a", "é", "漢", "\U0001f600", " ", "\n", "\t", "  ", "<", "P", ">", "<P", "<M", "\xa0", "\x0b", "\x00"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [None, "", " ", "\n\n ", "one", " one ", "a <P> b", "x<S>", "<M>", "<P", *made, "x" * 200_000, " " * 100_000, "w " * 150_000, "ab  \n" * 60_000 + " "]


@pytest.mark.parametrize("span", [1, 2, 7, 50, infill.SPAN])
def test_frames_keep_units_and_find_cuts(span):
    for t in texts()[:-4] if span < 50 else texts():
        t = t or ""
        units = re.findall(UNIT, t)
        f = infill.store(t, span)
        assert f.units[-1] == len(units) and f.chars[-1] == len(t) and f.bytes[-1] == len(t.encode())
        assert "".join(f.read(0, len(t))) == t
        for k in {0, len(units), len(units) // 2, len(units) // 3, max(len(units) - 1, 0)}:
            assert f.place(k) == len("".join(units[:k]))
        lo, hi = len(t) // 4, len(t) // 4 * 3
        assert "".join(f.read(lo, hi)) == t[lo:hi]


def test_a_cut_opens_one_frame(monkeypatch):
    f = infill.store("some words here " * 1000, 64)
    opened = []
    read = infill.Frames.text
    monkeypatch.setattr(infill.Frames, "text", lambda self, i: opened.append(i) or read(self, i))
    f.place(1500)
    assert len(f.data) > 100 and len(opened) <= 1


def test_rows_match_the_plain_version_and_restore(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id at all here"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in rows], SCHEMA).repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t in rows:
        n, form, p, m, out = plain(k, t)
        want.append((k, n, form, p, m, sha(out), sha(t or "")))
    order = lambda r: tuple(str(x) for x in r)
    got = [tuple(r) for r in infill.infill_digests(docs).collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    made = infill.restore(infill.fill_in_middle(docs)).collect()
    assert all(r.restored == (r.text or "") for r in made) and len(made) == len(rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert sorted((sha(r.output), r.form) for r in made) == sorted((w[5], w[2]) for w in want)


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_restoring_finds_marks_across_pieces(form):
    f = infill.store("alpha beta gamma delta <P <S M> epsilon" * 9, 5)
    out = "".join(infill.output(f, infill.Infill(form, 11, 40)))
    for step in (1, 2, 3, 10):
        pieces = iter([out[i:i + step] for i in range(0, len(out), step)])
        assert "".join(infill.restored(pieces, form)) == "".join(f.read(0, f.chars[-1]))


def test_frames_as_a_table(spark):
    import zstandard

    docs = spark.createDataFrame([(1, "word " * 50_000, "", ""), (2, None, "", "")], SCHEMA)
    got = {r.doc_id: r.frames for r in infill.compress(docs).collect()}
    assert got[2] == [] and len(got[1]) > 3
    assert "".join(zstandard.ZstdDecompressor().decompress(f["data"]).decode() for f in got[1]) == "word " * 50_000
    assert [f["units"] for f in got[1]] == sorted(f["units"] for f in got[1])
    assert infill.infill_digests(spark.createDataFrame([], SCHEMA)).count() == 0
