import duckdb
import pytest

from netloom.llm import chat
from netloom.llm.sql import PREFERENCES

U, A, S = "user", "assistant", "system"
TURNS = [(0, 0, U, "hi"), (0, 1, A, "hello"), (0, 2, U, "more"), (0, 3, A, "fine"), (1, 0, S, "be <|im_end|> good"), (1, 1, U, "é q"), (1, 2, A, "no\U0001f600"), (1, 3, U, "bye"),
         (2, 0, U, "alone"), (3, 0, U, "x"), (3, 1, A, "<|y"), (4, 0, U, "hi"), (4, 1, A, "same"), (5, 0, U, "hi"), (5, 1, A, "same"), (6, 0, A, None), (6, 1, None, "t"),
         (7, None, U, "first"), (7, 0, U, ""), (7, 0, U, ""), (7, 0, A, "tie"), (8, 5, U, "long"), (8, 9, A, "z" * 100_000), (None, 0, U, "lost"), (12, 0, A, "only")]


@pytest.fixture
def turns(spark):
    return spark.createDataFrame([(*t, "old") for t in TURNS], "conv_id long, turn long, role string, text string, chosen string")


def render(turns):
    return "".join(f"<|im_start|>{r.replace('<|', '< |')}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in turns)


def spans(turns):
    out, at = [], 0
    for r, t in turns:
        head = at + len(f"<|im_start|>{r.replace('<|', '< |')}\n")
        at += len(render([(r, t)]))
        if r == A:
            out.append(f"{head}:{at - 1}")
    return ",".join(out)


def slow():
    conv = {}
    for c, i, r, t in set(TURNS):
        if c is not None:
            conv.setdefault(c, []).append((-1 if i is None else i, r or "", t or ""))
    conv = {c: [x[1:] for x in sorted(v)] for c, v in conv.items()}
    last = {c: max((i for i, (r, _) in enumerate(v) if r == A), default=None) for c, v in conv.items()}
    for c, v in conv.items():
        other = c ^ 1
        rej = v if last[c] is None else v[:last[c]] + ([conv[other][last[other]]] if last.get(other) is not None else [])
        n = next((i for i, (x, y) in enumerate(zip(v, rej)) if x != y), min(len(v), len(rej)))
        yield c, n, render(v[:n]), render(v[n:]), render(rej[n:]), spans(v[n:]), spans(rej[n:])


def test_rows_match_the_plain_version_and_sql(turns):
    got = sorted(tuple(r) for r in chat.preference_rows(turns).collect())
    assert got == sorted(slow())
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", TURNS)
    assert sorted(con.execute(PREFERENCES).fetchall()) == got


def test_spans_show_the_assistant_only(turns):
    for r in chat.preference_rows(turns).collect():
        for text, marks in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            seen = [text[int(a):int(b)] for a, b in (m.split(":") for m in marks.split(",") if m)]
            assert all(s.endswith("<|im_end|>") and s.count("<|") == 1 for s in seen) and len(seen) == text.count(f"<|im_start|>{A}\n")


def test_general_interface(spark):
    df = spark.sql("""SELECT 1 AS pair, array(struct('user' AS role, 'a' AS text), struct('assistant' AS role, 'b' AS text)) AS chosen,
                      CAST(NULL AS array<struct<role:string,text:string>>) AS rejected, 'kept' AS extra""")
    r = chat.pair_up(df).first()
    assert r.n_common == 0 and r.prompt == "" and r.rejected == "" and r.chosen == render([(U, "a"), (A, "b")]) and r.extra == "kept"


def test_empty_table(turns):
    assert chat.preference_rows(turns.limit(0)).count() == 0
