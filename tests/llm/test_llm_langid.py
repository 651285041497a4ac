import random
from collections import Counter

import duckdb

from netloom.llm import langid


def slow_profile(texts, most):
    """Most frequent 1- to 3-grams; blanks at word edges; ties by length class, then letters."""
    n = Counter()
    for text in texts:
        low = [c.lower() if len(c.lower()) == 1 else c for c in text]
        s = " " + " ".join("".join(c if o.isalpha() else " " for c, o in zip(low, text)).split()) + " "
        if not s.strip():
            continue
        n.update(c for c in s if c != " ")
        n.update(s[i:i + 2] for i in range(len(s) - 1))
        n.update(s[i:i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
    key = lambda g: (len(g), [0 if c == " " else ord(c) for c in g])
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], key(x[0])))][:most]


def slow_predict(text, profiles, most):
    own = slow_profile([text], most)
    if not own:
        return "und", 0.0
    away = {}
    for name, p in profiles.items():
        place = {g: i for i, g in enumerate(p)}
        away[name] = sum(abs(place[g] - i) if g in place else most for i, g in enumerate(own))
    best = min(sorted(away), key=away.get)
    return best, 1 - away[best] / (most * len(own))


EDGE = [None, "", "123 !!", "a", "É", "straße über İstanbul ſ", "日本 語", "\U00010400\U00010428 x", "the " * 30_000]


def test_prediction_matches_the_plain_version(spark):
    rng = random.Random(1)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(40)) + "."
    kinds = {"xa": ["ab", "Ra", "ka"], "xb": ["lo", "Öl", "mo"], "xc": ["ti", "ki", "ra"]}
    rows = [(i, make(kinds[k]), k) for i, k in enumerate(sorted(kinds) * 20)]
    train = rows[:30] + [(900, None, "xa"), (901, "ab", None), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string").repartition(3)
    learned = langid.learn(df, most=60)
    plain = {k: slow_profile([t for _, t, x in train if x == k and t], 60) for k in kinds}
    tests = [t for _, t, _ in rows] + EDGE
    got = langid.identify(spark.createDataFrame([(i, t, "old") for i, t in enumerate(tests)], "doc_id long, text string, score string"), learned)
    for r in got.collect():
        name, score = slow_predict(tests[r.doc_id] or "", plain, 60)
        assert (r.lang_pred, round(r.score, 12)) == (name, round(score, 12)), r.doc_id
    assert {r.doc_id for r in got.where("lang_pred = 'und'").collect()} == {60, 61, 62}


def test_nothing_learned_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    none = langid.learn(df)
    assert [(r.lang_pred, r.score) for r in langid.identify(df, none).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0), none).count() == 0


def test_held_out_accuracy(spark):
    from netloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    lang = dict(duckdb.connect().execute(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    held = QUERIES["op4_language"](spark, sf).where("held_out").collect()
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held) > 0
