import math
import random
import re

import pytest

from netloom.llm import toxicity
from netloom.llm.toxicity import Lexicon, Matcher, Model

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_matches_edit_distance():
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(40)})
    lexicon = Lexicon(terms)
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        want = min((t for t in terms if len(t) >= 5 and distance(t, w) == 1), default=None)
        assert lexicon.near(w) == want
        if want:
            assert lexicon.may_match(w)


def test_quotation_and_abuse():
    matcher = Matcher(Model(terms={"moron": 0.9, "stupid": 0.9}, stems={"lowe": 0.8}, other=0.5))
    plain, hits, quoted = matcher.read("What a moron , that stupd man loweiso")
    assert hits == ["moron", "stupd", "loweiso"] and quoted == 0 and plain[0] > plain[2] == 0 and plain[1] > 0
    for text in ('He read "a moron" aloud', "The term moron is old", "Sie sagte moron"):
        said, _, quoted = matcher.read(text)
        assert said[0] == 0 and said[2] > 0 and quoted == 1
    for text in ('You are "a moron"', "I said you moron"):
        assert matcher.read(text)[2] == 0
    assert matcher.read(None)[1] == matcher.read("")[1] == matcher.read("nice day")[1] == []


def test_quotations_of_any_length_and_over_lines():
    cut = lambda t: [t[a:b] for a, b in toxicity.quotations(t)]
    assert cut('a "b c" d "e\nf" g') == ['"b c"', '"e\nf"']
    long = '"' + "far too long\n" * 500 + 'x."'
    assert cut("he wrote: " + long + " and left") == [long]
    assert cut('a 5" pipe, 6" wide, he said "so"') == ['"so"']
    assert cut('a "stray mark and (“two” or „drei“ or „vier”) «cinq» »sechs« "sept"') == ["“two”", "„drei“", "„vier”", "«cinq»", "»sechs«", '"sept"']
    assert cut('"a “b” c" d') == ['"a “b” c"'] and cut('"a “b" c” d') == ['"a “b" c”'] and cut('“a «b» "c" d” e') == ['“a «b» "c" d”']
    assert cut("") == cut('"') == cut('" "') == cut("”x“") == []
    matcher = Matcher(Model(terms={"moron": 0.9}))
    assert matcher.read('It reads "' + "word after word " * 50 + "a moron here " + "and on " * 99 + 'end"')[2] == 1


def plain_read(text, model):
    """As ``Matcher.read``, each word held against every term and every pair of marks by itself."""
    words = [(m.start(), m[0]) for m in re.finditer(r"\w+", text.lower())]
    chances = {}
    for i, (at, w) in enumerate(words):
        close = [t for t in model.terms if len(t) >= 5 and distance(t, w) == 1]
        begun = [c for t, c in model.stems.items() if w.startswith(t) and len(w) > len(t)]
        if w in model.terms:
            kind, chance = "term", model.terms[w]
        elif begun:
            kind, chance = "stem", max(begun)
        elif close:
            kind, chance = "term", model.variants.get(w, model.other)
        else:
            continue
        near = {x for _, x in words[max(0, i - toxicity.WINDOW):i + toxicity.WINDOW + 1]}
        inside = any(a <= at < b for a, b in toxicity.quotations(text.lower()))
        quoted = (inside or bool(near & toxicity.REPORTING)) and not near & toxicity.ADDRESS
        old = chances.setdefault(w, [kind, 0.0, 0.0])
        old[1 + (not quoted)] = max(old[1 + (not quoted)], chance)
    total = [sum(c[2] for c in chances.values() if c[0] == k) for k in ("term", "stem")]
    total.append(sum(c[1] for c in chances.values() if not c[2]))
    return [math.log1p(x) for x in total], list(chances)


def test_score_equals_plain_version(spark):
    rng = random.Random(8)
    model = Model({"gorblat": 0.9, "fizmuck": 0.8, "zyx": 0.7}, {"dunk": 0.75, "dunkel": 0.6}, {"gorbla": 0.3}, 0.4, (-2.0, 3.0, 2.0, -1.0))
    bits = ["gorblat", "fizmuk", "Gorbla", "zyx", "zy", "dunkelig", "dunk", '"', '"so', 'so"', "“", "”", "said", "you", "\n", "fizmucks"] + ["on", "er", "an"] * 8
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in toxicity.score(df, model).collect():
        features, hits = plain_read(r.text, model)
        assert r.toxicity.hits == hits and r.toxicity.features == pytest.approx(features)
        assert r.toxicity.score == pytest.approx(1 / (1 + math.exp(2 - 3 * features[0] - 2 * features[1] + features[2])))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(("an", "er", "on", "th", "st", "ou", "re")) for _ in range(rng.randint(1, 3)))
    bad = ["gorblat", "fizmuck", "dunkelhirn"]
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice([*bad, "zwurk" + word() + word()]))
        rows.append((i, " ".join(words), None, "s", 1))
        labels.append((i, 1, int(toxic)))
    rare = "only here once zyx " * 9
    rows += [(1000 + i, rare + "gorblat fizmuck", "en", "s", 1) for i in range(60)]  # copies
    labels += [(1000 + i, 0, 1) for i in range(60)]
    labels += [(None, 0, 1), (5, 0, None), (99_999, 1, 1), (0, 0, 1)]
    return spark.createDataFrame(rows, DOC).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(corpus):
    return toxicity.train(*corpus)


def test_terms_and_stems_are_learned_but_not_from_copies(model):
    assert {"gorblat", "fizmuck", "dunkelhirn"} <= set(model.terms) and not {"zyx", "once"} & set(model.terms)
    assert "zwurk" in model.stems


def test_scores(spark, corpus, model):
    cases = {1: ("a fine day on the river", 0), 2: ("an gorblat er fizmuck on", 1), 3: ("an gorblta er gorbla on fizmuckk dunkelhirm", 1),
             4: ("ou zwurkabc zwurkdef re", 1), 5: (None, 0), 6: ("", 0), 7: ("re st " * 20_000 + "gorblat fizmuck dunkelhirn", 1)}
    df = spark.createDataFrame([(k, t, "old") for k, (t, _) in cases.items()] * 2, "doc_id long, text string, toxicity string")
    got = toxicity.score(df, model).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert 0 <= r.toxicity.score <= 1 and int(r.toxicity.score >= 0.3) == cases[r.doc_id][1], r
    docs, labels = corpus
    kept = toxicity.keep_harmless(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 4}


def test_no_labels(spark, corpus):
    docs, labels = corpus
    m = toxicity.train(docs, labels.limit(0))
    assert not m.terms and toxicity.keep_harmless(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.score(docs.limit(0), m).count() == 0
