"""Toxicity by a learned lexicon, matched with misspellings and read in context.

``train`` learns from labelled documents which words, and which beginnings of words, mark toxic texts, what a word one
edit away from such a word is worth, and how the hits of a text add up.  ``score`` walks every whole text once:

* words are matched by intersecting a Levenshtein automaton with a trie of the lexicon (distance 0, or 1 for
  terms of five letters or more; a stem ends its match anywhere behind it).  Two pieces of every term, one of
  which a single edit leaves alone, rule most words out before;
* each hit is read in a window of words: inside quotation marks or beside words of reporting it counts as
  quotation, unless someone is addressed;
* a logistic function of the hits as words, as stems and as quotation gives the score.

Nothing but the text enters a score.  The model is fitted on at most ``sample`` labelled documents, chosen by a hash
of their number; everything else covers all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.shared import arrow_map, cut, map_rows

#: Labelled documents the model is fitted on, at most.
SAMPLE = 10_000
#: Words on either side of a hit that tell quotation from abuse.
WINDOW = 6
#: Letters of a stem; the word it begins is longer.
STEM = range(4, 8)
_WORD = re.compile(r"\w+")
_LETTER = re.compile(r"\w")
_MARK = re.compile("[\"“”„«»]")
# Words that report speech or name a word, and words that address someone.
REPORTING = frozenset("said says say called calls call word words term quote quoted quotes wrote writes slur insult insults "
                      "sagte sagt nannte nennt wort begriff zitat schrieb dit disait appelle mot terme citation "
                      "dijo dice llamó llama palabra término cita escribió".split())
ADDRESS = frozenset("you your yours youre du dich dir dein ihr euch tu te toi vous ton votre tú ti usted ustedes vos".split())


@dataclass
class Model:
    """Chances that a hit marks a toxic text, by term, stem and misspelling, and weights of a text's features."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    variants: dict[str, float] = field(default_factory=dict)
    other: float = 0.5
    weights: tuple[float, ...] = (-3.0, 4.0, 2.0, 1.0)

    def chance(self, features) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def quotations(text: str) -> list[tuple[int, int]]:
    """Stretches between paired quotation marks of the whole text, in order and apart, of any length and over line ends.

    A straight mark opens before and closes behind a character that is not white space, and does neither inside a
    word or number; where it may do both, it closes what is open.  Curly and angle marks close what their counterpart
    opened.  An opening mark that meets another of its family before its end is dropped: a stray mark quotes nothing.
    """
    opened: dict[str, tuple[str, int]] = {}
    found: list[tuple[int, int]] = []
    for m in _MARK.finditer(text):
        c, i = m[0], m.start()
        before, after = text[i - 1:i], text[i + 1:i + 2]
        family = "straight" if c == '"' else "angle" if c in "«»" else "curly"
        mark, start = opened.get(family, ("", 0))
        if family == "straight":
            closes = bool(mark) and before.strip() != "" and not _LETTER.match(after)
            opens = after.strip() != "" and not _LETTER.match(before)
        elif family == "angle":
            closes, opens = bool(mark) and mark != c, True
        else:
            closes = (mark + c) in ("“”", "„“", "„”")
            opens = c != "”"
        if closes:
            del opened[family]
            while found and found[-1][0] >= start:  # inside this one
                found.pop()
            if found and found[-1][1] > start:  # of another family, crossing
                start = found.pop()[0]
            found.append((start, i + 1))
        elif opens:
            opened[family] = (c, i)
    return found


# ------------------------------------------------------------------------------ matching

class Lexicon:
    """Trie of terms that finds those within one edit of a word."""

    def __init__(self, terms):
        self.trie: dict = {}
        # First and second halves of terms, each with the lengths that a word so begun or ended can have.
        self.heads: dict[str, set[int]] = {}
        self.tails: dict[str, set[int]] = {}
        for t in terms:
            node = self.trie
            for ch in t:
                node = node.setdefault(ch, {})
            node[""] = t
            if len(t) >= 5:
                h = len(t) // 2
                self.heads.setdefault(t[:h], set()).update((len(t) - 1, len(t), len(t) + 1))
                self.tails.setdefault(t[h:], set()).update((len(t) - 1, len(t), len(t) + 1))
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})

    def may_match(self, word: str) -> bool:
        """Whether a term's first or second half stands at the word's start or end, as one edit must leave it."""
        size = len(word)
        return (any(size in self.heads.get(word[:n], ()) for n in self.head_sizes)
                or any(size in self.tails.get(word[-n:], ()) for n in self.tail_sizes))

    def near(self, word: str) -> str | None:
        """The first term in alphabetical order that is one edit away.

        States of the automaton are rows of the edit matrix; a branch of the trie ends where the row has no 0 or 1.
        """
        best = None
        stack = [(self.trie, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            term = node.get("")
            if term is not None and row[-1] == 1 and len(term) >= 5 and (best is None or term < best):
                best = term
            for ch, child in node.items():
                if ch == "":
                    continue
                nxt = [row[0] + 1]
                for i, c in enumerate(word, 1):
                    nxt.append(min(nxt[-1] + 1, row[i] + 1, row[i - 1] + (c != ch)))
                if min(nxt) <= 1:
                    stack.append((child, nxt))
        return best


class Matcher:
    """Kind and chance of a word; remembers what it has looked up, up to a bound."""

    MOST = 500_000
    _last: tuple[Model, "Matcher"] | None = None

    @classmethod
    def of(cls, model: Model) -> "Matcher":
        """The worker's matcher for a broadcast model; it serves one task after another."""
        if cls._last is None or cls._last[0] is not model:
            cls._last = (model, cls(model))
        return cls._last[1]

    def __init__(self, model: Model):
        self.model, self.lexicon = model, Lexicon(model.terms)
        self.plain: set[str] = set()
        self.known: dict[str, tuple[str, float]] = {}

    def look_up(self, w: str) -> tuple[str, float] | None:
        m = self.model
        if w in m.terms:
            return "term", m.terms[w]
        stems = [m.stems[w[:n]] for n in STEM if len(w) > n and w[:n] in m.stems]
        if stems:
            return "stem", max(stems)
        if self.lexicon.may_match(w) and self.lexicon.near(w):
            return "near", m.variants.get(w, m.other)
        return None

    def hits(self, words: set[str]) -> dict[str, tuple[str, float]]:
        found = {}
        for w in words - self.plain:
            hit = self.known.get(w) or self.look_up(w)
            if len(self.plain) + len(self.known) > self.MOST:  # memory only: words are looked up again
                self.plain.clear()
                self.known.clear()
            if hit:
                self.known[w] = found[w] = hit
            else:
                self.plain.add(w)
        return found

    def read(self, text: str | None) -> tuple[tuple[float, float, float], list[str], int]:
        """Features, words hit in order of appearance, and how many hits are quotation."""
        found = self.hits(set(_WORD.findall(low))) if text and (low := text.lower()) else {}
        if not found:
            return (0.0, 0.0, 0.0), [], 0
        spans = quotations(low)
        words = list(_WORD.finditer(low))
        chances: dict[str, tuple[float, float]] = {}
        q = n_quoted = 0
        for i, m in enumerate(words):
            hit = found.get(m[0])
            if hit is None:
                continue
            while q < len(spans) and spans[q][1] <= m.start():
                q += 1
            around = {x[0] for x in words[max(0, i - WINDOW):i + WINDOW + 1]}
            quoted = (q < len(spans) and spans[q][0] <= m.start() or bool(around & REPORTING)) and not around & ADDRESS
            n_quoted += quoted
            said, meant = chances.get(m[0], (0.0, 0.0))
            chances[m[0]] = (max(said, hit[1]), meant) if quoted else (said, max(meant, hit[1]))
        total = {"term": 0.0, "stem": 0.0, "quoted": 0.0}
        for w, (said, meant) in chances.items():
            total["stem" if found[w][0] == "stem" else "term"] += meant
            total["quoted"] += said if not meant else 0.0
        return tuple(math.log1p(x) for x in total.values()), list(chances), n_quoted


# ------------------------------------------------------------------------------ training

#: Odd factors that turn a shingle's hash into the ranks of independent sketches.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _spread(rows: DataFrame) -> DataFrame:
    """toxic, text: few rows of each group of near copies, mostly one.

    Copies would make every rare word of one text look like a sign of its label.  A sketch is the smallest rank of a
    text's five-word shingles; near copies share most of their sketches, other texts hardly any, and of texts
    that share one only one stays.
    """
    names = [f"s{i}" for i in range(len(_FACTORS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            found = []
            for text in b.column(0).to_pylist():
                w = text.lower().split() if text else []
                grams = [" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))]
                h = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams))
                found.append((np.multiply.outer(_FACTORS, h).min(axis=1) >> np.uint64(1)).astype(np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([*map(pa.array, np.array(found).T.copy()), b.column(1), b.column(0)], names=[*names, "toxic", "text"])

    out = arrow_map(rows, run, ", ".join(f"{n} long" for n in names) + ", toxic int, text string")
    for n in names:
        out = out.groupBy(n, "toxic").agg(F.min(F.struct("text", *names)).alias("x")).select("toxic", "x.*")
    return out.select("toxic", "text")


def _signs(known: DataFrame) -> DataFrame:
    """sign, stem (whether a word's beginning), k1, k0: toxic and other texts that have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), 64):
                out = []
                for t, text in zip(toxic[at:at + 64], texts[at:at + 64]):
                    words = set(_WORD.findall(text.lower()))
                    out += [(w, False, t) for w in words]
                    out += [(p, True, t) for p in {w[:n] for w in words for n in STEM if len(w) > n}]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.bool_(), pa.int32()))],
                                                     names=["sign", "stem", "toxic"])

    return (arrow_map(known.where("text IS NOT NULL"), run, "sign string, stem boolean, toxic int").groupBy("sign", "stem")
            .agg(F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0")))


def _gain(k1: int, k0: int, n1: int, n0: int) -> float:
    """Log-likelihood ratio of a sign's two document frequencies."""
    p, out = (k1 + k0) / (n1 + n0), 0.0
    for k, n in ((k1, n1), (k0, n0)):
        for x, e in ((k, n * p), (n - k, n * (1 - p))):
            out += 2 * x * math.log(x / e) if x and e else 0.0
    return out


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Weights (intercept first) of a ridge logistic regression, by Newton's method."""
    a = np.column_stack((np.ones(len(x)), x))
    keep = np.diag([1e-3, *[ridge] * x.shape[1]])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + keep, a.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, gain: float = 22.0, stem_gain: float = 30.0,
          precision: float = 0.7, stem_precision: float = 0.4) -> Model:
    """A model from ``labels`` (doc_id, toxic 0 or 1; others are left out) and the texts of ``docs``.

    A word is a term if its log-likelihood ratio is at least ``gain`` and at least ``precision`` of the texts that have
    it are toxic; a beginning of words is a stem likewise.  Of a document labelled twice, the higher label counts.
    Without labels of both kinds nothing is a sign, and every text gets the same score.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # Bounded by ``sample`` rows of 12 bytes.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    known = cut(_spread(rows), "toxic")
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(weights=(4.0 if n1 else -4.0, 0.0, 0.0, 0.0))
    # Signs need this many toxic texts even if no other has them; in a bounded sample few do.
    few = next((k for k in range(1, n1 + 1) if _gain(k, 0, n1, n0) >= min(gain, stem_gain)), n1)
    share = F.when(F.col("stem"), stem_precision).otherwise(precision)
    often = [r for r in _signs(known).where((F.col("k1") >= few) & (F.col("k1") >= share * (F.col("k1") + F.col("k0")))).collect()
             if _gain(r.k1, r.k0, n1, n0) >= (stem_gain if r.stem else gain)]
    worth = lambda r: (r.k1 + 0.5) / (r.k1 + r.k0 + 1)
    model = Model({r.sign: worth(r) for r in often if not r.stem}, {r.sign: worth(r) for r in often if r.stem})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def close_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words one edit from a term in texts without a term or stem."""
        matcher = Matcher.of(shared.value)
        for b in batches:
            out = []
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = matcher.hits(set(_WORD.findall(text.lower()))) if text else {}
                if found and all(kind == "near" for kind, _ in found.values()):
                    out += [(toxic, w) for w in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.string()))], names=["toxic", "w"])

    own = arrow_map(known, close_words, "toxic int, w string").groupBy("w").agg(F.sum("toxic").alias("k1"), F.count("*").alias("n")).collect()
    # A misspelling not seen before is worth what those seen once are, between which and certainty nothing decides yet.
    once = [r for r in own if r.n == 1]
    model.other = (sum(r.k1 for r in once) + 1.0) / (len(once) + 2.0)
    model.variants = {r.w: (r.k1 + model.other) / (r.n + 1) for r in own}
    seen = score(known, model, out="f").select("toxic", "f.features").collect()
    # Doubtful rows of each label for each feature keep weights sane where the sample has no such case.
    x = np.array([r.features for r in seen] + [[0.7, 0, 0], [0, 0.7, 0]])
    y = np.array([r.toxic for r in seen] + [1, 1], float)
    model.weights = _fit(x, y)
    return model


# ------------------------------------------------------------------------------- scoring

def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` plus ``out``: struct of score (0 to 1), hits (the words found, each once, in order), quoted (hits read
    as quotation) and the features.

    Null and empty texts get the score of a text without hits, texts of any length are read whole.  Repeated rows are
    scored each; a column called ``out`` is replaced.  One pass over the texts, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        matcher = Matcher.of(m)

        def one(t):
            features, names, quoted = matcher.read(t)
            return ({"score": m.chance(features), "hits": names, "quoted": quoted, "features": features},)

        return one

    return map_rows(docs, {"t": text}, f"`{out}` struct<score:double,hits:array<string>,quoted:int,features:array<double>>", make)


def keep_harmless(docs: DataFrame, labels: DataFrame, reject: float = 0.3) -> DataFrame:
    """``docs`` less those that score ``reject`` or more under a model learned from ``labels``."""
    scored = score(docs, train(docs, labels), out="__toxicity")
    return scored.where(F.col("__toxicity.score") < reject).drop("__toxicity")
