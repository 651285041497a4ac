"""Secret scan with built-in functions only.

Rules find keyword assignments, access keys and long hex runs.  Candidate strings - long runs of key characters - belong to
the narrowest class that holds them (hex, one case and digits, letters, base64) and are read by a sliding window: the
counts of its characters, and with them its Shannon entropy, are kept up to date from the character that leaves and the one that
enters.  A candidate with a window above its class's threshold is a span as a whole, so no tail of a secret stays, unless it is on
the allow list.  Spans of the rules always stay.

No pattern repeats a group, which Java's engine would do by recursion; all reading is linear in the text, but for the prefix sums
of match positions, which take the power 1.5 of the number of matches.

All positions are code points.  A pattern's matches and the gaps between them (a split by the same pattern) give the
positions, since no function returns them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.shared import without

SPAN = "struct<kind:string,start:int,stop:int>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its matches, left to right, whose tail (all, or what follows ``head``) has ``least`` characters."""

    kind: str
    pattern: str
    least: int
    head: str | None = None


# Kinds in the order that breaks ties.
_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
RULES = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", 12, _ASSIGN),
    # A run that is long enough matches whole and a shorter one holds no longer match, so the least length stands in the
    # pattern; that spares a list of every short run.
    Rule("access", "AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", "[0-9a-f]{16,}", 16),
)


@dataclass(frozen=True)
class Charset:
    """A class of candidate strings: those of ``chars`` alone that no class before holds, suspicious from ``bits`` of entropy in a window."""

    kind: str
    pattern: str
    chars: str
    bits: float


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Characters of a window and, at least, of a candidate.
WINDOW = 24
#: Thresholds lie where 99 % and more of the windows of random strings of the class are above: 0.5 to 1 % quantiles of
#: simulated windows of 24 are 3.02-3.07 bits for hex, 3.49-3.61 for one case and digits, 3.77-3.80 for letters, 3.82-3.89 for base64.
CHARSETS = (
    Charset("entropy_hex", "^[0-9A-F]+$", _DIGITS + "ABCDEF", 3.0),
    Charset("entropy_base36", "^[A-Z0-9]+$|^[a-z0-9]+$", _DIGITS + _UPPER + _LOWER, 3.47),
    Charset("entropy_letters", "^[A-Za-z]+$", _UPPER + _LOWER, 3.72),
    Charset("entropy_base64", "", _DIGITS + _UPPER + _LOWER + "+/_-=", 3.8),
)
CANDIDATE = f"[A-Za-z0-9+/_-]{{{WINDOW},}}={{0,2}}"
#: Parts of a candidate, between separators, that are words or numbers; a candidate of such parts only (paths, dotted or dashed
#: names, dates, plain words) is no secret.
WORDLIKE, SEPARATORS = "^[A-Z]?[a-z]*$|^[A-Z]*$|^[0-9]*$", "[/_=+-]"
#: Whole candidates that are no secrets: lower-case hex (a rule's matter), UUIDs and sample keys.
ALLOW = (r"^[0-9a-f]+$|^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
         r"|(?i)example|sample|placeholder|dummy|changeme|your_?")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(widths: Column) -> Column:
    """Sums of the numbers before each place, in chunks of the square root of their count: appending to a long array copies it."""
    longs = "array<bigint>"

    def fold(values, start, add):
        return F.aggregate(values, F.struct(start.cast("bigint").alias("at"), F.array().cast(longs).alias("out")), lambda s, x: F.struct(
            (s["at"] + add(x)).cast("bigint").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def chunked(w):
        step = F.greatest(F.ceil(F.sqrt(F.size(w))), F.lit(1)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(w) / step) - 1, F.lit(0)).cast("int")), lambda c: F.slice(w, c * step + 1, step))
        total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
        return _let(chunks, lambda cs: _let(fold(cs, F.lit(0), total), lambda offsets: F.flatten(
            F.transform(cs, lambda c, i: fold(c, F.get(offsets, i), lambda x: x)))))

    return _let(widths, chunked)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, hit>> of all matches of ``pattern`` (without groups of its own), left to right."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    # The piece before match i ends where it starts; -1 keeps empty pieces.  The piece after the last match goes with none.
    gaps = F.split(text, pattern, -1)
    parts = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("hit"))), lambda p: p["hit"].isNotNull())
    widths = lambda ps: F.transform(ps, lambda p: (p["g"] + F.length(p["hit"])).cast("bigint"))
    return _let(parts, lambda ps: F.zip_with(ps, _starts(widths(ps)), lambda p, at: F.struct(
        (at + p["g"]).cast("int").alias("start"), p["hit"].alias("hit"))))


def _span(kind: str, start: Column, stop: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def _rule_spans(text: Column, rule: Rule) -> Column:
    def kept(m):
        tail = F.regexp_replace(m["hit"], f"^{rule.head}", "") if rule.head else m["hit"]
        return F.length(tail) >= rule.least

    found = F.transform(F.filter(_matches(text, rule.pattern), kept),
                        lambda m: _span(rule.kind, m["start"], m["start"] + F.length(m["hit"])))
    # Texts without a match are spared the exact reading.
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _hot(hit: Column, cs: Charset) -> Column:
    """Whether a window of the string reaches the class's entropy.

    With c_x the count of character x in a window of w, entropy is log2(w) - sum(c_x log2 c_x) / w.  The counts and the sum
    change by two characters a step; after a hot window nothing is read.
    """
    w, letters = WINDOW, F.lit(cs.chars)
    limit = (math.log2(w) - cs.bits) * w + 1e-9
    f = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(0.0)
    one = lambda same: F.when(same, 1).otherwise(0)

    def read(codes):
        def start(first):
            return F.transform(F.sequence(F.lit(1), F.lit(len(cs.chars))), lambda j: F.size(F.filter(first, lambda x: x == j)))

        def step(s, i):
            gone, new = F.element_at(codes, i), F.element_at(codes, i + w)
            c_gone, c_new = F.element_at(s["counts"], gone), F.element_at(s["counts"], new)
            moved = F.when(gone == new, s["sum"]).otherwise(s["sum"] - f(c_gone) + f(c_gone - 1) - f(c_new) + f(c_new + 1))
            counts = F.transform(s["counts"], lambda c, j: c + one(j + 1 == new) - one(j + 1 == gone))
            return F.when(s["hot"], s).otherwise(F.struct(moved.alias("sum"), counts.alias("counts"), (moved <= limit).alias("hot")))

        def fold(counts):
            total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + f(c))
            first = _let(total, lambda t: F.struct(t.alias("sum"), counts.alias("counts"), (t <= limit).alias("hot")))
            steps = F.when(F.size(codes) > w, F.sequence(F.lit(1), F.size(codes) - w)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(steps, first, step, lambda s: s["hot"])

        return _let(start(F.slice(codes, 1, w)), fold)

    return _let(F.transform(F.split(hit, ""), lambda ch: F.instr(letters, ch)), read)


def _entropy_spans(text: Column) -> Column:
    def judged(m):
        hot, kind = F.lit(False), F.lit(CHARSETS[-1].kind)
        for cs in reversed(CHARSETS):
            mine = m["hit"].rlike(cs.pattern) if cs.pattern else F.lit(True)
            hot, kind = F.when(mine, _hot(m["hit"], cs)).otherwise(hot), F.when(mine, F.lit(cs.kind)).otherwise(kind)
        plain = m["hit"].rlike(ALLOW) | F.forall(F.split(m["hit"], SEPARATORS), lambda p: p.rlike(WORDLIKE))
        return F.struct(kind.alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["hit"])).cast("int").alias("stop"),
                        F.when(plain, False).otherwise(hot).alias("hot"))

    found = F.filter(F.transform(_matches(text, CANDIDATE), judged), lambda s: s["hot"])
    spans = F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(df: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """``df`` plus ``base``, the spans of the rules, and ``spans``, those and the ones by entropy: arrays of
    (kind, start, stop) by start, then kind as listed, in code points, end exclusive.

    Null and empty texts have none; texts of any length are read whole.  Columns that carry these names are replaced.  A map: no
    shuffle.
    """
    kinds = [r.kind for r in RULES] + [c.kind for c in CHARSETS]
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])

    def sorted_spans(parts):
        keyed = F.transform(F.concat(*parts), lambda s: F.struct(
            s["start"].alias("start"), F.element_at(order, s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    rest = without(df, [base, spans])
    whole = F.coalesce(F.col("__whole"), F.lit(""))
    held = rest.withColumn("__whole", df[text])
    held = held.withColumns({f"__{k.kind}": _rule_spans(whole, k) for k in RULES} | {"__entropy": _entropy_spans(whole)})
    rules, more = [F.col(f"__{r.kind}") for r in RULES], F.col("__entropy")
    return (held.withColumn(base, sorted_spans(rules)).withColumn(spans, F.when(F.size(more) > 0, sorted_spans([*rules, more])).otherwise(F.col(base)))
            .drop("__whole", "__entropy", *[f"__{r.kind}" for r in RULES]))


def listed(spans: Column) -> Column:
    """kind:start:stop of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``mark`` (overlapping spans by one).

    Texts without a span, null ones too, stay as they are; so do all other columns.
    """
    names = ("__base", "__spans")
    found = scan(df, text, *names)
    whole, spans = F.col(text), F.col("__spans")

    def pieces(at, some, part):
        """Text and marks up to the last of some spans; ``at`` is where the spans before end and the text ``part`` begins."""
        start = F.struct(at.cast("int").alias("at"), F.array().cast("array<string>").alias("out"))

        def step(s, x):
            add = F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(
                F.when((x["start"] == s["at"]) & (s["at"] > 0), F.lit("")).otherwise(
                    F.concat(part.substr(s["at"] - at + 1, x["start"] - s["at"]), F.lit(mark)))))).otherwise(s["out"])
            return F.struct(F.greatest(s["at"], x["stop"]).cast("int").alias("at"), add.alias("out"))

        return F.aggregate(some, start, step)

    # In chunks of the square root of the number of spans, each cut from its own part of the text and joined to one piece: appending to
    # a long array copies it, and a place far into a string is found by reading up to it.
    size = F.greatest(F.ceil(F.sqrt(F.size(spans))), F.lit(1)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(spans) / size) - 1, F.lit(0)).cast("int")), lambda c: F.slice(spans, c * size + 1, size))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    part = lambda at, some: whole.substr(at + 1, F.greatest(F.array_max(F.transform(some, lambda x: x["stop"])) - at, F.lit(0)))
    kept = F.aggregate(chunks, first, lambda s, c: _let(part(s["at"], c), lambda text: _let(pieces(s["at"], c, text), lambda p: F.struct(
        p["at"].alias("at"), F.concat(s["out"], F.array(F.array_join(p["out"], ""))).alias("out")))), lambda s: F.concat(
        F.array_join(s["out"], ""), whole.substr(s["at"] + 1, F.length(whole))))
    return found.withColumn(text, F.when(F.size(spans) > 0, kept).otherwise(whole)).drop(*names)


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in RULES],
                        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
