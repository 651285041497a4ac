"""Fill-in-middle over seekable compressed texts.

A text is stored as independent zstandard frames, cut at unit ends every ``SPAN`` characters or so, each with the units,
characters and bytes that come before it.  A cut after unit k is found in the frame whose running count covers it, the only
one that is decompressed for it.  Outputs and restored texts are read frame by frame in the order of the output, so digests need
no copy of the text.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.shared import map_rows

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_END = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
#: Characters of a frame, up to the end of the unit it ends in.
SPAN, LEVEL = 1 << 15, 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass
class Frames:
    """Independent frames of one text; ``units``, ``chars`` and ``bytes`` hold running counts, from 0, one more than frames."""

    data: list[bytes] = field(default_factory=list)
    units: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    bytes: list[int] = field(default_factory=lambda: [0])

    def append(self, text: str, units: int) -> None:
        import zstandard

        raw = text.encode()
        self.data.append(zstandard.ZstdCompressor(level=LEVEL).compress(raw))
        for counts, n in ((self.units, units), (self.chars, len(text)), (self.bytes, len(raw))):
            counts.append(counts[-1] + n)

    def text(self, i: int) -> str:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self.data[i]).decode()

    def place(self, unit: int) -> int:
        """Characters before the end of the first ``unit`` units; opens at most one frame."""
        i = bisect.bisect_left(self.units, unit)
        if self.units[i] == unit:
            return self.chars[i]
        left = unit - self.units[i - 1]
        for at, m in enumerate(UNIT.finditer(self.text(i - 1)), 1):
            if at == left:
                return self.chars[i - 1] + m.end()
        raise ValueError("the frame has fewer units than its counts say")

    def read(self, start: int, stop: int) -> Iterator[str]:
        """Characters ``start`` to ``stop`` in pieces, one frame at a time."""
        i = max(bisect.bisect_right(self.chars, start) - 1, 0)
        while i < len(self.data) and self.chars[i] < stop:
            lo, hi = max(start - self.chars[i], 0), min(stop, self.chars[i + 1]) - self.chars[i]
            if lo < hi:
                yield self.text(i)[lo:hi]
            i += 1


def store(text: str, span: int = SPAN) -> Frames:
    """The frames of a text.  A unit ends where white space follows another character, so a frame's units are those of the whole
    text; a longer unit makes a longer frame."""
    out, at = Frames(), 0
    while at < len(text):
        end = _END.search(text, at + span)
        stop = end.start() if end else len(text)
        piece = text[at:stop]
        out.append(piece, len(UNIT.findall(piece)))
        at = stop
    return out


def draws(key: int | None, seed: int) -> list[int]:
    """Four numbers below 2^32 from the id (nothing stands for a null)."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]


def _marked(frames: Frames) -> bool:
    """Whether the text holds a mark, also across frames."""
    tail = ""
    for i in range(len(frames.data)):
        text = frames.text(i)
        if any(m in tail + text[:2] or m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            return True
        tail = (tail + text)[-2:]
    return False


@dataclass(frozen=True)
class Infill:
    """One text's form and cuts in characters; ``first`` and ``second`` are null if plain."""

    form: str
    first: int | None = None
    second: int | None = None


def choose(frames: Frames, key: int | None, seed: int = 42, plain: int = 50, spm: int = 80) -> Infill:
    """Form and cuts: ``plain`` percent of the texts stay as they are, ``spm`` percent of the others put the suffix first."""
    h1, h2, h3, h4 = draws(key, seed)
    n = frames.units[-1]
    if not frames.data or h3 % 100 >= 100 - plain or _marked(frames):
        return Infill("plain")
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return Infill("spm" if h4 % 100 < spm else "psm", frames.place(a), frames.place(b))


def output(frames: Frames, fim: Infill) -> Iterator[str]:
    """The output in pieces."""
    whole = frames.chars[-1]
    if fim.form == "plain":
        yield from frames.read(0, whole)
        return
    prefix, suffix = (PREFIX, 0, fim.first), (SUFFIX, fim.second, whole)
    for mark, start, stop in (*((prefix, suffix) if fim.form == "psm" else (suffix, prefix)), (MIDDLE, fim.first, fim.second)):
        yield mark
        yield from frames.read(start, stop)


def restored(pieces: Iterator[str], form: str) -> Iterator[str]:
    """The text in pieces, from an output's pieces and its form alone.

    The output is stored in frames as it comes and its marks are looked for at frame borders too; then its parts are read in
    the order of the text.
    """
    if form == "plain":
        yield from pieces
        return
    kept, at, tail, marks, held = Frames(), 0, "", {}, []

    def keep():
        if held:
            kept.append("".join(held), 0)
            held.clear()

    size = 0
    for piece in pieces:
        seen = tail + piece
        for m in re.finditer("<[PSM]>", seen):
            marks[m.group()] = at - len(tail) + m.start()
        at += len(piece)
        tail = seen[-2:]
        held.append(piece)
        size += len(piece)
        if size >= SPAN:
            keep()
            size = 0
    keep()
    ends = sorted([*marks.values(), at])
    for mark in (PREFIX, MIDDLE, SUFFIX):
        start = marks[mark]
        yield from kept.read(start + len(mark), ends[ends.index(start) + 1])


def _digest(pieces: Iterator[str]) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p.encode())
    return h.hexdigest()


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """``df`` plus output string, form string and n, prefix_chars, middle_chars long.

    Null texts count as empty; they and texts with a mark of their own are plain.  A null key draws like an empty one, so do
    rows that repeat a key: alike.  Columns that carry these names are replaced.  A map: no shuffle.
    """
    def make():
        def one(k, t):
            frames = store(t or "")
            fim = choose(frames, k, seed)
            plain = fim.form == "plain"
            return ("".join(output(frames, fim)), fim.form, frames.units[-1], None if plain else fim.first,
                    None if plain else fim.second - fim.first)

        return one

    return map_rows(df, {"k": key, "t": text}, "output string, form string, n bigint, prefix_chars bigint, middle_chars bigint", make)


def restore(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``df`` plus restored, the text behind each output; a null output has an empty one."""
    def make():
        return lambda o, f: ("".join(restored(iter([o or ""]), f)),)

    return map_rows(df, {"o": output, "f": form}, "restored string", make)


def compress(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus frames array<struct<units, chars, bytes, data>>: counts before each frame, and the frame.  Null has none."""
    def make():
        def one(t):
            f = store(t or "")
            return ([{"units": u, "chars": c, "bytes": b, "data": d} for u, c, b, d in zip(f.units, f.chars, f.bytes, f.data)],)

        return one

    return map_rows(df, {"t": text}, "frames array<struct<units:bigint,chars:bigint,bytes:bigint,data:binary>>", make)


def infill_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document.

    Each text is compressed once; cuts, output and restored text are read from frames, and only digests leave the task.
    """
    def make():
        def one(k, t):
            frames = store(t or "")
            fim = choose(frames, k)
            plain = fim.form == "plain"
            return (frames.units[-1], fim.form, None if plain else fim.first, None if plain else fim.second - fim.first,
                    _digest(output(frames, fim)), _digest(restored(output(frames, fim), fim.form)))

        return one

    return map_rows(docs.select("doc_id", "text"), {"k": "doc_id", "t": "text"},
                    "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
                    make).select("doc_id", F.col("n"), "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
