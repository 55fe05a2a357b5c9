"""Splitting oversized texts at natural boundaries by structure-tree packing.

A text is a tree: heading sections (nested by heading level), paragraphs and fenced code blocks, list items (nested by
indentation), lines, sentences, words. Spans of a level partition their parent, separators included, so the pieces' new
parts always join to the text again. Siblings are merged from the bottom up to the limit and only nodes over it are
opened. What looks like a heading, a blank line or a list item inside a code block is none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of the tree below the headings; the last is a cut inside an unbroken run of characters.
HEADING, PARAGRAPH, ITEM, LINE, SENTENCE, WORD, FORCED = 1, 5, 6, 7, 8, 9, 10
_STOP = re.compile(r"[。！？；]")
_HEADING = re.compile(r"^(#{1,6})[ \t]", re.M)
_ITEM = re.compile(r"^([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]", re.M)
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\r\n]*)(?:\r?\n|\Z)", re.M)
_ENDS = {
    PARAGRAPH: re.compile(r"\r?\n[ \t]*\r?\n\s*"),
    LINE: re.compile(r"\r?\n"),
    SENTENCE: re.compile(r"[.!?…。！？]+[\"'”’»)\]]*[ \t\r\n]+"),
    WORD: re.compile(r"[ \t\r\n]+"),
}


class _Tree:
    """A text and its code blocks, as the positions where they begin and end."""

    def __init__(self, text: str):
        self.text = text
        self.edges: list[int] = []
        mark = ""
        for m in _FENCE.finditer(text):
            if not mark:
                mark = m.group(1)
                self.edges.append(m.start())
            elif m.group(1)[0] == mark[0] and len(m.group(1)) >= len(mark) and not m.group(2).strip():
                mark = ""
                self.edges.append(m.end())
        if mark:  # a block that is never closed goes on to the end
            self.edges.append(len(text))

    def inside(self, at: int) -> bool:
        """Whether a position lies in a code block, behind its beginning."""
        i = bisect_right(self.edges, at)
        return i % 2 == 1 and self.edges[i - 1] < at

    def _nested(self, pattern: re.Pattern, lo: int, hi: int) -> list[tuple[int, int]]:
        """Parts of a span at the marks of its highest rank: headings by level, items by the width of their indentation."""
        found = [(m.start(), len(m.group(1).expandtabs(4))) for m in pattern.finditer(self.text, lo, hi) if m.start() > lo and not self.inside(m.start())]
        if not found:
            return [(lo, hi)]
        top = min(n for _, n in found)
        at = [lo, *(p for p, n in found if n == top), hi]
        return list(zip(at, at[1:], strict=False))

    def children(self, lo: int, hi: int, level: int) -> list[tuple[int, int]]:
        if level < PARAGRAPH:
            return self._nested(_HEADING, lo, hi)
        if level == ITEM:
            return self._nested(_ITEM, lo, hi)
        found = _ENDS[level].finditer(self.text, lo, hi)
        if level == WORD:
            cuts = {p for m in found for p in m.span()}
        elif level == PARAGRAPH:
            first = bisect_right(self.edges, lo)
            cuts = {m.end() for m in found if not self.inside(m.end())} | set(self.edges[first : bisect_right(self.edges, hi)])
        else:
            cuts = {m.end() for m in found}
        at = sorted({lo, hi, *cuts})
        return list(zip(at, at[1:], strict=False))


def _pack(tree: _Tree, lo: int, hi: int, level: int, soft: int, hard: int, out: list[tuple[int, int, int]]) -> None:
    """Append the spans of ``[lo, hi)``, each with the level at which it ends. ``soft`` leaves room for the overlap; a
    node of up to ``hard`` that cannot be merged stays whole."""
    text = tree.text
    if hi - lo <= hard and (hi - lo <= soft or level > HEADING):
        out.append((lo, hi, min(level, WORD)))
        return
    if level == FORCED:
        blank = text[lo:hi].isspace() and not text[lo:hi].strip(" \t\r\n")
        while lo < hi:
            end = min(lo + soft, hi)
            if not blank and end < hi:  # a script without blanks still ends its sentences
                stops = [m.end() for m in _STOP.finditer(text, lo + soft // 2, end)]
                end = stops[-1] if stops else end
            out.append((lo, end, WORD if blank else FORCED))
            lo = end
        return
    kids = tree.children(lo, hi, level)
    again = len(kids) > 1 and (level < PARAGRAPH or level == ITEM)
    below = level if again else max(level + 1, PARAGRAPH)
    if len(kids) == 1:
        _pack(tree, lo, hi, below, soft, hard, out)
        return
    start = end = lo
    for a, b in kids:
        if b - start <= soft:
            end = b
            continue
        if end > start:
            out.append((start, end, level))
        if b - a <= soft:
            start, end = a, b
            continue
        _pack(tree, a, b, below, soft, hard, out)
        # a short tail of an opened node may still take later siblings
        last = out[-1]
        if last[1] - last[0] < soft and last[2] != FORCED:
            out.pop()
            start, end = last[0], b
        else:
            start = end = b
    if end > start:
        out.append((start, end, level))


def split_text(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int, int, bool]]:
    """Pieces of a text as ``(start, new, end, forced)``: the piece is ``text[start:end]``, at most ``limit`` characters,
    of which ``text[start:new]`` repeats the end of the piece before (up to ``overlap`` characters, from a word's start
    where there is one). ``forced`` marks a piece cut inside a run of more than ``limit`` characters without a space,
    tab or line break, the only case in which a run is cut. A text within the limit is one piece; an empty text has none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text), False)]
    spans: list[tuple[int, int, int]] = []
    _pack(_Tree(text), 0, len(text), HEADING, limit - overlap, limit, spans)
    pieces = []
    for i, (lo, hi, level) in enumerate(spans):
        start = lo
        if i:
            room = min(overlap, limit - (hi - lo), lo - spans[i - 1][0])
            if room > 0:
                gap = _ENDS[WORD].search(text, lo - room - 1 if lo > room else 0, lo)
                if lo == room or text[lo - room - 1] in " \t\r\n":
                    start = lo - room
                elif gap and gap.end() < lo:
                    start = gap.end()
                elif level == FORCED and not gap:
                    start = lo - room
        pieces.append((start, lo, hi, level == FORCED))
    return pieces


def split_oversized(df: DataFrame, key: str, text: str, section: str | None = None, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """``key, [section,] piece, start, new_from, end, forced, text`` of every text over ``limit`` characters.

    Shorter and null texts never leave the JVM and give no rows (they need no split). Repeated rows count once; rows
    of one key with different texts are each split. Columns other than these are ignored.
    """
    cols = [key, *([section] if section else []), text]
    long = df.where(F.length(text) > limit).select(*cols).distinct()
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols[:-1]) + ", piece int, start int, new_from int, `end` int, forced boolean, text string"
    names = [*cols[:-1], "piece", "start", "new_from", "end", "forced", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            take = []
            for i, t in enumerate(b.column(len(cols) - 1).to_pylist()):
                for n, (s, new, e, forced) in enumerate(split_text(t, limit, overlap)):
                    take.append(i)
                    for column, value in zip(rows, (n, s, new, e, forced, t[s:e]), strict=True):
                        column.append(value)
            kinds_out = [pa.int32()] * 4 + [pa.bool_(), pa.string()]
            head = [c.take(pa.array(take, pa.int64())) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array(r, k) for r, k in zip(rows, kinds_out, strict=True))], names)

    return long.mapInArrow(run, schema)
