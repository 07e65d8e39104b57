"""Splitting oversized texts at natural boundaries by lexical cohesion.

A text's units are its sentences, rows, paragraphs and sections.  At each gap
between units the words of the blocks before and after are compared (cosine);
valleys of this similarity mark changes of topic.  Each piece ends at the
deepest valley of its size window, deeper for the boundary's kind; the next one
begins a given number of tokens before that cut.  A window without a boundary
is cut at a blank, one without blanks between two characters.

Map work only: a text never leaves its task, and no text is shortened.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm.leaks import folded
from strideflow.llm.tokens import VOCABULARY, Tokenizer, tokenizer

#: What a boundary's kind adds to the depth of its valley.
KINDS = (("section", 1.5), ("paragraph", 0.6), ("row", 0.25), ("sentence", 0.0))
#: Units in the blocks on either side of a gap.
BLOCK = 3
#: Characters that are looked at together.
STREAM = 400_000
_BLANK = re.compile(r"\s+")
#: Code points that the vocabulary's pattern takes for blanks.
_SPACES = np.zeros(0x3001, bool)
_SPACES[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
#: What a boundary looks for in a code point: any blank, a line's end, blank or tab, a sentence's end, what may close after it, a full-width end.
_ANY, _LINE, _TAB, _STOP, _CLOSE, _WIDE = 1, 2, 4, 8, 16, 32
_SIGNS = np.zeros(0x10000, np.uint8)
_SIGNS[:0x3001][_SPACES] = _ANY
_SIGNS[28:32] = _ANY
for _chars, _flag in (("\r\n", _LINE), (" \t", _TAB), (".!?…", _STOP), ("\"'’”)]", _CLOSE), ("。！？", _WIDE)):
    for _c in _chars:
        _SIGNS[ord(_c)] |= _flag
_KIND_NAMES = [k for k, _ in KINDS]
_BONUS = np.array([b for _, b in KINDS])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def boundaries_of(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The natural boundaries in a stream of code points, NUL between texts: where the next unit begins, and its number in ``KINDS``.

    A run of blanks with a line's end in it parts rows, with several of them
    paragraphs, before ``=`` sections; blanks and tabs part sentences after a
    full stop and what closes behind it; a full-width stop parts them by itself.
    """
    n = len(cp)
    sign = _SIGNS[np.minimum(cp, 0xFFFF)]
    blank = (sign & _ANY).astype(bool)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if n and blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    start = start[: len(end)]
    at, kind = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(end):
        pure = np.flatnonzero(sign == _ANY | _TAB)  # runs of blanks and tabs only
        whole = np.searchsorted(pure, end) - np.searchsorted(pure, start) == end - start
        line = np.flatnonzero(sign & _LINE)
        lf = line[(cp[line] == 10) & (cp[np.maximum(line - 1, 0)] == 13) & (line > 0)]  # the second half of a line's end
        ends = np.searchsorted(line, end) - np.searchsorted(line, start) - np.searchsorted(lf, end) + np.searchsorted(lf, start)
        broken = ends > 0
        before = np.where(start > 0, start - 1, 0)
        stop = whole & (start > 0) & ((sign[before] & _STOP) > 0)
        for k in np.flatnonzero(whole & (start > 0) & ((sign[before] & _CLOSE) > 0)):
            i = int(start[k]) - 1
            while i >= 0 and sign[i] & _CLOSE:
                i -= 1
            stop[k] = i >= 0 and bool(sign[i] & _STOP)
        used = broken | stop
        kind = np.where(broken, np.where(cp[end] == 61, 0, np.where(ends > 1, 1, 2)), 3)[used]
        at = end[used]
    wide = np.flatnonzero(sign & _WIDE) + 1
    if len(wide):
        wide = wide[wide < n]
        wide = wide[~blank[wide]]
        at, kind = np.concatenate([at, wide]), np.concatenate([kind, np.full(len(wide), 3)])
        order = np.argsort(at, kind="stable")
        at, kind = at[order], kind[order]
    inside = cp[at] != 0  # blanks at a text's end part nothing
    return at[inside], kind[inside]


def boundaries(text: str) -> list[tuple[int, str]]:
    """(position, kind) of one text's boundaries."""
    at, kind = boundaries_of(code_points(text))
    return [(p, _KIND_NAMES[k]) for p, k in zip(at.tolist(), kind.tolist())]


def word_hashes(cp: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word's folded letters and the unit that it is in."""
    code = folded(cp)
    used = np.flatnonzero(code)
    if not len(used):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.concatenate([[0], np.flatnonzero(np.diff(used) > 1) + 1])
    at = used[fresh]
    place = (used - np.repeat(at, np.diff(np.append(fresh, len(used))))).astype(np.uint64)
    mixed = (code[used].astype(np.uint64) + np.uint64(0x9E37)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9))
    mixed ^= mixed >> np.uint64(29)
    sums = np.add.reduceat(mixed, fresh)
    return (sums >> np.uint64(1)).astype(np.int64), np.searchsorted(cuts, at, "right") - 1


def stream_depths(cp: np.ndarray, cuts: np.ndarray, text_of: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """For every unit the depth of the valley at its beginning: how far the blocks' similarity there lies below the next peaks on either side.

    Unit k begins at ``cuts[k]`` of the stream and is in text ``text_of[k]``; a
    text's first unit has 0.  The blocks' dot products and norms are sums over
    a band of the units' own dot products, which only pairs of units with a
    common word add to.
    """
    n, width = len(cuts), 2 * block
    unit_no = np.arange(n) + text_of * width + width  # as many empty units between texts as two blocks reach
    span = int(unit_no[-1]) + 2 * width
    hashed, where = word_hashes(cp, cuts)
    bits = span.bit_length()  # the unit's number in the hash's last bits: one sort serves both
    both = np.sort((hashed >> bits << bits) | unit_no[where])
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(both)))
    both = both[at]
    word, unit = both >> bits, both & ((1 << bits) - 1)
    band = np.zeros((width, span))  # band[d, i]: product of the units i and i + d
    band[0] = np.bincount(unit, count * count, span) if len(unit) else 0
    for k in range(1, min(width, len(both))):
        d = unit[k:] - unit[:-k]
        ok = np.flatnonzero((word[k:] == word[:-k]) & (d < width))
        if not len(ok):
            break
        band += np.bincount(d[ok] * span + unit[ok], count[ok + k] * count[ok], width * span).reshape(width, span)
    own = np.zeros(span)  # a block's product with itself, by its first unit
    for i in range(block):
        own[: span - i] += band[0, i:]
        for j in range(i + 1, block):
            own[: span - i] += 2 * band[j - i, i:]
    dot = np.zeros(span)  # of the blocks before and after a unit's beginning
    for i in range(1, block + 1):
        for j in range(block):
            dot[i:] += band[i + j, : span - i]
    norm = np.sqrt(own * np.concatenate([np.zeros(block), own[:-block]]))
    every = np.where(norm > 0, dot / np.where(norm > 0, norm, 1), 0.0)[unit_no]
    # the peak that a climb from the valley reaches: where the run that doesn't fall towards the valley begins
    first = np.concatenate([[True], text_of[1:] != text_of[:-1]])
    gap = np.flatnonzero(~first)
    out = np.zeros(n)
    if len(gap):
        similar, m = every[gap], np.arange(len(gap))
        apart = np.diff(gap) > 1
        rise = np.concatenate([[True], apart | (similar[:-1] < similar[1:])])
        fall = np.concatenate([apart | (similar[1:] < similar[:-1]), [True]])
        up_left = similar[np.maximum.accumulate(np.where(rise, m, 0))]
        up_right = similar[np.minimum.accumulate(np.where(fall, m, len(gap) - 1)[::-1])[::-1]]
        out[gap] = up_left + up_right - 2 * similar
    return out


def valley_depths(cp: np.ndarray, cuts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The depths at the gaps of one text, whose unit k reaches from ``cuts[k]`` to ``cuts[k + 1]``."""
    return stream_depths(cp, cuts[:-1], np.zeros(len(cuts) - 1, np.int64), block)[1:] if len(cuts) > 2 else np.zeros(0)


def split_texts(texts: list[str | None], tok: Tokenizer, limit: int, overlap: int, least: float = 0.4) -> Iterator[tuple[int, list[tuple[int, int, int, int, str]]]]:
    """Of every text its place in the list and its pieces (start, end, tokens, overlap tokens, kind of the cut) in characters.

    A text within ``limit`` is one piece.  Every piece has at most ``limit``
    tokens as encoded by itself, and without the overlaps the pieces are the
    text.  A piece ends after ``least`` of the limit at the earliest, where
    there is a boundary.  NULL and empty: none.
    """
    if not 0 <= overlap < limit * (1 - least):
        raise ValueError("the overlap must leave room for a piece")
    held: list[tuple[int, str, list[int]]] = []
    n = 0
    for i, text in enumerate(texts):
        if not text:
            yield i, []
            continue
        tokens = tok.encode(text)
        if len(tokens) <= limit:
            yield i, [(0, len(text), len(tokens), 0, "end")]
            continue
        held.append((i, text, tokens))
        n += len(text)
        if n >= STREAM:
            yield from _split_stream(held, tok, limit, overlap, least)
            held, n = [], 0
    if held:
        yield from _split_stream(held, tok, limit, overlap, least)


def _split_stream(held: list[tuple[int, str, list[int]]], tok: Tokenizer, limit: int, overlap: int, least: float) -> Iterator[tuple[int, list]]:
    """Long texts with their tokens, taken as one stream: what arrays can do is done once for all of them."""
    cp = code_points("\x00".join(t for _, t, _ in held))
    starts = np.cumsum([0, *(len(t) + 1 for _, t, _ in held)])
    first, sizes = starts[:-1], np.diff(starts)
    marks, kinds = boundaries_of(cp)
    cuts = np.concatenate([first, marks])
    order = np.argsort(cuts, kind="stable")
    cuts = cuts[order]
    text_of = np.searchsorted(first, cuts, "right") - 1
    worth = (stream_depths(cp, cuts, text_of) + np.concatenate([np.zeros(len(first)), _BONUS[kinds]])[order])
    names = np.concatenate([np.zeros(len(first), np.int64), kinds])[order].tolist()
    # at a single blank between two other characters the words' pattern always cuts: what is encoded on either side doesn't depend on the other
    blank = _SPACES[np.minimum(cp, 0x3000)]
    blank[first[1:] - 1] = True
    firm_at = np.flatnonzero((cp[1:-1] == 32) & ~blank[:-2] & ~blank[2:]) + 1
    unit_no = np.searchsorted(cuts, first)
    firm_no = np.searchsorted(firm_at, starts)
    wide = np.where(cp > 0x7F, 1, 0) + (cp > 0x7FF) + (cp > 0xFFFF) if not all(t.isascii() for _, t, _ in held) else None
    for k, (i, text, tokens) in enumerate(held):
        a, b = int(first[k]), int(first[k] + sizes[k] - 1)
        lo, hi = int(unit_no[k]) + 1, int(unit_no[k + 1]) if k + 1 < len(held) else len(cuts)
        firm = (firm_at[firm_no[k] : firm_no[k + 1]] - a).tolist()
        ends = np.cumsum(tok.widths[np.array(tokens, np.int64)])
        at = cuts[lo:hi] - a
        bytes_before = None if wide is None or text.isascii() else np.concatenate([[0], np.cumsum(wide[a:b] + 1)])
        mark_byte = at if bytes_before is None else bytes_before[at]
        mark_token = (np.searchsorted(ends, mark_byte, "left") + (mark_byte > 0)).tolist()
        yield i, _cut(text, tok, limit, overlap, least, ends.tolist(), bytes_before, firm, at.tolist(), mark_token, worth[lo:hi].tolist(), names[lo:hi])


def _cut(text: str, tok: Tokenizer, limit: int, overlap: int, least: float, ends: list[int], byte_of: np.ndarray | None, firm: list[int], at: list[int], mark_token: list[int], worth: list[float], kinds: list[int]) -> list[tuple[int, int, int, int, str]]:
    """The pieces of one text: ``ends`` of its tokens in bytes, ``byte_of`` its characters (None: the same), its firm cuts, and its boundaries."""

    def token_at(char: int) -> int:
        """Tokens that begin before a character."""
        return bisect_left(ends, char if byte_of is None else byte_of[char]) + 1 if char > 0 else 0

    def char_at(token: int) -> int:
        """The first character that begins at or after the end of so many tokens."""
        b = ends[token - 1] if token else 0
        return b if byte_of is None else int(np.searchsorted(byte_of, b))

    def count(a: int, b: int) -> int:
        """Tokens of the stretch encoded by itself: its ends are encoded, what is between firm cuts was counted."""
        i, j = bisect_right(firm, a), bisect_left(firm, b) - 1
        if j <= i:
            return tok.count(text[a:b])
        p, q = firm[i], firm[j]
        return tok.count(text[a:p]) + token_at(q) - token_at(p) + tok.count(text[q:b])

    whole = len(ends)
    out: list[tuple[int, int, int, int, str]] = []
    start, fresh = 0, 0  # where the piece begins, and what of it is new
    while True:
        first = token_at(start)
        if whole - first <= limit and (n := count(start, len(text))) <= limit:
            out.append((start, len(text), n, count(start, fresh), "end"))
            return out
        room = limit
        while True:
            lo, hi = max(first + int(limit * least), token_at(fresh) + 1), first + room
            i, j = bisect_left(mark_token, lo), bisect_right(mark_token, hi)
            if i >= j:  # none in the window: the last one after what is new
                i = max(bisect_right(at, fresh), j - 1)
            best = max((k for k in range(i, j) if at[k] > fresh), key=lambda k: (worth[k], k), default=None)
            if best is not None:
                end, kind = at[best], _KIND_NAMES[kinds[best]]
            else:
                end, kind = min(char_at(min(hi, whole)), len(text)), "character"
                back = [m.end() for m in _BLANK.finditer(text, max(fresh, char_at(max(lo, 0))), end)]
                if back and back[-1] > fresh and back[-1] < len(text):
                    end, kind = back[-1], "word"
                end = max(end, fresh + 1)
            n = count(start, end)
            if n <= limit or (end == fresh + 1 and start == fresh):
                break
            if room <= 1 or (end == fresh + 1):  # nothing new fits beside the overlap: drop the overlap
                start, room = fresh, limit
                first = token_at(start)
            else:
                room -= max(1, n - limit)
        out.append((start, end, n, count(start, fresh) if fresh > start else 0, kind))
        fresh = end
        start = min(end, max(char_at(max(token_at(end) - overlap, 0)), out[-1][0] + 1)) if overlap else end


def split_text(text: str | None, tok: Tokenizer, limit: int, overlap: int, least: float = 0.4) -> list[tuple[int, int, int, int, str]]:
    """The pieces of one text."""
    return next(split_texts([text], tok, limit, overlap, least))[1]


_SCHEMA = "piece_no int, start_char bigint, end_char bigint, n_tokens int, overlap_tokens int, cut string, text string"


def pieces(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 512, overlap: int = 64, vocabulary: str = VOCABULARY) -> DataFrame:
    """The ordered pieces, counted from 1, of every text of over ``limit`` tokens: ``(key, piece_no, start_char, end_char, n_tokens, overlap_tokens, cut, text)``.

    NULL and short texts give no rows; repeated rows are cut each time.  A text
    of at most ``limit`` bytes has no more tokens and isn't encoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            texts = b.column(1).to_pylist()
            for i, parts in split_texts(texts, tok, limit, overlap):
                if len(parts) > 1:
                    t = texts[i]
                    for k, (s, e, n, o, kind) in enumerate(parts, 1):
                        for c, v in zip(cols, (i, k, s, e, n, o, kind, t[s:e])):
                            c.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds))], ["key", *(x.split()[0] for x in _SCHEMA.split(", "))])

    kind = documents.schema[key].dataType.simpleString()
    src = documents.where(F.octet_length(text) > limit).select(F.col(key).alias("key"), F.col(text).cast("string"))
    return src.mapInArrow(run, f"key {kind}, {_SCHEMA}").withColumnRenamed("key", key)
