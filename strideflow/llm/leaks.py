"""Evaluation texts that leak into a corpus: q-gram lemma filter and banded alignment.

All documents pass one vectorised scan.  A batch's texts become one stream of
folded letters and digits (case, accents, punctuation, blanks and markup signs
are gone), its q-grams are hashed in a handful of array operations and looked
up in a table of the items' q-grams.  Hits are counted per item in overlapping
diagonal bands; a band is retained when it has as many as an item's stretch of
the demanded length must share although some of its words are changed and
markup stands between them (the q-gram lemma: each such place destroys a
bounded number of q-grams, whichever subset of the item's q-grams is counted).

Retained documents are freed from markup and what it adds, and aligned with the
item word by word inside a band around the diagonal of the hits.

The items are broadcast: a stated set of bounded size (``max_item_chars``,
checked); beyond it they are taken in blocks.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 12
#: q-grams of more items than this count only for items that have too few others.
COMMON = 2
#: Least share of a stretch's q-grams that stays when words are changed and markup is set in between.
LEFT = 0.35
#: Half the width of a diagonal band in letters: what markup may add within a stretch.
HALF_BAND = 512
#: Items' characters that one broadcast index holds (some 30 bytes each).
ITEM_CHARS = 5_000_000
_BITS = 22
_P = 0x9E3779B1
_TABLE: np.ndarray | None = None


#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнοαινρτυχκ", "aeopcyxijsdhkmtbhoaivptuxk")


def fold(text: str) -> str:
    """Lower case without accents, compatibility forms undone, letters that look like Latin ones made so."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c)).translate(LOOKALIKES)


def _table() -> np.ndarray:
    """For each code point of the basic plane the code of its folded letter, 0 where it is dropped."""
    global _TABLE
    if _TABLE is None:
        t = np.zeros(0x10000, np.uint8)
        # ideographs and syllables stand for themselves, the others are folded one by one
        for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4)):
            t[lo:hi] = 128 + np.arange(lo, hi) % 127
        for c in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000)):
            if not chr(c).isalnum():
                continue
            f = [x for x in fold(chr(c)) if x.isalnum()]
            if f:
                o = ord(f[0])
                t[c] = o if o < 128 else 128 + o % 127
        _TABLE = t
    return _TABLE


def folded(cp: np.ndarray) -> np.ndarray:
    """The codes of code points; those outside the basic plane are dropped (0)."""
    return _table()[np.minimum(cp, 0xFFFF)]


def letters(text: str) -> np.ndarray:
    """The stream of folded letters and digits; characters outside the basic plane are dropped."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = folded(cp)
    return code[code > 0]


def gram_hashes(s: np.ndarray, q: int = Q) -> np.ndarray:
    """A 32-bit hash of every q-gram (q = 12: 8 + 4) of a stream."""
    if len(s) < q:
        return np.zeros(0, np.uint32)
    p = [pow(_P, k, 1 << 32) for k in (1, 2, 4)]
    h1 = s.astype(np.uint32) + np.uint32(1)
    h2 = h1[:-1] * np.uint32(p[0]) + h1[1:]
    h4 = h2[:-2] * np.uint32(p[1]) + h2[2:]
    h8 = h4[:-4] * np.uint32(p[2]) + h4[4:]
    h = h8[:-4] * np.uint32(p[2]) + h4[8:]
    h ^= h >> np.uint32(15)
    return h * np.uint32(0x85EBCA6B)


_COMMENT = re.compile(r"<!--.*?-->", re.S)
_REF = re.compile(r"<ref\b[^>/]*/>|<ref\b[^>]*>.*?</ref\s*>", re.S | re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_OUTER = re.compile(r"\[(?:https?:)?//\S+ ?([^\]]*)\]")
_INNER = re.compile(r"\{\{([^{}|]*)((?:\|[^{}]*)?)\}\}")
_NAMED = re.compile(r"^\s*[\w \-]{1,40}=")


#: Words from which a template's named value is taken for text, as in a quotation.
TEXT_WORDS = 4


def _arguments(m: re.Match) -> str:
    """A template's values: of one on a single line the unnamed ones and those that are text, of a longer one all, names left aside."""
    if not m[2]:
        return " "
    parts = m[2][1:].split("|")
    if "\n" in m[0]:
        return "\n" + "\n".join(_NAMED.sub("", p) for p in parts) + "\n"
    plain = (_NAMED.sub("", p) for p in parts if not _NAMED.match(p) or len(p.split()) >= TEXT_WORDS)
    return " " + " ".join(plain) + " "


def strip_markup(text: str) -> str:
    """Wiki markup off: the words that a reader sees remain."""
    t = html.unescape(text) if "&" in text else text
    if "<" in t:
        t = _COMMENT.sub("", t)
        t = _REF.sub(" ", t)
        t = _TAG.sub("", t)
    if "[" in t:
        t = _OUTER.sub(r"\1", _LINK.sub(r"\1", t))
    for _ in range(4):
        if "{{" not in t:
            break
        t, n = _INNER.subn(_arguments, t)
        if not n:
            break
    return t.replace("''", "")


_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]|(?<=\\w)[-\u2010\u2011]\\s*\n\\s*(?=\\w)")


def words_of(text: str) -> list[str]:
    """Folded words; soft hyphens, zero-width characters and hyphens at line ends don't part them."""
    return _WORD.findall(fold(_ODD.sub("", text)))


def longest_stretch(item: list[str], doc: list[str], gap: int = 6, band: int = 96, changed: float = 1.0, put_in: float = 0.15) -> int:
    """Words of the stretch of ``item`` that ``doc`` holds in one place.

    Banded local alignment as sparse dynamic programming over equal words: an
    equal word scores 1, one changed or left out costs ``changed``, and of words
    put in by what markup left, up to ``gap`` at a place cost ``put_in`` each;
    the diagonal may wander by ``band`` words.  The stretch of the best score
    counts with its single changed words.
    """
    where = defaultdict(list)
    for i, w in enumerate(item):
        where[w].append(i)
    recent: dict[int, tuple[int, float, int, int]] = {}  # by item word: doc position, score, first item word, diagonal there
    best, stretch = 0.0, 0
    for j, w in enumerate(doc):
        at = where.get(w)
        if not at:
            continue
        new = []
        for i in at:
            score, first, start = 1.0, i, j - i
            for back in (1, 2, 3):
                r = recent.get(i - back)
                if r and 0 < j - r[0] <= back + gap and abs(j - i - r[3]) <= band:
                    s = r[1] + 1 - changed * (back - 1) - put_in * max(0, j - r[0] - back)
                    if s > score:
                        score, first, start = s, r[2], r[3]
            new.append((i, (j, score, first, start)))
        for i, r in new:
            old = recent.get(i)
            if old is None or r[1] >= old[1] or j - old[0] > gap + 3:
                recent[i] = r
            if r[1] > best:
                best, stretch = r[1], i - r[2] + 1
    return stretch


class ItemIndex:
    """The items' q-grams, their table, and how many of them a stretch must share."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t or "") for _, t in items]
        streams = [letters(" ".join(w)) for w in self.words]
        grams = [gram_hashes(s) for s in streams]
        pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g.astype(np.uint64) << np.uint64(32) | np.uint64(k) for k, g in enumerate(grams))]))
        held, start = np.unique((pairs >> np.uint64(32)).astype(np.uint32), return_index=True)
        in_items = np.diff(np.append(start, len(pairs)))  # by hash, the items that have it
        hashes, items_, at = [], [], []
        self.need, self.least = [], []
        for k, g in enumerate(grams):
            n = len(self.words[k])
            self.least.append(max(1, int(np.ceil(share * n - 1e-9))))
            window = max(1, int(share * len(g)))
            rare = in_items[np.searchsorted(held, g)] <= COMMON if len(g) else np.zeros(0, bool)
            for keep in (rare, np.ones(len(g), bool)):
                c = np.concatenate([[0], np.cumsum(keep)])
                fewest = int((c[window:] - c[:-window]).min()) if len(g) else 0
                if fewest >= 40:
                    break
            self.need.append(max(2, int(LEFT * fewest)))
            pos = np.flatnonzero(keep)
            hashes.append(g[pos]), items_.append(np.full(len(pos), k)), at.append(pos)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.concatenate(items_)[order] if items_ else np.zeros(0, int)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, int)
        # one in at least 16 places of the table is taken, however many items there are
        self.shift = np.uint32(32 - min(31, max(_BITS, int(len(h) * 16).bit_length())))
        self.bits = np.zeros(1 << int(32 - self.shift), bool)
        self.bits[self.hash >> self.shift] = True
        self.need = np.array(self.need, int)
        self.short = [k for k, s in enumerate(streams) if 0 < len(s) < 3 * Q]

    def candidates(self, texts: list[str]) -> list[tuple[int, int]]:
        """(text, item) pairs with a retained band."""
        joined = "\x00".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = folded(cp)
        used = np.flatnonzero(code)
        s = code[used]
        h = gram_hashes(s)
        hit = np.flatnonzero(self.bits[h >> self.shift])
        hh = h[hit]
        lo, hi = np.searchsorted(self.hash, hh, "left"), np.searchsorted(self.hash, hh, "right")
        n = hi - lo
        hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
        out: list[tuple[int, int]] = []
        if len(hit):
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos = np.repeat(hit, n)
            starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
            doc = np.searchsorted(starts, used[pos], "right") - 1
            item = self.item[entry]
            diag = pos - self.at[entry]
            band = diag // HALF_BAND
            key = (doc * len(self.ids) + item).astype(np.int64)
            bands = np.concatenate([band, band + 1]) + (1 << 20)
            keys = np.concatenate([key, key]) * (1 << 24) + bands
            grams = np.concatenate([self.at[entry], self.at[entry]])
            order = np.lexsort((grams, keys))
            keys, grams = keys[order], grams[order]
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            fresh = first | np.concatenate([[True], grams[1:] != grams[:-1]])  # a repeated q-gram counts once
            at = np.flatnonzero(first)
            count = np.add.reduceat(fresh.astype(int), at)
            pair = keys[at] >> 24
            pair = np.unique(pair[count >= self.need[pair % len(self.ids)]])
            out = [(int(p // len(self.ids)), int(p % len(self.ids))) for p in pair]
        if self.short:  # items with hardly any q-gram are looked for by their letters
            flat = [letters(t).tobytes() for t in texts]
            for k in self.short:
                whole = letters(" ".join(self.words[k])).tobytes()
                out += [(d, k) for d, f in enumerate(flat) if whole in f]
        return sorted(set(out))


def _scan(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
        rows, k = [], 0
        while k < len(texts):  # some 8 MB of text at a time
            j, n = k, 0
            while j < len(texts) and (n < 2_000_000 or j == k):
                n += len(texts[j])
                j += 1
            cleaned: dict[int, list[str]] = {}
            for d, i in index.candidates(texts[k:j]):
                if d not in cleaned:
                    cleaned[d] = words_of(strip_markup(texts[k + d]))
                got = longest_stretch(index.words[i], cleaned[d])
                if got >= index.least[i]:
                    rows.append((index.ids[i], ids[k + d], got, len(index.words[i])))
            k = j
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["item_id", "doc_id", "words", "item_words"])


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.4, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_chars: int = ITEM_CHARS) -> DataFrame:
    """``(item_id, doc_id, words, item_words)`` of every document that holds a stretch of at least ``share`` of an item's words.

    Each pair once, with the words of its longest stretch.  NULL and empty
    texts match nothing; equal item texts are all reported; items with equal
    ids are taken as different texts and the longest stretch stays.
    """
    spark = documents.sparkSession
    wanted = items.where(F.col(item_id).isNotNull() & (F.length(text) > 0)).select(F.col(item_id).cast("bigint"), F.col(text).cast("string"))
    blocks, held, n = [], [], 0
    for r in wanted.toLocalIterator():
        held.append((r[0], r[1]))
        n += len(r[1])
        if n > item_chars:
            blocks, held, n = [*blocks, held], [], 0
    blocks.append(held)
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(ItemIndex(block, share))

        def run(batches, shared=shared):
            return _scan(batches, shared.value)

        part = docs.mapInArrow(run, "item_id bigint, doc_id bigint, words int, item_words int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("item_id", "doc_id").agg(F.max("words").alias("words"), F.max_by("item_words", "words").alias("item_words"))
