"""Mapping freely typed values to the entries of a reference list with BK-trees.

Every entry stands in the tree under the forms it may be typed in (its full
base, with the ending abbreviated, cut off).  The tree's metric is the
Levenshtein distance, computed bit-parallel for all queries and nodes of a level
at once; the triangle inequality prunes the children, so a search returns every
form within the radius.  Shards hold whole scopes (here: cities) up to a size,
larger scopes in several; each shard is built once and broadcast by itself, and
what the shards return is put together.

Only distinct typed values are searched; what they may mean is joined back.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.plans.lineage import cut

#: Entries in one broadcast shard (some 20 forms of 100 bytes each).
SHARD_ENTRIES = 20_000
_MOJIBAKE = re.compile("[ÃÂãâ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-™€]")


def _repair(m: re.Match) -> str:
    s = m[0].translate({0xE3: "Ã", 0xE2: "Â"})
    for kind in ("cp1252", "latin-1"):
        try:
            return s.encode(kind).decode("utf-8")
        except UnicodeError:
            pass
    return m[0]


def fold(text: str) -> str:
    """Lower case without accents; UTF-8 that was read as Latin-1 is mended first."""
    t = unicodedata.normalize("NFKD", _MOJIBAKE.sub(_repair, text)).casefold()
    return "".join(c for c in t if not unicodedata.combining(c))


# ------------------------------------------------------------------ BK-tree


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters' code points, padded with -1, and the lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.full((len(words), max(1, int(lengths.max())) if len(words) else 1), -1, np.int32)
    if len(words):
        out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, lengths


def pair_distances(q_codes: np.ndarray, q_lengths: np.ndarray, q: np.ndarray, codes: np.ndarray, lengths: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Levenshtein distance of query ``q[k]`` to word ``w[k]``, by Myers' bit vectors for all pairs at once (queries of over 63 characters by the plain recurrence)."""
    out = np.zeros(len(q), np.int64)
    long_ = q_lengths[q] > 63
    for i in np.unique(q[long_]):
        mine = np.flatnonzero(long_ & (q == i))
        out[mine] = _plain(q_codes[i, : q_lengths[i]], codes[w[mine]], lengths[w[mine]])
    k = np.flatnonzero(~long_)
    if not len(k):
        return out
    used, qi = np.unique(q[k], return_inverse=True)
    n = q_lengths[used]
    letters, at = np.unique(q_codes[used], return_inverse=True)
    at = at.reshape(len(used), -1)
    # bits of a query's places that hold a letter; the last column is for letters that no query has
    peq = np.zeros((len(used), len(letters) + 1), np.uint64)
    for j in range(int(n.max()) if len(n) else 0):
        has = np.flatnonzero(n > j)
        peq[has, at[has, j]] |= np.uint64(1 << j)
    words, wi = np.unique(w[k], return_inverse=True)
    place = np.searchsorted(letters, codes[words])
    place = np.where((place < len(letters)) & (letters[np.minimum(place, len(letters) - 1)] == codes[words]), place, len(letters))
    m, length = n[qi], lengths[w[k]]
    one, top = np.uint64(1), np.where(m > 0, m - 1, 0).astype(np.uint64)
    vp, vn = np.full(len(k), ~np.uint64(0)), np.zeros(len(k), np.uint64)
    score, base = m.copy(), qi * peq.shape[1]
    flat = peq.ravel()
    for j in range(int(length.max())):
        eq = flat[base + place[wi, j]]
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        score += (length > j) * (((hp >> top) & one).astype(np.int64) - ((hn >> top) & one).astype(np.int64))
        hp, hn = (hp << one) | one, hn << one
        vp, vn = hn | ~(d0 | hp), hp & d0
    out[k] = np.where(m > 0, score, length)
    return out


def _plain(q: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The recurrence of the edit distance, row by row, for one query and many words."""
    m = len(q)
    row = np.tile(np.arange(m + 1), (len(codes), 1))
    out = np.where(lengths == 0, m, 0)
    for j in range(int(lengths.max()) if len(lengths) else 0):
        new = np.empty_like(row)
        new[:, 0] = j + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (codes[:, j, None] != q[None, :]), row[:, 1:] + 1)
        # insertions: the least of what stands to the left, one more for each place
        new = np.minimum.accumulate(new - np.arange(m + 1), axis=1) + np.arange(m + 1)
        row = new
        out = np.where(lengths == j + 1, row[:, m], out)
    return out


def distances(query: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Levenshtein distance of ``query`` to every row."""
    n = len(codes)
    return pair_distances(*encode([query]), np.zeros(n, np.int64), codes, lengths, np.arange(n)) if n else np.zeros(0, np.int64)


@dataclass
class BKTree:
    """Nodes in the order of their levels; a node's children stand together, with their distance to it."""

    words: list[str]
    codes: np.ndarray = field(repr=False)
    lengths: np.ndarray = field(repr=False)
    edge: np.ndarray = field(repr=False)
    first: np.ndarray = field(repr=False)
    last: np.ndarray = field(repr=False)

    @classmethod
    def build(cls, words: list[str]) -> BKTree:
        words = sorted(set(words))
        codes, lengths = encode(words)
        order, edge, first, last = [], [], [], []
        todo: list[tuple[np.ndarray, int]] = [(np.arange(len(words)), 0)] if words else []
        k = 0
        while k < len(todo):
            members, d = todo[k]
            at = len(members) // 2
            root, rest = members[at], np.delete(members, at)
            order.append(root), edge.append(d), first.append(len(todo))
            if len(rest):
                dist = distances(words[root], codes[rest], lengths[rest])
                for x in np.unique(dist):
                    todo.append((rest[dist == x], int(x)))
            last.append(len(todo))
            todo[k] = (members[:0], d)
            k += 1
        order = np.array(order, int)
        return cls([words[i] for i in order], codes[order], lengths[order], np.array(edge, int), np.array(first, int), np.array(last, int))

    def within_many(self, queries: list[str], radii: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, word, distance) of every word at most its query's radius away; level by level for all queries."""
        q_codes, q_lengths = encode(queries)
        q = np.arange(len(queries) if self.words else 0)
        node = np.zeros(len(q), np.int64)
        out = []
        while len(q):
            d = pair_distances(q_codes, q_lengths, q, self.codes, self.lengths, node)
            near = d <= radii[q]
            out.append((q[near], node[near], d[near]))
            n = self.last[node] - self.first[node]
            parent = np.repeat(np.arange(len(node)), n)
            child = np.repeat(self.first[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            go = np.abs(self.edge[child] - d[parent]) <= radii[q[parent]]
            q, node = q[parent[go]], child[go]
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def within(self, query: str, radius: int) -> list[tuple[str, int]]:
        """Every word at most ``radius`` edits from ``query``, with its distance."""
        _, node, d = self.within_many([query], np.array([radius]))
        return [(self.words[i], int(x)) for i, x in zip(node, d)]


# ------------------------------------------------------- forms and variants


@dataclass(frozen=True)
class Spelling:
    """How values of one kind are typed: what is put around them, abbreviated endings, additions and their short forms."""

    noise: tuple[str, ...] = ()  # patterns, on folded text, of what doesn't belong to the value
    endings: tuple[tuple[str, tuple[str, ...]], ...] = ()  # an ending of the base and its abbreviations
    additions: tuple[str, ...] = ()  # words that tell apart entries of one base
    least_prefix: int = 7  # letters that a cut-off base keeps at least


_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=100_000)
def _meant(w: str, additions: tuple[str, ...]) -> str:
    """The addition that a word is, begins or is a misspelling of; else ''."""
    for a in additions:
        if w == a or (len(w) >= 2 and a.startswith(w)):
            return a
    if len(w) >= 4 and additions:
        d = distances(w, *encode(list(additions)))
        k = int(d.argmin())
        if d[k] <= (1 if len(w) < 7 else 2):
            return additions[k]
    return ""


def split_value(text: str, spelling: Spelling, scopes: list[str] = ()) -> tuple[str, str, str | None]:
    """(base without blanks, addition or '', scope named in the text or None) of a typed value."""
    t = " " + fold(text) + " "
    named = None
    for s in scopes:
        m = re.match(rf"\W*{re.escape(s)}\b[\s:,;/-]*(?=\w)", t)
        if m and len(t[m.end() :].strip()) > 3:
            t, named = " " + t[m.end() :], s
            break
    for p in spelling.noise:
        t = re.sub(p, " ", t)
    words = _WORD.findall(t.replace("-", ""))
    addition = ""

    if len(words) > 1:
        for k in (len(words) - 1, 0):
            if a := _meant(words[k], spelling.additions):
                addition = a
                del words[k]
                break
    return "".join(words), addition, named


def forms_of(base: str, spelling: Spelling) -> list[str]:
    """The base as it may be typed: whole, with an abbreviated ending, cut off."""
    out = [base]
    for ending, short in spelling.endings:
        if base.endswith(ending):
            out += [base[: -len(ending)] + s for s in short]
    out += [base[:k] for k in range(max(spelling.least_prefix, len(base) // 2), len(base))]
    return list(dict.fromkeys(out))


@dataclass
class Entry:
    id: int
    scope: str
    base: str
    addition: str
    x: float
    y: float


class Reference:
    """A shard's trees, one per scope and one over all its entries; ``scopes`` are those of all shards."""

    def __init__(self, rows: list[tuple], spelling: Spelling, scopes: list[str]):
        self.spelling, self.scopes, self.known = spelling, scopes, set(scopes)
        self.by_form: dict[str, dict[str, list[Entry]]] = defaultdict(lambda: defaultdict(list))
        for id_, scope, name, x, y in rows:
            base, addition, _ = split_value(name, spelling)
            scope = scope_of(scope)
            e = Entry(id_, scope, base, addition, x, y)
            for f in forms_of(base, spelling):
                for s in {scope, ""}:
                    self.by_form[s][f].append(e)
        self.by_form = {s: dict(f) for s, f in self.by_form.items()}
        self.trees = {s: BKTree.build(list(f)) for s, f in self.by_form.items()}

    def search(self, values: list[tuple[str | None, str]], loose: float = 0.34) -> list[list[tuple[int, float, bool, float, float, int]]]:
        """Of every (scope, text) its candidates (id, edits, same addition, x, y, letters of the base).

        Every entry with a form within the radius, ``loose`` of the letters, at
        its least distance; a form other than the base counts a quarter more.
        Bases of under four letters match as they are.  A scope that no entry
        has, and a missing one, searches all scopes.
        """
        out: list[list] = [[] for _ in values]
        parts: dict[str, dict[str, list[tuple[int, str]]]] = defaultdict(lambda: defaultdict(list))
        for k, (scope, text) in enumerate(values):
            base, addition, named = split_value(text, self.spelling, self.scopes)
            s = scope_of(scope)
            s = s if s in self.known else named or ""
            if base and s in self.trees:
                parts[s][base].append((k, addition))
        for s, wanted in parts.items():
            tree, forms, bases = self.trees[s], self.by_form[s], list(wanted)
            for at in range(0, len(bases), 2000):
                some = bases[at : at + 2000]
                radii = np.array([int(len(b) * loose) if len(b) >= 4 else 0 for b in some])
                found: dict[int, list[tuple[Entry, float]]] = defaultdict(list)
                for i, node, d in zip(*(a.tolist() for a in tree.within_many(some, radii))):
                    form = tree.words[node]
                    found[i] += [(e, d + (0 if form == e.base else 0.25)) for e in forms[form]]
                for i, hits in found.items():
                    least: dict[int, tuple[float, Entry]] = {}
                    for e, d in hits:
                        if e.id not in least or d < least[e.id][0]:
                            least[e.id] = (d, e)
                    for k, addition in wanted[some[i]]:
                        out[k] = sorted(((e.id, d, e.addition == addition, e.x, e.y, len(some[i])) for d, e in least.values()), key=lambda c: (c[1], c[0]))
        return out


def scope_of(scope: str | None) -> str:
    return fold(scope or "").strip()


_CANDIDATES = "array<struct<id:bigint,edits:double,same:boolean,x:double,y:double,letters:int>>"
_CAND_TYPE = pa.list_(pa.struct([("id", pa.int64()), ("edits", pa.float64()), ("same", pa.bool_()), ("x", pa.float64()), ("y", pa.float64()), ("letters", pa.int32())]))


def candidates(values: DataFrame, scope: str, value: str, entries: DataFrame, spelling: Spelling, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``(scope, value, candidates)`` for every distinct pair: all entries within the radius of the value.

    ``entries`` (``id``, ``scope``, ``name``, ``x``, ``y``) come to the driver
    one shard at a time, ordered by scope; the list of the scopes is whole.
    """
    context, conf = values.sparkSession.sparkContext, values.sparkSession.conf
    distinct = values.select(F.col(scope).cast("string").alias("scope"), F.col(value).cast("string").alias("value")).distinct()
    # a search costs far more than the few bytes it reads: small partitions, by number so that they aren't put together
    slices = max(context.defaultParallelism * 2, int(conf.get("spark.sql.shuffle.partitions")))
    distinct = distinct.repartition(slices, "value")
    scopes = sorted({scope_of(r[0]) for r in entries.select("scope").distinct().toLocalIterator() if r[0]}, key=lambda s: (-len(s), s))
    if entries.limit(shard_entries + 1).count() > shard_entries:  # read once for each shard
        distinct = cut(distinct)
    parts, held = None, []

    def search(held: list[tuple]) -> DataFrame:
        shared = context.broadcast(Reference(held, spelling, scopes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ref = shared.value
            for b in batches:
                found = ref.search(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
                out = [[{"id": i, "edits": float(d), "same": same, "x": x, "y": y, "letters": n} for i, d, same, x, y, n in c] for c in found]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, _CAND_TYPE)], ["scope", "value", "candidates"])

        return distinct.mapInArrow(run, f"scope string, value string, candidates {_CANDIDATES}")

    shards = 0
    for r in entries.select("id", "scope", "name", "x", "y").orderBy(F.lower(F.trim("scope")), "id").toLocalIterator():
        if len(held) >= shard_entries:
            part = search(held)
            parts, held, shards = part if parts is None else parts.unionByName(part), [], shards + 1
        held.append(tuple(r))
    part = search(held)
    parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("scope", "value").agg(F.flatten(F.collect_list("candidates")).alias("candidates")) if shards else parts


def map_values(rows: DataFrame, key: str, scope: str, value: str, x: str, y: str, entries: DataFrame, entry_id: str, entry_scope: str, entry_value: str, entry_x: str, entry_y: str, spelling: Spelling, strict: float = 0.28, strict_far: float = 0.15, near_m: float = 250.0, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``(key, entry_id)`` of every row whose value is neither NULL nor blank: the entry that is meant, or -1.

    Of the candidates those that are equal to the value, else those within one
    edit, else all, are looked at: the first of these classes that has an entry
    with the same addition.  Of them one whose place is within ``near_m`` of
    the row's wins; without such a one the edits may be at most ``strict`` of
    the letters (``strict_far`` where the row has a place), entries with the
    same addition go first, and entries of equal rank are undecided (-1).
    Repeated rows give one result; a NULL or unknown scope searches all scopes.
    """
    listed = entries.where(F.col(entry_id).isNotNull() & F.col(entry_value).isNotNull()).select(F.col(entry_id).cast("bigint").alias("id"), F.col(entry_scope).cast("string").alias("scope"), F.col(entry_value).cast("string").alias("name"), F.col(entry_x).cast("double").alias("x"), F.col(entry_y).cast("double").alias("y"))
    typed = rows.where(F.col(value).isNotNull() & (F.trim(F.regexp_replace(value, r"\s+", " ")) != "")).select(F.col(key).alias("k"), F.col(scope).cast("string").alias("scope"), F.col(value).cast("string").alias("value"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    found = candidates(typed, "scope", "value", listed, spelling, shard_entries)
    within = lambda most: F.exists("candidates", lambda c: c["same"] & (c["edits"] < most + 1))
    most = F.when(within(0), 0).when(within(1), 1).otherwise(1_000_000)
    found = found.withColumn("candidates", F.filter("candidates", lambda c: c["edits"] < most + 1))
    joined = typed.join(found.withColumnsRenamed({"scope": "s2", "value": "v2"}), F.col("scope").eqNullSafe(F.col("s2")) & (F.col("value") == F.col("v2")))
    placed = F.col("px").isNotNull() & F.col("py").isNotNull() & ~F.isnan("px") & ~F.isnan("py")
    ranked = F.transform(
        "candidates",
        lambda c: F.struct(
            F.when(placed & (F.hypot(c["x"] - F.col("px"), c["y"] - F.col("py")) <= near_m), 0).otherwise(1).alias("far"),
            F.when(c["same"], 0).otherwise(1).alias("other"), c["edits"].alias("edits"), c["id"].alias("id"), c["letters"].alias("letters"),
        ),
    )
    ok = F.filter(ranked, lambda c: (c["far"] == 0) | (F.floor(c["edits"]) <= F.when(placed, strict_far).otherwise(strict) * c["letters"]))
    first = F.array_min(ok)
    ties = F.size(F.filter(ok, lambda c: (c["far"] == first["far"]) & (c["other"] == first["other"]) & (c["edits"] == first["edits"])))
    decided = F.when(F.size(ok) == 0, -1).when((first["far"] == 0) | (ties == 1), first["id"]).otherwise(-1)
    return joined.select(F.col("k").alias(key), decided.cast("bigint").alias(entry_id)).distinct()
