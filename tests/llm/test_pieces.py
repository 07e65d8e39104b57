import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideflow.llm.leaks import folded
from strideflow.llm.pieces import boundaries, pieces, split_text, valley_depths
from strideflow.llm.tokens import tokenizer

TOK = tokenizer()


def _long(seed, sections=6):
    r = random.Random(seed)
    out = []
    for k in range(sections):
        topic = ["".join(r.choice("abcdeiklmnost") for _ in range(6)) for _ in range(12)]
        out.append(f"== Part {k} ==\n\n" + "\n\n".join(" ".join(" ".join(r.choice(topic) for _ in range(9)).capitalize() + "." for _ in range(5)) for _ in range(3)))
    return "\n\n".join(out)


TEXTS = [_long(1), _long(2, 3).replace("\n", "\r\n"), "a" * 30_000, " " * 9000, "ä€😀字。" * 1500, "row\n" * 3000, "word " * 4000, "x. " * 3000, "a b c " * 800, "short", "日本語です。" * 400]


@pytest.mark.parametrize("limit,overlap", [(512, 64), (40, 8), (24, 0), (5, 1)])
def test_pieces_cover_and_keep_the_limit(limit, overlap):
    for t in TEXTS:
        ps = split_text(t, TOK, limit, overlap)
        end = 0
        for i, (s, e, n, o, kind) in enumerate(ps):
            assert n == TOK.count(t[s:e]) and (n <= limit or e - s == 1)
            assert o == TOK.count(t[s:end]) if i else s == 0
            assert s <= end < e and (not i or s > ps[i - 1][0])
            end = e
        assert end == len(t) and ps[-1][4] == "end"
    assert split_text(None, TOK, limit, overlap) == split_text("", TOK, limit, overlap) == []


def test_overlap_is_as_asked():
    for t in TEXTS[:2]:
        ps = split_text(t, TOK, 200, 32)
        assert len(ps) > 2 and all(30 <= p[3] <= 34 for p in ps[1:])


def test_topics_are_cut_at_their_sections():
    kinds = Counter(p[4] for p in split_text(_long(3), TOK, 500, 0)[:-1])
    assert kinds["section"] >= 3 and set(kinds) <= {"section", "paragraph"}


def test_boundaries():
    t = "One. Two!\nRow\n\nPara\n== S ==\r\nx"
    assert [(t[p:][:3], k) for p, k in boundaries(t)] == [("Two", "sentence"), ("Row", "row"), ("Par", "paragraph"), ("== ", "section"), ("x", "row")]
    with pytest.raises(ValueError):
        split_text("abc", TOK, 10, 9)


def test_valleys_against_plain_counting():
    r = random.Random(9)
    for _ in range(60):
        units = [" ".join(r.choice("abcdefg") * 2 for _ in range(r.randrange(6))) + " " for _ in range(r.randrange(1, 14))]
        bags, sim = [Counter(u.split()) for u in units], []
        for g in range(1, len(units)):
            a, b = sum(bags[max(0, g - 3) : g], Counter()), sum(bags[g : g + 3], Counter())
            n = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            sim.append(sum(a[w] * b[w] for w in a) / n if n else 0)
        want = []
        for i in range(len(sim)):
            a = b = i
            while a and sim[a - 1] >= sim[a]:
                a -= 1
            while b + 1 < len(sim) and sim[b + 1] >= sim[b]:
                b += 1
            want.append(sim[a] + sim[b] - 2 * sim[i])
        text = "".join(units)
        got = valley_depths(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, units)]))
        assert np.allclose(got, want)
    assert folded(np.array([0x1F600], np.uint32)).tolist() == [0]


def test_operator(spark):
    df = spark.createDataFrame([(1, TEXTS[0]), (2, None), (3, ""), (4, "short"), (1, TEXTS[0])], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = pieces(df, limit=200, overlap=20).collect()
    one = split_text(TEXTS[0], TOK, 200, 20)
    assert len(got) == 2 * len(one) and {r.doc_id for r in got} == {1} and max(r.n_tokens for r in got) <= 200
    assert sorted({(r.piece_no, r.text) for r in got}) == [(k, TEXTS[0][p[0] : p[1]]) for k, p in enumerate(one, 1)]
    assert pieces(df.limit(0)).count() == 0


def test_sizes_of_long_stretches_are_the_whole_texts():
    for t in ("x" * 9000 + "yz" * 3000, "a" + " " * 5000 + "b c", "\n" * 4500, " " * 2_000_000 + "end", "　" * 6000 + "字"):
        got = TOK.encode(t)
        assert TOK._encoding.decode(got) == t
        if len(t) < 20_000:
            assert got == TOK._encoding.encode_ordinary(t)
