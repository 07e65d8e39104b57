import random

from pyspark.sql import functions as F

from strideflow.llm.leaks import ItemIndex, gram_hashes, leaks, letters, longest_stretch, strip_markup, words_of
from tests.conftest import rows

R = random.Random(6)
WORDS = ["".join(R.choice("aeioubdgklmnprst") for _ in range(R.randrange(3, 10))) for _ in range(3000)]


def text(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def test_gram_hashes_are_of_the_grams():
    s = letters("Abcdefghijkl mnöp abcdefghijklmn")
    h = gram_hashes(s).tolist()
    assert len(h) == len(s) - 11 and h[0] == h[16] and len(set(h)) == len(h) - 3


def test_markup_goes():
    t = "The [[was|tarholm]] was<ref>Miller, p. 3</ref> ''very''&nbsp;{{nowrap|old}}<!-- no --> <i>and</i> {{cn|date=May}} [http://x.y big]"
    assert words_of(strip_markup(t)) == ["the", "tarholm", "was", "very", "old", "and", "big"]
    assert words_of(strip_markup("{{Infobox note\n| remark = of the ridge\n| by = me\n}}")) == ["of", "the", "ridge", "me"]
    assert words_of(strip_markup("{{Quote|text=The old ridge fell, it is said|source=[[Me]]}} {{x|y=1}}")) == ["the", "old", "ridge", "fell", "it", "is", "said"]
    assert words_of("minо­r rail-\nway") == ["minor", "railway"]


def test_longest_stretch():
    a = text(40, 1)
    assert longest_stretch(a, text(30, 2) + a + text(30, 3)) == 40
    b = list(a)
    b[10] = b[25] = "zzz"
    assert longest_stretch(a, b) == 40
    assert longest_stretch(a, text(9, 4) + a[5:25] + text(40, 5)) == 20
    assert longest_stretch(a, a[:10] + ["x", "y"] + a[10:]) == 40
    assert longest_stretch(a, []) == 0 and longest_stretch([], a) == 0


def test_leaks(spark):
    items = [(k, " ".join(text(60, 100 + k)).capitalize() + ".") for k in range(30)] + [(90, None), (91, ""), (92, "tiny bit")]
    get = {k: t.lower().rstrip(".").split() for k, t in items if t}
    noise = lambda s: " ".join(text(150, s))
    marked = " ".join(w + ("<ref>Someone, p. 5</ref>" if i % 9 == 4 else "") if i % 7 else f"[[List of things|{w}]]" for i, w in enumerate(get[3]))
    changed = [("changed" if i % 10 == 5 else w) for i, w in enumerate(get[4])]
    docs = [
        (1, noise(1) + " " + items[0][1] + " " + noise(2)), (2, noise(3) + " " + " ".join(get[1][5:31]).upper() + " " + noise(4)), (3, noise(5) + " ".join(get[2][:15]) + noise(6)),
        (4, noise(7) + " " + marked + " " + noise(8)), (5, noise(9) + " " + " ".join(changed) + noise(10)), (6, None), (7, ""), (8, noise(11) * 40 + items[5][1]),
        (9, " ".join(get[6][:30]) + " " + noise(12) + " " + " ".join(get[6][30:])), (10, "x" * 300_000), (11, "a tiny bit more"), (1, noise(1) + " " + items[0][1] + " " + noise(2)), (12, "\r\n".join(get[7])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert rows(leaks(d, i).select("item_id", "doc_id")) == [(0, 1), (1, 2), (3, 4), (4, 5), (5, 8), (6, 9), (7, 12), (92, 11)]
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0
    assert rows(leaks(d, i, item_chars=900).select("item_id", "doc_id")) == rows(leaks(d, i).select("item_id", "doc_id"))


def test_the_filter_keeps_every_stretch_that_it_must():
    r = random.Random(7)
    items = [(k, " ".join(text(50, 200 + k))) for k in range(20)]
    index = ItemIndex(items, 0.4)
    for k, t in items:
        w = t.split()
        for _ in range(20):
            n = r.randrange(20, 51)
            a = r.randrange(0, 51 - n)
            part = [("odd" if i % 8 == 3 else x) for i, x in enumerate(w[a : a + n])]
            doc = " ".join(text(50, r.random()) + part + text(50, r.random()))
            assert (0, k) in index.candidates([doc])
