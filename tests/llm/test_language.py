import random
import zlib

import pyarrow as pa

from cardlens.llm.common import buffer_of
from cardlens.llm.language import BUCKETS, has_letter, identify, subwords

SYLLABLES = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["ber", "gen", "sch", "ung"],
             "zz": ["ção", "nha", "lhe", "õe"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
                        for _ in range(rng.randint(4, 60)))
        rows.append((i, text, lang if i % 9 else None, lang))
    return rows


def fold(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_rejection(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    out = {r["doc_id"]: r for r in identify(df).collect()}
    assert len(out) == len(rows)
    held = [r for r in rows if fold(r[0])]
    assert sum(out[r[0]]["lang_pred"] == r[3] for r in held) >= 0.97 * len(held)
    assert all(out[r[0]]["held_out"] == fold(r[0]) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    sure = [r for r in held if out[r[0]]["accepted"]]
    assert len(sure) > len(held) / 2


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = corpus(120)
    schema = "doc_id long, text string, lang string, truth string"
    other = [(i, t, "wrong" if fold(i) else x, y) for i, t, x, y in rows]
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in
             identify(spark.createDataFrame(x, schema)).collect()} for x in (rows, other))
    assert a == b


def test_edges(spark, edge, nothing):
    out = identify(edge).collect()
    assert len(out) == edge.count()
    for r in out:
        assert r["lang_pred"] in ("en", "und")
    by = {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] is not None}
    assert by[4] == by[5] == by[6] == "und" and by[1] == by[13] == "en"
    assert identify(nothing).collect() == []
    unlabelled = edge.drop("lang").withColumnRenamed("source", "lang").selectExpr(
        "doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in identify(unlabelled).collect()} == {"und"}


def test_letters_and_grams():
    texts = pa.array(["12 34 !".encode(), "漢".encode(), b"a", b"", "٣".encode(), b"abcd"])
    data, off = buffer_of(texts)
    assert has_letter(texts, data, off).tolist() == [False, True, True, False, False, True]
    three, four = subwords(data, off)
    last = slice(off[-2], off[-1])
    assert (three[last] < BUCKETS).tolist() == [True, True, False, False]
    assert (four[last] < BUCKETS).tolist() == [True, False, False, False]
    alone = buffer_of(pa.array([b"ABCD"]))
    assert subwords(*alone)[0].tolist() == three[last].tolist()
