import hashlib
import re

from cardlens.llm.pii import KINDS, find, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        odd = [int(c) for c in digits[::-1]]
        total = sum(odd[::2]) + sum(sum(divmod(2 * x, 10)) for x in odd[1::2])
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, *m.span()) for k in KINDS for m in re.finditer(PATTERNS[k], text or "")
            if valid(k, m.group())]


ODD = ["a@b.c_d@e.f.g", "@x.y a@ b@c d@e.f", "..@..a@b.c.", "1.2.3.4.5 300.1.1.1 01.002.3.4 1.2.3",
       "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111", "+1 (555) 123-4567 +12 +1 2",
       "+1 (269) 555-3296 4524132264652876", "é🙂 a@b.co 10.0.0.1", "٣@b.c +٣123456789",
       "x" * 3000 + "@" + "y" * 3000 + ".z", "1" * 5000, "1." * 4000, "+" * 2000 + "1 2"]


def test_base_spans_equal_patterns(spark, edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    rows += [(100 + i, t) for i, t in enumerate(ODD)]
    out = find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((-1 if i is None else i, hashlib.sha256(",".join(
        f"{k}:{a}:{b}" for k, a, b in base(t)).encode()).hexdigest(),
        tuple(sum(s[0] == k for s in base(t)) for k in KINDS)) for i, t in rows)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["base_sha256"],
                  tuple(r[f"n_{k}"] for k in KINDS)) for r in out)
    assert got == want
    for r in out:
        kept = [(s["kind"], s["a"], s["b"]) for s in r["all_spans"] if not s["found"]]
        assert kept == sorted(kept, key=lambda s: (KINDS.index(s[0]), s[1]))


def contexts():
    rows = [(i, f"hello there please call me at +1 (555) 010-{1000 + i} before noon")
            for i in range(12)]
    rows += [(50, "so please call me at 555-010-7777 before noon"),      # same context, no plus
             (51, "the sum was 555-010-8888 in all other ledgers"),      # another context
             (52, "and later 555-010-7777 once more"),                   # believed elsewhere
             (53, "no numbers here")]
    return rows


def test_trusted_contexts_find_unseen_identifiers(spark):
    df = spark.createDataFrame(contexts(), "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["a"], s["b"]) for s in r["all_spans"] if s["found"]]
             for r in find(df).collect()}
    assert found[50] == [("phone", 21, 33)]
    assert found[52] == [("phone", 10, 22)]
    assert found[51] == [] and found[53] == []
    assert all(found[i] == [] for i in range(12))


def test_redact_keeps_columns(spark, edge):
    df = spark.createDataFrame([(*r, "x", len(r[1])) for r in contexts()],
                               "doc_id long, text string, _key string, n_chars long")
    out = {r["doc_id"]: r for r in redact(df).collect()}
    assert redact(df).columns == df.columns
    assert out[0]["text"] == "hello there please call me at <PHONE> before noon"
    assert out[50]["text"] == "so please call me at <PHONE> before noon"
    assert out[51]["text"] == contexts()[13][1]
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    same = sorted((r["doc_id"] or -1, r["text"] or "") for r in edge.collect())
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in redact(edge).collect()) == same


def test_empty(nothing):
    assert find(nothing).collect() == []
    assert redact(nothing).collect() == []


def test_columns_with_odd_names_pass(spark):
    from cardlens.llm.decontamination import drop_contaminated
    from cardlens.llm.pii import redact
    docs = spark.createDataFrame([(1, "mail a.b@c.de now", 7, 2)], ["doc_id", "text", "a`b", "x.y, z"])
    out = redact(docs)
    assert out.columns == docs.columns and out.first()["text"] == "mail <EMAIL> now"
    items = spark.createDataFrame([(1, "one two three four five six seven eight")],
                                  "item_id long, text string")
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == 1
