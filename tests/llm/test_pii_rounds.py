from cardlens.llm.pii import find


def chain(hops, width=40):
    """Seeds in the first context; each hop has numbers that stand in the
    context before it and once more in one of its own."""
    word = ["call", "ring", "dial", "reach", "fax", "text", "page"]
    say = lambda k, x: f"so please {word[k]} {x} before noon"
    rows = [(i, say(0, f"+1 (555) 010-{1000 + i}")) for i in range(width)]
    for k in range(hops):
        for i in range(width):
            name = f"555-{100 + k}-{1000 + i}"
            rows += [(1000 * (k + 1) + 2 * i, say(k, name)),
                     (1000 * (k + 1) + 2 * i + 1, say(k + 1, name))]
    return rows


def test_a_chain_of_five_hops_is_followed_to_its_end(spark):
    rows = chain(5)
    out = find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"]: sum(s["found"] for s in r["all_spans"]) for r in out}
    assert all(found[i] == (i >= 1000) for i, _ in rows)
