import random

import corpus_pipeline as cp


def documents(seed=8):
    rng = random.Random(seed)
    vocab = [f"g{i}" for i in range(400)]

    def text(n):
        return " ".join(rng.choice(vocab) for _ in range(n))
    item = text(20)
    rows = [(i, text(rng.randint(30, 90))) for i in range(150)]
    junk = [(200 + i, " ".join(f"@@{rng.randint(0, 9)}@@" for _ in range(60))) for i in range(50)]
    near = rows[5][1].split()
    near[-1] = "changed"
    special = [(300, rows[3][1]), (301, " ".join(near)), (302, text(20) + " " + item + " " + text(9)),
               (303, text(30) + " mail me at jo.doe@mail.example.org soon"), (304, None), (305, "")]
    return rows + junk + special, item


def test_each_stage_acts_and_keeps_columns(spark, tmp_path):
    rows, item = documents()
    docs = spark.createDataFrame(
        [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows if i % 2 == 0],
                          "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    now, seen = docs, {}
    for name, stage in cp.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/out-{name}")
        now = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "pack":
            assert now.columns == docs.columns
    good = {i for i, _ in rows if i < 150}
    assert not any(200 <= i < 250 for i in seen["quality"])
    assert len(good & set(seen["quality"])) >= 140
    stays = set(seen["quality"]) - set(seen["near_duplicates"])
    assert stays <= {3, 5, 300, 301} and {300, 301} & set(seen["quality"]) <= stays
    assert set(seen["near_duplicates"]) - set(seen["decontaminate"]) == (
        {302} & set(seen["near_duplicates"]))
    assert set(seen["personal_data"]) == set(seen["decontaminate"])
    for i, r in seen["personal_data"].items():
        if i == 303:
            assert "<EMAIL> soon" in r["text"] and "@" not in r["text"]
            assert r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == seen["decontaminate"][i]["text"]
    assert set(seen["pack"]) == set(seen["personal_data"])
    assert now.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()
    whole = {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()}
    assert whole == set(seen["pack"])


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, "
                                 "n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
