from __future__ import annotations

import pytest

from cardlens.functions.answers import first_object, parse_answers
from cardlens.session import ensure_checkpoint_dir, is_local

CASES = [
    ('{"summary": "ok", "confidence": "high"}', "ok", "high", True),
    ('```json\n{"summary": "s"}\n```\nthanks', "s", "low", True),
    ('```\n{"confidence": "medium"}\n```', "", "medium", True),
    ('```json {"summary": "open fence"}', "open fence", "low", True),
    ('Sure: {"summary": "inside {braces}", "confidence": "high"} done', "inside {braces}", "high",
     False),
    ('{broken} then {"summary": "second"}', "second", "low", False),
    ('{"summary": {"a": 1}} tail', '{"a": 1}', "low", False),
    ("  plain words  ", "plain words", "low", False),
    ("{never closed", "{never closed", "low", False),
    ("x" * 2000, "x" * 2000, "low", False),
    ("", "", "low", False),
    (None, "", "low", False),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    got = {r["i"]: (r["summary"], r["confidence"], r["parsed"])
           for r in parse_answers(df, "text").collect()}
    for i, case in enumerate(CASES):
        assert got[i] == case[1:], case[0]
    cut = parse_answers(df, "text", max_chars=800).where("i = 9").first()
    assert len(cut["summary"]) == 800


def test_first_object():
    assert first_object("no") is None
    assert first_object('[1, {"a": "}"}]') == {"a": "}"}


class _Cluster:
    class sparkContext:  # noqa: N801
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class conf:  # noqa: N801
        get = staticmethod(lambda name, default=None: default)


def test_a_cluster_needs_a_shared_folder():
    assert is_local("local[4]") and is_local("local") and not is_local("local-cluster[2,1,1024]")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Cluster())
