"""Literal cases for typed nodes, cues and relations."""

import pytest
from pyspark.sql import functions as F

from docmill.operators import structure as U

CASES = [
    ("# A\n\ntext\nmore", [("heading", "A", 1, 1, 1), ("paragraph", "text\nmore", 0, 3, 4)]),
    ("~~~js\na\n```\n~~~\nx", [("code", "a\n```", 0, 1, 4), ("paragraph", "x", 0, 5, 5)]),
    ("````\n```\n````", [("code", "```", 0, 1, 3)]),
    ("```\nopen", [("code", "open", 0, 1, 2)]),
    ("a | b\n--- | ---\n1 | 2\n\nz", [("table", "a | b\n--- | ---\n1 | 2", 3, 1, 3), ("paragraph", "z", 0, 5, 5)]),
    ("| a | b |\n| no | rule |", [("paragraph", "| a | b |\n| no | rule |", 0, 1, 2)]),
    ("- x\n* y\n1. z\nw", [("list", "x\ny\nz", 3, 1, 3), ("paragraph", "w", 0, 4, 4)]),
    ("$$\na+b\n$$\n$$c$$\n$d$", [("formula", "a+b", 0, 1, 3), ("formula", "c", 0, 4, 4), ("formula", "d", 0, 5, 5)]),
    ("---\nk: v\n---\n# T", [("metadata", "k: v", 1, 1, 3), ("heading", "T", 1, 4, 4)]),
    ("---\nno end", [("paragraph", "---\nno end", 0, 1, 2)]),
    ('![a](b.png "t")\n> q\n>r', [("figure", '![a](b.png "t")', 0, 1, 1), ("quote", "q\nr", 2, 2, 3)]),
    ("p\n# H\n    ```\nq", [("paragraph", "p", 0, 1, 1), ("heading", "H", 1, 2, 2), ("paragraph", "```\nq", 0, 3, 4)]),
    ("", []), (None, []), ("\n \n", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_typed_nodes(text, want):
    assert U.typed_nodes(text) == want


def test_nodes_are_numbered_and_sound(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id int, text string")
    typed = U.nodes(docs)
    assert typed.count() == sum(len(w) for _, w in CASES) and U.node_faults(typed).count() == 0
    assert U.nodes(docs.limit(0)).count() == 0
    bad = typed.withColumn("n", F.col("n") * 2)
    assert {r["code"] for r in U.node_faults(bad).collect()} == {"ids_not_sequential"}


def test_cues(spark):
    text = "﻿WEBVTT\n\nNOTE skip\n\nintro\n00:01.000 --> 00:02.500 align:start\nhello\nthere\n\n1:00:00,000 --> 1:00:01,000\nbye\n\nNOTE\n00:05.000 --> 00:06.000\nx\r\n\r\n00:07.000 --> 00:08.000"
    got = spark.createDataFrame([(text,), ("",)], "t string").select(U.cues(F.col("t")).alias("c")).collect()
    assert [tuple(x) for x in got[0]["c"]] == [
        ("intro", "00:01.000", "00:02.500", "hello there", "align:start"), ("2", "1:00:00,000", "1:00:01,000", "bye", ""), ("3", "00:05.000", "00:06.000", "x", ""), ("4", "00:07.000", "00:08.000", "", "")]
    assert got[1]["c"] == []


def test_relations(spark):
    rows = [(1, 0, "heading", 1), (1, 1, "paragraph", 0), (1, 2, "figure", 0), (1, 3, "heading", 2), (1, 4, "paragraph", 0), (1, 5, "heading", 1)]
    got = {(r["kind"], r["source"], r["target"]) for r in U.relations(spark.createDataFrame(rows, "doc_id int, n int, type string, size int")).collect()}
    assert got == {*(("next_sibling", i, i + 1) for i in range(5)), *(("contains", 0, i) for i in range(1, 5)), ("contains", 3, 4), ("references", 1, 2)}
