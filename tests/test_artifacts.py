"""Literal cases for titles and review answers."""

import pytest

from docmill.operators import artifacts as A


@pytest.mark.parametrize("text, want", [
    ("<!-- page: 1 -->\n# Contents\n\n# A Field Guide\nBody text that is a sentence!", "A Field Guide"), ("Short Report | 2024\nmore words here", "Short Report | 2024"), ("Example Manual示例手册", "示例手册"), ("12\nabc\n", None), ("", None), (None, None),
    ("plain first line\nsecond line Report", "second line Report"), ("What is this?\nQuiet words", "Quiet words"), ("资源", None), ("x" * 41, None)])
def test_best_title(text, want):
    assert A.best_title(text) == want


def test_json_patch():
    op = {"op": "replace", "path": "/blocks/b/status", "value": "keep"}
    import json

    said = json.dumps([op])
    assert A.json_patch([said, "no array"]) == [op]
    assert A.json_patch(["[1, 2]", f"text [not json] then\n```json\n{said}\n```\n[3]"]) == [op]
    assert A.json_patch([{"content": said}, {"text": "[]"}]) == []
    assert A.json_patch([said, "[1]"]) == [op] and A.json_patch(["[{\"op\": 1}]"]) is None and A.json_patch([]) is None
