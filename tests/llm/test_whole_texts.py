"""Texts whose evidence lies farther apart, or closer together, than in the test tables."""

import pytest

from quarrymill.llm import licences, sentences
from tests.llm.test_names_and_licences import ENTRIES, NOTICE


def test_low_opening_mark_far_back():
    inner = "Wort " * 120
    text = f"Er sagte: „Hallo. {inner}Ende.“ Dann ging er. Noch ein Satz. Schluss."
    assert [text[a:b] for a, b in sentences.units(text)] == [f"Er sagte: „Hallo. {inner}Ende.“", "Dann ging er.", "Noch ein Satz.", "Schluss."]
    text = "Das „alte” Wort. He said “one. Two” here. End."
    assert [text[a:b] for a, b in sentences.units(text)] == ["Das „alte” Wort.", "He said “one. Two” here.", "End."]


@pytest.mark.parametrize(
    "text,plain",
    [
        ("# Do not edit\n# SPDX-License-Identifier: MIT", {"MIT"}),
        ("// Do not edit\n//\n// Licensed under the MIT License", {"MIT"}),
        ("/* Do not edit by hand\n * @license MIT\n */", {"MIT"}),
        ("# Do not edit\n# License: MIT", {"MIT"}),
        ("# This skill ships under the MIT License.", {"MIT"}),
        ("# Output is compared with a tool that\n# ships under the MIT License.", set()),
        ("# It replaces a tool that ships under the MIT License.", set()),
        ("# Do not assume that this is licensed\n# under the MIT License.", set()),
    ],
)
def test_mentions_end_where_statements_begin(text, plain):
    assert set(licences.Grammar(ENTRIES, list(NOTICE.items())).stated(text)[0]) == plain
