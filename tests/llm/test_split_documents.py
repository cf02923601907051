"""Documents whose rows repeat an id: operator 3 counts them as one."""

from __future__ import annotations

from test_llm import DOCS

from ridgemill.llm import decontaminate


def test_item_split_over_two_rows(table):
    words = [f"w{i}" for i in range(44)]  # 40 shingles of 5 words
    halves = [(7, " ".join(words[:24])), (7, " ".join(words[20:])), (8, " ".join(words[:24]))]
    got = decontaminate.contaminated(table(halves, DOCS), table([(1, " ".join(words))], "item_id long, text string"))
    assert [tuple(r) for r in got.collect()] == [(7, 1, 40, 40, 1.0)]
