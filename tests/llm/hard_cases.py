"""What the corpus operators' tests share."""

from __future__ import annotations

from pathlib import Path

DATA = Path("/root/testdata/sf0.001")

#: Texts that every operator has to take: null, empty, white space, repeats, one very long, one very long word.
HARD = [None, "", " \n\t ", "a", "a", "word " * 40_000, "x" * 50_000, "ß İ ﬁ 日本\u0301 \U0001f642 \x00 ▁", "line\n\n\nline\n", "the the the"]
