"""Words of whole texts, block by block, so that a very long text never becomes one list of words."""

from __future__ import annotations

import re

#: Characters (or bytes) of a block; it ends where a word ends.
BLOCK = 1 << 20


def runs(text, run: re.Pattern, gap: re.Pattern, block: int = BLOCK):
    """Lists of the matches of run, block by block. run matches maximal runs of some characters, gap any character that isn't one of them."""
    at = 0
    while at < len(text):
        end = at + block
        if end < len(text):
            cut = gap.search(text, end)
            end = cut.start() if cut else len(text)
        yield run.findall(text, at, end)
        at = end
