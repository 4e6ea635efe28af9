"""Which of many texts stand anywhere in a text, in one walk over it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = (8, 3, 2, 1)  # a needle is looked for where its first characters stand, as many as fit it


class Needles:
    """Texts by their first characters, with the lengths that texts of such a start have.

    Memory is a key a text at most, whatever its length: ``needles`` itself, a
    set or dict, is looked into and not copied.
    """

    def __init__(self, needles):
        self.needles = needles
        lengths: dict[str, tuple] = {}
        shared: dict[tuple, tuple] = {}  # few different ones
        for needle in needles:
            n = len(needle)
            if n:
                key = needle[: next(k for k in KEYS if k <= n)]
                have = lengths.get(key, ())
                if n not in have:
                    more = tuple(sorted((*have, n)))
                    lengths[key] = shared.setdefault(more, more)
        self.lengths = lengths
        self.keys = sorted({len(k) for k in lengths})

    def found(self, text: str) -> list[str]:
        """The needles that the text holds, each once."""
        lengths, needles, out, end = self.lengths, self.needles, set(), len(text)
        for key in self.keys:
            for at in range(end - key + 1):
                for n in lengths.get(text[at : at + key], ()):
                    if at + n > end:
                        break
                    if (held := text[at : at + n]) in needles:
                        out.add(held)
        return list(out)
