"""What stands between blanks, and what kind of line it stands in."""

from __future__ import annotations

import numpy as np

from quire.llm.codepoints import BLANK, DIGIT, LETTER, UPPER, runs

# Signs that code is full of and prose is not; a semicolon is one at the end of a line or inside what stands between blanks.
CODE_SIGNS = "_{};="


def counted(flags: np.ndarray) -> np.ndarray:
    """Prefix counts: entry i counts the true flags before i."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def at_text(codes: np.ndarray, text: str) -> np.ndarray:
    """Where ``text`` begins; it may run on into the next row."""
    out = np.zeros(len(codes), bool)
    if len(codes) >= len(text):
        hit = np.ones(len(codes) - len(text) + 1, bool)
        for i, char in enumerate(text):
            hit &= codes[i : len(hit) + i] == ord(char)
        out[: len(hit)] = hit
    return out


class Tokens:
    """Starts and ends of what stands between blanks, and whether it is a link, a tag or code."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, kinds: np.ndarray):
        self.starts, self.ends = runs((kinds & BLANK) == 0, offsets)
        letter, digit = (kinds & LETTER) > 0, (kinds & DIGIT) > 0
        self.link = self.holds(at_text(codes, "://"), 3) | self.holds(at_text(codes, "www."), 4)
        self.tag = (codes[self.starts] == ord("#")) & (self.ends - self.starts > 1) | self.holds(codes == ord("€"))
        lower = letter & ((kinds & UPPER) == 0)
        follows = np.zeros(len(codes), bool)
        follows[1:] = letter[:-1] & digit[1:] | lower[:-1] & ((kinds[1:] & UPPER) > 0) | letter[:-1] & (codes[1:] == ord("("))
        follows[self.starts] = False  # what stands before belongs to another row
        signs = np.isin(codes, np.array([ord(c) for c in CODE_SIGNS], np.uint32))
        # prose and lists put a semicolon between phrases of a line
        inside = np.zeros(len(codes), bool)
        inside[:-1] = ((kinds[1:] & BLANK) > 0) & (codes[1:] != 10)
        inside[offsets[1:][offsets[1:] > 0] - 1] = False
        signs &= ~((codes == ord(";")) & inside)
        self.code = (self.holds(signs | follows) | self.holds(at_text(codes, "->"), 2)) & ~self.link & ~self.tag

    def holds(self, flags: np.ndarray, length: int = 1) -> np.ndarray:
        """Whether something of ``length`` that begins at a flag lies inside."""
        total = counted(flags)
        return total[np.maximum(self.ends - length + 1, self.starts)] > total[self.starts]
