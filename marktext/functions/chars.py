"""Character classes and the atomic (letter + marks -> one codepoint) dimension.

Every character is built from its codepoint; no combining mark is typed into source,
because editors reorder and merge them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the studied corpus tooling for results to match.
#   Marks, in this order (index = "mark index" hi):
#     U+064B fathatan, U+064C dammatan, U+064D kasratan, U+064E fathah,
#     U+064F dammah, U+0650 kasrah, U+0651 shaddah, U+0652 sukun,
#     U+0670 superscript alef
#   Counting letters: U+0621-U+063A, U+0641-U+064A, U+0671-U+06D3
#   Mapping letters:  U+0621-U+063A (26) then U+0641-U+064A (10)
#   First private-use codepoint of the atomic mapping: U+E000
#   "Arabic token" block: U+0600-U+06FF
#   Pretokenizer pattern (Java/regex-module syntax):
#     [U+0621-U+064A U+064B-U+0652 U+0670 U+E000-U+EFFF]+ | [^\r\n\p{L}\p{N}]?+\p{L}+ | \p{N}{1,2}
#     |  ?[^\s\p{L}\p{N}]++[\r\n]* | \s*[\r\n] | \s+(?!\S) | \s+   (ordered alternation)
#   Special tokens: <|reserved_0|> <|reserved_1|> <|reserved_2|> <|reserved_3|>; BOS = <|reserved_0|>
# ---------------------------------------------------------------------------
MARK_CODEPOINTS = [0x064B, 0x064C, 0x064D, 0x064E, 0x064F, 0x0650, 0x0651, 0x0652, 0x0670]
MARK_NAMES = ["fathatan", "dammatan", "kasratan", "fathah", "dammah", "kasrah",
              "shaddah", "sukun", "superscript_alef"]
COUNT_LETTER_RANGES = [(0x0621, 0x063A), (0x0641, 0x064A), (0x0671, 0x06D3)]
MAP_LETTER_RANGES = [(0x0621, 0x063A), (0x0641, 0x064A)]
PUA_BASE = 0xE000
ARABIC_BLOCK = (0x0600, 0x06FF)
SPLIT_PATTERN = ("[" + chr(0x0621) + "-" + chr(0x064A) + chr(0x064B) + "-" + chr(0x0652)
                 + chr(0x0670) + chr(0xE000) + "-" + chr(0xEFFF) + "]+"
                 + r"|[^\r\n\p{L}\p{N}]?+\p{L}+"
                 r"|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+")
# The place before a blank that stands between two characters that are no whitespace: a pretoken always begins there.
BEFORE_SINGLE_BLANK = r"(?U)(?= \S)(?<=\S)"
SPECIAL_TOKENS = ["<|reserved_0|>", "<|reserved_1|>", "<|reserved_2|>", "<|reserved_3|>"]
BOS_TOKEN = "<|reserved_0|>"
MIN_MAPPING_ENTRIES = 252

SHADDAH = 0x0651
MARKS = "".join(chr(c) for c in MARK_CODEPOINTS)
MAP_LETTERS = "".join(chr(c) for lo, hi in MAP_LETTER_RANGES for c in range(lo, hi + 1))
COUNT_LETTERS = "".join(chr(c) for lo, hi in COUNT_LETTER_RANGES for c in range(lo, hi + 1))

N_LETTERS = len(MAP_LETTERS)          # 36
N_MARKS = len(MARKS)                  # 9
SHADDAH_BLOCK = N_LETTERS * N_MARKS   # 324: first letter+shaddah(+mark) slot
LONE_BLOCK = 2 * SHADDAH_BLOCK        # 648: first lone-mark slot
N_SLOTS = LONE_BLOCK + N_MARKS        # 657 slots, 621 of them used

# Python's str.isspace() set (split()/strip() semantics), as codepoints.
PY_WHITESPACE = ([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                  *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _class_body(codepoints) -> str:
    """Regex character-class body listing the characters literally (valid in Java and RE2)."""
    out = []
    for c in codepoints:
        ch = chr(c)
        out.append("\\" + ch if ch in "\\]^-[" else ch)
    return "".join(out)


def _range_body(ranges) -> str:
    return "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in ranges)


PYWS_CLASS = _class_body(PY_WHITESPACE)
MARK_CLASS = "[" + _class_body(MARK_CODEPOINTS) + "]"
NON_SHADDAH_MARK_CLASS = "[" + _class_body([c for c in MARK_CODEPOINTS if c != SHADDAH]) + "]"
MAP_LETTER_CLASS = "[" + _range_body(MAP_LETTER_RANGES) + "]"
COUNT_LETTER_CLASS = "[" + _range_body(COUNT_LETTER_RANGES) + "]"
WORD_PATTERN = "[^" + PYWS_CLASS + "]+"          # one Python split() word
NON_BLANK_PATTERN = "[^" + PYWS_CLASS + "]"      # has a char that str.strip() keeps
NON_BLANK_UNMARKED_PATTERN = "[^" + PYWS_CLASS + MARKS + "]"  # has one that is no mark either
# The same whitespace for Java alone, which tries the members of a class one after the other: the Latin-1
# ones are one bit set, and the range around all the others is tried before them.
JAVA_PYWS_CLASS = ("[" + _class_body([c for c in PY_WHITESPACE if c < 0x100]) + "["
                   + _range_body([(min(c for c in PY_WHITESPACE if c > 0xFF), max(PY_WHITESPACE))]) + "&&["
                   + _class_body([c for c in PY_WHITESPACE if c > 0xFF]) + "]]]")
PUA_CLASS = "[" + chr(PUA_BASE) + "-" + chr(PUA_BASE + N_SLOTS - 1) + "]"

# One atomic unit, longest first: letter+shaddah+mark, letter+mark, lone mark.
UNIT_PATTERN = (MAP_LETTER_CLASS + chr(SHADDAH) + NON_SHADDAH_MARK_CLASS
                + "|" + MAP_LETTER_CLASS + MARK_CLASS + "|" + MARK_CLASS)


def letter_index(cp: int) -> int:
    """Index of a mapping letter (0..35)."""
    return cp - 0x0621 if cp <= 0x063A else 26 + cp - 0x0641


def mark_index(cp: int) -> int:
    return MARK_CODEPOINTS.index(cp)


def slot_of(seq: str) -> int | None:
    """Closed-form slot of an atomic sequence, or None if it is not a mapping key."""
    cps = [ord(c) for c in seq]
    if len(cps) == 1:
        return LONE_BLOCK + mark_index(cps[0]) if cps[0] in MARK_CODEPOINTS else None
    if chr(cps[0]) not in MAP_LETTERS or any(c not in MARK_CODEPOINTS for c in cps[1:]):
        return None
    li = letter_index(cps[0])
    if len(cps) == 2:
        if cps[1] == SHADDAH:
            return SHADDAH_BLOCK + N_MARKS * li + 8
        return N_MARKS * li + mark_index(cps[1])
    if len(cps) == 3 and cps[1] == SHADDAH and cps[2] != SHADDAH:
        hi = mark_index(cps[2])
        return SHADDAH_BLOCK + N_MARKS * li + (hi if hi < 6 else hi - 1)
    return None


def atomic_sequences() -> list[str]:
    """All 621 mapping keys: letter+mark, letter+shaddah+mark, letter+shaddah, lone mark."""
    seqs = []
    for letter in MAP_LETTERS:
        for mark in MARKS:
            seqs.append(letter + mark)
    for letter in MAP_LETTERS:
        for mark in MARKS:
            if ord(mark) != SHADDAH:
                seqs.append(letter + chr(SHADDAH) + mark)
    seqs.extend(MARKS)
    return seqs


def atomic_mapping() -> dict[str, str]:
    """sequence -> private-use character (621 entries)."""
    return {s: chr(PUA_BASE + slot_of(s)) for s in atomic_sequences()}


def reverse_mapping() -> dict[str, str]:
    return {v: k for k, v in atomic_mapping().items()}


# Slot -> output character, and slot -> source sequence ('' for the 36 unused slots).
PUA_CHARS = [chr(PUA_BASE + i) for i in range(N_SLOTS)]
SLOT_SEQUENCES = [""] * N_SLOTS
for _seq, _pua in atomic_mapping().items():
    SLOT_SEQUENCES[ord(_pua) - PUA_BASE] = _seq
