"""Text columns: whitespace, encoding and character repair, corpus, case.

Everything is a column expression over whole values, so a clean of eleven
columns stays one projection without a Python hop. The longer repairs are
written as SQL text over a column name: one parse builds what would be a
hundred calls per column.
"""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's \s and str.strip() treat as space.
SPACE = (
    r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Any run of it that is not already one plain space. The leading test rejects
# most characters with one comparison, where the classes take a dozen.
_LOOSE_SPACE = (
    r"(?![!-\x{84}])(?:" + SPACE + r"{2,}|[\t-\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])"
)

# Character classes of the odd-character report and removal.
NON_ASCII = r"[^\x{00}-\x{7F}]"
CONTROL = r"[\x{00}-\x{1F}\x{7F}]"
ODD_SPACE = r"[\x{A0}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
QUICK_ODD_SPACE = r"(?=[\x{A0}-\x{3000}])" + ODD_SPACE
BROKEN = r"[\x{FFFD}\x{FEFF}]"
ODD_CLASSES = {
    "non_ascii": NON_ASCII,
    "control_chars": CONTROL,
    "weird_spaces": QUICK_ODD_SPACE,
    "unicode_replacement": BROKEN,
}

# Windows-1252 characters at bytes 80-9F, by byte; five are unused.
_CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_C1 = "".join(chr(0x80 + i) for i in range(32))

# Joined Latin letters and the letters they stand for.
LIGATURES = {
    "Ĳ": "IJ", "ĳ": "ij", "ŉ": "ʼn", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj",
    "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st",
}
SINGLE_QUOTES = r"[\x{2BC}\x{2018}-\x{201B}]"
DOUBLE_QUOTES = r"[\x{201C}-\x{201F}]"
TERMINAL_ESCAPE = r"\x{1B}\[[0-9;]*[a-zA-Z]"
REMOVED_CONTROL = (
    r"[\x{00}-\x{08}\x{0B}\x{0E}-\x{1F}\x{7F}\x{206A}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFC}]"
)
WIDE = r"[\x{3000}\x{FF01}-\x{FFEF}]"
# Only text with one of these can change in a repair; all other text is left alone.
_MISREAD = rf"[\x{{C2}}-\x{{F4}}][\x{{80}}-\x{{BF}}{_CP1252}]"
_UNTIDY = (
    r"(?![\t\n\r -~\x{A0}-\x{FF}])["
    r"\x{00}-\x{08}\x{0B}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{2BC}\x{2018}-\x{201F}\x{206A}-\x{206F}"
    r"\x{3000}\x{FEFF}\x{FF01}-\x{FFEF}\x{FFF9}-\x{FFFC}" + "".join(LIGATURES) + "]"
)


def wide_pairs() -> list[tuple[str, str]]:
    """Full- and half-width characters with their normal-width form, by rule."""
    pairs = [("　", " ")]
    for code in range(0xFF01, 0xFFF0):
        normal = unicodedata.normalize("NFKC", chr(code))
        if normal != chr(code) and len(normal) == 1:
            pairs.append((chr(code), normal))
    return pairs


def _lit(value: str) -> str:
    return "r'" + value + "'" if "'" not in value else '"' + value + '"'


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _where_found(value: str, name: str, pattern: str, changed: str) -> str:
    """``changed`` for the values that hold ``pattern``; the others pass as they are."""
    return _let(value, name, f"CASE WHEN {name} RLIKE {_lit(pattern)} THEN {changed} ELSE {name} END")


def _repair_encoding(c: str) -> str:
    decoded = "try_validate_utf8(CAST(encode(b, 'ISO-8859-1') AS STRING))"
    one_byte = r"b RLIKE r'^[\x{00}-\x{FF}]*$'"
    line = _let(
        f"translate(l, {_lit(_CP1252)}, {_lit(_C1)})", "b", f"coalesce(CASE WHEN {one_byte} THEN {decoded} END, l)"
    )
    lines = f"array_join(transform(split(e, '\\n'), l -> {line}), '\\n')"
    return _where_found(c, "e", _MISREAD, lines)


def _repair_typography(c: str) -> str:
    separate = "g"
    for joined, letters in LIGATURES.items():
        separate = f"replace({separate}, {_lit(joined)}, {_lit(letters)})"
    wide, normal = ("".join(side) for side in zip(*wide_pairs()))
    escaped = normal.replace("\\", "\\\\").replace('"', '\\"')
    x = _where_found("t", "k", r"[\x{80}-\x{9F}]", f"translate(k, {_lit(_C1)}, {_lit(_CP1252)})")
    x = _where_found(x, "g", f"[{''.join(LIGATURES)}]", separate)
    x = _where_found(x, "w", WIDE, f"translate(w, {_lit(wide)}, \"{escaped}\")")
    for pattern, new in (
        (SINGLE_QUOTES, "'"), (DOUBLE_QUOTES, '"'), (TERMINAL_ESCAPE, ""), (REMOVED_CONTROL, "")
    ):
        x = f"regexp_replace({x}, {_lit(pattern)}, {_lit(new)})"
    return _where_found(c, "t", _UNTIDY, x)


def _drop_unencodable(c: str) -> str:
    fixed = "replace(make_valid_utf8(v), '\uFFFD', '')"
    return _let(c, "v", f"CASE WHEN is_valid_utf8(v) THEN v ELSE {fixed} END")


def _collapse_space(c: str) -> str:
    return f"trim(regexp_replace({c}, {_lit(_LOOSE_SPACE)}, ' '))"


def _remove_odd_characters(c: str) -> str:
    for pattern, new in ((CONTROL, " "), (QUICK_ODD_SPACE, " "), (BROKEN, "")):
        c = f"regexp_replace({c}, {_lit(pattern)}, {_lit(new)})"
    return _collapse_space(c)


def strip(c: Column) -> Column:
    """Cut space of every kind from both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse_space(column: str) -> Column:
    """Runs of space, tabs and line breaks become one space; ends are trimmed."""
    return F.expr(_collapse_space(column))


def repair_encoding(column: str) -> Column:
    """Undo UTF-8 that was read as Windows-1252, line by line.

    A line is repaired only when all its characters fit in one byte and those
    bytes are valid UTF-8, so correct text comes back as it was.
    """
    return F.expr(_repair_encoding(column))


def repair_typography(column: str) -> Column:
    """Plain quotes, separate letters for ligatures, normal width, no control codes."""
    return F.expr(_repair_typography(column))


def drop_unencodable(column: str) -> Column:
    """Drop what has no UTF-8 form; valid text is unchanged."""
    return F.expr(_drop_unencodable(column))


def nan_to_null(column: str) -> Column:
    return F.expr(f"nullif({column}, 'nan')")


def clean_text(column: str) -> Column:
    """Encoding and character repair, then one-space form; missing stays missing."""
    repaired = _repair_typography(_repair_encoding(column))
    return F.expr(f"nullif({_drop_unencodable(_collapse_space(repaired))}, 'nan')")


def remove_odd_characters(column: str) -> Column:
    """Control codes and invisible spaces become spaces, broken characters go."""
    return F.expr(_remove_odd_characters(column))


def text_corpus(description: Column, variety: Column, region: Column) -> Column:
    """The text an item is encoded from; a missing part reads ``nan``."""

    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit("nan"))

    return F.concat(
        shown(description), F.lit(". Variety: "), shown(variety), F.lit(". Region: "), shown(region)
    )
