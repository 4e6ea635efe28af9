"""Fragments of the check SQL: the same rules, written for DuckDB."""

from shelfwise.functions import text
from shelfwise.vocab import ANCHORS, WINERY_COUNTRY

SPACE, NON_ASCII = text.SPACE, text.NON_ASCII

# Well-formed UTF-8, spelled over code points 00-FF that stand for its bytes.
_UTF8 = (
    r"^(?:[\x{00}-\x{7F}]|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]"
    r"|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]"
    r"|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}"
    r"|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2})*$"
)


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {lit(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, {lit(SPACE + '+')}, ' ', 'g'))"


def repair_encoding(c: str) -> str:
    b = f"translate(l, {lit(text._CP1252)}, {lit(text._C1)})"
    chars = f"list_transform(string_split({b}, ''), lambda ch: printf('%02x', unicode(ch)))"
    line = (
        f"CASE WHEN regexp_matches(l, {lit(NON_ASCII)}) AND regexp_matches({b}, {lit(_UTF8)}) "
        f"THEN decode(unhex(array_to_string({chars}, ''))) ELSE l END"
    )
    return f"array_to_string(list_transform(string_split({c}, chr(10)), lambda l: {line}), chr(10))"


def repair_typography(c: str) -> str:
    out = f"translate({c}, {lit(text._C1)}, {lit(text._CP1252)})"
    for joined, letters in text.LIGATURES.items():
        out = f"replace({out}, {lit(joined)}, {lit(letters)})"
    wide, normal = (("".join(x)) for x in zip(*text.wide_pairs()))
    out = f"translate({out}, {lit(wide)}, {lit(normal)})"
    for pattern, new in (
        (text.SINGLE_QUOTES, "'"), (text.DOUBLE_QUOTES, '"'), (text.TERMINAL_ESCAPE, ""),
        (text.REMOVED_CONTROL, ""),
    ):
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(new)}, 'g')"
    return out


def clean(c: str) -> str:
    return f"nullif({collapse(repair_typography(repair_encoding(c)))}, 'nan')"


def remove_odd(c: str) -> str:
    for pattern, new in ((text.CONTROL, " "), (text.ODD_SPACE, " "), (text.BROKEN, "")):
        c = f"regexp_replace({c}, {lit(pattern)}, {lit(new)}, 'g')"
    return collapse(c)


def winery_rules() -> str:
    rows = ", ".join(f"({lit(w)}, {lit(c)})" for w, c in WINERY_COUNTRY.items())
    return f"(VALUES {rows}) AS rules(winery, rule_country)"


def region_fill(region: str = "region_1") -> str:
    inside = r"CASE WHEN regexp_matches(title, '\((.*?)\)') THEN regexp_extract(title, '\((.*?)\)', 1) END"
    return f"coalesce({region}, {inside}, 'unknown')"


def corpus(description="description", variety="variety", region="region_1") -> str:
    return (
        f"concat(coalesce({description}, 'nan'), '. Variety: ', coalesce({variety}, 'nan'), "
        f"'. Region: ', coalesce({region}, 'nan'))"
    )


def title_case(c: str) -> str:
    runs = r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({c}), {lit(runs)}), "
        f"lambda x: CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || x[2:]), '')"
    )


def unit(vec: str) -> str:
    """A list scaled to unit length, as an expression over a column name."""
    length = f"sqrt(list_sum(list_transform({vec}, lambda x: x * x)))"
    return f"CASE WHEN {length} > 0 THEN list_transform({vec}, lambda x: x / {length}) ELSE {vec} END"


def encoded(source: str, keys: str, dim: int = 64) -> str:
    """A query that adds ``vec``, the hashed-word vector of column ``text``, to ``keys``."""
    words = (
        "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    )
    return f"""
      SELECT {keys}, CASE WHEN len > 0 THEN list_transform(c, lambda x: x / len) ELSE c END AS vec FROM (
        SELECT {keys}, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS len FROM (
          SELECT {keys}, list_transform(range({dim}), lambda d:
              CAST(len(list_filter(s, lambda x: x = d)) AS DOUBLE)) AS c FROM (
            SELECT {keys}, list_transform({words},
                lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dim}) AS s
            FROM ({source}) WHERE text IS NOT NULL)))
    """


def anchors_source() -> str:
    rows = ", ".join(
        f"({i}, {lit(t)}, {lit(col)}, {str(asc).lower()})" for i, (t, col, asc) in enumerate(ANCHORS)
    )
    return f"SELECT * FROM (VALUES {rows}) AS a(pos, text, sort_by, ascending)"


def request_parts(source: str) -> str:
    """Identifier, modifier and the numbers in it, for a table with ``query_id`` and ``query``."""
    space = lit(f"^{SPACE}+|{SPACE}+$")
    parts = f"list_transform(string_split(query, '+'), lambda x: regexp_replace(x, {space}, '', 'g'))"
    number = "TRY_CAST(nullif(regexp_extract(modifier, '{}', 1), '') AS {})"
    return f"""
      SELECT query_id, identifier, modifier,
        {number.format('(?i)under \\$?([0-9]+(\\.[0-9]+)?)', 'DOUBLE')} AS price_max,
        {number.format('(?i)over \\$?([0-9]+(\\.[0-9]+)?)', 'DOUBLE')} AS price_min,
        {number.format('(?i)([0-9]+)\\+?\\s*points', 'INT')} AS min_points,
        CASE WHEN regexp_full_match(identifier, '[0-9]+') THEN TRY_CAST(identifier AS BIGINT) END AS id_wanted
      FROM (SELECT query_id, parts[1] AS identifier,
              {strip("array_to_string(parts[2:], ' ')")} AS modifier
            FROM (SELECT query_id, {parts} AS parts FROM ({source})))
    """
