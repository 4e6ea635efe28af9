"""Check SQL of the operators, for DuckDB: what each result must be, worked out another way.

Windows are compared as digests of their text, without anchors, automata or
suffix arrays; near words and lines are told apart by their first differing
character. Ids must tell documents apart, as they do in the tables.
"""

from shelfwise.llm.licenses import BLOCK, LOWER, PHRASES, STRIDE, TEMPLATES, THRESHOLD, UPPER, needed

WORD = r"[^\x20\x09-\x0D]+"


def one_edit(a: str, b: str) -> str:
    """Whether two different strings are one inserted, deleted or replaced code point apart."""
    first = (
        f"list_position(list_transform(list_zip(string_split({a}, ''), string_split({b}, '')), "
        "lambda z: z[1] IS DISTINCT FROM z[2]), true)"
    )
    return f"""CASE length({a}) - length({b})
      WHEN 0 THEN substr({a}, {first} + 1) = substr({b}, {first} + 1)
      WHEN 1 THEN substr({a}, {first} + 1) = substr({b}, {first})
      WHEN -1 THEN substr({a}, {first}) = substr({b}, {first} + 1)
      ELSE false END"""


def halves(table: str, name: str, columns: str) -> str:
    """Rows of ``table`` with the parts of which two strings within one edit share one, by the length of the shorter."""
    return f"""(SELECT {columns}, m, unnest([
        '<' || left({name}, CAST(m // 2 AS INT)), '>' || right({name}, CAST(m - m // 2 AS INT))]) AS half
      FROM (SELECT {columns}, unnest([length({name}), length({name}) - 1]) AS m FROM {table}) WHERE m >= 0)"""


# a line goes where an earlier one equals it or is one edit away; a pair shares the half that the edit leaves alone
LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
j AS (SELECT * FROM l WHERE trim(line, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) <> ''),
n AS (SELECT line, min(row(doc_id, pos)) AS place, row_number() OVER (ORDER BY min(row(doc_id, pos))) AS nth FROM j GROUP BY line),
h AS MATERIALIZED {halves("n", "line", "line, nth")},
pairs AS (SELECT DISTINCT a.line, a.nth, b.nth AS other_nth FROM h a JOIN h b ON a.half = b.half AND a.m = b.m AND b.nth < a.nth),
near AS (SELECT DISTINCT p.line FROM pairs p JOIN n o ON o.nth = p.other_nth WHERE {one_edit("p.line", "o.line")}),
gone AS (SELECT j.doc_id, j.pos FROM j JOIN n USING (line)
  WHERE row(j.doc_id, j.pos) > n.place OR j.line IN (SELECT line FROM near)),
kept AS (SELECT l.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines,
  coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

# every window of 20 words but the first of equals
SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k
  FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents WHERE text IS NOT NULL)),
x AS (SELECT doc_id, k, md5(string_agg(word, ' ') OVER f) AS digest, count(*) OVER f AS n FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY digest ORDER BY doc_id, k) AS r FROM x WHERE n = 20),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS k FROM r WHERE r > 1),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM w ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_words, coalesce(n.n, 0) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM (SELECT doc_id FROM documents) LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# every window of 400 bytes that another place repeats; runs of them joined where they overlap or touch
SUFFIXES = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
x AS (SELECT doc_id, k, md5(b[k:k + 399]) AS digest FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS k FROM d)),
g AS (SELECT digest FROM x GROUP BY 1 HAVING count(*) > 1),
m AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM x SEMI JOIN g USING (digest)),
t AS (SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k > before + 400 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY k) AS run FROM m),
s AS (SELECT doc_id, run, min(k) AS first, max(k) + 400 AS stop FROM t GROUP BY 1, 2),
c AS (SELECT doc_id, first AS stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY run), 1) AS first FROM s
  UNION ALL SELECT doc_id, n + 1, coalesce(max(stop), 1) FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id, n),
kept AS (SELECT doc_id, unhex(string_agg(hex(CASE WHEN c.first < c.stop THEN b[c.first:c.stop - 1] ELSE ''::BLOB END), '' ORDER BY c.first)) AS b
  FROM c JOIN d USING (doc_id) GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n_spans, sum(stop - first) AS n_removed FROM s GROUP BY 1)
SELECT doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(kept.b) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN r USING (doc_id)
"""


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def _licenses() -> str:
    sets = [sorted(set(text.split())) for _, text in TEMPLATES]
    words = [(i, w) for i, s in enumerate(sets) for w in s]
    sizes = [(i, TEMPLATES[i][0], len(s), needed(len(s), THRESHOLD)) for i, s in enumerate(sets)]
    phrases = [(label, *(p.split() + [""] * 3)[:3], len(p.split())) for p, label in PHRASES.items()]
    return rf"""
WITH tw(template, word) AS (VALUES {_rows(words)}), tn(template, label, n, need) AS (VALUES {_rows(sizes)}),
ph(label, a, b, c, n) AS (VALUES {_rows(phrases)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos, len(ws) AS n FROM d),
f AS (SELECT doc_id, pos, word, lead(word, 1, '') OVER o AS second, lead(word, 2, '') OVER o AS third
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT doc_id, label, pos FROM f JOIN ph ON word = a AND second = b AND (ph.n = 2 OR third = c)),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM p GROUP BY 1),
near AS (SELECT doc_id, word, n, pos, unnest([pos // {STRIDE} - 1, pos // {STRIDE}]) AS block FROM w SEMI JOIN tw USING (word)),
held AS (SELECT DISTINCT doc_id, block, word FROM near
  WHERE block >= 0 AND block * {STRIDE} <= greatest(n - {STRIDE} - 1, 0) AND pos < block * {STRIDE} + {BLOCK}),
hit AS (SELECT doc_id, label, found / n AS containment FROM (
    SELECT doc_id, block, template, count(*) AS found FROM held JOIN tw USING (word) GROUP BY ALL) JOIN tn USING (template) WHERE found >= need),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM hit UNION ALL SELECT doc_id, label FROM p) GROUP BY 1),
s AS (SELECT doc_id, max(containment) AS score FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""


LICENSES = _licenses()

# the CRC of each run, a byte at a time; near words share a half, as near lines do
SPELLINGS = rf"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_concat([b], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY b) AS k
  FROM (SELECT range AS b FROM range(256))),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
  FROM o WHERE length(run) >= 6 GROUP BY 1, 2),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2),
    lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))), lambda a, y: xor(a >> 8, k[xor(a & 255, y) + 1])), 4294967295) AS h FROM r, crc_table),
c AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
v AS MATERIALIZED {halves("w", "word", "word, n")},
near AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n
    FROM v a JOIN v b ON a.half = b.half AND a.m = b.m AND a.word <> b.word) WHERE {one_edit("word", "other")}),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
    CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""


def xxh64(name: str, source: str) -> str:
    """CTEs that end in ``name`` (``id, h``): XXH64 of hexadecimal ``x`` under ``seed``, in 128-bit numbers cut to 64 bits."""
    # The five primes of XXH64.
    primes = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in primes)
    whole = (1 << 64) - 1
    cut = lambda x: f"(({x}) & {whole}::UHUGEINT)"
    times = lambda x, y: cut(f"({x}) * {y}")
    turned = lambda x, r: f"(({x}) * {1 << r}::UHUGEINT % {whole}::UHUGEINT)"
    mixed = lambda acc, lane: times(turned(cut(f"{acc} + {times(lane, p2)}"), 31), p1)
    number = lambda at, n: " + ".join(f"b[{at} + {j + 1}] * {1 << 8 * j}::UHUGEINT" for j in range(n))
    starts = (f"seed + {p1} + {p2}", f"seed + {p2}", "seed", f"seed + {(1 << 64) - primes[0]}::UHUGEINT")
    lanes = ", ".join(
        f"list_reduce(list_concat([{cut(v)}], lanes[{j + 1}:4 * (n // 32):4]), lambda a, k: {mixed('a', 'k')}) AS v{j}"
        for j, v in enumerate(starts)
    )
    joined = cut(" + ".join(turned(f"v{j}", r) for j, r in enumerate((1, 7, 12, 18))))
    for j in range(4):
        joined = cut(f"{times(f'xor({joined}, {mixed('0::UHUGEINT', f'v{j}')})', p1)} + {p4}")
    eights = cut(f"{times(turned(f'xor(h, {mixed("0::UHUGEINT", "k")})', 27), p1)} + {p4}")
    four = cut(f"{times(turned(f'xor(h, {times(number("8 * (n // 8)", 4), p1)})', 23), p2)} + {p3}")
    ones = times(turned(f"xor(h, {times('k', p5)})", 11), p1)
    return f"""
{name}_b AS (SELECT id, CAST(seed AS UHUGEINT) AS seed, length(x) // 2 AS n,
  list_transform(regexp_extract_all(x, '..'), lambda y: CAST('0x' || y AS UHUGEINT)) AS b FROM ({source})),
{name}_l AS (SELECT *, list_transform(range(0, n // 8), lambda i: {number("8 * i", 8)}) AS lanes FROM {name}_b),
{name}_v AS (SELECT *, {lanes} FROM {name}_l),
{name}_0 AS (SELECT id, n, b, lanes, CASE WHEN n >= 32 THEN {joined} ELSE seed + {p5} END + n::UHUGEINT AS h FROM {name}_v),
{name}_1 AS (SELECT id, n, b, list_reduce(list_concat([{cut("h")}], lanes[4 * (n // 32) + 1:]), lambda h, k: {eights}) AS h FROM {name}_0),
{name}_2 AS (SELECT id, n, b, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM {name}_1),
{name}_3 AS (SELECT id, list_reduce(list_concat([h], b[n - n % 4 + 1:]), lambda h, k: {ones}) AS h FROM {name}_2),
{name}_4 AS (SELECT id, {times("xor(h, h >> 33)", p2)} AS h FROM {name}_3),
{name}_5 AS (SELECT id, {times("xor(h, h >> 29)", p3)} AS h FROM {name}_4),
{name} AS MATERIALIZED (SELECT id, CAST(xor(h, h >> 32) AS UBIGINT) AS h FROM {name}_5)"""


# bits of shingle hashes by majority; pairs of fingerprints, and what is reachable
SIMHASH = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k, len(ws) AS n FROM d),
g AS (SELECT doc_id, n, k, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS shingle FROM w),
s AS MATERIALIZED (SELECT doc_id, shingle, count(*) AS times FROM g WHERE k <= greatest(n - 2, 1) GROUP BY 1, 2),
{xxh64("hashed", "SELECT shingle AS id, hex(encode(shingle)) AS x, 42 AS seed FROM (SELECT DISTINCT shingle FROM s)")},
bit(mask) AS (VALUES {", ".join(f"({1 << i}::UBIGINT)" for i in range(64))}),
votes AS (SELECT doc_id, mask FROM s JOIN hashed ON id = shingle, bit
  GROUP BY 1, 2 HAVING 2 * sum(CASE WHEN h & mask > 0 THEN times ELSE 0 END) > sum(times)),
f AS MATERIALIZED (SELECT d.doc_id, coalesce(bit_or(mask), 0::UBIGINT) AS fp FROM d LEFT JOIN votes USING (doc_id) GROUP BY 1),
m AS MATERIALIZED (SELECT fp, min(doc_id) AS first FROM f GROUP BY 1),
e AS MATERIALIZED (SELECT a.fp, b.fp AS other FROM m a, m b WHERE a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 3),
r AS (SELECT fp, fp AS other FROM m UNION SELECT r.fp, e.other FROM r JOIN e ON e.fp = r.other),
c AS (SELECT r.fp, min(m.first) AS component_id FROM r JOIN m ON m.fp = r.other GROUP BY 1)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM f JOIN c USING (fp)
"""

# a source's words in hashed order, gone round until its target is taken; sources that stop early are found one a step
MIXING = rf"""
WITH RECURSIVE {xxh64("h1", "SELECT 0 AS id, hex(encode('mix')) AS x, 42 AS seed")},
{xxh64("h2", """SELECT doc_id AS id, array_to_string(list_transform(range(15, 0, -2), lambda i: y[i:i + 1]), '') AS x, h AS seed
  FROM (SELECT doc_id, lpad(to_hex(doc_id), 16, '0') AS y FROM documents WHERE doc_id IS NOT NULL), h1""")},
{xxh64("h3", "SELECT doc_id AS id, hex(encode(text)) AS x, h AS seed FROM documents JOIN h2 ON id = doc_id WHERE text IS NOT NULL")},
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size, coalesce(h3.h, h2.h) AS place
  FROM documents LEFT JOIN h2 ON h2.id = doc_id LEFT JOIN h3 ON h3.id = doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS nth FROM d GROUP BY 1),
w AS MATERIALIZED (SELECT source, source_size, [5, 2, 1][nth + 1] AS weight FROM s),
step AS (SELECT 0 AS k, CAST(NULL AS DOUBLE) AS before, CAST((SELECT sum(source_size) FROM w) AS BIGINT) / (SELECT sum(weight) FROM w) AS level
  UNION ALL
  SELECT k + 1, level, (SELECT CAST(sum(source_size) - coalesce(sum(3 * source_size) FILTER (3 * source_size <= weight * step.level), 0) AS BIGINT)
    / nullif(coalesce(sum(weight) FILTER (3 * source_size > weight * step.level), 0), 0) FROM w)
  FROM step WHERE level IS DISTINCT FROM before AND level IS NOT NULL),
t AS (SELECT w.*, CASE WHEN 3 * source_size > weight * l THEN weight * l ELSE CAST(3 * source_size AS DOUBLE) END AS target
  FROM w, (SELECT max(level) AS l FROM step)),
o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE
    CAST(round(target) AS BIGINT) // source_size * size + least(greatest(CAST(round(target) AS BIGINT) % source_size - start, 0), size) END AS BIGINT) AS taken
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
"""
