"""DuckDB common table expressions that several statements share: compatibility form, LCS ratios, components."""

from __future__ import annotations

import unicodedata

from .functions.text import normalised_sql

#: Python's white space, for word splitting.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def lowered(e: str) -> str:
    """Lower case with the final sigma that Java writes."""
    return f"lower(regexp_replace({e}, '(\\p{{L}})Σ($|[^\\p{{L}}])', '\\1ς\\2', 'g'))"


def _compatible() -> str:
    """Characters whose compatibility form is not their composed one, with that form, by rule."""
    chars = (chr(i) for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000)
    return ", ".join(f"('{c}', '{k.replace(chr(39), chr(39) * 2)}')" for c in chars if (k := unicodedata.normalize("NFKC", c)) != unicodedata.normalize("NFC", c))


def composed(p: str, source: str) -> tuple[str, ...]:
    """{p}(x, n): the distinct non-null x of `source` (a select of x) with their normalised form n."""
    return (
        f"{p}c AS (SELECT DISTINCT x FROM ({source}) WHERE x IS NOT NULL)",
        f"{p}u AS (SELECT x, unnest(range(1, length(x) + 1)) AS i FROM {p}c)",
        f"{p}m(c, t) AS (VALUES {_compatible()})",
        f"{p}k AS (SELECT x, nfc_normalize(coalesce(string_agg(coalesce(t, substr(x, i, 1)), '' ORDER BY i), '')) AS k FROM {p}c LEFT JOIN {p}u USING (x) LEFT JOIN {p}m ON c = substr(x, i, 1) GROUP BY x)",
        f"{p} AS (SELECT x, {normalised_sql('k')} AS n FROM {p}k)",
    )


def ratios(p: str, source: str) -> tuple[str, ...]:
    """{p}(a, b, sorted, in_set): the ratios of the distinct pairs of texts a, b of `source` (a select of a, b, not null).

    The longest common subsequence is filled row by row: step i of the recursion holds row i of the table.
    """
    words = lambda e: f"list_filter(regexp_split_to_array({e}, '{SPACE}'), lambda w: w <> '')"
    joined = lambda e: f"array_to_string(list_sort({e}), ' ')"
    r = lambda x, y, lcs: f"CASE WHEN length({x}) + length({y}) = 0 THEN 100.0 ELSE 200.0 * {lcs} / (length({x}) + length({y})) END::DOUBLE"
    return (
        f"{p}p AS (SELECT DISTINCT a, b, {words('a')} AS wa, {words('b')} AS wb FROM ({source}))",
        f"{p}s AS (SELECT a, b, {joined('wa')} AS sa, {joined('wb')} AS sb, {joined('list_distinct(list_intersect(wa, wb))')} AS i, {joined('list_distinct(list_filter(wa, lambda w: NOT list_contains(wb, w)))')} AS oa, {joined('list_distinct(list_filter(wb, lambda w: NOT list_contains(wa, w)))')} AS ob FROM {p}p)",
        f"{p}t AS (SELECT *, trim(i || ' ' || oa) AS l, trim(i || ' ' || ob) AS r FROM {p}s)",
        f"{p}q AS (SELECT sa AS x, sb AS y FROM {p}t UNION SELECT l, r FROM {p}t)",
        f"{p}r(x, y, n, row) AS (SELECT x, y, 0, [0 for k in range(length(y))] FROM {p}q UNION ALL SELECT x, y, n + 1, [list_max(t[1:j]) for j in range(1, len(t) + 1)] FROM (SELECT x, y, n, [greatest(row[j], CASE WHEN substr(x, n + 1, 1) = substr(y, j, 1) THEN coalesce(row[j - 1], 0) + 1 ELSE 0 END) for j in range(1, length(y) + 1)] AS t FROM {p}r WHERE n < length(x)))",
        f"{p}l AS (SELECT x, y, coalesce(row[length(y)], 0) AS lcs FROM {p}r WHERE n = length(x))",
        f"""{p} AS (SELECT a, b, {r('sa', 'sb', 'g.lcs')} AS sorted, CASE WHEN sa = '' OR sb = '' THEN 0.0 WHEN i <> '' AND (oa = '' OR ob = '') THEN 100.0 WHEN i = '' THEN {r('l', 'r', 'h.lcs')}
  ELSE greatest({r('l', 'r', 'h.lcs')}, {r('i', 'l', 'length(i)')}, {r('i', 'r', 'length(i)')}) END::DOUBLE AS in_set FROM {p}t JOIN {p}l g ON g.x = sa AND g.y = sb JOIN {p}l h ON h.x = l AND h.y = r)""",
    )


def components(p: str, edges: str) -> tuple[str, ...]:
    """{p}(x, root) of the nodes of `edges` (a select of a, b)."""
    return (
        f"{p}e AS (SELECT a AS x, b AS y FROM ({edges}) UNION SELECT b, a FROM ({edges}))",
        f"{p}(x, root) USING KEY (x) AS (SELECT x, min(x) FROM {p}e GROUP BY x UNION SELECT e.y, min(s.root) FROM {p} s JOIN {p}e e ON e.x = s.x JOIN recurring.{p} AS c ON c.x = e.y WHERE s.root < c.root GROUP BY e.y)",
    )


def classes(p: str, edges: str) -> tuple[str, ...]:
    """{p}g(id, root): members of the classes {p}v (id, cls) that are linked by `edges` of classes, or hold several members."""
    return (*components(f"{p}o", edges), f"{p}g AS (SELECT id, min(id) OVER (PARTITION BY coalesce(o.root, cls)) AS root FROM {p}v LEFT JOIN {p}o o ON o.x = cls QUALIFY count(*) OVER (PARTITION BY coalesce(o.root, cls)) > 1)")


def similar_tags(p: str, source: str) -> tuple[str, ...]:
    """{p}g(id, root): tracks of `source` with nearly equal title, artist and length."""
    return (
        *composed(f"{p}n", f"SELECT title AS x FROM {source} UNION SELECT coalesce(nullif(artist, ''), albumartist) FROM {source}"),
        f"{p}w AS (SELECT id, coalesce(y.n, '') AS t, coalesce(z.n, '') AS a, duration AS d FROM {source} s LEFT JOIN {p}n y ON y.x = title LEFT JOIN {p}n z ON z.x = coalesce(nullif(artist, ''), albumartist) WHERE coalesce(y.n, '') <> '' AND duration > 0)",
        f"{p}v AS (SELECT *, min(id) OVER (PARTITION BY t, a, d) AS cls FROM {p}w)",
        f"{p}h AS (SELECT id, t, a, d, array_to_string(string_split(t, ' ')[1:3], ' ') || '|' || substr(a, 1, 24) AS h FROM {p}v WHERE id = cls)",
        f"{p}j AS (SELECT x.id AS i, y.id AS k, x.t AS tx, y.t AS ty, x.a AS ax, y.a AS ay FROM {p}h x JOIN {p}h y ON x.h = y.h AND x.id < y.id AND abs(x.d - y.d) <= 7)",
        *ratios(f"{p}f", f"SELECT tx AS a, ty AS b FROM {p}j UNION SELECT ax, ay FROM {p}j"),
        *classes(p, f"SELECT i AS a, k AS b FROM {p}j JOIN {p}f y ON y.a = tx AND y.b = ty JOIN {p}f z ON z.a = ax AND z.b = ay WHERE y.sorted >= 88 AND z.in_set >= 80"),
    )


def agreement(a: str, b: str, shift: int = 60) -> str:
    """The largest share of equal bits of two word lists over all offsets that overlap in ten words."""
    at = lambda k, n, x, y: f"CASE WHEN {n} >= 10 THEN 1 - CAST(list_sum([bit_count(xor({x}, {y})) for i in range(1, {n} + 1)]) AS DOUBLE) / ({n} * 32) END"
    right = at("k", f"least(len({a}) - k, len({b}))", f"{a}[i + k]", f"{b}[i]")
    left = at("k", f"least(len({a}), len({b}) - k)", f"{a}[i]", f"{b}[i + k]")
    return f"greatest(0.0, coalesce(list_max([{right} for k in range(0, {shift + 1})]), 0), coalesce(list_max([{left} for k in range(1, {shift + 1})]), 0))"


def similar_sound(p: str, source: str, words: str) -> tuple[str, ...]:
    """{p}g(id, root): tracks of `source` whose fingerprints (`words`: id, words) agree and whose lengths are near."""
    return (
        f"{p}v AS (SELECT id, min(id) OVER (PARTITION BY fingerprint, duration) AS cls, duration AS d FROM {source} WHERE fingerprint IS NOT NULL AND duration > 0)",
        f"{p}c AS (SELECT id, d, words FROM {p}v JOIN {words} USING (id) WHERE id = cls AND len(words) >= 2)",
        f"{p}b AS (SELECT id, d, words, b, b * greatest(1, len(words) // 6) AS o FROM {p}c, range(6) z(b) WHERE b * greatest(1, len(words) // 6) + 2 <= len(words))",
        f"{p}j AS (SELECT DISTINCT x.id AS i, y.id AS k FROM {p}b x JOIN {p}b y ON x.b = y.b AND x.words[x.o + 1] >> 24 = y.words[y.o + 1] >> 24 AND x.words[x.o + 2] >> 24 = y.words[y.o + 2] >> 24 AND x.id < y.id AND abs(x.d - y.d) <= 7)",
        f"{p}x AS (SELECT i, k, {agreement('v.words', 'w.words')} AS s FROM {p}j JOIN {p}c v ON v.id = i JOIN {p}c w ON w.id = k)",
        *classes(p, f"SELECT i AS a, k AS b FROM {p}x WHERE s >= 0.9"),
    )


def numbered(plan: str) -> tuple[str, ...]:
    """nu(id, path, target, changed): `plan` (a select of id, path, target) with targets unique, claimed in order of id within a base name."""
    base = lambda e: lowered(f"regexp_replace({e}, '(?: \\(\\d+\\))+(\\.[^./]*)$', '\\1')")
    name = "CASE WHEN k = 1 THEN target ELSE regexp_replace(target, '^(.*)(\\.[^.]*)$', '\\1 (' || k || ')\\2') END"
    low = lowered(name)
    free = f"list_filter(range(1, 100), lambda k: NOT list_contains(taken, {low}) AND (NOT list_contains(files, {low}) OR {low} = {lowered('path')}))[1]"
    return (
        f"np AS (SELECT *, {base('target')} AS base FROM ({plan}))",
        f"nf AS (SELECT DISTINCT {base('path')} AS base, {lowered('path')} AS file FROM np WHERE path IS NOT NULL)",
        f"nr AS (SELECT base FROM np GROUP BY 1 HAVING count(*) > 1 UNION SELECT base FROM np WHERE {lowered('path')} IS DISTINCT FROM {lowered('target')} AND base IN (SELECT base FROM nf))",
        f"ns AS (SELECT *, row_number() OVER (PARTITION BY {lowered('target')} ORDER BY id) AS r FROM np WHERE base IN (SELECT base FROM nr))",
        "nl AS (SELECT base, list(file) AS files FROM nf GROUP BY 1)",
        "no AS (SELECT ns.*, coalesce(files, []) AS files, row_number() OVER (PARTITION BY ns.base ORDER BY id) AS n FROM ns LEFT JOIN nl USING (base) WHERE r < 100)",
        f"nc(base, n, id, path, target, taken) AS (SELECT DISTINCT base, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[] FROM no UNION ALL SELECT base, n, id, path, got, list_append(taken, {lowered('got')}) FROM (SELECT base, n, id, path, taken, CASE WHEN k IS NULL THEN path ELSE {name} END AS got FROM (SELECT o.base, o.n, o.id, o.path, o.target, c.taken, {free.replace('taken', 'c.taken').replace('files', 'o.files').replace('target', 'o.target').replace('path', 'o.path')} AS k FROM nc c JOIN no o ON o.base = c.base AND o.n = c.n + 1)))",
        f"nu AS (SELECT id, path, target, {lowered('target')} <> {lowered('path')} AS changed FROM (SELECT id, path, target FROM np WHERE base NOT IN (SELECT base FROM nr) UNION ALL SELECT id, path, path FROM ns WHERE r >= 100 UNION ALL SELECT id, path, target FROM nc WHERE n > 0))",
    )


def admitted(calls: int, seconds: float) -> tuple[str, ...]:
    """ad(event_id, user_id, admitted): events in order of time within each user, at most `calls` in any `seconds`."""
    return (
        "ao AS (SELECT *, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)",
        f"ad(user_id, n, event_id, hits, admitted) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, []::DOUBLE[], NULL::BOOLEAN FROM ao UNION ALL SELECT user_id, n, event_id, CASE WHEN len(h) < {calls} THEN list_append(h, t) ELSE h END, len(h) < {calls} FROM (SELECT o.user_id, o.n, o.event_id, o.t, list_filter(a.hits, lambda x: x > o.t - {seconds}) AS h FROM ad a JOIN ao o ON o.user_id = a.user_id AND o.n = a.n + 1))",
    )
