"""SQL of the linker: every project against every profile of its states, with the spelling ratio worked out by
recursion (longest block, then what stands left and right of it)."""

from __future__ import annotations

from headway.operators.linkage import AHEAD, CLOSE, FILLER

_filler = ", ".join(f"'{w}'" for w in FILLER)


def key_of(name: str) -> str:
    """The canonical name key of an SQL text."""
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce({name}, '')), '&', ' and '), "
            r"'\([^)]*\)', ' ', 'g'), '\bbus rapid transit\b', 'brt', 'g'), '[^a-z0-9]+', ' ', 'g'), "
            r"'\b(the|project|program)\b', ' ', 'g'), '\s+', ' ', 'g'))")


def _own(key: str) -> str:
    return f"list_distinct(list_filter(string_split({key}, ' '), lambda w: w <> '' AND w NOT IN ({_filler})))"


def _block(a: str, b: str) -> str:
    """1000 * length + 999 - start of the longest text both hold, the earliest in ``a``; names are shorter than that."""
    return (f"list_max(flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform(range(1, length({a}) - i + 2), "
            f"lambda n: CASE WHEN contains({b}, substr({a}, i, n)) THEN 1000 * n + 999 - i END))))")


def judged(projects: str, profiles: str) -> str:
    """WITH entries up to ``judged``: (name, state, profile_id, same, inside, ratio) of all pairs that share a state.

    ``projects`` selects (name, state), ``profiles`` (profile_id, key, states). A ratio is NULL where it is below CLOSE - AHEAD.
    """
    floor = CLOSE - AHEAD
    return f"""RECURSIVE pj AS (SELECT *, {_own('key')} AS ws, list_filter(string_split(coalesce(state, ''), '-'), lambda s: s <> '') AS st
    FROM (SELECT DISTINCT name, state, {key_of('name')} AS key FROM ({projects}))),
pf AS (SELECT profile_id, key AS fkey, coalesce(states, []) AS fst, {_own('key')} AS fws FROM ({profiles})),
met AS MATERIALIZED (SELECT name, state, key, profile_id, fkey, key = fkey AS same,
    len(ws) > 0 AND len(fws) > 0 AND (list_has_all(fws, ws) OR list_has_all(ws, fws)) AS inside
    FROM pj JOIN pf ON len(fst) = 0 OR list_has_any(st, fst)),
near AS MATERIALIZED (SELECT DISTINCT key, fkey FROM met WHERE levenshtein(key, fkey) <= (1 - {floor}) * (length(key) + length(fkey)) + 1e-6),
walk AS (SELECT key, fkey, key AS a, fkey AS b, {_block('key', 'fkey')} AS v FROM near
    UNION ALL SELECT key, fkey, x, y, {_block('x', 'y')} FROM (SELECT key, fkey, unnest([substr(a, 1, i - 1), substr(a, i + n)]) AS x,
            unnest([substr(b, 1, instr(b, substr(a, i, n)) - 1), substr(b, instr(b, substr(a, i, n)) + n)]) AS y
        FROM (SELECT key, fkey, a, b, v // 1000 AS n, 999 - v % 1000 AS i FROM walk WHERE v IS NOT NULL)) WHERE x <> '' AND y <> ''),
ratios AS (SELECT key, fkey, 2.0::DOUBLE * coalesce(sum(v // 1000), 0) / (length(key) + length(fkey)) AS ratio FROM walk GROUP BY key, fkey),
judged AS MATERIALIZED (SELECT name, state, met.key, profile_id, same, inside, ratio FROM met LEFT JOIN ratios ON ratios.key = met.key AND ratios.fkey = met.fkey)"""


def links(projects: str, profiles: str) -> str:
    """WITH entries up to ``links``: (name, state, key, profile_id, tier) of every project."""
    return judged(projects, profiles) + f""",
tiers AS (SELECT name, state, min(profile_id) FILTER (WHERE same) AS exact_id,
    CASE WHEN count(*) FILTER (WHERE inside) = 1 THEN min(profile_id) FILTER (WHERE inside) END AS only_id FROM judged GROUP BY name, state),
places AS (SELECT name, state, profile_id, ratio, lead(ratio) OVER (PARTITION BY name, state ORDER BY ratio DESC NULLS LAST, profile_id) AS second,
    row_number() OVER (PARTITION BY name, state ORDER BY ratio DESC NULLS LAST, profile_id) AS place FROM judged),
links AS (SELECT p.name, p.state, p.key, coalesce(exact_id, only_id, c.profile_id) AS profile_id,
    CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN only_id IS NOT NULL THEN 'contained' WHEN c.profile_id IS NOT NULL THEN 'close' ELSE 'none' END AS tier
    FROM pj p LEFT JOIN tiers t ON t.name IS NOT DISTINCT FROM p.name AND t.state IS NOT DISTINCT FROM p.state
    LEFT JOIN places c ON c.name IS NOT DISTINCT FROM p.name AND c.state IS NOT DISTINCT FROM p.state AND place = 1 AND ratio >= {CLOSE}
        AND (second IS NULL OR ratio - second >= {AHEAD}))"""
