"""DuckDB SQL of the corpus queries that SQL can express, whole tables and whole texts."""

from __future__ import annotations

from langloom.llm.hilbert import BITS, SHARDS
from langloom.llm.secrets import BASE, RULES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"


def either_case(pattern: str) -> str:
    """The pattern with its ASCII letters in either case, outside of classes; RE2's own flag knows letters beyond ASCII."""
    if not pattern.startswith("(?i)"):
        return pattern
    out, depth, escaped = "", 0, 0
    for c in pattern[4:]:
        if escaped or depth or c == "\\":
            out += c
        else:
            out += f"[{c.lower()}{c.upper()}]" if c.isalpha() else c
        escaped = 3 if c == "\\" else max(0, escaped - 1)  # \x20 is the only escape here
        depth += (c == "[") - (c == "]") if not escaped else 0
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets() -> str:
    """A match is where its string is first found after the match before it, as all before has no match."""
    parts = []
    for order, rule in enumerate(RULES):
        p = quoted(either_case(rule.pattern))
        parts.append(
            f"SELECT rid, {order} AS o, '{rule.kind}' AS kind, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {rule.group}) AS g, {rule.least} AS least, t FROM d"
        )
    base = "(" + ", ".join(quoted(k) for k in BASE) + ")"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    line = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o)"
    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    r AS ({" UNION ALL ".join(parts)}),
    walk AS (
        SELECT rid, o, kind, m, g, least, t, 0 AS k, 0::BIGINT AS s, 0::BIGINT AS e FROM r WHERE len(m) > 0
        UNION ALL
        SELECT rid, o, kind, m, g, least, t, k + 1, e + instr(substr(t, e + 1), m[k + 1]) - 1, e + instr(substr(t, e + 1), m[k + 1]) - 1 + length(m[k + 1]) FROM walk WHERE k < len(m)),
    spans AS (SELECT rid, o, kind, s, e FROM walk WHERE k > 0 AND length(g[k]) >= least),
    told AS (SELECT rid, {counts}, {line} FILTER (kind IN {base}) AS base, {line} AS spans FROM spans GROUP BY rid)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN told USING (rid)"""


def hilbert() -> str:
    """The curve's index by undoing the turns of each level, then the Gray code; axes are x0, x1, x2."""
    steps, last = [], "cell"
    for q in (1 << b for b in range(BITS - 1, 0, -1)):
        for i in range(3):
            p, own = q - 1, f"x{i}"
            swap = f"xor(x0, {own}) & {p}"
            first = f"CASE WHEN {own} & {q} <> 0 THEN xor(x0, {p}) ELSE xor(x0, {swap}) END AS x0"
            other = "" if i == 0 else f", CASE WHEN {own} & {q} <> 0 THEN {own} ELSE xor({own}, {swap}) END AS {own}"
            name = f"u{q}_{i}"
            steps.append(f"{name} AS (SELECT * REPLACE ({first}{other}) FROM {last})")
            last = name
    steps.append(f"g1 AS (SELECT * REPLACE (xor(x1, x0) AS x1) FROM {last})")
    steps.append("g2 AS (SELECT * REPLACE (xor(x2, x1) AS x2) FROM g1)")
    turn = "0"
    for q in (1 << b for b in range(BITS - 1, 0, -1)):
        turn = f"xor({turn}, CASE WHEN x2 & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    steps.append(f"g3 AS (SELECT *, {turn} AS turn FROM g2)")
    bits = " + ".join(f"((xor(x{i}, turn) >> {b}) & 1) * {1 << (3 * b + 2 - i)}" for b in range(BITS) for i in range(3))
    table = "[" + ", ".join(str(_crc_entry(i)) for i in range(256)) + "]"
    crc = f"xor(list_reduce([{2**32 - 1}::BIGINT] || list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, b: xor(a >> 8, ({table}::BIGINT[])[(xor(a, b) & 255) + 1])), {2**32 - 1})"
    category = lambda c: f"CASE WHEN {c} IS NULL THEN 0 ELSE ('0x' || substr(md5({c}), 1, 4))::INT % {1 << BITS} END"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    cell AS (SELECT rid, doc_id, strlen(t)::BIGINT + 1 AS size, {crc} AS text_crc32, sha256(t) AS digest, {category("lang")} AS x0, {category("source")} AS x1, least({(1 << BITS) - 1}, length(bin(strlen(t) + 1))) AS x2 FROM d),
    {", ".join(steps)},
    placed AS (SELECT rid, doc_id, size, text_crc32, digest, ({bits})::BIGINT AS own FROM g3),
    grouped AS (SELECT *, min(own) OVER (PARTITION BY digest) AS curve, count(*) OVER (PARTITION BY digest) AS copies FROM placed),
    ranked AS (SELECT *, row_number() OVER (ORDER BY curve, copies DESC, text_crc32, size, digest, doc_id NULLS FIRST) - 1 AS k, count(*) OVER () // {SHARDS} AS small, count(*) OVER () % {SHARDS} AS more FROM grouped),
    cut AS (SELECT *, CASE WHEN k < more * (small + 1) THEN k // (small + 1) ELSE more + (k - more * (small + 1)) // greatest(small, 1) END AS shard FROM ranked)
    SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (k - shard * small - least(shard, more))::BIGINT AS slot, NULL::INT AS grown_shard, curve FROM cut"""


def _crc_entry(i: int) -> int:
    """The table of CRC-32, by its polynomial."""
    for _ in range(8):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i


SUBSTRING = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
    win AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 49], ' ') AS key FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i) WHERE doc_id IS NOT NULL),
    low AS (SELECT key, min(doc_id) AS low FROM win GROUP BY key HAVING min(doc_id) < max(doc_id)),
    gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM win JOIN low USING (key) WHERE low < doc_id),
    word AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
    kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
    item AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS key FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
    size AS (SELECT DISTINCT n FROM item),
    win AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS key FROM d, size, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
    hit AS (SELECT DISTINCT rid, i, n, item_id FROM win JOIN item USING (n, key)),
    words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
    names AS (SELECT rid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT rid, item_id::VARCHAR AS name FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (rid) LEFT JOIN names USING (rid)"""

COUNTERS = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
    win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS key FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i)),
    many AS (SELECT rid, key FROM win GROUP BY rid, key HAVING count(*) > 1),
    hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM win SEMI JOIN many USING (rid, key)) GROUP BY rid),
    line AS (SELECT rid, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{SPACED}') GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
    FROM d LEFT JOIN hit USING (rid) LEFT JOIN line USING (rid)"""

ORACLE_SQL = {"op3_secret_scan": secrets(), "op5_hilbert_shards": hilbert(), "op7_substring_dedup": SUBSTRING, "op9_decontamination": DECONTAMINATION, "base_quality_counters": COUNTERS}
