"""SQL of queries whose text is put together level by level or shared."""

from __future__ import annotations

import string

#: Levels of the trees in ``manifest_sql``, each of 16 children a node.
LEVELS = 6

# Remainders of the reversed CRC-32 polynomial for each byte, as one list ``t``.
_CRC_TABLE = """crc AS (
        SELECT list(list_reduce(list_prepend(b, range(8)),
            lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS t
        FROM (SELECT unnest(range(256)) AS b)
    )"""


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 of a text; ``t`` of the table above must be in scope."""
    data = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    step = "xor(a >> 8, t[(xor(a, b) & 255) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda a, b: {step}))"


def lower_sql(text: str) -> str:
    return f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def decontamination_sql(width: int = 10) -> str:
    words = f"regexp_extract_all({lower_sql('coalesce(text, $$$$)')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
    win AS (
        SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t
        FROM (SELECT item, w, least(len(w), {width}) AS n, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i
              FROM b WHERE len(w) > 0)
    ), place AS (
        SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))
    ), hit AS (SELECT r, i, n, item FROM place JOIN win USING (n, t)),
    hits AS (
        SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
    ), items AS (
        SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
    """


def manifest_sql(fan: int = 16) -> str:
    def value(x: str) -> str:
        return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(value(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    changed = f"CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN {lower_sql('text')} ELSE text END"
    steps, folds = [], []
    for name, first in (("s", "leaf"), ("u", "subroot")):
        steps.append(f"{name}0 AS (SELECT tree, place, size, digest, NULL::VARCHAR[] AS kids FROM {first})")
        for k in range(LEVELS):
            steps.append(f"""{name}{k + 1} AS (
        SELECT tree, place // {fan} AS place, size, sha256(string_agg(digest, '' ORDER BY place)) AS digest,
            list(digest ORDER BY place) AS kids
        FROM {name}{k} WHERE size > {fan**k} GROUP BY tree, place // {fan}, size)""")
        tops = " UNION ALL ".join(
            f"SELECT tree, digest FROM {name}{k} WHERE size <= {fan**k}" for k in range(LEVELS + 1))
        if name == "s":
            steps.append(f"top AS ({tops})")
            steps.append("subroot AS (SELECT 0 AS tree, tree AS place, count(*) OVER () AS size, digest FROM top)")
        else:
            steps.append(f"whole AS ({tops})")
    last = "f0"
    steps.append("f0 AS (SELECT *, altered AS f, '' AS proof FROM leaf)")
    for name, tree, place in (("s", "tree", "place"), ("u", "0", "tree")):
        for k in range(LEVELS):
            now = f"f{len(folds) + 1}"
            at = f"(x.{place} // {fan**k}) % {fan}"
            before, after = f"array_to_string(kids[1:{at}], '')", f"array_to_string(kids[{at} + 2:], '')"
            up = "x.tree" if name == "s" else "0"
            steps.append(f"""{now} AS (
        SELECT x.* REPLACE (CASE WHEN kids IS NULL THEN f ELSE sha256({before} || f || {after}) END AS f,
            CASE WHEN kids IS NULL THEN proof ELSE proof || {before} || {after} END AS proof)
        FROM {last} x LEFT JOIN {name}{k + 1} r ON r.tree = {up} AND r.place = x.{place} // {fan ** (k + 1)})""")
            folds.append(now)
            last = now
    return f"""
    WITH {_CRC_TABLE}, hashed AS (
        SELECT doc_id, source, {leaf('text')} AS digest, {leaf(f'({changed})')} AS altered FROM documents, crc
    ), leaf AS (
        SELECT doc_id, digest, altered, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS place,
            count(*) OVER (PARTITION BY source) AS size
        FROM hashed
    ), {', '.join(steps)}
    SELECT doc_id, x.digest AS leaf, top.digest AS subroot, whole.digest AS root, sha256(proof) AS proof_sha256,
        f AS folded_root, f = whole.digest AS verified
    FROM {last} x JOIN top ON top.tree = x.tree CROSS JOIN whole
    """


def spelling_sql() -> str:
    run = lower_sql("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")
    return f"""
    WITH RECURSIVE {_CRC_TABLE}, runs AS (
        SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, {run} AS run FROM documents) GROUP BY ALL
    ), hashed AS (
        SELECT run, times, {crc32_sql('key')} AS h
        FROM (SELECT run, times, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM runs), crc
    ), words AS (
        SELECT word, sum(times)::BIGINT AS n
        FROM (SELECT times, CASE WHEN h % 97 = 0
                THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
        WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
    ), skips AS (
        SELECT word, i, substr(word, 1, i) || '?' || substr(word, i + 2) AS mask,
            substr(word, 1, i) || substr(word, i + 2) AS rest
        FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)
    ), near AS (
        SELECT a.word, b.word AS other FROM skips a JOIN skips b ON a.mask = b.mask AND a.word <> b.word
        UNION SELECT a.word, b.word FROM skips a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word FROM skips a JOIN words b ON a.rest = b.word
    ), best AS (
        SELECT near.word, count(*) AS n_near, first(other ORDER BY w.n DESC, other) AS best, max(w.n) AS best_n
        FROM near JOIN words w ON w.word = other GROUP BY near.word
    ), forms AS (
        SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form,
            CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
        FROM words LEFT JOIN best USING (word)
    ), follow AS (
        SELECT word, word AS tip FROM forms
        UNION ALL SELECT follow.word, form AS tip FROM follow JOIN forms ON forms.word = tip WHERE form IS NOT NULL
    )
    SELECT f.word, f.form, tip AS root, f.n, f.n_near, f.form_n
    FROM forms f JOIN follow USING (word) JOIN forms e ON e.word = tip AND e.form IS NULL
    """
