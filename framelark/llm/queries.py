"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op10_decontaminate
from .language import op9_language_id
from .lines import op3_line_dedup
from .near import op2_near_duplicates
from .packing import op1_pack_sequences
from .pii import op5_personal_data
from .quality import op6_quality_rules
from .repeats import op11_periodic_runs
from .spelling import op13_spelling_variants
from .substrings import op7_repeated_bytes
from .tokenfiles import op4_token_files
from .toxicity import op8_toxicity
from .warc import op12_web_archives

QUERIES = {
    "op1_pack_sequences": op1_pack_sequences,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_files": op4_token_files,
    "op5_personal_data": op5_personal_data,
    "op6_quality_rules": op6_quality_rules,
    "op7_repeated_bytes": op7_repeated_bytes,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_decontaminate": op10_decontaminate,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_web_archives": op12_web_archives,
    "op13_spelling_variants": op13_spelling_variants,
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\\x20\\x09-\\x0D]+')"

# crc32 of a string, byte by byte, with the table of its 256 remainders as a list.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda c: list_reduce(list_concat([c], range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS tab)"


def _crc32(text: str) -> str:
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: (strpos('123456789ABCDEF', x[1]) * 16 + strpos('123456789ABCDEF', x[2]))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {values}), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        sh AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN list_slice(ws, 1, len(ws)) ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END AS l FROM w),
        sets AS (SELECT doc_id, list_sort(list_distinct(l)) AS l FROM sh),
        same AS (SELECT l, min(doc_id) AS r, len(l) AS n FROM sets WHERE len(l) > 0 GROUP BY l),
        e AS (SELECT r, n, unnest(l) AS s FROM same), f AS (SELECT s, count(*) AS m FROM e GROUP BY s),
        o AS (SELECT e.r, e.n, e.s, row_number() OVER (PARTITION BY e.r ORDER BY f.m, e.s) AS i FROM e JOIN f USING (s)),
        rare AS (SELECT * FROM o WHERE i <= n - ceil(0.8 * n) + 1),
        cand AS (SELECT DISTINCT a.r AS x, b.r AS y FROM rare a JOIN rare b ON a.s = b.s AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
        links AS (SELECT x, y FROM cand JOIN same a ON a.r = x JOIN same b ON b.r = y WHERE 100 * len(list_intersect(a.l, b.l)) >= 80 * (a.n + b.n - len(list_intersect(a.l, b.l)))),
        two AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT r AS x, r AS y FROM same UNION SELECT reach.x, two.y FROM reach JOIN two ON two.x = reach.y),
        comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
        SELECT doc_id, len(sets.l) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
        FROM sets LEFT JOIN same ON same.l = sets.l LEFT JOIN comp ON comp.x = same.r
    """,
    "op7_repeated_bytes": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        j AS (SELECT doc_id, h, len(h) // 2 AS n, unnest(range((len(h) + 399) // 400)) AS j FROM d),
        c AS (SELECT doc_id, n, j, substr(h, 400 * j + 1, 498) AS piece FROM j),
        p AS (SELECT doc_id, n, j, piece, unnest(range(least(200, n - 200 * j))) AS o FROM c),
        s AS (SELECT doc_id, 200 * j + o AS i, CASE WHEN 200 * j + o + 50 <= n THEN md5(substr(piece, 2 * o + 1, 100)) END AS k, substr(piece, 2 * o + 1, 2) AS byte FROM p),
        f AS (SELECT k, min(doc_id) AS low FROM s WHERE k IS NOT NULL GROUP BY k),
        m AS (SELECT s.doc_id, i, byte, coalesce(low < s.doc_id, false) AS starts FROM s LEFT JOIN f USING (k)),
        g AS (SELECT doc_id, i, byte, coalesce(max(CASE WHEN starts THEN i END) OVER (PARTITION BY doc_id ORDER BY i) > i - 50, false) AS gone FROM m),
        r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM g),
        t AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256 FROM r GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN t USING (doc_id)
    """,
    "op3_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM split),
        keyed AS (SELECT doc_id, i, line, translate(trim(line, {_SPACE}), {_UPPER}, {_LOWER}) AS k FROM lines),
        common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id <> common.keeper AS lost FROM keyed LEFT JOIN common USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op11_periodic_runs": f"""
        WITH {_CRC_TABLE},
        raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, coalesce({_crc32("doc_id::VARCHAR")}, 1) AS h FROM documents, crc),
        cuts AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM raw),
        tails AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cuts),
        d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) END AS ws FROM tails),
        w AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(ws) AS x FROM d),
        pairs AS (SELECT y.doc_id, y.i, z.i - y.i AS q FROM w y JOIN w z ON y.doc_id = z.doc_id AND y.x = z.x AND z.i > y.i AND 3 * (z.i - y.i) <= y.n),
        islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs),
        periodic AS (SELECT doc_id, min(i) AS s, count(*) + q AS l, q FROM islands GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
        runs AS (SELECT doc_id, s, l, min(q) AS q FROM periodic GROUP BY doc_id, s, l),
        best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) AS r FROM runs),
        told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS txt FROM runs GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
        kept AS (SELECT w.doc_id, string_agg(x, ' ' ORDER BY w.i) AS txt FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i WHERE gone.i IS NULL GROUP BY w.doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
               sha256(coalesce(told.txt, '')) AS runs_sha256, sha256(coalesce(kept.txt, '')) AS collapsed_sha256
        FROM d LEFT JOIN told ON told.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id AND r = 1
    """,
    "op12_web_archives": """
        WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        n AS (SELECT *, list_transform(range(8), lambda i: list_reduce(list_transform(range(1, 6), lambda k: strpos('123456789abcdef', h[5 * i + k])), lambda x, y: x * 16 + y)) AS twenty_bits FROM d),
        b AS (SELECT *, array_to_string(list_transform(twenty_bits, lambda v: array_to_string(list_transform([v >> 15, (v >> 10) % 32, (v >> 5) % 32, v % 32], lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', c + 1, 1)), '')), '') AS payload_digest FROM n),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS head FROM b)
        SELECT page_id, strlen(html) AS payload_bytes, payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN head <> page_id THEN head END AS refers_to, 'ok' AS status FROM m
    """,
    "op13_spelling_variants": f"""
        WITH RECURSIVE {_CRC_TABLE},
        runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_UPPER}, {_LOWER}), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY doc_id, run),
        hashed AS (SELECT run, c, {_crc32("doc_id || ':' || run")} AS h FROM counted, crc),
        lossy AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
        v AS (SELECT word, sum(c)::BIGINT AS n FROM lossy WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
        cuts AS (SELECT word, length(word) AS l, unnest(range(1, length(word) + 1)) AS i FROM v),
        less AS (SELECT word, l, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS s FROM cuts),
        near AS (
            SELECT a.word AS x, b.word AS y FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.l = b.l AND a.word <> b.word
            UNION SELECT less.word, v.word FROM less JOIN v ON v.word = less.s UNION SELECT v.word, less.word FROM less JOIN v ON v.word = less.s),
        ranked AS (SELECT x, y, v.n AS m, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY v.n DESC, hex(encode(y))) AS r FROM near JOIN v ON v.word = y),
        formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN y END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN ranked ON x = v.word AND r = 1),
        walk AS (SELECT word, word AS at FROM v UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NOT NULL),
        ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NULL)
        SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
    """,
}
