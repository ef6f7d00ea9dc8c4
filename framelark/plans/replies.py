"""Queries of loose replies, with SQL. Turns of conversations are the chatter around answers of many forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies
from ..sources import frames as src
from ._base import rounded

# {a} and {b} are numbers of the row, {t} is its text; both engines build the same replies from these forms
ANSWERS = (
    '{t} {"start_sec": {a}, "end_sec": {b}, "subject": "dog"}',
    '```json\n{"start": {b}, "end": {a},}\n```',
    '```\n[{"begin_sec": "{a}", "to_sec": {b}}, {"x": 1}]\n``` {t}',
    "{t}",
    '[[{a}, {b}], [1, 2],] and {"start": 1',
    '{"inner": {"start": {a}}}',
    '[1, {"start": {a}}, 2 {t}',
    '   ```JSON {"from_sec": {a}, "stop_sec": {b}, "subjects": "cat"} ``` {"start": 0, "end": 1}',
    '{"start": true, "end": "x", "stop_sec": {b}, "subject": ""}',
    '[{"start": {a}, "end": {a}}]',
)
SEGMENTS = (
    '{t} {"segments": [[{a}, {b}], [{b}, "{a}"], [5], ["x", 6], 7, null]}',
    'first {"b": 1} then {"segments": []} then {"segments": [[{a}, {a}]]} {t}',
    '{"meta": {"n": {a}}, "segments": [[0, {b}]]}',
    'broken {"segments": [[{a}, {b}], [3, 4.5] {t} [5,6',
    "segments: [ -{a}.5 , {b}. ] [3,4,5] [6,{a}]",
    "[1, {a}] before the word segment",
    '{"a": {"b": {"segments": [[{a}, {b}]]}}}',
)
POINTS = (
    "[[0.{a}, 0.{b}], [0.5, 0.25]]",
    '{"points": [[{a}, {b}], [50, 140]]} {t}',
    '```json\n{"other": 1, "data": [[1{a}, 9{b}]]}```',
    '[{"x": 0.{a}, "y": "0.{b}"}, {"cx": 0.1, "cy": 2}]',
    '[{"bbox_2d": [0.1, 0.{a}, 0.3, 0.{b}]}, {"bbox": [0.5, 0.{a}]}]',
    "[[0, {a}, 200, {b}],]",
    "[[1, 5{a}, 60], [2, 70, 8{b}]]",
    "[[[0.{a}, 0.2], [0.3, 0.{b}]]]",
    '{"bbox": [0.2, 0.{a}, 0.4, 0.6]}',
    '{"x": 0.{a}, "y": 0.{b}}',
    '[[0.{a}, 0.2], {"x": 1}]',
    "[[{a}, 2, 3, 4, 5]]",
    '{"a": {a}}',
)
_A, _B = "(conv_id % 7 + 10)", "(turn % 5 + 20)"


def _pieces(form: str) -> list[str]:
    """The form's literal parts and its fields, in order."""
    out, rest = [], form
    while rest:
        at = [(rest.find(f), f) for f in ("{a}", "{b}", "{t}") if f in rest]
        if not at:
            return [*out, rest]
        i, f = min(at)
        out += [rest[:i], f]
        rest = rest[i + 3 :]
    return out


def _turns(s, d, forms):
    fields = {"{a}": (F.col("conv_id") % 7 + 10).cast("string"), "{b}": (F.col("turn") % 5 + 20).cast("string"), "{t}": F.coalesce("text", F.lit(""))}
    cases = F.when(F.lit(False), F.lit(""))
    for i, form in enumerate(forms):
        cases = cases.when((F.col("conv_id") + 3 * F.col("turn")) % len(forms) == i, F.concat(*(fields.get(p, F.lit(p)) for p in _pieces(form))))
    return src.table(s, d, "conversations").select("conv_id", "turn", cases.alias("reply"))


def _sql_turns(forms) -> str:
    fields = {"{a}": f"{_A}::VARCHAR", "{b}": f"{_B}::VARCHAR", "{t}": "coalesce(text, '')"}
    quoted = lambda p: "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    cases = " ".join(f"WHEN {i} THEN {' || '.join(fields.get(p, quoted(p)) for p in _pieces(form))}" for i, form in enumerate(forms))
    return f"replies AS (SELECT conv_id, turn, CASE (conv_id + 3 * turn) % {len(forms)} {cases} END AS reply FROM conversations)"


def answers(s, d):
    r = _turns(s, d, ANSWERS).withColumn("v", replies.answer(F.col("reply"))).withColumn("i", replies.interval(F.col("v")))
    return rounded(r.select("conv_id", "turn", F.when(replies.is_list(F.col("v")), "list").when(replies.is_object(F.col("v")), "object").alias("kind"), "i.start", "i.end", "i.subject"))


def segments(s, d):
    r = _turns(s, d, SEGMENTS).select("conv_id", "turn", F.posexplode(replies.segments(F.col("reply"))).alias("place", "s"))
    return rounded(r.select("conv_id", "turn", "place", "s.start", "s.end"))


def points(s, d):
    r = _turns(s, d, POINTS).select("conv_id", "turn", F.posexplode(replies.points(replies.answer(F.col("reply")), 8)).alias("place", "p"))
    return rounded(r.select("conv_id", "turn", "place", "p.x", "p.y"))


QUERIES = {"sf6_reply_answers": answers, "sf5_reply_segments": segments, "sf8_reply_points": points}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_JSON = """CASE WHEN json_valid({0}) THEN {0} WHEN json_valid(replace(replace({0}, ',]', ']'), ',}}', '}}')) THEN replace(replace({0}, ',]', ']'), ',}}', '}}') END"""


def _spans(forms) -> str:
    """From replies to ``parsed``: the JSON text ``j`` of each answer."""
    return f"""{_sql_turns(forms)},
        trimmed AS (SELECT *, trim(reply, {_WS}) AS t FROM replies),
        bare AS (SELECT conv_id, turn, CASE WHEN starts_with(t, '```') THEN regexp_replace(string_split(t, '```')[2], '^\\s*(?i:json)', '') ELSE t END AS t FROM trimmed),
        spans AS (SELECT *, strpos(t, '{{') AS oa, length(t) - strpos(reverse(t), '}}') + 1 AS ob, strpos(t, '[') AS la, length(t) - strpos(reverse(t), ']') + 1 AS lb FROM bare),
        cut AS (SELECT *, CASE WHEN oa > 0 AND strpos(t, '}}') > 0 AND ob > oa THEN substr(t, oa, ob - oa + 1) END AS o, CASE WHEN la > 0 AND strpos(t, ']') > 0 AND lb > la THEN substr(t, la, lb - la + 1) END AS l FROM spans),
        tried AS (SELECT *, {_JSON.format("o")} AS oj, {_JSON.format("l")} AS lj FROM cut),
        parsed AS (SELECT conv_id, turn, (CASE WHEN l IS NULL OR (o IS NOT NULL AND oa < la) THEN coalesce(oj, lj) ELSE coalesce(lj, oj) END)::JSON AS j FROM tried)"""


def _num(e: str) -> str:
    """A JSON number, text or truth value as a double."""
    return f"CASE json_type({e}) WHEN 'BOOLEAN' THEN (({e})::VARCHAR = 'true')::INT::DOUBLE WHEN 'ARRAY' THEN NULL WHEN 'OBJECT' THEN NULL ELSE TRY_CAST(({e})->>'$' AS DOUBLE) END"


def _first(e: str, keys) -> str:
    return "coalesce(" + ", ".join(_num(f"json_extract({e}, '$.{k}')") for k in keys) + ")"


_LIST = "CASE json_array_length({0}) WHEN 4 THEN [({n0} + {n2}) / 2, ({n1} + {n3}) / 2] WHEN 3 THEN [{n1}, {n2}] WHEN 2 THEN [{n0}, {n1}] END"


def _corners(e: str) -> str:
    pair = _LIST.format(e, **{f"n{i}": _num(f"json_extract({e}, '$[{i}]')") for i in range(4)})
    every = " AND ".join(f"(json_array_length({e}) <= {i} OR {_num(f'json_extract({e}, ' + chr(39) + f'$[{i}]' + chr(39) + ')')} IS NOT NULL)" for i in range(4))
    return f"CASE WHEN {every} THEN {pair} END"


ORACLE_SQL = {
    "sf6_reply_answers": f"""
        WITH {_spans(ANSWERS)},
        one AS (SELECT conv_id, turn, json_type(j) AS k, CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[0]') ELSE j END AS e FROM parsed),
        obj AS (SELECT conv_id, turn, k, CASE WHEN json_type(e) = 'OBJECT' THEN e END AS e FROM one),
        ab AS (SELECT *, {_first("e", replies.START)} AS a, {_first("e", replies.END)} AS b, coalesce(nullif(json_extract_string(e, '$.subject'), ''), nullif(json_extract_string(e, '$.subjects'), ''), '') AS subject FROM obj)
        SELECT conv_id, turn, CASE k WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' END AS kind, CASE WHEN abs(b - a) >= 1e-3 THEN least(a, b) END AS start, CASE WHEN abs(b - a) >= 1e-3 THEN greatest(a, b) END AS "end", CASE WHEN abs(b - a) >= 1e-3 THEN subject END AS subject FROM ab
    """,
    "sf5_reply_segments": f"""
        WITH {_sql_turns(SEGMENTS)},
        objects AS (SELECT conv_id, turn, unnest(regexp_extract_all(reply, '\\{{(?:[^{{}}]|\\{{[^{{}}]*\\}})*\\}}')) AS o, unnest(range(len(regexp_extract_all(reply, '\\{{(?:[^{{}}]|\\{{[^{{}}]*\\}})*\\}}')))) AS oi FROM replies),
        lists AS (SELECT conv_id, turn, oi, json_extract(CASE WHEN json_valid(o) THEN o END, '$.segments') AS l FROM objects),
        elements AS (SELECT conv_id, turn, oi, unnest(range(json_array_length(l)::BIGINT)) AS i, l FROM lists WHERE json_type(l) = 'ARRAY'),
        e AS (SELECT conv_id, turn, oi, i, json_extract(l, '$[' || i || ']') AS e FROM elements),
        p AS (SELECT conv_id, turn, oi, i, {_num("json_extract(e, '$[0]')")} AS a, {_num("json_extract(e, '$[1]')")} AS b FROM e WHERE json_type(e) = 'ARRAY'),
        told AS (SELECT conv_id, turn, a, b, oi, i FROM p WHERE a IS NOT NULL AND b IS NOT NULL QUALIFY oi = min(oi) OVER (PARTITION BY conv_id, turn)),
        tails AS (SELECT conv_id, turn, CASE WHEN strpos(reply, 'segments') > 0 THEN substr(reply, strpos(reply, 'segments')) ELSE '' END AS t FROM replies WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM told)),
        loose AS (SELECT conv_id, turn, unnest(regexp_extract_all(t, '\\[\\s*(-?\\d+\\.?\\d*)\\s*,\\s*(-?\\d+\\.?\\d*)\\s*\\]', 1)) AS a, unnest(regexp_extract_all(t, '\\[\\s*(-?\\d+\\.?\\d*)\\s*,\\s*(-?\\d+\\.?\\d*)\\s*\\]', 2)) AS b,
                  unnest(range(len(regexp_extract_all(t, '\\[\\s*(-?\\d+\\.?\\d*)\\s*,\\s*(-?\\d+\\.?\\d*)\\s*\\]')))) AS i FROM tails)
        SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INT AS place, a AS start, b AS "end" FROM told
        UNION ALL SELECT conv_id, turn, i::INT, a::DOUBLE, b::DOUBLE FROM loose
    """,
    "sf8_reply_points": f"""
        WITH {_spans(POINTS)},
        found AS (SELECT conv_id, turn, CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_type(j) = 'OBJECT' THEN coalesce({", ".join(f"CASE WHEN json_type(json_extract(j, '$.{k}')) = 'ARRAY' THEN json_extract(j, '$.{k}') END" for k in replies.LISTS)},
                  CASE WHEN {" OR ".join(f"json_extract(j, '$.{k}') IS NOT NULL" for k in (*replies.BOXES, *replies.X))} THEN json_array(j) END) END AS l FROM parsed),
        opened AS (SELECT conv_id, turn, CASE WHEN json_array_length(l) = 1 AND json_type(json_extract(l, '$[0][0]')) IN ('ARRAY', 'OBJECT') THEN json_extract(l, '$[0]') ELSE l END AS l FROM found),
        e AS (SELECT conv_id, turn, json_array_length(l) AS n, i, json_extract(l, '$[' || i || ']') AS e FROM (SELECT *, unnest(range(json_array_length(l)::BIGINT)) AS i FROM opened WHERE l IS NOT NULL)),
        flat AS (SELECT conv_id, turn, max(abs(v)) AS top FROM (SELECT conv_id, turn, unnest([{", ".join(_num(f"json_extract(e, '$[{i}]')") for i in range(6))}]) AS v FROM e WHERE json_type(e) = 'ARRAY') GROUP BY ALL),
        boxed AS (SELECT *, coalesce(json_extract(e, '$.bbox_2d'), json_extract(e, '$.bbox')) AS bx FROM e),
        p AS (SELECT conv_id, turn, n, i, CASE WHEN json_type(e) = 'ARRAY' THEN {_corners("e")} WHEN json_type(e) = 'OBJECT' AND bx IS NOT NULL THEN {_corners("bx")}
              WHEN json_type(e) = 'OBJECT' AND {_first("e", replies.X)} IS NOT NULL AND {_first("e", replies.Y)} IS NOT NULL THEN [{_first("e", replies.X)}, {_first("e", replies.Y)}] END AS p FROM boxed),
        whole AS (SELECT *, count(p) OVER (PARTITION BY conv_id, turn) AS good, CASE WHEN coalesce(top, 0) <= 1.5 THEN 1.0::DOUBLE WHEN top <= 150 THEN 100.0::DOUBLE ELSE 1000.0::DOUBLE END AS scale FROM p LEFT JOIN flat USING (conv_id, turn))
        SELECT conv_id, turn, i::INT AS place, round_even(greatest(0, least(1, p[1] / scale)) * 1e6, 0) / 1e6 AS x, round_even(greatest(0, least(1, p[2] / scale)) * 1e6, 0) / 1e6 AS y FROM whole WHERE good = n AND n <= 8
    """,
}
