"""DuckDB SQL for the queries of ``catalogue``, by name. Each stands on the driver's views alone."""

from __future__ import annotations

SEG = """
seg AS (
  SELECT user_id AS session_id, event_type AS speaker_id, event_id AS seg_idx,
         CASE WHEN event_id % 2 = 0 THEN 'mic' ELSE 'system' END AS source,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 // 1000 AS start_ms,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 // 1000 + floor(value * 1000 + 0.5)::BIGINT AS end_ms,
         CASE WHEN event_type = 'error' THEN '[error]' ELSE event_type END AS text
  FROM events)"""
USEFUL = "NOT regexp_full_match(trim(text), '\\[[^\\]]+\\]') AND trim(text) <> ''"
RUN = """
run AS (
  SELECT *, row_number() OVER w AS ord,
         coalesce(sum(end_ms - start_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_ms,
         sum(end_ms - start_ms) OVER (PARTITION BY session_id, speaker_id)::BIGINT AS total_ms
  FROM rng WINDOW w AS (PARTITION BY session_id, speaker_id ORDER BY start_ms, end_ms, seg_idx))"""
RNG_USEFUL = f"rng AS (SELECT session_id, speaker_id, seg_idx, start_ms, end_ms FROM seg WHERE {USEFUL} AND end_ms - start_ms >= 500)"
RNG_PLAIN = "rng AS (SELECT session_id, speaker_id, seg_idx, start_ms, end_ms FROM seg WHERE NOT (text LIKE '[%' AND text LIKE '%]') AND end_ms - start_ms >= 500)"
LINES = """
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem)"""
NAMES = """
asked AS (
  SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 3 = 0 THEN '  ' || upper(s_name) || ' ' ELSE s_name END AS name FROM supplier
  UNION ALL SELECT -c_custkey, lower(c_mktsegment) FROM customer),
enrolled AS (
  SELECT s_suppkey AS profile_id, s_name AS display_name FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT c_custkey + 1000000000, c_mktsegment FROM customer WHERE c_custkey % 7 = 0)"""
RANGES = "ranges(source, r0, r1) AS (VALUES ('mic', 0, 400000), ('mic', 300000, 900000), ('system', 1000000, 1500000), ('system', 2400000, 2500000))"


def at(target: str, scale: int = 2) -> str:
    """The time, in ms times ``scale``, at which summed speech reaches ``target``."""
    reached = f"{scale} * before_ms + {scale} * (end_ms - start_ms) >= ({target})"
    return f"coalesce(arg_min({scale} * start_ms + (({target}) - {scale} * before_ms), ord) FILTER ({reached}), arg_max({scale} * end_ms, ord))"


SUMMARY = f"""
numbered AS (SELECT *, greatest(end_ms - start_ms, 0) AS ms, {USEFUL} AS use,
  row_number() OVER (PARTITION BY session_id, speaker_id, {USEFUL} ORDER BY seg_idx) AS k FROM seg),
summed AS (
  SELECT session_id, speaker_id, count(*)::BIGINT AS segments, count(*) FILTER (use)::BIGINT AS useful_segments,
         sum(ms)::BIGINT AS speech_ms, coalesce(sum(ms) FILTER (use), 0)::BIGINT AS useful_speech_ms,
         arg_min(source, seg_idx) AS source, NULL::VARCHAR AS speaker_name,
         coalesce(string_agg(text, '|' ORDER BY seg_idx) FILTER (use AND k <= 3), '') AS examples
  FROM numbered GROUP BY ALL)"""
WINDOWS = f"""
ends AS (
  SELECT session_id, speaker_id, 2 * arg_min(start_ms, ord) AS e0, {at('least(24000, 2 * total_ms)')} AS e1,
         {at('greatest(0, total_ms - 12000)')} AS m0, {at('least(2 * total_ms, total_ms + 12000)')} AS m1,
         {at('greatest(0, 2 * total_ms - 24000)')} AS l0, 2 * arg_max(end_ms, ord) AS l1
  FROM run GROUP BY ALL),
kept1 AS (SELECT *, e1 - e0 >= 1000 AS ke FROM ends),
kept2 AS (SELECT *, m1 - m0 >= 1000 AND NOT (ke AND abs(m0 - e0) < 1000 AND abs(m1 - e1) < 1000) AS km FROM kept1),
kept3 AS (SELECT *, l1 - l0 >= 1000 AND NOT (ke AND abs(l0 - e0) < 1000 AND abs(l1 - e1) < 1000)
  AND NOT (km AND abs(l0 - m0) < 1000 AND abs(l1 - m1) < 1000) AS kl FROM kept2),
wins AS (
  SELECT session_id, speaker_id, 'early' AS label, e0 AS start_half, e1 AS end_half FROM kept3 WHERE ke
  UNION ALL SELECT session_id, speaker_id, 'middle', m0, m1 FROM kept3 WHERE km
  UNION ALL SELECT session_id, speaker_id, 'late', l0, l1 FROM kept3 WHERE kl)"""


def audit(ratio: str = "3", source: str = "seg") -> str:
    """CTEs up to ``audited``; ``source`` names the segments."""
    ctes = f"{RNG_USEFUL},{RUN},{WINDOWS},{SUMMARY}".replace(" FROM seg", f" FROM {source}")
    return f"""{ctes},
times AS (
  SELECT session_id, speaker_id, arg_min(start_ms, ord) AS first_ms, {at('total_ms')} AS middle_half_ms,
         arg_max(end_ms, ord) AS last_ms, max(total_ms) AS range_ms
  FROM run GROUP BY ALL),
has AS (SELECT session_id, speaker_id, bool_or(label = 'early') AS he, bool_or(label = 'late') AS hl FROM wins GROUP BY ALL),
audited AS (
  SELECT s.*, first_ms, middle_half_ms, last_ms, last_ms - first_ms AS span_ms,
         CASE WHEN coalesce(range_ms, 0) < 5000 THEN 'unknown'
              WHEN coalesce(he, false) AND coalesce(hl, false) AND last_ms - first_ms > {ratio} * range_ms THEN 'mixed_suspected'
              ELSE 'pure_likely' END AS status
  FROM summed s LEFT JOIN times USING (session_id, speaker_id) LEFT JOIN has USING (session_id, speaker_id)),
final AS (SELECT *, status = 'pure_likely' AS safe FROM audited)"""


VEC = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT label, min(vec_id) AS profile_id, arg_min(e, vec_id) AS pe, 'Label ' || label AS display_name FROM v GROUP BY label),
c AS (SELECT vec_id AS candidate_id, e FROM v WHERE vec_id NOT IN (SELECT profile_id FROM p)),
scored AS (SELECT candidate_id, profile_id, display_name, list_dot_product(e, pe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(pe, pe))) AS score FROM c, p),
ranked AS (
  SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM scored WINDOW w AS (PARTITION BY candidate_id ORDER BY score DESC, profile_id)),
m AS (
  SELECT candidate_id, profile_id, display_name, score AS confidence, score - coalesce(nxt, 0) AS margin,
         CASE WHEN score < 0.2 THEN 'below_threshold' WHEN score - coalesce(nxt, 0) < 0.05 THEN 'ambiguous' ELSE 'matched' END AS status
  FROM ranked WHERE r = 1),
sm AS (SELECT candidate_id % 20 AS session_id, lpad(candidate_id::VARCHAR, 8, '0') AS speaker_id, * FROM m)"""
DUPS = """
dups AS (
  SELECT session_id, profile_id, count(*)::BIGINT AS clusters, string_agg(speaker_id, '|' ORDER BY speaker_id) AS speaker_ids,
         round(max(confidence), 6) AS best_confidence
  FROM sm WHERE status = 'matched' GROUP BY ALL HAVING count(*) >= 2)"""
MIXED = """
hits AS (SELECT DISTINCT candidate_id // 5 AS speaker_id, profile_id, display_name FROM m WHERE status = 'matched'),
mixed AS (
  SELECT speaker_id, string_agg(profile_id::VARCHAR, '|' ORDER BY profile_id) AS profile_ids, string_agg(display_name, '|' ORDER BY display_name) AS names
  FROM hits GROUP BY ALL HAVING count(*) >= 2)"""
CLUSTERED = """
cl AS (SELECT vec_id % 10 AS session_id, vec_id AS seg_idx, label::VARCHAR AS cluster, vec_id % 7 * 1000 + label * 900 AS ms, embedding::DOUBLE[] AS e FROM embeddings),
tot AS (SELECT session_id, cluster, sum(ms) AS ms FROM cl GROUP BY ALL),
parts AS (SELECT session_id, cluster, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM cl),
mean AS (SELECT session_id, cluster, i, avg(x) AS x FROM parts GROUP BY ALL),
cen AS (SELECT session_id, cluster, list(x ORDER BY i) AS e FROM mean GROUP BY ALL),
unit AS (SELECT session_id, cluster, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM cen),
near AS (
  SELECT a.session_id, a.cluster, b.cluster AS target, list_dot_product(a.e, b.e) AS similarity,
         row_number() OVER (PARTITION BY a.session_id, a.cluster ORDER BY list_dot_product(a.e, b.e) DESC, b.cluster::INT) AS r
  FROM unit a JOIN tot ta USING (session_id, cluster) JOIN unit b ON a.session_id = b.session_id
  JOIN tot tb ON tb.session_id = b.session_id AND tb.cluster = b.cluster WHERE ta.ms < 30000 AND tb.ms >= 30000)"""
SMP = """
smp AS (
  SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_id,
         least(greatest(floor((value - 50) * 400 + 0.5), -32768), 32767)::BIGINT AS value
  FROM events)"""
HALVES = """
hv AS (SELECT track, event_id % 2 AS half, row_number() OVER (PARTITION BY track, event_id % 2 ORDER BY event_id) - 1 AS idx, value FROM smp),
two AS (SELECT coalesce(a.track, b.track) AS track, coalesce(a.idx, b.idx) AS idx, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b
  FROM (SELECT * FROM hv WHERE half = 0) a FULL JOIN (SELECT * FROM hv WHERE half = 1) b ON a.track = b.track AND a.idx = b.idx)"""


def loud(divisor: str) -> str:
    return f"""
x AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, value / {divisor} AS v FROM events),
fr AS (SELECT track, idx // 5 AS f, sqrt(avg(v * v)) AS rms FROM x GROUP BY ALL HAVING count(*) = 5),
au AS (SELECT * FROM fr WHERE rms > 0.002),
bd AS (SELECT track, quantile_cont(rms, 0.5) AS lo, quantile_cont(rms, 0.95) AS hi, count(*) AS n FROM au GROUP BY ALL),
ba AS (SELECT track, sqrt(avg(rms * rms)) AS band FROM au JOIN bd USING (track) WHERE rms BETWEEN lo AND hi GROUP BY ALL),
ld AS (
  SELECT track, coalesce(n, 0)::BIGINT AS frames, CASE WHEN coalesce(n, 0) < 10 THEN plain ELSE band END AS loudness
  FROM (SELECT track, sqrt(avg(v * v)) AS plain FROM x GROUP BY ALL) LEFT JOIN bd USING (track) LEFT JOIN ba USING (track))"""


AWAY = "(sign({0}) * floor(abs({0}) + 0.5))::BIGINT"


def scaled(value: str, gain: str) -> str:
    return f"CASE WHEN {gain} = 1 THEN {value} ELSE least(greatest({AWAY.format(f'({value}::DOUBLE * {gain})')}, -32768), 32767) END"


SESS = """
ses AS (
  SELECT o_orderkey AS session_id,
         CASE o_orderstatus WHEN 'O' THEN 'stopped' WHEN 'P' THEN 'transcribing' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'transcription_failed' ELSE 'transcribed' END END AS status,
         strftime(o_orderdate, '%Y-%m-%d') AS started_at, o_orderkey % 5 = 0 AS has_transcript, o_totalprice > 1000 AS has_audio, o_orderpriority AS title
  FROM orders)"""
LANE = "CASE status WHEN 'stopped' THEN 'To Transcribe' WHEN 'transcribing' THEN 'To Transcribe' WHEN 'transcribed' THEN 'Transcribed' ELSE 'Failed / Needs Attention' END"
LIFE = """
ev AS (
  SELECT user_id AS session_id, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS at_ms,
         CASE event_type WHEN 'signup' THEN 'scheduled' WHEN 'click' THEN 'recording' WHEN 'view' THEN 'stopped' WHEN 'purchase' THEN 'transcribed' ELSE 'transcription_failed' END AS status
  FROM events),
fold AS (SELECT session_id, arg_max(status, (at_ms, event_id)) AS status, max(at_ms) AS at_ms, count(*)::BIGINT AS events FROM ev GROUP BY ALL)"""


def sql() -> dict[str, str]:
    audit_columns = "session_id, speaker_id, segments, useful_segments, useful_speech_ms, first_ms, middle_half_ms, last_ms, span_ms, status, safe"
    step = 285000
    return {
        "speaker_summary": f"WITH {SEG},{SUMMARY} SELECT * FROM summed",
        "speaker_stats": f"WITH {SEG} SELECT session_id, speaker_id, count(*)::BIGINT AS segments, sum(greatest(end_ms - start_ms, 0))::BIGINT AS speech_ms FROM seg GROUP BY ALL",
        "source_extent": f"WITH {SEG}, x AS (SELECT session_id, source, max(end_ms) AS source_end_ms FROM seg GROUP BY ALL) SELECT *, max(source_end_ms) OVER (PARTITION BY session_id) AS session_end_ms FROM x",
        "session_sources": f"WITH {SEG}, d AS (SELECT DISTINCT session_id, source FROM seg), a AS (SELECT session_id, string_agg(source, '+' ORDER BY source) AS sources FROM d GROUP BY ALL), b AS (SELECT session_id, max(end_ms) AS duration_ms FROM seg GROUP BY ALL) SELECT * FROM a JOIN b USING (session_id)",
        "normalize_segments": """
WITH r AS (
  SELECT event_id AS seg_idx, user_id::VARCHAR AS speaker_id, floor(value * 1000 + 0.5)::BIGINT AS s,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE (floor(value)::BIGINT + 5) * 1000 END AS e,
         CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS text
  FROM events)
SELECT seg_idx, speaker_id, s + 5000 AS start_ms, e + 5000 AS end_ms, e - s AS duration_ms, text FROM r WHERE text <> ''""",
        "speech_predicates": r"""
WITH t AS (
  SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '[' || p_name || ']' WHEN 1 THEN '[]' WHEN 2 THEN '[a] ' || p_name || ' [b]' WHEN 3 THEN '  ' ELSE p_name END AS text
  FROM part)
SELECT p_partkey, starts_with(trim(text), '[') AND ends_with(trim(text), ']') AS bracketed, regexp_full_match(trim(text), '\[[^\]]+\]') AS tag,
       trim(text) <> '' AND NOT regexp_full_match(trim(text), '\[[^\]]+\]') AS useful
FROM t""",
        "track_merge_order": f"WITH {SEG} SELECT session_id, seg_idx, source, start_ms, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, source, seg_idx) AS position FROM seg",
        "render_lines": """
SELECT conv_id AS session_id, string_agg('[' || printf('%d.%02d', turn * 2040 // 1000, turn * 2040 % 1000 // 10) || ' - ' ||
       printf('%d.%02d', (turn * 2040 + 1500) // 1000, (turn * 2040 + 1500) % 1000 // 10) || '] ' ||
       upper(role[1]) || role[2:] || ' Speaker ' || role || ': ' || trim(text), chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""",
        "flatten_text": """
WITH t AS (
  SELECT conv_id, turn, trim(text) AS t, '[' || printf('%.1f', turn * 2.0) || ' - ' || printf('%.1f', turn * 2.0 + 1.5) || '] ' AS pre, CASE WHEN turn % 2 = 0 THEN role END AS sp
  FROM conversations WHERE trim(coalesce(text, '')) <> '')
SELECT conv_id AS session_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS text,
       string_agg(pre || CASE WHEN sp IS NULL THEN '' ELSE 'Speaker ' || sp || ': ' END || t, chr(10) ORDER BY turn) AS diarised_text
FROM t GROUP BY conv_id""",
        "first_examples": "SELECT * FROM (SELECT conv_id AS session_id, role AS speaker_id, turn AS seg_idx, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rank, text FROM conversations) WHERE rank <= 3",
        "positional_labels": f"WITH {SEG} SELECT session_id, source AS track, seg_idx, (seg_idx % 4)::VARCHAR AS speaker_id FROM seg",
        "named_speakers": f"WITH {SEG} SELECT session_id, seg_idx, speaker_id, CASE speaker_id WHEN 'click' THEN 'Ana' WHEN 'view' THEN 'Ben' END AS speaker_name FROM seg",
        "single_speaker": r"""
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '[laughs]' ELSE trim(text) END AS t FROM conversations WHERE role = 'user')
SELECT conv_id AS session_id, string_agg(t, chr(10) ORDER BY turn) AS text FROM t WHERE trim(t) <> '' AND NOT regexp_full_match(trim(t), '\[[^\]]+\]') GROUP BY conv_id""",
        "fallback_texts": """
WITH t AS (SELECT conv_id AS session_id, role AS source, arg_min(text, turn) AS text, max(turn * 2040 + 1500) AS end_ms FROM conversations GROUP BY ALL)
SELECT session_id, source, 0::BIGINT AS start_ms, end_ms, trim(text) AS text FROM t WHERE trim(text) <> ''""",
        "session_json": f"""
WITH {SEG} SELECT session_id, 'spark' AS backend, max(end_ms) / 1000.0::DOUBLE AS duration_seconds, string_agg(DISTINCT source, '+' ORDER BY source) AS sources, count(*) AS segments, round(sum(start_ms) / 1000.0::DOUBLE, 3) AS starts
FROM seg GROUP BY session_id""",
        "backend_names": "WITH h AS (SELECT DISTINCT o_custkey AS session_id, string_split(o_orderpriority, '-')[-1] AS b FROM orders) SELECT session_id, string_agg(b, '+' ORDER BY b) AS backend FROM h GROUP BY ALL",
        "speaker_order": f"""
WITH {SEG}, x AS (SELECT session_id, CASE WHEN seg_idx % 3 = 0 THEN speaker_id ELSE (seg_idx % 12)::VARCHAR END AS speaker_id, greatest(end_ms - start_ms, 0) AS ms, {USEFUL} AS use FROM seg),
g AS (SELECT session_id, speaker_id, coalesce(sum(ms) FILTER (use), 0) AS ms, TRY_CAST(speaker_id AS INT) AS n FROM x GROUP BY ALL)
SELECT session_id, speaker_id, row_number() OVER (PARTITION BY session_id ORDER BY ms DESC, speaker_id) AS by_speech, row_number() OVER (PARTITION BY session_id ORDER BY n IS NULL, n, speaker_id) AS by_number FROM g""",
        "range_clip": f"WITH {SEG}, {RANGES} SELECT session_id, speaker_id, count(*)::BIGINT AS pieces, sum(least(end_ms, r1) - greatest(start_ms, r0))::BIGINT AS clipped_ms FROM seg JOIN ranges USING (source) WHERE least(end_ms, r1) - greatest(start_ms, r0) >= 500 GROUP BY ALL",
        "overlap_relabel": f"WITH {SEG}, {RANGES} SELECT session_id, seg_idx, start_ms, end_ms, 'Ana' AS speaker_name FROM seg WHERE speaker_id = 'click' AND EXISTS (SELECT 1 FROM ranges WHERE ranges.source = seg.source AND start_ms < r1 AND end_ms > r0)",
        "relabelled_outputs": f"""
WITH {SEG}, {RANGES}, x AS (SELECT *, EXISTS (SELECT 1 FROM ranges WHERE ranges.source = seg.source AND start_ms < r1 AND end_ms > r0) AS hit FROM seg),
l AS (
  SELECT *, '[' || printf('%d.%02d', start_ms // 1000 + (c0 // 100), c0 % 100) || ' - ' || printf('%d.%02d', end_ms // 1000 + (c1 // 100), c1 % 100) || '] ' || upper(source[1]) || source[2:] ||
         CASE WHEN hit THEN ' Ana' ELSE ' Speaker ' || speaker_id END || ': ' || text AS line
  FROM (SELECT *, round_even(start_ms % 1000 / 10.0::DOUBLE, 0)::INT AS c0, round_even(end_ms % 1000 / 10.0::DOUBLE, 0)::INT AS c1 FROM x)),
h AS (SELECT session_id, count(*) FILTER (hit) AS changed FROM x GROUP BY ALL HAVING count(*) FILTER (hit) > 0)
SELECT session_id, 'transcript.md' AS name, changed, sha256(string_agg(line, chr(10) ORDER BY seg_idx) || chr(10)) AS text_sha256, NULL::VARCHAR AS first_name FROM l JOIN h USING (session_id) GROUP BY session_id, changed
UNION ALL SELECT session_id, 'transcript.json', changed, NULL, CASE WHEN arg_min(hit, seg_idx) THEN 'Ana' END FROM l JOIN h USING (session_id) GROUP BY session_id, changed
UNION ALL SELECT session_id, 'transcript.' || source || '.json', count(*) FILTER (hit), NULL, CASE WHEN arg_min(hit, seg_idx) THEN 'Ana' END FROM l JOIN h USING (session_id) GROUP BY session_id, source""",
        "selected_ranges": f"""
WITH {SEG}, {RANGES}, c AS (SELECT session_id, speaker_id, count(*) AS segments, round(sum(least(end_ms, r1) - greatest(start_ms, r0)) / 1000.0::DOUBLE, 3) AS seconds FROM seg JOIN ranges USING (source) WHERE least(end_ms, r1) - greatest(start_ms, r0) >= 500 GROUP BY ALL),
q AS (SELECT session_id, speaker_id, count(*) AS requested FROM (SELECT DISTINCT session_id, speaker_id, source FROM seg) JOIN ranges USING (source) GROUP BY ALL)
SELECT session_id, speaker_id, segments, seconds, requested FROM c FULL JOIN q USING (session_id, speaker_id)""",
        "clip_tokens": f"""
WITH {SEG}, x AS (SELECT *, seg_idx % 2 = 0 AS norm, seg_idx % 3 * 1500 AS ms, end_ms + seg_idx % 1000 AS last_ms FROM seg),
j AS (
  SELECT *, sha1('{{"normalize":' || norm || ',"ranges":[[' || (start_ms / 1000.0::DOUBLE)::VARCHAR || ',' || (end_ms / 1000.0::DOUBLE)::VARCHAR || '],[' || (end_ms / 1000.0::DOUBLE)::VARCHAR || ',' || (last_ms / 1000.0::DOUBLE)::VARCHAR ||
         ']],"sample_seconds":' || (ms / 1000.0::DOUBLE)::VARCHAR || ',"source":"' || source || '","speaker_id":"' || speaker_id || '"}}') AS h
  FROM x)
SELECT seg_idx, 'speaker-' || speaker_id || '-enroll-ranges-' || left(h, 12) || CASE WHEN norm THEN '-norm' ELSE '-raw' END AS sample,
       'speaker-' || speaker_id || '-' || CASE ms WHEN 0 THEN 'all' WHEN 1500 THEN '2s' ELSE '3s' END || CASE WHEN norm THEN '-norm' ELSE '-raw' END AS clip
FROM j""",
        "audio_by_source": f"""
WITH {SEG} SELECT session_id, seg_idx, session_id || CASE session_id % 4 WHEN 0 THEN CASE source WHEN 'mic' THEN '/Mic' ELSE '/system' END WHEN 1 THEN '/SYSTEM' WHEN 2 THEN CASE source WHEN 'mic' THEN '/mic' ELSE '/room' END END AS audio_path FROM seg""",
        "labels_before": f"WITH {SEG}, d AS (SELECT DISTINCT session_id, CASE WHEN seg_idx % 3 = 0 THEN upper(speaker_id) ELSE '' END AS l FROM seg) SELECT session_id, string_agg(l, '|' ORDER BY l) AS labels FROM d GROUP BY ALL",
        "cap_duration": f"WITH {SEG}, {RNG_PLAIN},{RUN} SELECT session_id, speaker_id, seg_idx, start_ms, least(end_ms, start_ms + 120000 - before_ms) AS end_ms FROM run WHERE before_ms < 120000",
        "speech_midpoint": f"WITH {SEG}, {RNG_USEFUL},{RUN} SELECT session_id, speaker_id, arg_min(start_ms, ord) AS first_ms, {at('total_ms')} AS middle_half_ms, arg_max(end_ms, ord) AS last_ms, max(total_ms) AS speech_ms FROM run GROUP BY ALL",
        "purity_windows": f"""
WITH {SEG}, {RNG_USEFUL},{RUN},{WINDOWS},
pieces AS (SELECT w.*, least(2 * end_ms, end_half) - greatest(2 * start_ms, start_half) AS x FROM wins w JOIN rng USING (session_id, speaker_id))
SELECT session_id, speaker_id, label, start_half, end_half, count(*) FILTER (x >= 1000)::BIGINT AS segment_count, coalesce(sum(x) FILTER (x >= 1000), 0)::BIGINT AS speech_half
FROM pieces GROUP BY ALL""",
        "equal_speech_windows": f"""
WITH {SEG}, {RNG_PLAIN},{RUN},
w AS (SELECT *, total_ms * (win - 1) AS low, total_ms * win AS high FROM run, (VALUES (1), (2)) t(win)),
x AS (
  SELECT session_id, speaker_id, win::BIGINT AS "window",
         arg_min(2 * start_ms + greatest(low - 2 * before_ms, 0), ord) FILTER (2 * before_ms + 2 * (end_ms - start_ms) > low) AS start_part,
         arg_min(2 * start_ms + high - 2 * before_ms, ord) FILTER (2 * before_ms + 2 * (end_ms - start_ms) >= high) AS end_part
  FROM w GROUP BY ALL)
SELECT * FROM x WHERE end_part - start_part >= 1000""",
        "safety_audit": f"""
WITH {SEG}, {audit()}
SELECT {audit_columns}, CASE WHEN span_ms IS NULL THEN 'no_useful_speech' WHEN status = 'unknown' THEN 'useful_speech_below_minimum'
       WHEN safe THEN 'span_to_speech_ratio_within_threshold|no_widely_separated_window_pair' ELSE 'span_to_speech_ratio_exceeds_threshold|distinct_early_and_late_windows_span_wide_timeline' END AS reasons
FROM final""",
        "audit_join_list": f"WITH {SEG}, {audit()} SELECT session_id, speaker_id, segments, useful_speech_ms, status, safe FROM final WHERE NOT (session_id % 2 = 0 AND speaker_id = 'click')",
        "enrolment_guard": f"""
WITH {SEG}, mic AS (SELECT * FROM seg WHERE source = 'mic'), {audit(source='mic')},
req AS (SELECT DISTINCT session_id, speaker_id FROM seg),
j AS (SELECT req.*, status, safe, req.session_id IN (SELECT session_id FROM final) AS known FROM req LEFT JOIN final USING (session_id, speaker_id))
SELECT session_id, speaker_id, CASE WHEN status IS NULL THEN 'warn' WHEN safe THEN 'allow' ELSE 'refuse' END AS decision,
       CASE WHEN NOT known THEN 'no_speaker_audit_found' WHEN status IS NULL THEN 'speaker_not_in_audit' ELSE 'audit_status_' || status END AS reason
FROM j""",
        "all_clusters_safe": f"WITH {SEG}, ok AS (SELECT * FROM seg WHERE {USEFUL}), {audit('20', 'ok')} SELECT session_id, bool_and(safe) AS all_safe FROM final GROUP BY ALL",
        "forward_fill_speaker": f"""
WITH {SEG}, k AS (SELECT *, CASE WHEN NOT (text LIKE '[%' AND text LIKE '%]') AND end_ms - start_ms >= 5000 THEN speaker_id END AS sp FROM seg),
t AS (SELECT session_id, sp, sum(end_ms - start_ms) AS ms FROM k WHERE sp IS NOT NULL GROUP BY ALL),
d AS (SELECT session_id, sp, row_number() OVER (PARTITION BY session_id ORDER BY ms DESC, sp) AS r FROM t)
SELECT k.session_id, seg_idx, coalesce(last_value(k.sp IGNORE NULLS) OVER (PARTITION BY k.session_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d.sp, '0') AS assigned_id
FROM k LEFT JOIN d ON d.session_id = k.session_id AND d.r = 1""",
        "first_appearance_labels": f"WITH {SEG}, f AS (SELECT session_id, speaker_id, row_number() OVER (PARTITION BY session_id ORDER BY min(seg_idx)) - 1 AS label_no FROM seg GROUP BY session_id, speaker_id) SELECT session_id, seg_idx, speaker_id, label_no FROM seg JOIN f USING (session_id, speaker_id)",
        "chunk_windows": f"""
WITH {SEG}, d AS (SELECT session_id, max(end_ms) AS d FROM seg GROUP BY ALL),
n AS (SELECT *, unnest(generate_series(0, greatest(CASE WHEN d <= 300000 THEN 0 ELSE (d - 300000 + {step} - 1) // {step} END, 0))) AS chunk_idx FROM d WHERE d > 0)
SELECT session_id, chunk_idx, chunk_idx * {step} AS chunk_start_ms, least(chunk_idx * {step} + 300000, d) AS chunk_end_ms FROM n""",
        "boundary_dedup": f"""
WITH {SEG}, k AS (SELECT *, start_ms // {step} AS chunk_idx, start_ms // {step} * {step} AS c0, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS m FROM seg)
SELECT session_id, chunk_idx, seg_idx, start_ms, text FROM k a
WHERE NOT EXISTS (
  SELECT 1 FROM k b WHERE a.session_id = b.session_id AND b.chunk_idx < a.chunk_idx AND a.m = b.m AND a.m <> '' AND a.end_ms <= a.c0 + 16000
    AND b.end_ms >= greatest(0, a.c0 - 20000) AND (abs(a.start_ms - b.start_ms) <= 3000 OR abs(a.end_ms - b.end_ms) <= 3000 OR greatest(a.start_ms, b.start_ms) <= least(a.end_ms, b.end_ms)))""",
        "merged_chunks": f"""
WITH {SEG}, k AS (SELECT session_id, seg_idx, start_ms // {step} AS chunk_idx, CASE WHEN seg_idx % 10 <> 0 THEN start_ms END AS start_ms FROM seg)
SELECT session_id, chunk_idx, seg_idx, start_ms, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(start_ms, 0), chunk_idx, seg_idx) AS position FROM k""",
        "track_offsets": f"""
WITH {SEG}, k AS (SELECT *, CASE WHEN NOT (text LIKE '[%' AND text LIKE '%]') AND end_ms - start_ms >= 5000 THEN speaker_id END AS sp FROM seg WHERE source = 'mic'),
t AS (SELECT session_id, sp, sum(end_ms - start_ms) AS ms FROM k WHERE sp IS NOT NULL GROUP BY ALL),
d AS (SELECT session_id, sp, row_number() OVER (PARTITION BY session_id ORDER BY ms DESC, sp) AS r FROM t),
f AS (SELECT k.session_id, coalesce(last_value(k.sp IGNORE NULLS) OVER (PARTITION BY k.session_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d.sp, '0') AS a FROM k LEFT JOIN d ON d.session_id = k.session_id AND d.r = 1)
SELECT session_id, count(DISTINCT a) AS id_offset FROM f GROUP BY ALL""",
        "cosine_match": f"WITH {VEC} SELECT candidate_id, profile_id, round(confidence, 6) AS confidence, round(margin, 6) AS margin, status FROM m",
        "skipped_profiles": f"""
WITH {VEC}, n AS (SELECT count(*) AS candidates, len(any_value(e)) AS dimension FROM c)
SELECT 'mean-pool' AS provider, 'v1' AS model, dimension::INT AS dimension, candidates, profile_id,
       CASE profile_id % 4 WHEN 0 THEN 'provider_model_mismatch' WHEN 1 THEN 'missing_embedding' ELSE 'embedding_dimension_mismatch' END AS reason
FROM p, n WHERE profile_id % 4 < 3""",
        "label_resolution": f"""
WITH {VEC}, s AS (SELECT *, CASE WHEN candidate_id % 9 = 0 THEN 'too_short' ELSE status END AS st FROM sm),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, profile_id, st = 'matched' ORDER BY confidence DESC, speaker_id) AS k FROM s),
f AS (SELECT *, CASE WHEN st = 'matched' AND k > 1 THEN 'duplicate_profile_match' ELSE st END AS fin FROM r)
SELECT session_id, speaker_id, CASE WHEN fin = 'matched' THEN display_name ELSE 'Speaker ' || speaker_id END AS label,
       CASE WHEN fin = 'matched' THEN profile_id END AS profile_id, CASE WHEN fin <> 'too_short' THEN round(confidence, 6) END AS confidence, fin AS status
FROM f""",
        "duplicate_groups": f"WITH {VEC},{DUPS} SELECT * FROM dups",
        "mixed_windows": f"WITH {VEC},{MIXED} SELECT * FROM mixed",
        "label_suggestions": f"WITH {VEC} SELECT session_id, speaker_id, profile_id, status, CASE status WHEN 'matched' THEN 'reuse_profile' ELSE 'no_confident_match' END AS recommendation FROM sm",
        "suggestion_summary": f"""
WITH {VEC},{DUPS},{MIXED}
SELECT count(*)::BIGINT AS cluster_count, count(*) FILTER (status = 'matched')::BIGINT AS matched_count, (SELECT count(*) FROM dups)::BIGINT AS duplicate_group_count,
       (SELECT count(*) FROM mixed)::BIGINT AS mixed_cluster_count, count(*) FILTER (status <> 'matched')::BIGINT AS unmatched_count, 'ok' AS status
FROM m""",
        "centroid_nearest": f"WITH {CLUSTERED} SELECT session_id, cluster, target, round(similarity, 6) AS similarity FROM near WHERE r = 1",
        "agglomerative": """
WITH RECURSIVE v AS (SELECT vec_id // 100 AS session_id, vec_id AS seg_idx, embedding::DOUBLE[] AS e FROM embeddings),
d AS (
  SELECT a.session_id, a.seg_idx AS i, b.seg_idx AS j, 1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS d
  FROM v a JOIN v b ON a.session_id = b.session_id AND a.seg_idx <> b.seg_idx),
s(step, session_id, seg_idx, c) AS (
  SELECT 0, session_id, seg_idx, seg_idx FROM v
  UNION ALL
  SELECT step + 1, s.session_id, s.seg_idx, CASE WHEN c = m.hi THEN m.lo ELSE c END
  FROM s JOIN (
    SELECT session_id, arg_min(lo, (h, lo, hi)) AS lo, arg_min(hi, (h, lo, hi)) AS hi
    FROM (SELECT x.session_id, x.c AS lo, y.c AS hi, avg(d) AS h FROM s x JOIN d ON d.session_id = x.session_id AND i = x.seg_idx JOIN s y ON y.session_id = x.session_id AND y.seg_idx = j WHERE x.c < y.c GROUP BY ALL)
    WHERE h <= 0.85 GROUP BY session_id) m ON m.session_id = s.session_id),
e AS (SELECT * FROM s QUALIFY step = max(step) OVER (PARTITION BY session_id)),
n AS (SELECT session_id, c, row_number() OVER (PARTITION BY session_id ORDER BY min(seg_idx)) - 1 AS k FROM e GROUP BY session_id, c)
SELECT session_id, seg_idx, k::VARCHAR AS cluster FROM e JOIN n USING (session_id, c)""",
        "merged_clusters": f"""
WITH {CLUSTERED}, g AS (SELECT cl.session_id, seg_idx, coalesce(target, cl.cluster) AS c FROM cl LEFT JOIN (SELECT * FROM near WHERE r = 1) n USING (session_id, cluster)),
f AS (SELECT session_id, c, row_number() OVER (PARTITION BY session_id ORDER BY min(seg_idx)) - 1 AS k FROM g GROUP BY session_id, c)
SELECT session_id, seg_idx, k::VARCHAR AS cluster FROM g JOIN f USING (session_id, c)""",
        "profile_lookup": f"""
WITH {NAMES}, p AS (SELECT lower(trim(display_name)) AS k, count(*) AS n, min(profile_id) AS id FROM enrolled GROUP BY ALL)
SELECT request_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS profile_id
FROM asked LEFT JOIN p ON lower(trim(name)) = k""",
        "names_taken": f"WITH {NAMES} SELECT request_id FROM asked WHERE name IN (SELECT display_name FROM enrolled)",
        "enrolment_outcomes": f"""
WITH {NAMES}
SELECT request_id, CASE WHEN name IN (SELECT display_name FROM enrolled) THEN 'skipped' WHEN abs(request_id) % 4 = 0 THEN 'failed' WHEN abs(request_id) % 5 = 0 THEN 'error' ELSE 'enrolled' END AS outcome
FROM asked""",
        "profile_listing": """
WITH p AS (
  SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 5 = 0 THEN 'zoe 7' ELSE c_mktsegment || ' ' || c_custkey % 120 END AS "displayName", CASE WHEN c_custkey % 5 = 0 THEN 't1' ELSE 't0' END AS "updatedAt"
  FROM customer WHERE c_custkey % 11 <> 0)
SELECT *, row_number() OVER (PARTITION BY lower(left("displayName", 1))
         ORDER BY lower(regexp_extract("displayName", '^[^0-9]+')), regexp_extract("displayName", '[0-9]+$')::INT, "displayName", id) AS place
FROM p""",
        "suggested_labels": f"""
WITH {VEC}, x AS (SELECT m.*, candidate_id % 20 AS session_id, lpad(candidate_id::VARCHAR, 8, '0') AS speaker_id, candidate_id % 3 + 1 AS segments, (candidate_id % 3 + 1) * (candidate_id % 7 + 1) * 1000 AS speech_ms FROM m),
y AS (SELECT *, CASE WHEN speech_ms >= 8000 THEN status END AS st FROM x)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY speaker_id) AS position, speaker_id, 'mic' AS source, segments, speech_ms, CASE WHEN speech_ms < 8000 THEN 'too_short' ELSE 'ok' END AS extraction,
       CASE WHEN st = 'matched' THEN profile_id END AS profile_id, st AS status, CASE WHEN st = 'matched' THEN 'reuse_profile' ELSE 'no_confident_match' END AS recommendation,
       CASE WHEN st = 'matched' THEN 'Cluster ' || speaker_id || ' is ' || display_name || ' (' || profile_id || ') with confidence ' || printf('%.4f', confidence) || '; reuse the profile.'
            ELSE 'Cluster ' || speaker_id || ' has no confident match (status: ' || coalesce(st, 'no_match') || ').' END AS detail
FROM y""",
        "suggested_windows": f"""
WITH {VEC}, w AS (SELECT session_id, speaker_id, unnest([candidate_id, candidate_id + 20]) AS other FROM sm WHERE (candidate_id % 3 + 1) * (candidate_id % 7 + 1) >= 8),
h AS (SELECT DISTINCT w.session_id, w.speaker_id, m.profile_id, m.display_name FROM w JOIN m ON m.candidate_id = other WHERE m.status = 'matched')
SELECT session_id, speaker_id, string_agg(profile_id::VARCHAR, '|' ORDER BY profile_id) AS profile_ids, string_agg(display_name, '|' ORDER BY display_name) AS names
FROM h GROUP BY ALL HAVING count(*) >= 2""",
        "loudness_band": f"WITH {loud('500.0')} SELECT track, frames, round(loudness, 6) AS loudness FROM ld",
        "speech_gain": f"WITH {loud('50000.0')} SELECT track, round(CASE WHEN loudness <= 1e-9 THEN 1 ELSE greatest(least(pow(10, -19.0 / 20) / loudness, 40), 1) END, 6)::DOUBLE AS gain FROM ld",
        "gated_rms_peak": f"WITH {SMP} SELECT track, round(coalesce(sqrt(avg(value::DOUBLE * value) FILTER (abs(value) >= 32)), 0), 6) AS rms, count(*) FILTER (value <> 0)::BIGINT AS non_zero, max(least(abs(value), 32767)) AS peak FROM smp GROUP BY ALL",
        "mix_tracks": f"WITH {SMP},{HALVES} SELECT track, idx, least(greatest(a + b, -32768), 32767) AS value FROM two",
        "mix_balanced": f"""
WITH {SMP},{HALVES}, q AS (SELECT track, idx, a, floor(b / 7.0)::BIGINT AS b FROM two),
l AS (SELECT track, coalesce(sqrt(avg(a::DOUBLE * a) FILTER (abs(a) >= 32)), 0) AS ra, coalesce(sqrt(avg(b::DOUBLE * b) FILTER (abs(b) >= 32)), 0) AS rb FROM q GROUP BY ALL),
g AS (SELECT q.*, CASE WHEN ra > 0 AND rb > 0 AND rb > ra THEN rb / ra ELSE 1 END AS ga, CASE WHEN ra > 0 AND rb > 0 AND ra > rb THEN ra / rb ELSE 1 END AS gb FROM q JOIN l USING (track)),
s AS (SELECT track, idx, ({scaled('a', 'ga')}) + ({scaled('b', 'gb')}) AS s FROM g),
h AS (SELECT track, CASE WHEN max(abs(s)) > 32767 THEN 32767.0::DOUBLE / max(abs(s)) ELSE 1 END AS h FROM s GROUP BY ALL),
t AS (SELECT track, idx, least(greatest({AWAY.format('(s::DOUBLE * h)')}, -32768), 32767) AS v FROM s JOIN h USING (track)),
u AS (SELECT track, CASE WHEN max(abs(v)) > 0 AND max(abs(v)) < 32767 * 0.8::DOUBLE THEN least(16, 32767 * 0.8::DOUBLE / max(abs(v))) ELSE 1 END AS g FROM t GROUP BY ALL),
o AS (SELECT track, {scaled('v', 'g')} AS v FROM t JOIN u USING (track))
SELECT track, count(*)::BIGINT AS n, sum(v)::BIGINT AS total, max(abs(v)) AS peak FROM o GROUP BY ALL""",
        "track_drift": f"WITH {SMP},{HALVES}, n AS (SELECT track, count(*) FILTER (half = 0) / 4.0::DOUBLE AS left_s, count(*) FILTER (half = 1) / 4.0::DOUBLE AS right_s FROM hv GROUP BY ALL) SELECT track, left_s, right_s, abs(left_s - right_s) AS drift_s FROM n WHERE left_s > 0 AND right_s > 0 AND abs(left_s - right_s) > 0.25",
        "resample_linear": f"""
WITH {SMP}, n AS (SELECT track, list(value ORDER BY idx) AS s FROM smp GROUP BY ALL),
o AS (SELECT track, s, unnest(generate_series(0, floor(len(s) * 1.5 + 0.5)::BIGINT - 1)) AS idx FROM n),
k AS (SELECT track, idx, s, idx / 1.5::DOUBLE AS pos, least(floor(idx / 1.5::DOUBLE), len(s) - 1)::BIGINT AS i FROM o),
y AS (SELECT track, idx, s[i + 1]::DOUBLE + (s[least(i + 2, len(s))] - s[i + 1])::DOUBLE * (pos - i) AS y FROM k)
SELECT track, idx, least(greatest({AWAY.format('y')}, -32768), 32767) AS value FROM y""",
        "float_to_int16": "WITH x AS (SELECT event_id, greatest(least((value - 50) / 100, 1.0), -1.0) AS v FROM events) SELECT event_id, trunc(CASE WHEN v < 0 THEN v * 32768 ELSE v * 32767 END)::BIGINT AS sample FROM x",
        "interleaved": f"""
WITH {SMP},{HALVES}, c AS (SELECT track, least(count(*) FILTER (half = 0), count(*) FILTER (half = 1)) AS n FROM hv GROUP BY ALL)
SELECT track, 2 * idx + half AS idx, value FROM hv JOIN c USING (track) WHERE idx < n""",
        "energy_topk": f"""
WITH {SEG}, {SMP}, {RNG_PLAIN}, g AS (SELECT *, start_ms % 40 AS f, greatest((end_ms - start_ms) // 4000, 1) AS n FROM rng),
s AS (
  SELECT g.session_id, g.speaker_id, g.seg_idx, round(coalesce(sqrt(avg(value * value)) / 32768.0::DOUBLE, 0), 6) AS score
  FROM g LEFT JOIN smp ON smp.track = g.session_id AND smp.idx >= f AND smp.idx < f + n GROUP BY ALL),
r AS (
  SELECT g.*, score, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY session_id, speaker_id ORDER BY score DESC, start_ms, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
  FROM g JOIN s USING (session_id, speaker_id, seg_idx))
SELECT session_id, speaker_id, seg_idx, start_ms, least(end_ms, start_ms + 90000 - b) AS end_ms, score FROM r WHERE b < 90000""",
        "range_samples": f"""
WITH {SMP}, r(k, a, b) AS (VALUES (0, 8, 14), (1, 1, 7), (2, 20, 4000)),
x AS (SELECT track, value, row_number() OVER (PARTITION BY track ORDER BY k, idx) - 1 AS idx FROM smp JOIN r ON idx >= a AND idx < b)
SELECT track, idx, value FROM x""",
        "normalized_speech": f"""
WITH {SMP}, q AS (SELECT track, idx, floor(value / 50.0)::BIGINT AS value FROM smp),
x AS (SELECT track, idx, value / 32768.0::DOUBLE AS v FROM q), {loud('1')[loud('1').index('fr AS'):]},
g AS (SELECT track, CASE WHEN loudness <= 1e-9 THEN 1 ELSE greatest(least(pow(10, -19.0 / 20) / loudness, 40), 1) END AS gain FROM ld),
o AS (SELECT q.track, CASE WHEN gain = 1 THEN value ELSE least(greatest(round_even(value * gain, 0)::BIGINT, -32768), 32767) END AS v FROM q JOIN g USING (track))
SELECT track, count(*)::BIGINT AS n, sum(v)::BIGINT AS total, max(abs(v)) AS peak FROM o GROUP BY ALL""",
        "mono_tracks": f"""
WITH {SMP}, p AS (SELECT track, idx // 2 AS idx, sum(value) AS s, count(*) AS n FROM smp GROUP BY ALL)
SELECT track, idx, floor(s / 2.0)::BIGINT AS floored, trunc(s / 2.0)::BIGINT AS cut FROM p WHERE n = 2""",
        "band_features": f"""
WITH {SMP}, n AS (SELECT track, count(*) AS n, greatest(count(*) // 13, 1) AS w FROM smp GROUP BY ALL),
b AS (SELECT s.track, least(idx // w, 12) AS band, idx, value FROM smp s JOIN n USING (track)),
t AS (SELECT *, lag(value) OVER (PARTITION BY track, band ORDER BY idx) AS prev FROM b),
f AS (
  SELECT track, band, avg(abs(value))::DOUBLE AS mean, count(*) FILTER (prev IS NOT NULL AND (prev >= 0) <> (value >= 0)) / greatest(count(*) - 1, 1)::DOUBLE * 1000 AS zcr
  FROM t GROUP BY ALL),
g AS (SELECT track, k.band, coalesce(mean, 0) AS mean, coalesce(zcr, 0) AS zcr FROM n CROSS JOIN (SELECT unnest(range(13)) AS band) k LEFT JOIN f USING (track, band)),
q AS (SELECT track, sqrt(sum(mean * mean + zcr * zcr)) AS q FROM g GROUP BY ALL),
u AS (SELECT track, 2 * band AS dim, mean AS x FROM g UNION ALL SELECT track, 2 * band + 1, zcr FROM g)
SELECT track, dim, round(x / CASE WHEN q > 0 THEN q ELSE 1 END, 6) AS feature FROM u JOIN q USING (track)""",
        "meeting_now": f"""
WITH {SEG}, e AS (SELECT * FROM seg WHERE seg_idx % 13 <> 0), n AS (SELECT DISTINCT session_id, 1200000::BIGINT AS now_s FROM seg),
c AS (SELECT session_id, arg_min((seg_idx, start_ms, end_ms), (-start_ms, seg_idx)) AS c FROM e WHERE start_ms <= 1200000 AND end_ms > 1200000 GROUP BY ALL),
u AS (SELECT session_id, arg_min((seg_idx, start_ms, end_ms), (start_ms, seg_idx)) AS u FROM e WHERE start_ms > 1200000 AND start_ms - 1200000 <= 60000 GROUP BY ALL),
b AS (SELECT n.*, CASE WHEN c IS NOT NULL THEN 'current' WHEN u IS NOT NULL THEN 'upcoming' END AS status, coalesce(c, u) AS m FROM n LEFT JOIN c USING (session_id) LEFT JOIN u USING (session_id)),
x AS (SELECT b.session_id, arg_min(e.seg_idx, (e.start_ms, e.seg_idx)) AS next_id FROM b JOIN e ON e.session_id = b.session_id AND e.start_ms >= coalesce(m[3], now_s) GROUP BY ALL)
SELECT b.session_id, now_s, status, m[1] AS event_id, CASE WHEN status = 'upcoming' THEN m[2] - now_s END AS starts_in_s, CASE WHEN status = 'current' THEN m[3] - now_s END AS ends_in_s, next_id
FROM b LEFT JOIN x USING (session_id)""",
        "timeout_by_session": f"WITH {SEG}, l AS (SELECT session_id, max((end_ms - start_ms) / 100.0::DOUBLE) AS longest_s FROM seg GROUP BY ALL) SELECT *, greatest(1800.0::DOUBLE, 4 * longest_s + 300) AS timeout_s FROM l",
        "board_lanes": f"WITH {SESS} SELECT {LANE} AS lane, count(*)::BIGINT AS sessions, max(started_at) AS newest, arg_max(session_id, (started_at, -session_id)) AS newest_id FROM ses GROUP BY ALL",
        "board_cards": f"""
WITH {SESS}, x AS (
  SELECT session_id AS k, started_at AS day, CASE WHEN session_id % 17 <> 0 THEN title || ' | a]]' ELSE 'Untitled' END AS title,
         ['recording', 'scheduled', 'stopped', 'transcribing', 'transcribed', 'transcription_failed', 'transcription_interrupted', 'recording_failed', 'scheduled_cancelled', 'odd'][session_id % 10 + 1] AS status,
         CASE WHEN session_id % 6 <> 0 THEN 'meeting' ELSE 'unknown' END AS mode
  FROM ses),
y AS (
  SELECT *, CASE status
    WHEN 'transcribed' THEN 'transcribed ' || CASE WHEN k % 5 = 0 THEN 'on ' || day ELSE day END
    WHEN 'transcription_failed' THEN 'failed ' || CASE WHEN k % 7 = 0 THEN 'on ' || day WHEN k % 3 = 0 THEN day WHEN k % 2 = 0 THEN 'on ' || day ELSE '' END || CASE WHEN k % 5 <> 0 THEN ' — no audio' ELSE '' END
    WHEN 'recording_failed' THEN 'recording failed to launch ' || CASE WHEN k % 7 = 0 THEN 'on ' || day WHEN k % 3 = 0 THEN day ELSE '' END || CASE WHEN k % 5 <> 0 THEN ' — no audio' ELSE '' END
    WHEN 'transcription_interrupted' THEN 'interrupted ' || CASE WHEN k % 4 = 1 THEN day WHEN k % 2 = 0 THEN 'on ' || day ELSE '' END || ' — resume with transcribe --resume'
    WHEN 'transcribing' THEN 'transcribing (PID ' || CASE WHEN k % 2 = 1 THEN k::VARCHAR ELSE '?' END || ') since ' || day
    WHEN 'stopped' THEN 'stopped ' || CASE WHEN k % 2 = 0 THEN 'on ' || day ELSE day END
    WHEN 'recording' THEN 'started ' || CASE WHEN k % 3 = 0 THEN 'on ' || day ELSE day END
    WHEN 'scheduled' THEN 'scheduled for ' || day
    WHEN 'scheduled_cancelled' THEN 'scheduled start cancelled ' || day || CASE WHEN k % 7 = 0 THEN ' — too late' ELSE '' END
    ELSE status END AS said,
    CASE WHEN status IN ('recording', 'scheduled') THEN 'Recording' WHEN status = 'transcribed' THEN 'Transcribed' WHEN status IN ('stopped', 'transcribing', 'odd') THEN 'To Transcribe' ELSE 'Failed / Needs Attention' END AS lane
  FROM x)
SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY day DESC, k) AS place, k AS session_id,
       '- [ ] [[recordings/' || k || '/session|' || replace(replace(title, '|', '-'), ']]', '] ]') || ']] — ' || said || ' — mode ' || mode AS card
FROM y""",
        "marked_sessions": f"""
WITH {SESS}, x AS (SELECT session_id AS k, status AS old, CASE WHEN session_id % 3 <> 0 THEN 'r1' END AS own FROM ses),
c AS (SELECT k, ['transcribing', 'transcribed', 'transcription_failed', 'transcription_interrupted', 'recording'][k % 5 + 1] AS nw, CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 6 = 1 THEN 'r2' ELSE 'r1' END END AS run, CASE WHEN k % 9 = 0 THEN 'log' END AS log FROM x WHERE k % 4 <> 0),
j AS (SELECT x.k, old, nw, log, (run IS NULL OR own IS NULL OR run = own) AND (
  (old = 'stopped' AND nw = 'transcribing') OR (old = 'transcribing' AND nw IN ('transcribed', 'transcription_failed', 'transcription_interrupted')) OR (old IN ('transcribed', 'transcription_failed') AND nw = 'transcribing')) AS good
  FROM x LEFT JOIN c USING (k)),
g AS (SELECT *, coalesce(good, false) AND nw IS NOT NULL AS ok FROM j)
SELECT k AS session_id, CASE WHEN ok THEN nw ELSE old END AS status, nw IS NOT NULL AND NOT ok AS refused, CASE WHEN ok AND nw = 'transcription_failed' THEN '1999-01-01' END AS failed_at,
       CASE WHEN ok AND nw = 'transcription_failed' THEN 'no audio' END AS failure_reason, CASE WHEN ok AND nw = 'transcription_interrupted' THEN '1999-01-01' END AS interrupted_at,
       CASE WHEN ok AND nw = 'transcribed' THEN '1999-01-01' END AS transcribed_at, CASE WHEN NOT (ok AND nw IN ('transcribed', 'transcription_failed', 'transcription_interrupted')) THEN '77' END AS transcription_pid,
       CASE WHEN ok AND nw = 'transcribing' THEN '1999-01-01' END AS transcription_started_at, CASE WHEN ok THEN log END AS transcription_log_path
FROM g""",
        "refused_transitions": f"""
WITH {LIFE}, o AS (SELECT session_id, event_id, lag(status) OVER (PARTITION BY session_id ORDER BY at_ms, event_id) AS before, status FROM ev)
SELECT * FROM o WHERE NOT coalesce((before IS NULL AND status IN ('scheduled', 'recording')) OR (before = 'scheduled' AND status = 'recording') OR (before = 'recording' AND status = 'stopped'), false)""",
        "session_ends": f"""
WITH {SESS}, f AS (SELECT l_orderkey AS session_id, max(l_shipdate) AS last FROM lineitem GROUP BY ALL)
SELECT session_id, CASE WHEN session_id % 3 = 0 THEN started_at ELSE strftime(last, '%Y-%m-%d') END AS ended_on FROM ses JOIN f USING (session_id)""",
        "audio_choices": """
WITH x AS (SELECT o_orderkey AS k, o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AS mixed FROM orders)
SELECT k AS session_id, k || CASE WHEN mixed THEN '/mixed.wav' ELSE '/mic.wav' END AS audio, k || '/mic.wav|' || k || '/system.wav' || CASE WHEN mixed THEN '|' || k || '/mixed.wav' ELSE '' END AS outputs,
       CASE WHEN NOT mixed THEN 'Mixed track unavailable (' || CASE WHEN k % 5 = 0 THEN 'rates differ' ELSE 'no mixed file' END || '); transcribing the microphone instead.' END AS note,
       mixed AND abs(k % 50 / 4.0 - k % 48 / 4.0) > 0.25 AS drifts
FROM x""",
        "calendar_answers": f"""
WITH {LINES}, e AS (SELECT l_orderkey AS answer_id, l_orderkey % 7 AS k, n, l_shipdate FROM li)
SELECT answer_id, NULL::VARCHAR AS error, n - 1 AS event_no, CASE WHEN n % 3 <> 0 THEN 'Line ' || n ELSE '(untitled)' END AS subject, strftime(l_shipdate, '%Y-%m-%d') AS start, strftime(l_shipdate + INTERVAL 1 DAY, '%Y-%m-%d') AS "end", n = 2 AS is_all_day
FROM e WHERE k = 6
UNION ALL
SELECT DISTINCT answer_id, ['outlook_not_found', 'timeout', 'calendar_failed', 'bad_json', 'calendar_error', 'no_login'][k + 1], NULL::BIGINT, NULL, NULL, NULL, false FROM e WHERE k < 6""",
        "staged_runs": """
WITH x AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 0 OR o_orderkey % 8 <> 0),
r AS (
  SELECT k AS run_id, CASE WHEN k % 8 = 0 THEN 'missing transcript.md' WHEN k % 10 = 0 THEN 'missing transcript.json' WHEN k % 9 = 0 THEN 'transcript.md is empty' WHEN k % 7 = 6 THEN 'transcript.json is empty'
         WHEN k % 7 = 3 THEN 'transcript.json is not valid JSON' WHEN k % 7 IN (2, 4) THEN 'transcript.json does not have the shape of a transcript' ELSE '' END AS reason
  FROM x)
SELECT run_id, reason = '' AS valid, reason FROM r""",
        "growing_files": f"""
WITH {LINES}, f AS (SELECT l_orderkey || '/' || n AS path, (l_quantity * 100)::BIGINT AS length, l_returnflag AS rf, l_linestatus AS ls FROM li),
a AS (SELECT path, length FROM f WHERE rf <> 'A'), b AS (SELECT path, length + length(path) % 2 AS length FROM f WHERE ls = 'O' OR rf = 'A')
SELECT coalesce(a.path, b.path) AS path, a.length AS before_bytes, b.length AS after_bytes FROM a FULL JOIN b ON a.path = b.path WHERE a.length IS DISTINCT FROM b.length""",
        "audio_lists": f"""
WITH {LINES}, f AS (SELECT l_orderkey AS session_id, ['system.wav', 'mic.wav', 'extra.wav', 'mixed.wav', 'a.wav'][n % 5 + 1] AS name, max((l_quantity * 3)::BIGINT) AS length FROM li GROUP BY ALL)
SELECT session_id, string_agg(name, '|' ORDER BY CASE name WHEN 'mixed.wav' THEN 1 WHEN 'mic.wav' THEN 2 WHEN 'system.wav' THEN 3 ELSE 4 END, name) AS audio_files FROM f WHERE length > 44 GROUP BY session_id""",
        "sounding_files": f"WITH {LINES} SELECT l_orderkey, n, (l_quantity * 200)::BIGINT AS length FROM li WHERE (l_quantity * 200)::BIGINT > 4096",
        "scheduled_starts": """
WITH e AS (SELECT event_id, event_id % 3 AS k, ts, TIMESTAMP '2024-01-15 12:00:00' AS now FROM events),
w AS (SELECT *, CASE k WHEN 0 THEN TIMESTAMP '2024-01-15' + (date_trunc('minute', ts) - date_trunc('day', ts)) WHEN 1 THEN date_trunc('second', ts) END AS due FROM e),
g AS (SELECT *, CASE WHEN due > now THEN due END AS ok FROM w)
SELECT event_id, CASE k WHEN 0 THEN strftime(ts, '%H:%M') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE 'at ' || strftime(ts, '%H:%M') END AS text,
       strftime(ok, '%Y-%m-%d %H:%M:%S') AS starts, strftime(ok, '%Y%m%d-%H%M%S') AS token, (epoch_us(date_trunc('second', ts)) - epoch_us(now)) // 1000000 AS from_now_s, (epoch_us(ok) - epoch_us(now)) // 1000000 AS to_start_s
FROM g""",
        "device_errors": "SELECT c_custkey, CASE WHEN c_custkey % 7 IN (1, 5) THEN 'timeout' WHEN c_custkey % 7 IN (3, 4) THEN 'memory' END AS kind FROM customer",
        "pending_sessions": f"WITH {SESS} SELECT session_id, status, started_at FROM ses WHERE status <> 'transcribing' AND NOT has_transcript ORDER BY started_at DESC, session_id LIMIT 20",
        "chosen_session": f"WITH {SESS} SELECT session_id, status, started_at FROM ses WHERE status <> 'transcribing' AND NOT has_transcript AND has_audio ORDER BY started_at DESC, session_id LIMIT 1",
        "slug_titles": "SELECT p_partkey, left(regexp_replace(regexp_replace(lower(trim('  ' || p_name || ' / ' || p_brand || '! ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug FROM part",
        "parse_ranges": f"""
WITH {LINES}, k AS (SELECT l_orderkey, n, l_quantity::INT AS q, l_partkey % 100 AS p, l_suppkey % 7 AS k FROM li),
c AS (SELECT *, lpad((q % 60)::VARCHAR, 2, '0') || ':' || lpad((q % 50)::VARCHAR, 2, '0') AS clock, (q % 60) * 60 + q % 50 AS sec FROM k),
t AS (
  SELECT l_orderkey, n,
         CASE k WHEN 0 THEN p || '-' || q WHEN 1 THEN clock || '-1:' || clock WHEN 2 THEN ' ' || q || '.5 - ' || clock || ' ' WHEN 3 THEN '-' || p WHEN 4 THEN p || 'x-' || p
                WHEN 5 THEN '0:' || clock || '-' ELSE '00:' || clock || '-01:00:' || lpad(p::VARCHAR, 2, '0') || '.25' END AS text,
         CASE k WHEN 0 THEN p::DOUBLE WHEN 1 THEN sec::DOUBLE WHEN 2 THEN q + 0.5::DOUBLE WHEN 6 THEN sec::DOUBLE END AS a,
         CASE k WHEN 0 THEN q::DOUBLE WHEN 1 THEN 3600.0::DOUBLE + sec WHEN 2 THEN sec::DOUBLE WHEN 6 THEN 3600.25::DOUBLE + p END AS b
  FROM c)
SELECT l_orderkey, n, text, CASE WHEN a < b THEN a END AS start_s, CASE WHEN a < b THEN b END AS end_s FROM t""",
        "attendee_lists": """
WITH c AS (SELECT c_custkey, c_custkey % 4 AS k, c_name, c_mktsegment AS seg, 'c' || c_custkey || '@mail.example' AS mail FROM customer)
SELECT c_custkey, 0::BIGINT AS pos, c_name AS name, mail AS address FROM c WHERE k = 0
UNION ALL SELECT c_custkey, 1, seg, '' FROM c WHERE k = 0
UNION ALL SELECT c_custkey, 0, seg || ', ' || c_name, mail FROM c WHERE k = 1
UNION ALL SELECT c_custkey, 1, '', mail FROM c WHERE k = 1
UNION ALL SELECT c_custkey, 0, '', mail FROM c WHERE k = 2
UNION ALL SELECT c_custkey, 1, 'not@mail', '' FROM c WHERE k = 2
UNION ALL SELECT c_custkey, 2, c_name, '' FROM c WHERE k = 2""",
        "journal_decision": f"""
WITH {LINES}, k AS (SELECT l_orderkey AS journal_id, n AS name, l_orderkey * 7 + n AS k FROM li),
j AS (SELECT *, k % 5 <> 0 AS existed, k % 11 < 9 AS replaced, (k % 3)::VARCHAR AS nw, CASE WHEN k % 13 <> 0 THEN (k % 6 % 3)::VARCHAR END AS fd FROM k),
d AS (SELECT *, replaced OR coalesce(nw = fd, false) AS done FROM j), a AS (SELECT *, bool_and(done) OVER (PARTITION BY journal_id) AS fin FROM d)
SELECT journal_id, name, CASE WHEN fin THEN 'keep' WHEN NOT done THEN 'none' WHEN existed THEN 'restore_backup' ELSE 'remove' END AS action FROM a""",
        "resume_decision": f"""
WITH {SESS}, a AS (
  SELECT status, CASE WHEN status <> 'transcribing' THEN 'none' WHEN session_id % 4 = 0 THEN 'wait' WHEN session_id % 4 = 1 THEN 'finalize'
                      WHEN session_id % 4 = 2 AND '1995-01-01' >= started_at THEN 'accept_legacy' ELSE 'mark_interrupted' END AS action
  FROM ses)
SELECT status, action, count(*)::BIGINT AS sessions FROM a GROUP BY ALL""",
        "foreign_runs": """
WITH s AS (
  SELECT o_orderkey AS session_id, (o_orderkey % 7)::VARCHAR AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 5)::VARCHAR END AS a, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 7)::VARCHAR END AS b
  FROM orders)
SELECT session_id, run_id FROM s WHERE NOT (a IS NOT DISTINCT FROM run_id OR b IS NOT DISTINCT FROM run_id)""",
        "lifecycle_fold": f"WITH {LIFE} SELECT session_id, CASE WHEN status = 'scheduled' AND 2600000000 >= at_ms + 90000 THEN 'scheduled_cancelled' ELSE status END AS status, at_ms, events FROM fold",
        "lifecycle_stream": f"WITH {LIFE} SELECT session_id, status, at_ms, events FROM fold",
    }
