"""DuckDB SQL for the queries over the core operators."""

from __future__ import annotations

from ..functions.profiles import BENGALI, LATIN
from ..operators.audio import CLIPPING, MAX_RMS_DB, MIN_RMS_DB, MIN_SNR_DB
from ..operators.stats import BUCKETS


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_LINES = """
x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS text, unnest(range(len(ls)))::BIGINT AS pos FROM x),
raw AS (SELECT * FROM l WHERE length(text) > 0)"""


def _norm(t: str) -> str:
    t = f"regexp_replace({t}, '^[0-9]+[,.]?\\s*', '')"
    t = f"translate(trim(regexp_replace({t}, '\\s+', ' ', 'g')), '–—', '--')"
    for run, mark in (("।।+", "।"), ("\\.\\.+", "."), ("\\?\\?+", "?"), ("!!+", "!")):
        t = f"regexp_replace({t}, '{run}', '{mark}', 'g')"
    return f"regexp_replace({t}, '([।.!?])[।.!?]+$', '\\1')"


_KEY = "substr(md5(regexp_replace(lower({t}), '\\s+', '', 'g')), 1, 12)"
_WORDS = "len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> ''))"
_TYPE = "CASE WHEN contains({t}, '?') THEN 'question' WHEN contains({t}, '!') THEN 'exclamation' ELSE 'statement' END"
_UNITS = f"list_filter({_list(LATIN.labelled())}, lambda u: contains({{t}}, substr(u, strpos(u, ':') + 1)))"
_CONJ = f"list_filter({_list(LATIN.units['conjunct'])}, lambda u: contains({{t}}, u))"
_OWN = "A-Za-zÀ-ɏ"
_SHARE = f"length(regexp_replace({{t}}, '[^{_OWN} ।,!?''\"\\-():;\\n]', '', 'g')) / length({{t}})"

_SENT = f"""{_LINES},
s0 AS (SELECT doc_id, pos, {_norm("text")} AS text FROM raw),
s AS (SELECT doc_id, pos, text, length(text)::BIGINT AS char_count, {_WORDS.format(t="text")}::BIGINT AS word_count,
    {_UNITS.format(t="text")} AS units, {_CONJ.format(t="text")} AS conj, {_TYPE.format(t="text")} AS sentence_type FROM s0 WHERE text <> '')"""
_SCORE = f"""{_SENT},
q AS (SELECT *, (CASE WHEN char_count BETWEEN 15 AND 50 THEN 30 WHEN char_count BETWEEN 10 AND 60 THEN 20 WHEN char_count BETWEEN 5 AND 80 THEN 10 ELSE 5 END
    + least(len(units) * 1.5, 30) + least(len(conj) * 3, 15) + CASE WHEN regexp_matches(text, '[।.?!]$') THEN 10 ELSE 0 END
    + CASE WHEN regexp_matches(text, '^[{_OWN}]') THEN 5 ELSE 0 END
    + CASE sentence_type WHEN 'question' THEN 10 WHEN 'exclamation' THEN 8 ELSE 5 END)::DOUBLE AS quality_score FROM s)"""


def _balance(group: str, shares: list[tuple[str, float]], name: str) -> str:
    quota = "CASE g " + " ".join(f"WHEN '{g}' THEN least(floor(total * {s}::DOUBLE), n)" for g, s in shares) + " END"
    place = "CASE g " + " ".join(f"WHEN '{g}' THEN {i}" for i, (g, _) in enumerate(shares)) + " END"
    return f"""WITH {_SCORE}, a AS (SELECT *, {group} AS g FROM q),
    b AS (SELECT *, count(*) OVER () AS total, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY quality_score DESC, doc_id, pos) AS r FROM a),
    c AS (SELECT *, {place} AS p, CASE WHEN r <= {quota} THEN 0 ELSE 1 END AS late FROM b)
    SELECT doc_id, pos, row_number() OVER (ORDER BY late, CASE late WHEN 0 THEN p END, CASE late WHEN 1 THEN -quality_score END, p, r) AS {name} FROM c"""


_PROMPTS = "p AS (SELECT event_id AS idx, printf('%07d', event_id) AS prompt_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'retry' ELSE 'pending' END AS status FROM events)"
_META = "m AS (SELECT doc_id, doc_id || '.wav' AS filename, CASE WHEN doc_id % 11 <> 0 THEN 'text ' || doc_id ELSE '' END AS text FROM documents)"
_FILES = "f AS (SELECT doc_id || CASE WHEN quality = 1 THEN '.wav' ELSE '_temp.webm' END AS name, doc_id::DOUBLE AS duration FROM labels)"
_MATCH = f"""{_META}, {_FILES}, n AS (SELECT DISTINCT name FROM f),
    j AS (SELECT m.doc_id, m.text, coalesce(a.name, c.name) AS audio FROM m LEFT JOIN n a ON a.name = m.filename LEFT JOIN n c ON c.name = m.doc_id || '_temp.webm' WHERE m.text <> ''),
    k AS (SELECT doc_id, text, audio, regexp_replace(audio, '\\.[^.]*$', '') AS wav FROM j WHERE audio IS NOT NULL)"""
_RUNS = "r AS (SELECT user_id AS run, ts, event_id AS step, value, (floor(value)::BIGINT % 100) / 100 AS score, 'ck_' || event_id AS path FROM events)"
_DB = "CASE WHEN {ms} > 0 THEN 20 * log10(sqrt({ms})) ELSE -100 END"


def _signal(rate: int, scale: str = "v") -> str:
    window, hop = int(rate * 0.025), max(int(rate * 0.010), 1)
    return f"""
    e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
    lv AS (SELECT vec_id, unnest(list_transform(range(0, len(x) - {window}, {hop}), lambda i: list_sum(list_transform(x[i + 1 : i + {window}], lambda v: v * v)) / {window})) AS ms FROM e),
    sn AS (SELECT vec_id, quantile_cont(20 * log10(sqrt(ms)), 0.9) - quantile_cont(20 * log10(sqrt(ms)), 0.1) AS snr_db FROM lv WHERE ms > 0 GROUP BY vec_id),
    pt AS (SELECT vec_id, len(x) AS n, unnest(x) AS v, unnest(range(len(x))) AS i FROM e),
    ed AS (SELECT vec_id, n, i FROM pt WHERE abs(v) > power(10, -2.5) UNION ALL SELECT vec_id, len(x), len(x) FROM e),
    ga AS (SELECT vec_id, i - coalesce(lag(i) OVER (PARTITION BY vec_id ORDER BY i), -1) - 1 AS run FROM ed),
    si AS (SELECT vec_id, coalesce(sum(run / {rate}) FILTER (WHERE run / {rate} >= 0.3), 0) AS silence FROM ga GROUP BY vec_id),
    ba AS (SELECT vec_id, len(x) / {rate} AS duration, list_max(list_transform(x, lambda v: abs(v))) AS peak, list_sum(list_transform(x, lambda v: v * v)) / len(x) AS ms FROM e),
    mt AS (SELECT vec_id, duration, peak, {_DB.format(ms="ms")} AS rms_db, snr_db, silence / duration AS silent_share FROM ba LEFT JOIN sn USING (vec_id) LEFT JOIN si USING (vec_id))"""


_VERDICT = f"""v AS (SELECT vec_id, duration BETWEEN 0.5 AND 15 AS duration, peak < {CLIPPING} AS clipping, rms_db BETWEEN {MIN_RMS_DB} AND {MAX_RMS_DB} AS rms,
    coalesce(snr_db >= {MIN_SNR_DB}, false) AS snr, snr_db IS NOT NULL AS told, silent_share < 0.95 AS silence_only FROM mt)"""
_STOP = f"""{_RUNS}, li AS (SELECT run, list({{'v': value, 'best': 'inf'::DOUBLE, 'n': 0, 'seen': 0, 'stop': NULL::INTEGER}} ORDER BY ts, step) AS xs FROM r GROUP BY run),
    st AS (SELECT run, list_reduce(list_prepend({{'v': 0::DOUBLE, 'best': 'inf'::DOUBLE, 'n': 0, 'seen': 0, 'stop': NULL::INTEGER}}, xs), lambda a, b: {{
        'v': b.v, 'best': CASE WHEN b.v < a.best - 0.001 THEN b.v ELSE a.best END, 'n': CASE WHEN b.v < a.best - 0.001 THEN 0 ELSE a.n + 1 END, 'seen': a.seen + 1,
        'stop': coalesce(a.stop, CASE WHEN NOT (b.v < a.best - 0.001) AND a.n + 1 >= 10 THEN a.seen + 1 END)}}) AS z FROM li)"""
_COLLAPSE = f"""{_RUNS}, w AS (SELECT run, ts, step, score, row_number() OVER o AS n, avg(score) OVER (o ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent,
    avg(score) OVER (o ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS ten FROM r WINDOW o AS (PARTITION BY run ORDER BY ts, step)),
    c AS (SELECT run, ts, step, recent AS recent_avg, CASE WHEN n >= 20 THEN ten ELSE recent END AS older_avg, score < 0.3 OR (n >= 10 AND recent < CASE WHEN n >= 20 THEN ten ELSE recent END * 0.8) AS collapsed FROM w)"""
_BACK = "bk AS (SELECT run, arg_max(path, (ts, step)) AS path FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts DESC, step DESC) AS k FROM r) WHERE k <= 3 AND score > 0.35 / 0.7 GROUP BY run)"
_PLAN = """(SELECT '/in/' || p_partkey || CASE WHEN p_size > 25 THEN '.WAV' ELSE '.mp3' END AS path, p_partkey, p_size FROM part WHERE p_size > 25)
    CROSS JOIN (VALUES ('original', 1.0, ''), ('speed', 0.95, '_speed0.95'), ('speed', 1.05, '_speed1.05'), ('volume', 0.9, '_vol0.90'), ('volume', 1.1, '_vol1.10')) k(kind, factor, suffix)"""
_U = BENGALI.units
_CATALOGUE = f"""g AS (
    SELECT 0 AS rank, i, 'vowel' AS type, t AS text FROM (SELECT unnest({_list(_U["vowel"])}) AS t, unnest(range({len(_U["vowel"])})) AS i)
    UNION ALL SELECT 1, i, 'consonant', t FROM (SELECT unnest({_list(_U["consonant"])}) AS t, unnest(range({len(_U["consonant"])})) AS i)
    UNION ALL SELECT 2, a.i * 1000 + b.i, 'consonant_matra', a.t || b.t FROM (SELECT unnest({_list(_U["consonant"])}) AS t, unnest(range({len(_U["consonant"])})) AS i) a,
        (SELECT unnest({_list(_U["matra"])}) AS t, unnest(range({len(_U["matra"])})) AS i) b
    UNION ALL SELECT 3, i, 'conjunct', t FROM (SELECT unnest({_list(_U["conjunct"])}) AS t, unnest(range({len(_U["conjunct"])})) AS i)
    UNION ALL (VALUES (4, 0, 'word', 'আমি'), (4, 1, 'word', 'তুমি'), (5, 0, 'sentence', 'আমি যাই।'), (6, 0, 'carrier', 'বলো আমি এখন'), (6, 1, 'carrier', 'আমি লেখো'), (6, 2, 'carrier', 'বলো তুমি এখন'), (6, 3, 'carrier', 'তুমি লেখো')))"""

ORACLE = {
    "curate_lines": f"""WITH {_SCORE}, k AS (SELECT *, {_KEY.format(t="text")} AS key FROM q),
        o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) = 1)
        SELECT doc_id, pos, text, quality_score FROM o ORDER BY quality_score DESC, doc_id, pos LIMIT 500""",
    "normalize_lines": f"WITH {_LINES} SELECT doc_id, pos, {_norm('text')} AS text FROM raw",
    "text_projections": f"""WITH {_LINES}, c AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t2, {_SHARE.format(t="text")} AS sh FROM raw)
        SELECT doc_id, pos, {_KEY.format(t="text")} AS dedup_key, {_WORDS.format(t="text")} AS words, {_TYPE.format(t="text")} AS kind, round(sh, 6) AS share, sh >= 0.7 AS valid,
        trim(regexp_replace(regexp_replace(text, '[a-zA-Z]+', '', 'g'), '\\s+', ' ', 'g')) AS rest,
        lower(trim(regexp_replace(regexp_replace(text, '[।,!?\\-–—"''()\\[\\]]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS form,
        CASE WHEN length(t2) BETWEEN 2 AND 500 AND length(regexp_replace(t2, '[^{_OWN}]', '', 'g')) >= 0.5 * length(replace(t2, ' ', '')) THEN t2 END AS clean,
        regexp_replace(translate(text, '–—', '--'), '([।,.!?])[।,.!?]*', '\\1', 'g') AS marks FROM c""",
    "digit_values": "SELECT o_orderkey, regexp_replace(o_orderpriority || '/' || o_orderkey, '[^0-9]', '', 'g')::BIGINT AS value FROM orders",
    "recording_names": """WITH n AS (SELECT o_orderkey, 'sp' || o_custkey || '_' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '_' || printf('%05d', o_orderkey) || '.wav' AS name FROM orders)
        SELECT o_orderkey, name, regexp_extract(name, '_([^_]*)\\.wav$', 1) AS prompt_id, true AS safe, true AS inside FROM n""",
    "dedup_documents": f"SELECT min(doc_id) AS doc_id, {_KEY.format(t='text')} AS dedup_key FROM documents GROUP BY 2",
    "analyze_lines": f"WITH {_SENT} SELECT doc_id, pos, char_count, word_count, len(units) AS units, len(conj) AS conjuncts, sentence_type FROM s",
    "quality_scores": f"WITH {_SCORE} SELECT doc_id, pos, quality_score FROM q",
    "filtered_counts": f"WITH {_SCORE} SELECT 'length' AS rule, count(*) AS n FROM q WHERE char_count BETWEEN 3 AND 150 UNION ALL SELECT 'quality', count(*) FROM q WHERE quality_score >= 60",
    "corpus_overview": f"""WITH {_SENT} SELECT count(*) AS total_sentences, sum(char_count)::BIGINT AS total_characters, sum(word_count)::BIGINT AS total_words,
        round(avg(char_count), 6) AS avg_sentence_length, round(sum(char_count) / 5 / 3600, 6) AS estimated_hours FROM s""",
    "unit_counts": f"WITH {_SENT}, u AS (SELECT unnest(units) AS unit FROM s) SELECT unit, count(*) AS sentences FROM u GROUP BY unit",
    "conjunct_counts": f"WITH {_SENT}, u AS (SELECT unnest(conj) AS conjunct FROM s) SELECT conjunct, count(*) AS sentences FROM u GROUP BY conjunct",
    "top_conjuncts": f"""WITH {_SENT}, u AS (SELECT doc_id, pos, unnest(conj) AS conjunct, unnest(range(len(conj))) AS i FROM s)
        SELECT conjunct, count(*) AS sentences FROM u GROUP BY conjunct ORDER BY count(*) DESC, min((doc_id, pos, i)) LIMIT 20""",
    "type_shares": f"WITH {_SENT} SELECT sentence_type, count(*) AS sentences, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS percent FROM s GROUP BY 1",
    "length_histogram": f"""WITH {_SENT}, b AS (SELECT CASE WHEN char_count <= 10 THEN '1-10' WHEN char_count <= 20 THEN '11-20' WHEN char_count <= 30 THEN '21-30' WHEN char_count <= 50 THEN '31-50'
        WHEN char_count <= 80 THEN '51-80' ELSE '80+' END AS bucket FROM s) SELECT a.bucket, count(b.bucket) AS sentences FROM (SELECT unnest({_list(BUCKETS)}) AS bucket) a LEFT JOIN b USING (bucket) GROUP BY 1""",
    "category_coverage": f"""WITH {_SENT}, i AS (SELECT unnest({_list(LATIN.labelled())}) AS unit), u AS (SELECT DISTINCT unnest(units) AS unit FROM s)
        SELECT split_part(i.unit, ':', 1) AS category, count(u.unit) AS covered, count(*) AS total, round(count(u.unit) * 100 / count(*), 6) AS percent FROM i LEFT JOIN u USING (unit) GROUP BY 1""",
    "missing_units": f"""WITH {_SENT}, i AS (SELECT unnest({_list(LATIN.labelled())}) AS unit), u AS (SELECT DISTINCT unnest(units) AS unit FROM s)
        SELECT split_part(unit, ':', 1) AS category, unit FROM i WHERE unit NOT IN (SELECT unit FROM u)""",
    "balance_types": _balance("sentence_type", [("statement", 0.60), ("question", 0.25), ("exclamation", 0.15)], "type_rank"),
    "balance_lengths": _balance("CASE WHEN char_count <= 20 THEN 'short' WHEN char_count <= 50 THEN 'medium' ELSE 'long' END", [("short", 0.25), ("medium", 0.50), ("long", 0.25)], "length_rank"),
    "select_best": f"WITH {_SCORE} SELECT doc_id, pos, quality_score FROM q WHERE char_count BETWEEN 3 AND 200 AND quality_score >= 5 ORDER BY quality_score DESC, doc_id, pos LIMIT 2000",
    "select_fallback": f"WITH {_SCORE} SELECT count(*) AS n, sum(quality_score) AS total FROM q WHERE quality_score >= 15",
    "split_sizes": """WITH n AS (SELECT count(*) AS n FROM documents), z AS (SELECT n, floor(n * 0.9::DOUBLE)::BIGINT AS a, floor(n * 0.05::DOUBLE)::BIGINT AS b FROM n)
        SELECT 'train' AS split, a AS n FROM z UNION ALL SELECT 'val', b FROM z UNION ALL SELECT 'test', n - a - b FROM z""",
    "fill_templates": """SELECT DISTINCT n_name || ' lies in ' || r_name || '.' AS text FROM nation, region UNION SELECT 'Where is ' || n_name || '?' FROM nation UNION SELECT 'All of it.'""",
    "prompt_catalogue": f"WITH {_CATALOGUE} SELECT printf('%05d', row_number() OVER (ORDER BY rank, i)) AS prompt_id, type, text, 'pending' AS status FROM g",
    "prompt_type_counts": f"WITH {_CATALOGUE} SELECT type, count(*) AS prompts FROM g GROUP BY type",
    "recording_stats": f"""WITH {_PROMPTS}, d AS (SELECT count(*) AS recordings, sum(floor(value))::DOUBLE AS t FROM events WHERE event_type = 'purchase')
        SELECT count(*) AS total_prompts, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'retry') AS retry,
        any_value(recordings) AS recordings, any_value(round(t, 2)) AS total_duration_seconds, any_value(round(t / 60, 2)) AS total_duration_minutes FROM p, d""",
    "navigate_prompts": f"""WITH {_PROMPTS}, t AS (SELECT count(*) AS total FROM p), mv AS (
        SELECT 'next 10' AS move, least(11, total - 1) AS i FROM t UNION ALL SELECT 'prev 0', 0 UNION ALL SELECT 'goto 3', total - 1 FROM t UNION ALL SELECT 'stay 7', 7
        UNION ALL SELECT 'next_pending 41', coalesce(min(idx) FILTER (WHERE idx > 41), min(idx) FILTER (WHERE idx < 41), 41) FROM p WHERE status = 'pending'
        UNION ALL SELECT 'next_pending 100000000', coalesce(min(idx), 100000000) FROM p WHERE status = 'pending')
        SELECT move, i AS index, total, b.prompt_id AS previous, c.prompt_id AS current, a.prompt_id AS next FROM mv CROSS JOIN t LEFT JOIN p c ON c.idx = i LEFT JOIN p b ON b.idx = i - 1 LEFT JOIN p a ON a.idx = i + 1""",
    "status_update": f"WITH {_PROMPTS} SELECT idx, prompt_id, CASE WHEN idx % 7 = 0 THEN 'done' ELSE status END AS status FROM p",
    "newest_recordings": """WITH n AS (SELECT user_id::VARCHAR AS prompt_id, arg_max('/r/' || event_id, (ts, event_id)) AS path FROM events GROUP BY 1)
        SELECT c_custkey::VARCHAR AS prompt_id, path FROM customer LEFT JOIN n ON n.prompt_id = c_custkey::VARCHAR""",
    "match_audio": f"WITH {_MATCH} SELECT doc_id, audio, wav FROM k",
    "ljspeech_filelist": f"WITH {_MATCH} SELECT '/data/wav/' || wav || '.wav|' || text || '|' || text AS value FROM k WHERE wav || '.wav' IN (SELECT name FROM n)",
    "recording_metadata": """WITH e AS (SELECT user_id, event_type, CASE WHEN event_id % 5 > 0 THEN floor(value)::BIGINT END AS v FROM events),
        n AS (SELECT * FROM e WHERE user_id % 2 IS DISTINCT FROM 0 OR user_id % 3 = 0 EXCEPT SELECT * FROM e WHERE user_id % 2 = 0), a AS (SELECT * FROM e WHERE user_id % 2 = 0 UNION ALL SELECT * FROM n) SELECT user_id, count(*) AS n FROM a GROUP BY 1""",
    "validate_entries": f"""WITH {_META}, {_FILES} SELECT doc_id, f.name IS NOT NULL AND text <> '' AS valid, (f.name IS NULL)::BIGINT + (text = '')::BIGINT AS n_issues, duration AS actual_duration FROM m LEFT JOIN f ON f.name = m.filename""",
    "signal_metrics": f"WITH {_signal(1000)} SELECT vec_id, round(duration, 6) AS duration, round(peak, 6) AS peak, round(rms_db, 6) AS rms_db, round(snr_db, 6) AS snr_db, round(silent_share, 6) AS silent_share FROM mt",
    "audio_verdicts": f"""WITH {_signal(100)}, {_VERDICT} SELECT vec_id, duration, clipping, rms, snr, silence_only,
        (NOT duration)::BIGINT + (NOT clipping)::BIGINT + (NOT rms)::BIGINT + (NOT snr AND told)::BIGINT + (NOT silence_only)::BIGINT AS n_issues, duration AND clipping AND rms AND snr AND silence_only AS passed FROM v""",
    "live_verdicts": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: floor(v::DOUBLE * 100000)) AS x, (vec_id % 40)::DOUBLE AS d FROM embeddings),
        m AS (SELECT vec_id, d, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) / 32767 AS rms, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM e),
        f AS (SELECT vec_id, CASE WHEN d < 0.3 THEN 30 WHEN d > 30 THEN 10 ELSE 0 END AS a, CASE WHEN d > 0 AND rms < 0.01 THEN 40 WHEN d > 0 AND rms < 0.03 THEN 20 ELSE 0 END AS b, CASE WHEN d > 0 AND peak >= 32700 THEN 25 ELSE 0 END AS c FROM m)
        SELECT vec_id, (a > 0)::BIGINT + (b > 0)::BIGINT + (c > 0)::BIGINT AS n_issues, greatest(100 - a - b - c, 0)::BIGINT AS quality_score, a + b + c = 0 AS passed FROM f""",
    "rejected_audio": f"WITH {_signal(100)}, {_VERDICT}, z AS (SELECT duration AND clipping AND rms AND snr AND silence_only AS passed FROM v) SELECT count(*) FILTER (WHERE passed) AS good, count(*) FILTER (WHERE NOT passed) AS bad FROM z",
    "duplicate_texts": "SELECT md5(text) AS hash, count(*) AS n, min(printf('%09d', doc_id)) AS first_path, max(printf('%09d', doc_id)) AS last_path FROM documents GROUP BY 1 HAVING count(*) > 1",
    "augmentation_plan": f"SELECT path, kind, factor::DOUBLE AS factor, CASE WHEN suffix = '' THEN p_partkey || '.WAV' ELSE p_partkey || suffix || '.wav' END AS output FROM {_PLAN}",
    "augmentation_stats": f"""SELECT count(*) FILTER (WHERE kind = 'original') AS original_files, count(*) FILTER (WHERE kind = 'speed') AS speed_augmented,
        count(*) FILTER (WHERE kind = 'volume') AS volume_augmented, count(*) AS total_output FROM {_PLAN}""",
    "processing_plan": "SELECT '/in/p.' || p_partkey || '.webm' AS input, '/out/p.' || p_partkey || '.wav' AS output, 'convert>trim' AS steps, '22050' AS sample_rate FROM part",
    "volume_change": f"WITH e AS (SELECT vec_id, list_sum(list_transform(embedding, lambda v: v::DOUBLE * 0.5 * v::DOUBLE * 0.5)) / len(embedding) AS ms FROM embeddings) SELECT vec_id, round({_DB.format(ms='ms')}, 6) AS rms_db FROM e",
    "diagonal_scores": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS x FROM embeddings)
        SELECT vec_id, round(list_sum(list_transform(range(0, 8), lambda i: x[i * 9 + 1])) / (list_sum(x) + 1e-8), 6) AS score FROM e""",
    "lr_schedule": """SELECT event_id, round(CASE WHEN event_id < 1000 THEN event_id / 1000 ELSE greatest(0.05, 0.5 * (1 + cos(pi() * (event_id - 1000) / 7000))) END, 9) AS factor, event_id / 10000 < 0.35 AS augment FROM events""",
    "early_stopping": f"WITH {_STOP} SELECT run, z.best AS best_value, z.n AS counter, z.stop IS NOT NULL AS stopped, z.stop AS stopped_at FROM st",
    "alignment_collapse": f"WITH {_COLLAPSE} SELECT run, step, round(recent_avg, 6) AS recent_avg, round(older_avg, 6) AS older_avg, collapsed FROM c",
    "checkpoints_kept": f"WITH {_RUNS} SELECT run, step FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY ts DESC, step DESC) <= 10",
    "latest_checkpoints": f"WITH {_RUNS} SELECT run, arg_max(path, (ts, step)) AS path FROM r GROUP BY run",
    "rollback_choice": f"WITH {_RUNS}, {_BACK} SELECT run, path FROM bk",
    "best_so_far": f"WITH {_RUNS} SELECT run, step, coalesce(value < min(value) OVER (PARTITION BY run ORDER BY ts, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM r",
    "stop_decisions": f"WITH {_STOP}, la AS (SELECT run, arg_max(score, (ts, step)) AS score FROM r GROUP BY run) SELECT run, z.stop IS NOT NULL OR score < 0.5 AS stop FROM st JOIN la USING (run)",
    "collapse_actions": f"""WITH {_COLLAPSE}, {_BACK}, z AS (SELECT run, arg_max(collapsed, (ts, step)) AS collapsed FROM c GROUP BY run)
        SELECT run, CASE WHEN NOT collapsed THEN 'continue' WHEN path IS NOT NULL THEN 'rollback' ELSE 'stop' END AS action, path FROM z LEFT JOIN bk USING (run)""",
    "mean_values": "SELECT round(coalesce(avg(value), 0), 6) AS mean FROM events",
    "word_similarity": """WITH p AS (SELECT p_partkey, p_name AS a, lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS b FROM part)
        SELECT p_partkey, round(CASE WHEN a = b THEN 1 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS similarity,
        round(len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / len(list_distinct(list_concat(string_split(a, ''), string_split(b, '')))), 6) AS overlap FROM p""",
}
