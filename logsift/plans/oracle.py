"""DuckDB oracle SQL for the query catalog.

Each query is stated independently in SQL over the driver's tables: the
fixture is rebuilt as CTEs (FIXTURES.md) and the expected result is derived
either from the same rule in SQL or from the fields the fixture was built from.
"""

from __future__ import annotations

from ..functions.patterns import ENGLISH_STOP_WORDS

# Token pattern of the text features, stated here on its own.
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"

MSG = """case event_type
  when 'error'    then 'Connection refused for user '||user_id||' after '||k||'ms'
  when 'purchase' then 'Slow query detected ('||k||'ms) for user '||user_id
  else 'user '||user_id||' '||event_type||' ok in '||k||'ms' end"""

EV = """ev AS (SELECT event_id, ts, user_id, event_type, value,
       cast(regexp_extract(props,'([0-9]+)',1) as int) AS k,
       substring(cast(ts as varchar),1,19) AS t,
       case event_type when 'error' then 'ERROR' when 'purchase' then 'WARNING'
                       when 'click' then 'DEBUG' else 'INFO' end AS lvl
FROM events)"""

FX1 = f"""fx1 AS (SELECT event_id, t, lvl, event_type, user_id, k,
  t||' ['||lvl||'] '||event_type||'_service: '||{MSG} AS line FROM ev)"""

FX2 = """fx2 AS (SELECT page_id, url, html,
  case page_id%6 when 0 then 200 when 1 then 201 when 2 then 301 when 3 then 404 when 4 then 500 else 503 end AS st,
  '10.0.0.'||(page_id%256)||' - - [10/Oct/2000:13:'||lpad(cast(page_id%60 as varchar),2,'0')
  ||':36 -0700] "GET '||url||' HTTP/1.1" '
  ||(case page_id%6 when 0 then 200 when 1 then 201 when 2 then 301 when 3 then 404 when 4 then 500 else 503 end)
  ||' '||(case when page_id%9=0 then '-' else cast(length(html) as varchar) end) AS line
FROM pages)"""

FX3 = f"""fx3 AS (SELECT event_id+1 AS line_no, t AS timestamp, {MSG} AS message, lvl AS level,
  cast(case when event_type='signup' then null else (k%5+1)*100 end as integer) AS http_status,
  case when k%7=0 then null else cast(k*100 as double) end AS response_size,
  case when k%11=0 then null else value end AS response_time,
  cast((k*37+user_id*11)%1000 as double)/1000 AS anomaly_score,
  cast(case when (k*37+user_id*11)%1000>=950 then 1 else 0 end as integer) AS is_anomaly
FROM ev)"""

FX4 = f"""fx4 AS (SELECT event_id, case when event_id%50=0 then '{{broken' when event_id%50=1 then ''
  else '{{"time":"'||t||'","severity":"'||lower(lvl)||'",'
       ||case when event_id%10=3 then '"level":null,' else '' end
       ||'"msg":"'||{MSG}||'","status":'||((k%5+1)*100)||',"latency_ms":'||value||'}}' end AS line
FROM ev)"""

FX5 = f"""fx5 AS (SELECT event_id, t, lvl, k, value, {MSG} AS msg,
  case when k%4=0 then '' else cast((k%5+1)*100 as varchar) end AS status_text,
  t||','||lvl||',"'||{MSG}||'",'
  ||case when k%4=0 then '' else cast((k%5+1)*100 as varchar) end||','||(k*100)||','||value AS line
FROM ev)"""

FX6 = """fx6 AS (SELECT event_id, 'worker '||user_id||case event_type when 'error' then ' FATAL crash'
    when 'purchase' then ' warn backlog' else ' done' end
  ||case when k%2=0 then ' status '||((k%5+1)*100) else '' end
  ||' took '||k||case when k%3=0 then ' sec' else 'ms' end AS line
FROM ev)"""

FX7 = "fx7 AS (SELECT doc_id, text FROM documents)"


FX8 = """fx8 AS (SELECT event_id, t, lvl, event_type, k, '198.51.'||(user_id%3)||'.'||(user_id%40) AS ip FROM ev)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- shared SQL expressions ------------------------------------------------------

ERROR_WORDS = r"(?i)\b(error|exception|fail|fatal|critical|traceback|segfault|oom|kill|crash|timeout|refused|denied)\b"
STATUS = r"\b([1-5][0-9][0-9])\b"
MILLIS = "(?i)([0-9]+(?:[.][0-9]+)?)[ ]*ms"
SECONDS = r"(?i)([0-9]+(?:[.][0-9]+)?)[ ]*s(?:ec)?\b"
BLANK = "(blank line)"
FAILURE_TAGS = {
    "connection": r"(?i)\b(refused|connection|unreachable|timeout|timed out)\b",
    "circuit_breaker": r"(?i)\b(circuit|breaker)\b",
    "oom": r"(?i)\b(oom|out of memory|killed)\b",
    "disk": r"(?i)\b(disk|filesystem|no space|read-only|i/o error)\b",
}


def level_weight(c: str) -> str:
    return (f"cast(CASE WHEN upper({c}) IN ('DEBUG', 'TRACE') THEN 0 WHEN upper({c}) = 'NOTICE' THEN 2 "
            f"WHEN upper({c}) IN ('WARNING', 'WARN') THEN 3 WHEN upper({c}) = 'ERROR' THEN 4 "
            f"WHEN upper({c}) IN ('CRITICAL', 'FATAL', 'EMERG', 'ALERT') THEN 5 ELSE 1 END AS DOUBLE)")


def http_sev(c: str) -> str:
    return (f"cast(CASE WHEN {c} IS NULL THEN 1.0 WHEN {c} < 300 THEN 0.0 WHEN {c} < 400 THEN 1.0 "
            f"WHEN {c} < 500 THEN 2.0 ELSE 4.0 END AS DOUBLE)")


def kw(c: str) -> str:
    return f"coalesce(regexp_matches({c}, {q(ERROR_WORDS)}), false)"


def ts_parse(c: str) -> str:
    return f"try_cast({c} AS TIMESTAMP)"


def hour(c: str) -> str:
    return f"cast(coalesce(hour({ts_parse(c)}), 0) as double)"


def minute_text(c: str) -> str:
    return f"strftime(date_trunc('minute', {ts_parse(c)}), '%Y-%m-%d %H:%M:%S')"


def features_cte(src: str = "fx3") -> str:
    return f"""feat AS (SELECT *,
  {level_weight('level')} AS severity_score,
  {http_sev('http_status')} AS http_status_sev,
  ln(1 + coalesce(response_size, 0)) AS f_response_size,
  ln(1 + coalesce(response_time, 0)) AS f_response_time,
  {hour('timestamp')} AS hour_of_day,
  cast(CASE WHEN {kw('message')} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS error_keyword,
  cast(coalesce(http_status, 200) as double) AS http_code
FROM {src})"""


STRUCTURED = ["severity_score", "http_status_sev", "f_response_size", "f_response_time",
              "hour_of_day", "error_keyword", "http_code"]


def syslog_cte(src: str = "fx1", key: str = "event_id") -> str:
    """The parts that the fixture's lines were put together from."""
    return f"""sys AS (SELECT row_number() OVER (ORDER BY {key}) AS line_no, line,
  t AS timestamp, lvl AS level, event_type||'_service' AS component, {MSG} AS message
FROM {src})"""


def free_level(c: str) -> str:
    arms = " ".join(f"WHEN upper({c}) LIKE '%{l}%' THEN '{l}'"
                    for l in ("FATAL", "CRITICAL", "ERROR", "WARNING", "WARN", "INFO", "DEBUG", "TRACE"))
    return f"(CASE {arms} ELSE 'INFO' END)"


def free_status(c: str) -> str:
    return f"try_cast(nullif(regexp_extract({c}, {q(STATUS)}, 1), '') AS INTEGER)"


def free_rt(c: str) -> str:
    return (f"coalesce(try_cast(nullif(regexp_extract({c}, {q(MILLIS)}, 1), '') AS DOUBLE), "
            f"try_cast(nullif(regexp_extract({c}, {q(SECONDS)}, 1), '') AS DOUBLE) * 1000)")


def grams_ctes(src: str = "fx7") -> str:
    stop = "[" + ", ".join(q(w) for w in ENGLISH_STOP_WORDS) + "]"
    return f"""toks AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), {q(TOKEN_RE)}),
      lambda t: NOT list_contains({stop}, t)) AS u FROM {src}),
grams AS (SELECT doc_id, list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])) AS g
  FROM toks),
terms AS (SELECT doc_id, unnest(g) AS term FROM grams),
stats AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM terms GROUP BY term),
ndoc AS (SELECT count(*) AS n FROM {src}),
vocab AS (SELECT term, tf, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM stats, ndoc ORDER BY tf DESC, term LIMIT 50)"""


def json_first(c: str, keys: list[str], default: str) -> str:
    arms = " ".join(f"WHEN json_exists({c}, {q('$.' + k)}) THEN json_extract_string({c}, {q('$.' + k)})"
                    for k in keys)
    return f"(CASE {arms} ELSE {default} END)"


def json_level(c: str) -> str:
    arms = " ".join(f"WHEN json_exists({c}, {q('$.' + k)}) THEN coalesce(json_extract_string({c}, {q('$.' + k)}), 'None')"
                    for k in ("level", "severity", "log_level"))
    return f"upper(CASE {arms} ELSE 'INFO' END)"


# --- the queries -----------------------------------------------------------------

def sql_queries() -> dict[str, str]:
    S: dict[str, str] = {}
    F3 = with_(EV, FX3)
    F3F = with_(EV, FX3, features_cte())

    S["raw_line_split"] = with_(EV, FX1) + "SELECT row_number() OVER (ORDER BY event_id) AS line_no, line FROM fx1"

    S["syslog_parse"] = with_(EV, FX1, syslog_cte()) + \
        "SELECT line_no, timestamp, level, component, message FROM sys"

    S["apache_parse"] = with_(FX2) + """SELECT row_number() OVER (ORDER BY page_id) AS line_no,
  '10.0.0.'||(page_id%256) AS client_ip,
  '10/Oct/2000:13:'||lpad(cast(page_id%60 as varchar),2,'0')||':36 -0700' AS timestamp,
  'GET '||url AS message,
  CASE WHEN st >= 500 THEN 'ERROR' WHEN st >= 400 THEN 'WARNING' ELSE 'INFO' END AS level,
  st AS http_status,
  CASE WHEN page_id%9=0 THEN NULL ELSE cast(length(html) as double) END AS response_size,
  '2000-10-10 13:'||lpad(cast(page_id%60 as varchar),2,'0')||':36' AS ts_parsed
FROM fx2"""

    S["fallback_parse"] = with_(EV, FX6) + f"""SELECT row_number() OVER (ORDER BY event_id) AS line_no,
  {free_level('line')} AS level, {free_status('line')} AS http_status, {free_rt('line')} AS response_time,
  line AS message FROM fx6"""

    S["mixed_raw_parse"] = _mixed_sql()

    S["ndjson_parse"] = with_(EV, FX4) + f"""SELECT row_number() OVER (ORDER BY event_id) AS line_no, line AS raw_line,
  {json_first('line', ['timestamp', 'time', '@timestamp', 'date'], "''")} AS timestamp,
  coalesce({json_first('line', ['message', 'msg', 'log', 'body'], "''")}, '') AS message,
  {json_level('line')} AS level,
  try_cast({json_first('line', ['status', 'status_code', 'http_status'], 'NULL')} AS INTEGER) AS http_status,
  try_cast({json_first('line', ['size', 'bytes', 'response_size'], 'NULL')} AS DOUBLE) AS response_size,
  try_cast({json_first('line', ['duration', 'response_time', 'elapsed', 'latency_ms'], 'NULL')} AS DOUBLE) AS response_time
FROM fx4 WHERE line <> '' AND json_valid(line)"""

    S["csv_multiline"] = with_(EV) + f"""SELECT row_number() OVER (ORDER BY event_id) AS line_no, t AS timestamp,
  {MSG}||chr(10)||'detail "'||k||'", end' AS message, lvl AS level,
  cast(CASE WHEN k%4<>0 THEN (k%5+1)*100 END AS INTEGER) AS http_status, cast(k*100 AS DOUBLE) AS response_size,
  cast(value AS DOUBLE) AS response_time FROM ev"""

    S["csv_parse"] = with_(EV, FX5) + """SELECT row_number() OVER (ORDER BY event_id) AS line_no,
  t||' '||lvl||' '||msg||' '||status_text||' '||(k*100)||' '||value AS raw_line,
  t AS timestamp, msg AS message, upper(lvl) AS level,
  try_cast(nullif(status_text, '') AS INTEGER) AS http_status,
  cast(k*100 as double) AS response_size, value AS response_time
FROM fx5"""

    S["format_sniff"] = with_(EV, FX1, FX4, FX5) + """,
h1 AS (SELECT trim(line) AS l FROM fx1 WHERE trim(line) <> '' ORDER BY event_id LIMIT 20),
h4 AS (SELECT trim(line) AS l FROM fx4 WHERE trim(line) <> '' ORDER BY event_id LIMIT 20),
h5 AS (SELECT trim(line) AS l FROM fx5 WHERE trim(line) <> '' ORDER BY event_id LIMIT 20)
SELECT 'fx1' AS fixture, CASE WHEN (SELECT avg(CASE WHEN l LIKE '{%' THEN 1.0 ELSE 0.0 END) FROM h1) >= 0.5 THEN 'json'
  WHEN (SELECT length(line) - length(replace(line, ',', '')) FROM fx1 ORDER BY event_id LIMIT 1) >= 2 THEN 'csv'
  ELSE 'raw' END AS format
UNION ALL
SELECT 'fx4', CASE WHEN (SELECT avg(CASE WHEN l LIKE '{%' THEN 1.0 ELSE 0.0 END) FROM h4) >= 0.5 THEN 'json'
  WHEN (SELECT length(line) - length(replace(line, ',', '')) FROM fx4 ORDER BY event_id LIMIT 1) >= 2 THEN 'csv'
  ELSE 'raw' END
UNION ALL
SELECT 'fx5', CASE WHEN (SELECT avg(CASE WHEN l LIKE '{%' THEN 1.0 ELSE 0.0 END) FROM h5) >= 0.5 THEN 'json'
  ELSE 'csv' END"""

    S["line_numbers"] = with_(EV, FX4) + """SELECT row_number() OVER (ORDER BY event_id) AS line_no, line AS raw_line
FROM fx4 WHERE line <> '' AND json_valid(line)"""

    S["structured_features"] = F3F + "SELECT line_no, " + ", ".join(
        f"round({c}, 6) AS {c}" for c in STRUCTURED) + " FROM feat"

    names = {"f_response_size": "response_size", "f_response_time": "response_time"}
    S["feature_view"] = F3F + "SELECT line_no, " + ", ".join(
        f"round({c}, 4) AS {names.get(c, c)}" for c in STRUCTURED) + " FROM feat"

    S["tfidf_vocab"] = with_(FX7, grams_ctes()) + "SELECT term, tf, df, round(idf, 9) AS idf FROM vocab"

    S["tfidf_weights"] = with_(FX7, grams_ctes()) + """,
cnt AS (SELECT doc_id, term, count(*) AS c FROM terms WHERE term IN (SELECT term FROM vocab) GROUP BY doc_id, term),
w AS (SELECT doc_id, term, (1 + ln(c)) * idf AS w FROM cnt JOIN vocab USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM w"""

    S["robust_scale"] = F3F + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median,
  round(quantile_cont({c}, 0.75), 6) AS q75,
  round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr,
  round(CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1.0
        ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END, 6) AS scale FROM feat""" for c in STRUCTURED)

    S["minmax_score"] = F3 + """SELECT line_no, round(CASE WHEN hi = lo THEN 0.0 ELSE (anomaly_score - lo) / (hi - lo) END, 6)
  AS score_norm FROM fx3, (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM fx3) b"""

    S["quantile_threshold"] = F3 + """, th AS (SELECT CASE WHEN quantile_cont(anomaly_score, 0.95) = max(anomaly_score)
    THEN quantile_cont(anomaly_score, 0.90) ELSE quantile_cont(anomaly_score, 0.95) END AS threshold,
    max(anomaly_score) AS max_score FROM fx3)
SELECT round(threshold, 9) AS threshold, round(max_score, 9) AS max_score,
  (SELECT count(*) FROM fx3 WHERE anomaly_score >= threshold) AS n_flagged FROM th"""

    gt = f"""p95 AS (SELECT coalesce(quantile_cont(response_time, 0.95), 'Infinity'::DOUBLE) AS p FROM fx3),
gt AS (SELECT fx3.*, concat_ws(',',
   CASE WHEN upper(level) IN ('ERROR', 'CRITICAL', 'FATAL', 'EMERG', 'ALERT') THEN 'error_level' END,
   CASE WHEN http_status >= 500 THEN 'server_error' END,
   CASE WHEN {kw('message')} THEN 'error_keyword' END,
   CASE WHEN response_time > p THEN 'slow_response' END) AS reasons FROM fx3, p95)"""
    S["ground_truth"] = with_(EV, FX3, gt) + \
        "SELECT line_no, CASE WHEN reasons <> '' THEN 1 ELSE 0 END AS gt, reasons FROM gt"

    S["evaluation_metrics"] = with_(EV, FX3, gt) + """, c AS (SELECT
  count(*) FILTER (WHERE is_anomaly = 1 AND reasons <> '') AS tp,
  count(*) FILTER (WHERE is_anomaly = 1 AND reasons = '') AS fp,
  count(*) FILTER (WHERE is_anomaly <> 1 AND reasons <> '') AS fn,
  count(*) FILTER (WHERE is_anomaly <> 1 AND reasons = '') AS tn, count(*) AS n FROM gt),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)
SELECT tp, fp, fn, tn, round_even(p * 100, 1) AS precision, round_even(r * 100, 1) AS recall,
  round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END * 100, 1) AS f1,
  round_even(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END * 100, 1) AS fpr,
  round_even(CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0 END * 100, 1) AS estimated_accuracy,
  tp + fn AS gt_anomalies FROM r"""

    S["kpi_summary"] = F3 + """SELECT count(*) AS total_lines, cast(coalesce(sum(is_anomaly), 0) as bigint) AS anomalies,
  CASE WHEN count(*) > 0 THEN round_even(100.0 * sum(is_anomaly) / count(*), 1) ELSE 0.0 END AS pct FROM fx3"""

    S["minute_volume"] = F3 + f"""SELECT {minute_text('timestamp')} AS minute, count(*) AS count FROM fx3
WHERE {ts_parse('timestamp')} IS NOT NULL GROUP BY 1"""

    S["minute_anomalies"] = F3 + f"""SELECT {minute_text('timestamp')} AS minute, count(*) AS anom_count FROM fx3
WHERE {ts_parse('timestamp')} IS NOT NULL AND is_anomaly = 1 GROUP BY 1"""

    S["anomaly_events"] = F3 + f""", vol AS (SELECT {minute_text('timestamp')} AS minute, count(*) AS cnt FROM fx3
  WHERE {ts_parse('timestamp')} IS NOT NULL GROUP BY 1)
SELECT line_no, strftime({ts_parse('timestamp')}, '%Y-%m-%d %H:%M:%S') AS ts, a.minute, anomaly_score,
  coalesce(cnt, 1) AS minute_count
FROM (SELECT *, {minute_text('timestamp')} AS minute FROM fx3
      WHERE {ts_parse('timestamp')} IS NOT NULL AND is_anomaly = 1) a LEFT JOIN vol USING (minute)"""

    S["score_histogram"] = F3 + f""", b AS (SELECT is_anomaly,
  CASE WHEN is_anomaly = 1 THEN 20 ELSE 40 END AS n_bins, anomaly_score FROM fx3)
SELECT is_anomaly, cast(least(greatest(floor(anomaly_score * n_bins) + 1, 1), n_bins) as integer) AS bin,
  round((least(greatest(floor(anomaly_score * n_bins) + 1, 1), n_bins) - 1) / n_bins, 6) AS lo,
  round(least(greatest(floor(anomaly_score * n_bins) + 1, 1), n_bins) / n_bins, 6) AS hi,
  count(*) AS count FROM b GROUP BY ALL"""

    S["score_histogram_line"] = F3 + """, th AS (SELECT round(CASE WHEN quantile_cont(anomaly_score, 0.95) = max(anomaly_score)
    THEN quantile_cont(anomaly_score, 0.90) ELSE quantile_cont(anomaly_score, 0.95) END, 9) AS threshold FROM fx3),
b AS (SELECT is_anomaly, CASE WHEN is_anomaly = 1 THEN 20 ELSE 40 END AS n_bins, anomaly_score FROM fx3),
h AS (SELECT is_anomaly, n_bins, least(greatest(floor(anomaly_score * n_bins) + 1, 1), n_bins) AS bin, count(*) AS count FROM b GROUP BY ALL)
SELECT is_anomaly, cast(bin as integer) AS bin, round((bin - 1) / n_bins, 6) AS lo, round(bin / n_bins, 6) AS hi, count, threshold,
  bin = least(greatest(floor(threshold * n_bins) + 1, 1), n_bins) AS at_threshold FROM h, th"""

    S["level_breakdown"] = with_(EV, FX1) + """SELECT lvl AS level, count(*) AS count,
  round(count(*) / (SELECT count(*) FROM fx1), 6) AS share FROM fx1 GROUP BY lvl"""

    prof = []
    for c in ("severity_score", "http_status_sev", "f_response_size", "f_response_time", "hour_of_day", "error_keyword"):
        prof.append(f"""SELECT '{c}' AS feature,
  round(coalesce(avg(CASE WHEN is_anomaly = 1 THEN CASE WHEN hi = lo THEN 0.0 ELSE ({c} - lo) / (hi - lo) END END), 0.0), 6)
    AS anomaly_mean,
  round(avg(CASE WHEN is_anomaly <> 1 THEN CASE WHEN hi = lo THEN 0.0 ELSE ({c} - lo) / (hi - lo) END END), 6)
    AS normal_mean
FROM feat, (SELECT min({c}) AS lo, max({c}) AS hi FROM feat) b""")
    S["feature_profile"] = F3F + " UNION ALL ".join(prof)

    S["severity_pivot"] = F3 + f"""SELECT strftime({ts_parse('timestamp')}, '%H:%M') AS minute_str, """ + ", ".join(
        f"count(*) FILTER (WHERE upper(level) = '{l}') AS {l}" for l in ("DEBUG", "INFO", "NOTICE", "WARNING", "WARN", "ERROR", "CRITICAL", "FATAL")) + \
        f" FROM fx3 WHERE {ts_parse('timestamp')} IS NOT NULL GROUP BY 1"

    band = "CASE WHEN anomaly_score >= 0.75 THEN 'high' WHEN anomaly_score >= 0.5 THEN 'medium' ELSE 'low' END"
    disp = (f"line_no AS Line, timestamp AS Timestamp, level AS Level, http_status AS Status, "
            f"anomaly_score AS Score, message AS Message, {band} AS Band")
    S["anomaly_table"] = F3 + f"SELECT {disp} FROM fx3 WHERE is_anomaly = 1"
    S["all_lines_table"] = F3 + f"SELECT {disp} FROM fx3"

    S["top_anomalies"] = F3 + f""", top AS (SELECT * FROM fx3 WHERE is_anomaly = 1
  ORDER BY anomaly_score DESC, line_no LIMIT 12)
SELECT line_no, 'L'||line_no||' · '||level||' · '||substring(coalesce(message, ''), 1, 40) AS label,
  anomaly_score, round(0.4 + 0.6 * (anomaly_score - lo) / greatest(hi - lo, 1e-6), 6) AS emphasis
FROM top, (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM top) b"""

    S["explain_cards"] = F3 + f""", top AS (SELECT * FROM fx3 WHERE is_anomaly = 1
  ORDER BY anomaly_score DESC, line_no LIMIT 5)
SELECT line_no,
  'Line '||repeat(' ', greatest(4 - length(cast(line_no as varchar)), 0))||line_no||'  |  ['||level||']  |  Score '||printf('%.4f', anomaly_score)
    ||'  |  '||substring(coalesce(message, ''), 1, 70)
    ||CASE WHEN length(coalesce(message, '')) > 70 THEN '…' ELSE '' END AS header,
  coalesce(timestamp, 'None')||' · Line '||line_no||' · '||level AS context,
  coalesce(message, '') AS text FROM top"""

    S["enrich_distinct"] = F3 + f""", a AS (SELECT line_no, trim(coalesce(message, '')) AS x
  FROM fx3 WHERE is_anomaly = 1)
SELECT line_no, CASE WHEN x = '' THEN {q(BLANK)}
  ELSE upper(substring(x, 1, 30))||' ('||length(x)||' chars)' END AS explanation FROM a"""

    S["csv_sink_roundtrip"] = F3 + """SELECT line_no, timestamp, message, level, http_status, response_size, response_time,
  anomaly_score, is_anomaly FROM fx3"""

    S["latency_spikes"] = F3 + """, m AS (SELECT quantile_cont(response_time, 0.5) AS med FROM fx3)
SELECT line_no, response_time, round(med, 6) AS median_rt FROM fx3, m WHERE response_time > 10 * med"""

    S["size_outliers"] = F3 + """, m AS (SELECT quantile_cont(response_size, 0.25) AS a, quantile_cont(response_size, 0.5) AS med,
  quantile_cont(response_size, 0.75) AS b FROM fx3),
z AS (SELECT line_no, response_size, abs(response_size - med) / CASE WHEN b - a = 0 THEN 1.0 ELSE b - a END AS rz
  FROM fx3, m)
SELECT line_no, response_size, round(rz, 6) AS robust_z FROM z WHERE rz > 3"""

    S["severity_bursts"] = with_(EV, FX1) + f""", hs AS (SELECT row_number() OVER (ORDER BY event_id) AS line_no, lvl,
  event_type||'_service' AS component, t, epoch({ts_parse('t')}) AS sec FROM fx1),
c AS (SELECT line_no, component, t, count(*) OVER (PARTITION BY component ORDER BY sec
  RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS burst_count FROM hs WHERE {level_weight('lvl')} >= 4)
SELECT line_no, component, t AS ts, burst_count FROM c WHERE burst_count >= 3"""

    S["rare_vocabulary"] = with_(FX7, grams_ctes()) + """,
dt AS (SELECT DISTINCT doc_id, term FROM terms),
pd AS (SELECT doc_id, avg(ln((1 + n) / (1 + df)) + 1) AS m, count(*) AS n_terms
  FROM dt JOIN stats USING (term), ndoc GROUP BY doc_id)
SELECT doc_id, round(m, 6) AS mean_idf, n_terms FROM pd ORDER BY round(m, 6) DESC, doc_id LIMIT 20"""

    S["client_error_rate"] = with_(FX2) + """SELECT '10.0.0.'||(page_id%256) AS client_ip,
  '2000-10-10 13:'||lpad(cast(page_id%60 as varchar),2,'0')||':00' AS minute,
  count(*) AS requests, count(*) FILTER (WHERE st >= 400 AND st < 500) AS client_errors,
  round(count(*) FILTER (WHERE st >= 400 AND st < 500) / count(*), 6) AS error_rate
FROM fx2 GROUP BY 1, 2"""

    S["server_errors"] = with_(FX2) + """SELECT line_no, client_ip, http_status, message FROM (
  SELECT row_number() OVER (ORDER BY page_id) AS line_no, '10.0.0.'||(page_id%256) AS client_ip, st AS http_status,
  'GET '||url AS message FROM fx2) WHERE http_status >= 500"""

    S["off_hours"] = F3 + f"""SELECT line_no, {hour('timestamp')} AS hour_of_day FROM fx3
WHERE {hour('timestamp')} < 8 OR {hour('timestamp')} >= 18"""

    S["volume_bursts"] = F3 + f""", pm AS (SELECT {minute_text('timestamp')} AS minute, count(*) AS count FROM fx3
  WHERE {ts_parse('timestamp')} IS NOT NULL GROUP BY 1),
st AS (SELECT avg(count) AS mu, stddev_pop(count) AS sd FROM pm)
SELECT minute, count, round(CASE WHEN sd > 0 THEN (count - mu) / sd ELSE 0.0 END, 6) AS z,
  CASE WHEN sd > 0 AND (count - mu) / sd > 3 THEN 1 ELSE 0 END AS is_burst FROM pm, st"""

    S["failed_logins"] = with_(EV, FX8) + f""", f AS (
  SELECT ip, {ts_parse('t')} AS ts FROM fx8 WHERE event_type IN ('error', 'click') AND {ts_parse('t')} IS NOT NULL),
g AS (SELECT ip, ts, CASE WHEN lag(ts) OVER (PARTITION BY ip ORDER BY ts) IS NULL
    OR ts - lag(ts) OVER (PARTITION BY ip ORDER BY ts) >= INTERVAL 60 SECOND THEN 1 ELSE 0 END AS new_s FROM f),
s AS (SELECT ip, ts, sum(new_s) OVER (PARTITION BY ip ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT ip, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start,
  strftime(max(ts) + INTERVAL 60 SECOND, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS attempts,
  CASE WHEN count(*) >= 3 THEN 1 ELSE 0 END AS is_attack FROM s GROUP BY ip, sid"""

    S["normal_table"] = F3 + f"SELECT {disp} FROM fx3 WHERE is_anomaly = 0"
    S["explain_top"] = F3 + f""", top AS (SELECT * FROM fx3 WHERE is_anomaly = 1 ORDER BY anomaly_score DESC, line_no LIMIT 50),
a AS (SELECT *, trim(coalesce(message, '')) AS x FROM top)
SELECT line_no, anomaly_score, substring(coalesce(message, ''), 1, 80) AS preview,
  CASE WHEN x = '' THEN {q(BLANK)} ELSE upper(substring(x, 1, 30))||' ('||length(x)||' chars)' END
    AS explanation FROM a"""

    S |= _given_model_sql()

    tags = ", ".join(f"CASE WHEN regexp_matches(message, {q(p)}) THEN '{n}' END" for n, p in FAILURE_TAGS.items())
    S["failure_tags"] = with_(EV, FX1, syslog_cte()) + f"""SELECT line_no, tags FROM (
  SELECT line_no, concat_ws(',', {tags}) AS tags FROM sys) WHERE tags <> ''"""
    return S


def _mixed_sql() -> str:
    """FX1, FX2 and FX6 interleaved in the same files (key = id * 3 + source)."""
    return with_(EV, FX1, FX2, FX6) + f""", m AS (
  SELECT event_id * 3 AS key, line, 'sys' AS src, NULL::BIGINT AS page_id, NULL::VARCHAR AS url,
    NULL::INTEGER AS st, NULL::VARCHAR AS html, t, lvl, event_type, {MSG} AS msg FROM fx1
  UNION ALL SELECT page_id * 3 + 1, line, 'ap', page_id, url, st, html, NULL, NULL, NULL, NULL FROM fx2
  UNION ALL SELECT event_id * 3 + 2, line, 'free', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM fx6)
SELECT row_number() OVER (ORDER BY key) AS line_no, line AS raw_line,
  CASE src WHEN 'sys' THEN t
           WHEN 'ap' THEN '10/Oct/2000:13:'||lpad(cast(page_id%60 as varchar),2,'0')||':36 -0700' END AS timestamp,
  CASE src WHEN 'sys' THEN msg WHEN 'ap' THEN 'GET '||url ELSE line END AS message,
  CASE src WHEN 'sys' THEN lvl
           WHEN 'ap' THEN CASE WHEN st >= 500 THEN 'ERROR' WHEN st >= 400 THEN 'WARNING' ELSE 'INFO' END
           ELSE {free_level('line')} END AS level,
  CASE src WHEN 'ap' THEN st WHEN 'free' THEN {free_status('line')} END AS http_status,
  CASE WHEN src = 'ap' AND page_id%9 <> 0 THEN cast(length(html) as double) END AS response_size,
  CASE src WHEN 'free' THEN {free_rt('line')} END AS response_time,
  CASE src WHEN 'ap' THEN '10.0.0.'||(page_id%256) END AS client_ip,
  CASE src WHEN 'sys' THEN event_type||'_service' END AS component
FROM m"""


def _given_model_sql() -> dict[str, str]:
    """Scores and labels of the models that are stated by rule: forest walk, kernel features, bounds and threshold."""
    cells = ", ".join(f"({c} - quantile_cont({c}, 0.5) OVER ()) / coalesce(nullif(quantile_cont({c}, 0.75) OVER () "
                      f"- quantile_cont({c}, 0.25) OVER (), 0), 1.0)" for c in STRUCTURED)
    walk = "SELECT line_no, t, x, 0 AS node FROM x, range(12) r(t)"
    for _ in range(4):
        walk = (f"SELECT line_no, t, x, 2 * node + CASE WHEN x[(t * 3 + node * 5) % 7 + 1] <= ((t * 5 + node * 3) % 9 - 3) / 4.0 "
                f"THEN 1 ELSE 2 END AS node FROM ({walk})")
    base = with_(EV, FX3, features_cte()) + f""", x AS (SELECT line_no, [{cells}] AS x FROM feat),
iso AS (SELECT line_no, pow(2.0, -avg(4 + ((t + node) % 5) / 2.0) / (2 * (ln(255.0) + 0.5772156649) - 2 * 255.0 / 256)) AS iso
  FROM ({walk}) GROUP BY line_no)"""
    turned = " + ".join(f"x[{i + 1}] * sqrt(2 * gamma) * (({i} * 31 + j * 17) % 13 - 6) / 4.0" for i in range(7))
    raw = base + f""", g AS (SELECT 1 / (7 * var_pop(v)) AS gamma FROM (SELECT unnest(x) AS v FROM x)),
s AS (SELECT line_no, round(sum(((j * 5) % 7 - 2) / 10.0 * sqrt(2 / 16.0) * cos({turned} + 2 * pi() * ((j * 7) % 13) / 13.0)), 9) AS s
  FROM x, g, range(16) r(j) GROUP BY line_no),
rho AS (SELECT quantile_cont(s, 0.05) AS rho FROM s),
raw AS (SELECT line_no, iso, rho - s AS svm, gamma, rho FROM iso JOIN s USING (line_no), g, rho)"""
    return {
        "forest_walk": base + " SELECT line_no, round(iso, 6) AS iso_score FROM iso",
        "svm_products": raw + """ SELECT line_no, round(svm, 6) AS svm_score, cast(svm > 0 AS INTEGER) AS outside,
  round(gamma, 6) AS gamma, round(rho, 6) AS rho FROM raw""",
        "ensemble_labels": raw + """, e AS (SELECT line_no,
  0.5 * ((iso - min(iso) OVER ()) / (max(iso) OVER () - min(iso) OVER ())) + 0.5 * ((svm - min(svm) OVER ()) / (max(svm) OVER () - min(svm) OVER ())) AS score
  FROM raw),
t AS (SELECT CASE WHEN quantile_cont(score, 0.95) = max(score) THEN quantile_cont(score, 0.9) ELSE quantile_cont(score, 0.95) END AS threshold FROM e)
SELECT line_no, round_even(score, 4) AS anomaly_score, cast(score >= threshold AS INTEGER) AS is_anomaly, round(threshold, 6) AS threshold FROM e, t""",
    }
