"""Fixed values that must equal the reference's for identical results.

Everything in this module is a constant: regular expressions, level names and
weights, and the column-alias lists used to recognise CSV headers and JSON
keys.  They are stated plainly, in their natural order.
"""

# --- fixed values: line shapes (Java regex syntax, positional groups) -------

# Apache / Nginx combined log: ip, ident, auth, [time], "method path proto",
# status, size, optional "referrer" "agent".  Anchored prefix match.
# groups: 1 ip, 2 time, 3 method, 4 path, 5 status, 6 size
APACHE_RE = (
    r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)?\s*(\S+)?\s*\S+"\s+(\d{3})\s+(\S+)'
)

# Syslog-like: 2024-01-15 12:34:56[.f][Z|+hh:mm] [LEVEL] component: message
# groups: 1 time, 2 level, 3 component, 4 message
SYSLOG_RE = (
    r'^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)'
    r'(?:\s+\[([A-Z]+)\])?'
    r'(?:\s+(\S+):)?'
    r'\s*(.*)'
)

# Free text: first 3-digit number 100-599 as a whole word.
STATUS_IN_TEXT_RE = r'\b([1-5]\d{2})\b'
# Free text: "<n> ms" (no word boundary), else "<n> s" / "<n> sec" (seconds).
MILLIS_IN_TEXT_RE = r'(?i)(\d+(?:\.\d+)?)\s*ms'
SECONDS_IN_TEXT_RE = r'(?i)(\d+(?:\.\d+)?)\s*s(?:ec)?\b'

# Error keywords, whole words, case-insensitive.
ERROR_KEYWORDS = [
    "error", "exception", "fail", "fatal", "critical", "traceback", "segfault",
    "oom", "kill", "crash", "timeout", "refused", "denied",
]
ERROR_KEYWORD_RE = r'(?i)\b(' + "|".join(ERROR_KEYWORDS) + r')\b'

# Apache time without its zone (first 20 characters), for hour-of-day.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
APACHE_TIME_RE = r"^[0-9]{2}/(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2}"

# Line separators that Python's str.splitlines honours beyond \n, \r, \r\n.
EXTRA_LINE_BREAKS_RE = "[\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"

# --- fixed values: levels ----------------------------------------------------

# Level -> severity weight; anything else weighs 1.
LEVEL_WEIGHTS = {
    "DEBUG": 0, "TRACE": 0,
    "INFO": 1,
    "NOTICE": 2,
    "WARNING": 3, "WARN": 3,
    "ERROR": 4,
    "CRITICAL": 5, "FATAL": 5, "EMERG": 5, "ALERT": 5,
}
UNKNOWN_LEVEL_WEIGHT = 1

# Order in which free text is searched for a level word.
TEXT_LEVEL_ORDER = ["FATAL", "CRITICAL", "ERROR", "WARNING", "WARN", "INFO", "DEBUG", "TRACE"]

# Levels that count as errors in the rule-based ground truth.
ERROR_LEVELS = ["ERROR", "CRITICAL", "FATAL", "EMERG", "ALERT"]

# Column order of the minute x level pivot.
PIVOT_LEVELS = ["DEBUG", "INFO", "NOTICE", "WARNING", "WARN", "ERROR", "CRITICAL", "FATAL"]

# --- fixed values: CSV header aliases (first present wins, per file) ----------

CSV_ALIASES = {
    "timestamp": ["timestamp", "time", "date", "datetime", "@timestamp"],
    "message": ["message", "msg", "log", "log_message", "text", "body"],
    "level": ["level", "severity", "log_level", "loglevel"],
    "status": ["status", "status_code", "http_status", "response_code"],
    "size": ["size", "bytes", "response_size", "body_bytes_sent"],
    "time": ["response_time", "duration", "elapsed", "latency_ms"],
}

# --- fixed values: JSON key aliases (first present key wins, per row) ---------

JSON_ALIASES = {
    "timestamp": ["timestamp", "time", "@timestamp", "date"],
    "message": ["message", "msg", "log", "body"],
    "level": ["level", "severity", "log_level"],
    "status": ["status", "status_code", "http_status"],
    "size": ["size", "bytes", "response_size"],
    "time": ["duration", "response_time", "elapsed", "latency_ms"],
}

# --- fixed values: report parameters ------------------------------------------

# Radar profile features (the six structured features shown per label).
PROFILE_FEATURES = ["severity_score", "http_status_sev", "f_response_size",
                    "f_response_time", "hour_of_day", "error_keyword"]
HIST_BINS_NORMAL = 40
HIST_BINS_ANOMALY = 20
TOP_ANOMALIES = 12
EXPLAIN_DEFAULT = 5
EXPLAIN_MAX_CHARS = 1200
LABEL_MSG_CHARS, CARD_MSG_CHARS, PREVIEW_CHARS = 40, 70, 80
SCORE_BANDS = [(0.75, "high"), (0.5, "medium")]  # else "low"
BLANK_EXPLANATION = "(blank line)"

# Spark's English stop words, in the order Spark ships them.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split())
