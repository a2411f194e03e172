"""DuckDB SQL for every catalog query, written independently of the Spark
plans, over the same driver tables (pre-registered views ``conversations``,
``documents``, ``labels``). Used as the correctness oracle.

Conventions that keep both engines bit-equal: rates and means are computed
as double division of exact integer sums (divide, then multiply by 100);
rounding is half-to-even on the scaled double; sums are cast to BIGINT.
"""

from __future__ import annotations

from convolytics import constants as K
from convolytics.plans.catalog import CUBE_QUERIES
from convolytics.sources.fixtures import SESSIONS_SQL

WS = K.WHITESPACE_CLASS
STATUSES = ("partially_resolved", "resolved", "unresolved", "user_drop_off")
SENTIMENTS = ("negative", "neutral", "positive")
INTENTS = ("accurate", "not_accurate")
SPAMS = ("not_spam", "spam")

FEATURED = f"""{SESSIONS_SQL},
featured AS (
  SELECT *,
    CAST(length(coalesce(USER_QUERY, '')) AS BIGINT) AS query_length,
    CAST(len(regexp_extract_all(coalesce(USER_QUERY, ''), '[^{WS}]+')) AS BIGINT) AS query_word_count,
    CAST(length(coalesce(RESOLUTION, '')) AS BIGINT) AS resolution_length,
    CAST(len(regexp_extract_all(coalesce(RESOLUTION, ''), '[^{WS}]+')) AS BIGINT) AS resolution_word_count
  FROM sessions
)"""

FEATURED_COLUMNS = (
    "TOPIC", "TOPIC_DESCRIPTION", "USER_QUERY", "RESOLUTION", "RESOLUTION_STATUS",
    "RESOLUTION_STATUS_REASONING", "USER_SENTIMENT", "USER_SENTIMENT_REASONING", "SESSION_ID",
    "intent_accuracy", "spam_check", "suggestion",
    "query_length", "query_word_count", "resolution_length", "resolution_word_count",
)


def _tokens() -> str:
    return ", ".join(f"'{t}'" for t in K.NULL_TOKENS)


def _with(select: str, *ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {FEATURED}{extra}\n{select}"


def _rate(cond: str) -> str:
    return f"(CAST(count(CASE WHEN {cond} THEN 1 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100)"


def _share(n: str, total: str) -> str:
    return f"(CAST({n} AS DOUBLE) / CAST({total} AS DOUBLE) * 100)"


def _round2(x: str) -> str:
    return f"(round_even(({x}) * 100, 0) / 100)"


def _avg(x: str) -> str:
    return f"(CAST(sum({x}) AS DOUBLE) / CAST(count({x}) AS DOUBLE))"


def _title(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), "
        f"lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
    )


def _counts_by(key: str, values: tuple[str, ...], source: str) -> str:
    cells = ", ".join(f"count(CASE WHEN {key} = '{v}' THEN 1 END) AS {v}" for v in values)
    return cells


def _value_counts(key: str) -> str:
    return _with(f"SELECT {key}, count(*) AS n FROM featured WHERE {key} IS NOT NULL GROUP BY {key}")


def _value_counts_share(key: str) -> str:
    return _with(
        f"SELECT {key}, n, {_share('n', '(SELECT sum(n) FROM g WHERE ' + key + ' IS NOT NULL)')} AS pct_of_non_null "
        f"FROM g WHERE {key} IS NOT NULL",
        f"g AS (SELECT {key}, count(*) AS n FROM featured GROUP BY {key})",
    )


def _crosstab(row: str, col: str, values: tuple[str, ...]) -> str:
    return _with(
        f"SELECT {row}, {_counts_by(col, values, 'featured')} FROM featured "
        f"WHERE {row} IS NOT NULL AND {col} IS NOT NULL GROUP BY {row}"
    )


def _crosstab_top(row: str, col: str, values: tuple[str, ...], k: int) -> str:
    cells = ", ".join(f"coalesce(x.{v}, 0) AS {v}" for v in values)
    return _with(
        f"SELECT r.rank, r.{row}, {cells} FROM ranked r LEFT JOIN xt x ON x.{row} = r.{row}",
        f"top AS (SELECT {row}, count(*) AS n FROM featured WHERE {row} IS NOT NULL GROUP BY {row} "
        f"ORDER BY n DESC, {row} LIMIT {k})",
        f"ranked AS (SELECT row_number() OVER (ORDER BY n DESC, {row}) AS rank, {row} FROM top)",
        f"xt AS (SELECT {row}, {_counts_by(col, values, 'featured')} FROM featured "
        f"WHERE {row} IS NOT NULL AND {col} IS NOT NULL GROUP BY {row})",
    )


def _crosstab_margins(row: str, col: str, values: tuple[str, ...]) -> str:
    sums = ", ".join(f"CAST(sum({v}) AS BIGINT) AS {v}" for v in values)
    return _with(
        f"SELECT * FROM body UNION ALL SELECT 'All' AS {row}, {sums}, CAST(sum(\"All\") AS BIGINT) AS \"All\" FROM body",
        f"body AS (SELECT {row}, {_counts_by(col, values, 'featured')}, count(*) AS \"All\" FROM featured "
        f"WHERE {row} IS NOT NULL AND {col} IS NOT NULL GROUP BY {row})",
    )


def _histogram(col: str, bins: int = K.HISTOGRAM_BINS) -> str:
    half = bins // 2
    return _with(
        f"""SELECT bins.bin,
  CASE WHEN b.lo = b.hi THEN (CAST(b.lo AS DOUBLE) - 0.5) + CAST(bins.bin AS DOUBLE) * (1.0 / {bins})
       ELSE b.lo + bins.bin * ((b.hi - b.lo) / {bins}) END AS bin_start,
  CASE WHEN bins.bin + 1 >= {bins} THEN CASE WHEN b.lo = b.hi THEN CAST(b.hi AS DOUBLE) + 0.5 ELSE CAST(b.hi AS DOUBLE) END
       WHEN b.lo = b.hi THEN (CAST(b.lo AS DOUBLE) - 0.5) + CAST(bins.bin + 1 AS DOUBLE) * (1.0 / {bins})
       ELSE b.lo + (bins.bin + 1) * ((b.hi - b.lo) / {bins}) END AS bin_end,
  CAST(coalesce(binned.n, 0) AS BIGINT) AS n
FROM bins CROSS JOIN b LEFT JOIN binned ON binned.bin = bins.bin""",
        f"counts AS (SELECT {col} AS x, count(*) AS n FROM featured WHERE {col} IS NOT NULL GROUP BY {col})",
        "b AS (SELECT min(x) AS lo, max(x) AS hi FROM counts)",
        f"binned AS (SELECT CASE WHEN b.lo = b.hi THEN {half} ELSE least((x - b.lo) * {bins} // (b.hi - b.lo), {bins - 1}) END AS bin, "
        "sum(n) AS n FROM counts CROSS JOIN b GROUP BY 1)",
        f"bins AS (SELECT range AS bin FROM range({bins}))",
    )


def _keywords(text_sql: str, source: str, top_n: int) -> str:
    stop = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
    return (
        f"SELECT keyword, count(*) AS n FROM ("
        f"SELECT unnest(regexp_extract_all(lower(coalesce({text_sql}, '')), '[\\p{{L}}\\p{{N}}_]+')) AS keyword FROM {source}"
        f") WHERE regexp_full_match(keyword, '[a-z]+') AND length(keyword) > 2 AND keyword NOT IN ({stop}) "
        f"GROUP BY keyword ORDER BY n DESC, keyword LIMIT {top_n}"
    )


def _missing_cells() -> str:
    return " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in FEATURED_COLUMNS)


ORACLE_SQL: dict[str, str] = {
    "topic_summary_report": _with(
        f"""SELECT TOPIC, count(SESSION_ID) AS total_conversations,
  {_round2(_rate("RESOLUTION_STATUS = 'resolved'"))} AS resolution_rate_pct,
  {_round2(_rate("USER_SENTIMENT = 'positive'"))} AS positive_sentiment_pct,
  {_round2(_avg('query_word_count'))} AS avg_query_words,
  {_round2(_avg('resolution_word_count'))} AS avg_response_words
FROM featured WHERE TOPIC IS NOT NULL GROUP BY TOPIC"""
    ),
    "csv_round_trip": _with(
        "SELECT "
        + ", ".join(f"CASE WHEN {c} NOT IN ({_tokens()}) THEN {c} END AS {c}" for c in FEATURED_COLUMNS[:12])
        + " FROM featured"
    ),
    "topic_summary_export": _with(
        f"""SELECT TOPIC, count(SESSION_ID) AS "{K.TOPIC_SUMMARY_HEADERS[0]}",
  {_round2(_rate("RESOLUTION_STATUS = 'resolved'"))} AS "{K.TOPIC_SUMMARY_HEADERS[1]}",
  {_round2(_rate("USER_SENTIMENT = 'positive'"))} AS "{K.TOPIC_SUMMARY_HEADERS[2]}",
  {_round2(_avg('query_word_count'))} AS "{K.TOPIC_SUMMARY_HEADERS[3]}",
  {_round2(_avg('resolution_word_count'))} AS "{K.TOPIC_SUMMARY_HEADERS[4]}"
FROM featured WHERE TOPIC IS NOT NULL GROUP BY TOPIC"""
    ),
    "topic_summary": _with(
        f"""SELECT TOPIC, count(SESSION_ID) AS count,
  {_round2(_rate("RESOLUTION_STATUS = 'resolved'"))} AS resolution_rate_pct,
  {_round2(_rate("USER_SENTIMENT = 'positive'"))} AS positive_sentiment_pct,
  {_round2(_avg('query_word_count'))} AS avg_query_words
FROM featured WHERE TOPIC IS NOT NULL GROUP BY TOPIC"""
    ),
    "resolution_rate_by_topic": _with(
        f"""SELECT TOPIC, {_rate("RESOLUTION_STATUS = 'resolved'")} AS resolution_rate_pct
FROM featured WHERE TOPIC IS NOT NULL GROUP BY TOPIC ORDER BY resolution_rate_pct DESC, TOPIC LIMIT {K.TOP_RESOLUTION_RATE}"""
    ),
    "accuracy_by_status": _with(
        f"""SELECT RESOLUTION_STATUS, accuracy_pct,
  CASE WHEN accuracy_pct > 80 THEN 'good' WHEN accuracy_pct > 50 THEN 'medium' ELSE 'poor' END AS band
FROM (SELECT RESOLUTION_STATUS, {_round2(_rate("intent_accuracy = 'accurate'"))} AS accuracy_pct
      FROM featured WHERE RESOLUTION_STATUS IS NOT NULL GROUP BY RESOLUTION_STATUS)"""
    ),
    "spam_by_sentiment": _with(
        f"""SELECT USER_SENTIMENT, spam_pct,
  CASE WHEN spam_pct > 20 THEN 'poor' WHEN spam_pct > 5 THEN 'medium' ELSE 'good' END AS band
FROM (SELECT USER_SENTIMENT, {_round2(_rate("spam_check = 'spam'"))} AS spam_pct
      FROM featured WHERE USER_SENTIMENT IS NOT NULL GROUP BY USER_SENTIMENT)"""
    ),
    "avg_query_words_by_topic": _with(
        f"""SELECT TOPIC, {_avg('query_word_count')} AS avg_query_words
FROM featured WHERE TOPIC IS NOT NULL GROUP BY TOPIC ORDER BY avg_query_words DESC, TOPIC LIMIT {K.TOP_AVG_QUERY_WORDS}"""
    ),
    "avg_resolution_words_by_status": _with(
        f"""SELECT RESOLUTION_STATUS, {_avg('resolution_word_count')} AS avg_resolution_words
FROM featured WHERE RESOLUTION_STATUS IS NOT NULL GROUP BY RESOLUTION_STATUS"""
    ),
    "kpi_overview": _with(
        f"""SELECT count(*) AS total_conversations,
  count(DISTINCT TOPIC) AS unique_topics,
  count(DISTINCT SESSION_ID) AS unique_sessions,
  {_rate("RESOLUTION_STATUS = 'resolved'")} AS resolution_rate_pct,
  {_rate("USER_SENTIMENT = 'negative'")} AS negative_sentiment_pct,
  {_rate("RESOLUTION_STATUS = 'user_drop_off'")} AS drop_off_rate_pct
FROM featured"""
    ),
    "kpi_quality": _with(
        f"""SELECT total_conversations,
  accurate_count, {_share('accurate_count', 'total_conversations')} AS accurate_pct,
  not_accurate_count, {_share('not_accurate_count', 'total_conversations')} AS not_accurate_pct,
  not_spam_count, {_share('not_spam_count', 'total_conversations')} AS not_spam_pct,
  spam_count, {_share('spam_count', 'total_conversations')} AS spam_pct
FROM (SELECT count(*) AS total_conversations,
  count(CASE WHEN intent_accuracy = 'accurate' THEN 1 END) AS accurate_count,
  count(CASE WHEN intent_accuracy = 'not_accurate' THEN 1 END) AS not_accurate_count,
  count(CASE WHEN spam_check = 'not_spam' THEN 1 END) AS not_spam_count,
  count(CASE WHEN spam_check = 'spam' THEN 1 END) AS spam_count
  FROM featured)"""
    ),
    "kpi_sentiment": _with(
        "SELECT position, USER_SENTIMENT, "
        + _title("USER_SENTIMENT")
        + " AS label, n, "
        + _share("n", "total")
        + " AS pct_of_rows FROM ("
        + " UNION ALL ".join(
            f"SELECT CAST({i + 1} AS BIGINT) AS position, '{v}' AS USER_SENTIMENT, "
            f"count(CASE WHEN USER_SENTIMENT = '{v}' THEN 1 END) AS n, count(*) AS total FROM featured"
            for i, v in enumerate(K.SENTIMENTS)
        )
        + ") WHERE n > 0"
    ),
    "kpi_status": _with(
        f"SELECT RESOLUTION_STATUS, {_title('RESOLUTION_STATUS')} AS label, n, "
        f"{_share('n', '(SELECT sum(n) FROM g)')} AS pct_of_rows FROM g WHERE RESOLUTION_STATUS IS NOT NULL",
        "g AS (SELECT RESOLUTION_STATUS, count(*) AS n FROM featured GROUP BY RESOLUTION_STATUS)",
    ),
    "key_insights": _with(
        f"""SELECT resolution_rate_pct, drop_off_rate_pct, negative_sentiment_pct,
  (SELECT TOPIC FROM tc ORDER BY n DESC, TOPIC LIMIT 1) AS top_topic,
  (SELECT n FROM tc ORDER BY n DESC, TOPIC LIMIT 1) AS top_topic_count,
  avg_query_words,
  CASE WHEN resolution_rate_pct > 50 THEN 'good resolution rate' ELSE 'focus on improving resolution rates' END AS resolution_advice,
  CASE WHEN drop_off_rate_pct < 15 THEN 'low drop-off rate' ELSE 'investigate user drop-offs' END AS drop_off_advice,
  CASE WHEN negative_sentiment_pct < 10 THEN 'positive user sentiment' ELSE 'address negative sentiment' END AS sentiment_advice
FROM (SELECT {_rate("RESOLUTION_STATUS = 'resolved'")} AS resolution_rate_pct,
  {_rate("RESOLUTION_STATUS = 'user_drop_off'")} AS drop_off_rate_pct,
  {_rate("USER_SENTIMENT = 'negative'")} AS negative_sentiment_pct,
  {_avg('query_word_count')} AS avg_query_words
  FROM featured)""",
        "tc AS (SELECT TOPIC, count(*) AS n FROM featured WHERE TOPIC IS NOT NULL GROUP BY TOPIC)",
    ),
    "text_stats": _with(
        """SELECT avg(query_word_count) AS query_words_mean,
  CAST(quantile_cont(query_word_count, 0.5) AS DOUBLE) AS query_words_median,
  max(query_word_count) AS query_words_max, min(query_word_count) AS query_words_min,
  avg(resolution_word_count) AS resolution_words_mean,
  CAST(quantile_cont(resolution_word_count, 0.5) AS DOUBLE) AS resolution_words_median,
  max(resolution_word_count) AS resolution_words_max, min(resolution_word_count) AS resolution_words_min
FROM featured""".replace("avg(query_word_count)", _avg("query_word_count")).replace(
            "avg(resolution_word_count)", _avg("resolution_word_count")
        )
    ),
    "topic_counts": _value_counts("TOPIC"),
    "status_counts": _value_counts_share("RESOLUTION_STATUS"),
    "sentiment_counts": _value_counts("USER_SENTIMENT"),
    "intent_counts": _value_counts_share("intent_accuracy"),
    "spam_counts": _value_counts_share("spam_check"),
    "topics_top15": _with(
        f"SELECT TOPIC, count(*) AS n FROM featured WHERE TOPIC IS NOT NULL GROUP BY TOPIC "
        f"ORDER BY n DESC, TOPIC LIMIT {K.TOP_TOPICS_CHART}"
    ),
    "topics_top10_pct": _with(
        f"SELECT TOPIC, n, {_round2(_share('n', '(SELECT count(*) FROM featured)'))} AS pct FROM ("
        f"SELECT TOPIC, count(*) AS n FROM featured WHERE TOPIC IS NOT NULL GROUP BY TOPIC "
        f"ORDER BY n DESC, TOPIC LIMIT {K.TOP_TOPICS_TABLE})"
    ),
    "top_topic": _with(
        "SELECT TOPIC, count(*) AS n FROM featured WHERE TOPIC IS NOT NULL GROUP BY TOPIC ORDER BY n DESC, TOPIC LIMIT 1"
    ),
    "xt_status_sentiment": _crosstab("RESOLUTION_STATUS", "USER_SENTIMENT", SENTIMENTS),
    "xt_status_intent": _crosstab("RESOLUTION_STATUS", "intent_accuracy", INTENTS),
    "xt_sentiment_spam": _crosstab("USER_SENTIMENT", "spam_check", SPAMS),
    "xt_intent_spam": _crosstab("intent_accuracy", "spam_check", SPAMS),
    "xt_topic_status_top20": _crosstab_top("TOPIC", "RESOLUTION_STATUS", STATUSES, K.TOP_TOPICS_HEATMAP),
    "xt_topic_intent_top10": _crosstab_top("TOPIC", "intent_accuracy", INTENTS, K.TOP_TOPICS_INTENT),
    "xt_topic_sentiment_top15": _crosstab_top("TOPIC", "USER_SENTIMENT", SENTIMENTS, K.TOP_TOPICS_SENTIMENT),
    "xt_topic_status_margins": _crosstab_margins("TOPIC", "RESOLUTION_STATUS", STATUSES),
    "xt_topic_sentiment_margins": _crosstab_margins("TOPIC", "USER_SENTIMENT", SENTIMENTS),
    "xt_topic_status_margins_long": _with(
        """SELECT CASE WHEN grouping(TOPIC) = 1 THEN 'All' ELSE TOPIC END AS TOPIC,
  CASE WHEN grouping(RESOLUTION_STATUS) = 1 THEN 'All' ELSE RESOLUTION_STATUS END AS RESOLUTION_STATUS,
  count(*) AS n
FROM featured WHERE TOPIC IS NOT NULL AND RESOLUTION_STATUS IS NOT NULL
GROUP BY CUBE (TOPIC, RESOLUTION_STATUS)"""
    ),
    "hist_query_words": _histogram("query_word_count"),
    "hist_resolution_words": _histogram("resolution_word_count"),
    "top_keywords": _with(_keywords("USER_QUERY", "featured", K.KEYWORD_TOP_N)),
    "top_keywords_documents": _keywords("text", "documents", K.KEYWORD_TOP_N),
    "profile_shape": _with(
        f"""SELECT count(*) AS row_count, CAST({len(FEATURED_COLUMNS)} AS BIGINT) AS column_count,
  CAST(sum({_missing_cells()}) AS BIGINT) AS missing_cells,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM featured)) AS BIGINT) AS duplicate_rows
FROM featured"""
    ),
    "profile_shape_documents": """SELECT count(*) AS row_count, CAST(4 AS BIGINT) AS column_count,
  CAST(sum(CAST(text IS NULL AS BIGINT) + CAST(lang IS NULL AS BIGINT) + CAST(source IS NULL AS BIGINT)
    + CAST(n_chars IS NULL AS BIGINT)) AS BIGINT) AS missing_cells,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS BIGINT)
    AS duplicate_rows
FROM documents""",
    "profile_types": _with(
        "SELECT t.position, t.column_name, t.data_type, c.non_null_count FROM ("
        "SELECT CAST(row_number() OVER () AS BIGINT) AS position, column_name, "
        "CASE column_type WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS data_type "
        "FROM (DESCRIBE (SELECT * FROM featured))) t JOIN ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count({c}) AS non_null_count FROM featured" for c in FEATURED_COLUMNS
        )
        + ") c ON c.column_name = t.column_name"
    ),
    "profile_missing": _with(
        "SELECT position, column_name, missing_count, "
        + _round2(_share("missing_count", "row_count"))
        + " AS missing_pct FROM ("
        + " UNION ALL ".join(
            f"SELECT CAST({i + 1} AS BIGINT) AS position, '{c}' AS column_name, "
            f"count(*) - count({c}) AS missing_count, count(*) AS row_count FROM featured"
            for i, c in enumerate(FEATURED_COLUMNS)
        )
        + ") WHERE missing_count > 0"
    ),
    "preview": _with(
        "SELECT * EXCLUDE (suggestion) FROM featured ORDER BY "
        + ", ".join(f"{c} ASC NULLS FIRST" for c in FEATURED_COLUMNS if c != "suggestion")
        + " LIMIT 10"
    ),
    "text_features": _with("SELECT * FROM featured"),
}

_EXPORTED = _with(
    "SELECT "
    + ", ".join(
        f"CASE WHEN CAST({c} AS VARCHAR) NOT IN ({_tokens()}) THEN CAST({c} AS VARCHAR) END AS {c}" for c in FEATURED_COLUMNS
    )
    + " FROM featured"
)

# the same results by other means
ORACLE_SQL |= {f"cube_{name}": ORACLE_SQL[name] for name in CUBE_QUERIES} | {
    "full_dataset_export": _EXPORTED,
    "csv_file_round_trip": _EXPORTED,
    "xlsx_round_trip": _EXPORTED,
    "top_keywords_documents_pruned": ORACLE_SQL["top_keywords_documents"],
    "profile_shape_filtered": ORACLE_SQL["profile_shape"],
    "profile_shape_filtered_documents": ORACLE_SQL["profile_shape_documents"],
    "cube_cells": _with(
        """SELECT TOPIC, RESOLUTION_STATUS, USER_SENTIMENT, intent_accuracy, spam_check, count(*) AS n,
  count(SESSION_ID) AS SESSION_ID, CAST(sum(query_word_count) AS BIGINT) AS query_word_count,
  CAST(sum(resolution_word_count) AS BIGINT) AS resolution_word_count
FROM featured GROUP BY 1, 2, 3, 4, 5"""
    ),
    "continuous_stats_lineitem": """SELECT count(x) AS n, median(x) AS median, max(x) AS max, min(x) AS min
FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem)""",
    # one file, read in its order
    "first_rows_documents": "SELECT * FROM documents LIMIT 10",
}
