"""The ``sessions`` test table, derived by Spark from the driver's
``conversations``, ``documents`` and ``labels`` tables (FIXTURES.md section 2).

One row per user turn. The resolution is the following turn when an assistant
wrote it. The plan avoids windows on ``conv_id`` on purpose: a window would
put one whole conversation into one task, so a single huge conversation would
serialise. Instead:

* the next turn comes from an equi-join on ``(conv_id, turn)``: the shuffle is
  spread over both keys, so no single conversation lands in one task, and
  only assistant text (plus the length of other turns) is shuffled;
* the last turn of each conversation is a ``max`` aggregate (map-side
  combined, so a hot ``conv_id`` collapses before the shuffle);
* ``documents`` and ``labels`` are joined to that one-row-per-conversation
  table first. It meets the distinct ``(conv_id, turn)`` keys of the user
  turns, with no text, on ``conv_id``. Spark broadcasts it only if its
  measured size is under ``spark.sql.autoBroadcastJoinThreshold``; beyond that
  it is a sort-merge join whose skewed partitions AQE splits, and only keys
  and labels move;
* the user turns (with their text) then join the next turn and those
  per-turn attributes, both on ``(conv_id, turn)``. The second join reuses
  the partitioning of the first, so each text crosses the shuffle once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convolytics.functions.text import char_length, word_count
from convolytics.schema import DEFAULT_COLUMNS as C


#: the columns the derivation reads; given, so that planning reads no file
_READ = {
    "conversations": "conv_id long, turn long, role string, text string",
    "documents": "doc_id long, lang string, source string",
    "labels": "doc_id long, quality int, toxic int",
}

_FEATURES = (C.query_length, C.query_words, C.resolution_length, C.resolution_words)

# Only assistant text is kept as a resolution; of other turns only the length
# is used, so their text never enters the shuffle.
_SESSIONS = f"""
WITH nxt AS (
  SELECT conv_id, turn - 1 AS turn, role AS nr, CASE WHEN role = 'assistant' THEN text END AS nt,
    length(text) AS nt_len, chars AS nt_chars, words AS nt_words
  FROM {{conv}}
), last_turn AS (
  SELECT conv_id, max(turn) AS mt FROM {{conv}} GROUP BY conv_id
), per_conv AS (
  SELECT m.conv_id, m.mt, d.lang, d.source, l.quality, l.toxic
  FROM last_turn m LEFT JOIN {{docs}} d ON d.doc_id = m.conv_id LEFT JOIN {{labels}} l ON l.doc_id = m.conv_id
), users AS (
  SELECT * FROM {{conv}} WHERE role = 'user'
), per_turn AS (
  SELECT t.conv_id, t.turn, p.mt, p.lang, p.source, p.quality, p.toxic
  FROM (SELECT DISTINCT conv_id, turn FROM users) t LEFT JOIN per_conv p ON p.conv_id = t.conv_id
), labelled AS (
  SELECT u.conv_id, u.turn, u.text, u.chars, u.words, n.nr, n.nt, n.nt_chars, n.nt_words,
    CASE WHEN u.conv_id % 19 = 4 THEN NULL ELSE concat(p.lang, '/', p.source) END AS TOPIC,
    CASE WHEN u.conv_id % 29 = 11 THEN NULL
      WHEN n.nr IS NULL THEN 'user_drop_off'
      WHEN u.turn + 1 = p.mt THEN 'resolved'
      WHEN n.nt_len < 700 THEN 'partially_resolved'
      ELSE 'unresolved' END AS RESOLUTION_STATUS,
    CASE WHEN p.toxic = 1 THEN 'negative'
      WHEN p.quality = 1 THEN 'positive'
      WHEN p.quality = 0 THEN 'neutral'
      WHEN u.conv_id % 3 = 0 THEN 'neutral'
      WHEN u.conv_id % 3 = 1 THEN 'negative' END AS USER_SENTIMENT
  FROM users u
  LEFT JOIN nxt n ON n.conv_id = u.conv_id AND n.turn = u.turn
  LEFT JOIN per_turn p ON p.conv_id = u.conv_id AND p.turn = u.turn
), marked AS (
  SELECT *, (conv_id + turn) % 17 = 3 AS no_query, nr = 'assistant' AS answered FROM labelled
)
SELECT TOPIC,
  concat('Conversations about ', TOPIC) AS TOPIC_DESCRIPTION,
  CASE WHEN no_query THEN NULL ELSE text END AS USER_QUERY,
  CASE WHEN answered THEN nt END AS RESOLUTION,
  RESOLUTION_STATUS,
  concat('Status assessed as ', RESOLUTION_STATUS) AS RESOLUTION_STATUS_REASONING,
  USER_SENTIMENT,
  concat('Sentiment assessed as ', USER_SENTIMENT) AS USER_SENTIMENT_REASONING,
  CASE WHEN conv_id % 23 = 7 THEN NULL ELSE CAST(conv_id AS STRING) END AS SESSION_ID,
  CASE WHEN conv_id % 31 = 13 THEN NULL WHEN (conv_id + 2 * turn) % 4 = 0 THEN 'not_accurate' ELSE 'accurate' END AS intent_accuracy,
  CASE WHEN (conv_id * 7 + turn) % 10 = 0 THEN 'spam' ELSE 'not_spam' END AS spam_check,
  CASE WHEN RESOLUTION_STATUS = 'unresolved' THEN 'Offer a follow-up' END AS suggestion,
  CASE WHEN no_query THEN 0L ELSE chars END AS {C.query_length},
  CASE WHEN no_query THEN 0L ELSE words END AS {C.query_words},
  CASE WHEN answered THEN nt_chars ELSE 0L END AS {C.resolution_length},
  CASE WHEN answered THEN nt_words ELSE 0L END AS {C.resolution_words}
FROM marked"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session table (nine required columns, the two quality columns and
    ``suggestion``), all strings."""
    return featured_sessions(spark, sf_dir).drop(*_FEATURES)


def featured_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session table with its four text features. The features are
    taken from the turns before the joins, so an analysis that reads only
    them moves numbers, never texts. One SQL text with given schemas plans
    faster than a chain of calls that each go to the JVM."""
    conv, docs, labels = (spark.read.schema(ddl).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet") for name, ddl in _READ.items())
    counted = conv.withColumns({"chars": char_length("text"), "words": word_count("text")})
    return spark.sql(_SESSIONS, conv=counted, docs=docs, labels=labels)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


# The same table in DuckDB SQL, for the oracle queries (a CTE named
# ``sessions`` over the driver's pre-registered views).
SESSIONS_SQL = """
sessions_nxt AS (
  SELECT conv_id, turn - 1 AS turn, role AS nr, text AS nt FROM conversations
),
sessions_conv AS (
  SELECT m.conv_id, m.mt, d.lang, d.source, l.quality, l.toxic
  FROM (SELECT conv_id, max(turn) AS mt FROM conversations GROUP BY conv_id) m
  LEFT JOIN documents d ON d.doc_id = m.conv_id
  LEFT JOIN labels l ON l.doc_id = m.conv_id
),
sessions_base AS (
  SELECT u.conv_id, u.turn, u.text, n.nr, n.nt, p.mt, p.lang, p.source, p.quality, p.toxic
  FROM conversations u
  LEFT JOIN sessions_nxt n ON n.conv_id = u.conv_id AND n.turn = u.turn
  LEFT JOIN sessions_conv p ON p.conv_id = u.conv_id
  WHERE u.role = 'user'
),
sessions_labelled AS (
  SELECT conv_id, turn, text, nr, nt,
    CASE WHEN conv_id % 19 = 4 THEN NULL ELSE lang || '/' || source END AS TOPIC,
    CASE WHEN conv_id % 29 = 11 THEN NULL
         WHEN nr IS NULL THEN 'user_drop_off'
         WHEN turn + 1 = mt THEN 'resolved'
         WHEN length(nt) < 700 THEN 'partially_resolved'
         ELSE 'unresolved' END AS RESOLUTION_STATUS,
    CASE WHEN toxic = 1 THEN 'negative'
         WHEN quality = 1 THEN 'positive'
         WHEN quality = 0 THEN 'neutral'
         WHEN conv_id % 3 = 0 THEN 'neutral'
         WHEN conv_id % 3 = 1 THEN 'negative' END AS USER_SENTIMENT
  FROM sessions_base
),
sessions AS (
  SELECT TOPIC,
    'Conversations about ' || TOPIC AS TOPIC_DESCRIPTION,
    CASE WHEN (conv_id + turn) % 17 = 3 THEN NULL ELSE text END AS USER_QUERY,
    CASE WHEN nr = 'assistant' THEN nt END AS RESOLUTION,
    RESOLUTION_STATUS,
    'Status assessed as ' || RESOLUTION_STATUS AS RESOLUTION_STATUS_REASONING,
    USER_SENTIMENT,
    'Sentiment assessed as ' || USER_SENTIMENT AS USER_SENTIMENT_REASONING,
    CASE WHEN conv_id % 23 = 7 THEN NULL ELSE CAST(conv_id AS VARCHAR) END AS SESSION_ID,
    CASE WHEN conv_id % 31 = 13 THEN NULL
         WHEN (conv_id + 2 * turn) % 4 = 0 THEN 'not_accurate'
         ELSE 'accurate' END AS intent_accuracy,
    CASE WHEN (conv_id * 7 + turn) % 10 = 0 THEN 'spam' ELSE 'not_spam' END AS spam_check,
    CASE WHEN RESOLUTION_STATUS = 'unresolved' THEN 'Offer a follow-up' END AS suggestion
  FROM sessions_labelled
)"""
