"""Paths and small tables shared by the core tests."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def sessions_frame(spark, rows, quality=True):
    """A small session table from tuples (TOPIC, USER_QUERY, RESOLUTION,
    RESOLUTION_STATUS, USER_SENTIMENT, SESSION_ID[, intent, spam])."""
    from convolytics.operators.features import add_text_features

    full = []
    for r in rows:
        topic, query, resolution, status, sentiment, sid = r[:6]
        extra = list(r[6:8]) if quality else []
        full.append(
            (topic, f"about {topic}" if topic else None, query, resolution, status, None, sentiment, None, sid, *extra)
        )
    names = [
        "TOPIC", "TOPIC_DESCRIPTION", "USER_QUERY", "RESOLUTION", "RESOLUTION_STATUS",
        "RESOLUTION_STATUS_REASONING", "USER_SENTIMENT", "USER_SENTIMENT_REASONING", "SESSION_ID",
    ]
    if quality:
        names += ["intent_accuracy", "spam_check"]
    schema = ", ".join(f"`{n}` string" for n in names)
    return add_text_features(spark.createDataFrame(full, schema))
