"""Fixed values.

Everything in this module must stay equal to the source dashboard's values,
otherwise results differ. They are listed plainly, in their natural order.
"""

# --- fixed values: optional columns ----------------------------------------
INTENT_COLUMN = "intent_accuracy"
SPAM_COLUMN = "spam_check"
HIDDEN_IN_PREVIEW_COLUMN = "suggestion"

# --- fixed values: derived feature column names ----------------------------
QUERY_LENGTH = "query_length"
QUERY_WORD_COUNT = "query_word_count"
RESOLUTION_LENGTH = "resolution_length"
RESOLUTION_WORD_COUNT = "resolution_word_count"

# --- fixed values: label literals ------------------------------------------
STATUS_RESOLVED = "resolved"
STATUS_DROP_OFF = "user_drop_off"
SENTIMENTS = ("positive", "neutral", "negative")
INTENT_ACCURATE = "accurate"
INTENT_NOT_ACCURATE = "not_accurate"
SPAM_NOT_SPAM = "not_spam"
SPAM_SPAM = "spam"

# --- fixed values: generic keyword stop words, in their natural order ------
# (the dashboard also drops two site-specific words; pass such words through
# ``extra_stop_words``)
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "is", "are", "was", "were", "can", "i", "you", "my",
    "what", "how", "do", "does", "about",
)
MIN_KEYWORD_LENGTH = 3          # a keyword must be longer than 2 characters
KEYWORD_TOP_N = 30              # the dashboard asks for 30 keywords
KEYWORD_DEFAULT_TOP_N = 20      # the extractor's own default

# --- fixed values: top-k sizes ----------------------------------------------
TOP_TOPICS_CHART = 15           # topic distribution chart
TOP_TOPICS_TABLE = 10           # top-10 topics table with percentages
TOP_TOPICS_HEATMAP = 20         # topic x status heatmap
TOP_TOPICS_INTENT = 10          # topic x intent chart
TOP_TOPICS_SENTIMENT = 15       # topic x sentiment chart
TOP_RESOLUTION_RATE = 20        # resolution rate by topic chart
TOP_AVG_QUERY_WORDS = 10        # average query words by topic chart

# --- fixed values: histogram -------------------------------------------------
HISTOGRAM_BINS = 20

# --- fixed values: bands and recommendation thresholds (strict) ------------
ACCURACY_GOOD_ABOVE = 80
ACCURACY_MEDIUM_ABOVE = 50
SPAM_POOR_ABOVE = 20
SPAM_MEDIUM_ABOVE = 5
RESOLVED_GOOD_ABOVE = 50
DROP_OFF_GOOD_BELOW = 15
NEGATIVE_GOOD_BELOW = 10

# --- fixed values: label for cross-tab totals -------------------------------
MARGIN_LABEL = "All"

# --- fixed values: text read as missing by the CSV reader, in order ---------
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- fixed values: report names and timestamp format -----------------------
REPORT_TOPIC_SUMMARY = "topic_summary"
REPORT_RESOLUTION = "resolution_analysis"
REPORT_SENTIMENT = "sentiment_analysis"
REPORT_FULL_DATASET = "full_dataset"
REPORT_TIMESTAMP_FORMAT = "%Y%m%d_%H%M%S"

# --- fixed values: exported column headers of the topic summary report ------
TOPIC_SUMMARY_HEADERS = (
    "Total_Conversations",
    "Resolution_Rate_%",
    "Positive_Sentiment_%",
    "Avg_Query_Words",
    "Avg_Response_Words",
)

# --- fixed values: Unicode whitespace that separates words ------------------
# (the characters Python's str.split() splits on, as code points)
WHITESPACE_CODE_POINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
    0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
# the same set as a regex character class
WHITESPACE_CLASS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
