"""Schemas of the tables the pipelines read and write."""

TWEETS = (
    "tweet_id BIGINT, author_id STRING, inbound BOOLEAN, created_at STRING, text STRING, "
    "response_tweet_id STRING, in_response_to_tweet_id BIGINT"
)
TRANSCRIPTS = "company STRING, conversation_id STRING, conversation STRING"
THREADS = (
    "thread_id STRING, customer_message STRING, agent_reply STRING, turns_count BIGINT, "
    "num_customer_turns BIGINT, num_support_turns BIGINT, is_boilerplate BOOLEAN, "
    "raw_turns ARRAY<STRUCT<role: STRING, text: STRING>>"
)
EVALUATION = (
    "example_id STRING, thread_id STRING, customer_message STRING, gold_class STRING, "
    "gold_decision STRING, gold_reason STRING, must_contain STRING, is_adversarial BOOLEAN, "
    "adversarial_type STRING, annotator STRING"
)
AUDIT = (
    "example_id STRING, thread_id STRING, customer_message STRING, gold_class STRING, "
    "gold_decision STRING, human_scores STRUCT<groundedness: INT, correctness: INT, tone_empathy: INT, "
    "completeness: INT, overall: DOUBLE>, human_rater STRING, human_note STRING"
)
RESPONSES = "cache_key STRING, prompt STRING, response STRING"
CENTROIDS = "class STRING, centroid ARRAY<DOUBLE>"
CLASSES = "class STRING, ordinal INT, description STRING"
