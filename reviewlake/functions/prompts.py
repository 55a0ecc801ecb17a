"""Chat prompts for the batch-scoring job, as ARRAY<STRUCT<role, content>>.

The wording is ours; the label sets are the ones the review record uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.dictionaries import TOPICS_FIVE, TOPICS_TWO

SENTIMENT_RULES = ("Label the sentiment of the review. Answer with exactly one word: "
                   "positive, negative or neutral.")
TEXT_RATING_RULES = ("Rate the review text from 1.000 (very negative) to 5.000 (very positive) "
                     "with three decimals, ignoring any star rating. Answer with the number only.")
TOPIC_RULES_FIVE = ("Pick the single topic of the review from: " + ", ".join(TOPICS_FIVE)
                    + ". Answer with the topic only.")
TOPIC_RULES_TWO = ("Pick the single topic of the review from: " + ", ".join(TOPICS_TWO)
                   + ". Answer with the topic only.")

TEMPLATES = {
    "sentiment": SENTIMENT_RULES,
    "text_rating": TEXT_RATING_RULES,
    "topic": TOPIC_RULES_FIVE,
    "topic_two": TOPIC_RULES_TWO,
}


def messages(template: str, user_text) -> Column:
    """[{role: system, content: rules}, {role: user, content: text}]."""
    u = F.col(user_text) if isinstance(user_text, str) else user_text
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(TEMPLATES[template]).alias("content")),
        F.struct(F.lit("user").alias("role"), u.alias("content")))
