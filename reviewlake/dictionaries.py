"""Dictionaries and taxonomies (our own words), as small literal tables.

A ``Dictionary`` knows its row count when it is built, so broadcasting it is
bounded by construction.  User-supplied DataFrames become one through
``as_dictionary`` (read up to a bound), or are joined through
``operators.joins.small_side``, which checks the size first.

Two families:
  * ``*_EN``: English words a user would start from.
  * ``*_FIXTURE``: words that occur in the driver's synthetic test text (which
    is invented syllables plus function words in en/fr/de/es); the registered
    queries use these so every code path is exercised on the test tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dictionary:
    name: str
    schema: str
    rows: tuple

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def broadcast(self, spark: SparkSession) -> DataFrame:
        # Bounded: the rows are a literal table of len(self.rows) entries.
        return F.broadcast(self.frame(spark))

    def column(self, i: int) -> list:
        return [r[i] for r in self.rows]

    def __len__(self) -> int:
        return len(self.rows)


#: Rows that a dictionary read from a DataFrame may have.
MAX_DICTIONARY_ROWS = 200_000


def as_dictionary(side) -> Dictionary:
    """``side`` as a Dictionary; a DataFrame is read up to ``MAX_DICTIONARY_ROWS`` and refused beyond."""
    if isinstance(side, Dictionary):
        return side
    rows = side.limit(MAX_DICTIONARY_ROWS + 1).collect()
    if len(rows) > MAX_DICTIONARY_ROWS:
        raise ValueError(f"a dictionary has at most {MAX_DICTIONARY_ROWS} rows; operators.phrases takes larger ones")
    schema = ", ".join(f"{n} {t}" for n, t in side.dtypes)
    return Dictionary("table", schema, tuple(tuple(r) for r in rows))


def _pairs(schema: str, name: str, mapping: dict) -> Dictionary:
    rows = tuple((k, w) for k, ws in mapping.items() for w in ws)
    return Dictionary(name, schema, rows)


# Extra stop words added to the term cloud, in their original form.
REVIEW_EXTRA_STOPWORDS = ["ANONYMIZED", "EMAIL", "DATE", "LOCATION", "PERSON", "Asda"]

# Our own English stop-word list (function words).
STOPWORDS_EN_WORDS = """
a about above after again against all also am an and any are as at be because been before
being below between both but by can could did do does doing down during each few for from
further had has have having he her here hers herself him himself his how i if in into is it
its itself just me more most my myself no nor not now of off on once only or other ought our
ours ourselves out over own same she should so some such than that the their theirs them
themselves then there these they this those through to too under until up very was we were
what when where which while who whom why will with would you your yours yourself yourselves
""".split()

STOPWORDS_EN = Dictionary(
    "stopwords_en", "term string",
    tuple((w,) for w in sorted(set(STOPWORDS_EN_WORDS) | {w.lower() for w in REVIEW_EXTRA_STOPWORDS})))

# Sentiment lexicon: integer weights, sign is what matters.
LEXICON_EN = Dictionary("lexicon_en", "term string, weight int", (
    ("good", 1), ("great", 2), ("excellent", 3), ("amazing", 3), ("friendly", 2), ("helpful", 2),
    ("love", 3), ("happy", 2), ("fast", 1), ("fresh", 1), ("easy", 1), ("recommend", 2),
    ("best", 3), ("nice", 1), ("quick", 1), ("cheap", 1), ("polite", 2), ("perfect", 3),
    ("bad", -1), ("poor", -2), ("terrible", -3), ("awful", -3), ("late", -1), ("rude", -2),
    ("cold", -1), ("broken", -2), ("damaged", -2), ("worst", -3), ("slow", -1), ("missing", -1),
    ("wrong", -1), ("expensive", -1), ("disappointed", -2), ("never", -1), ("refund", -1),
))
LEXICON_FIXTURE = Dictionary("lexicon_fixture", "term string, weight int", (
    ("the", 1), ("and", 1), ("la", 1), ("und", 1), ("que", 1), ("le", 1),
    ("of", -1), ("to", -1), ("der", -1), ("de", -1), ("die", -1), ("el", -1),
))

# Topic taxonomies: (topic, topic_order, keyword, weight).  Ties go to the lower order.
TOPICS_FIVE = ["in-person shopping", "delivery experience", "customer service", "price",
               "product defects and quality"]
TOPICS_TWO = ["onboarding and setup", "experience"]


def _taxonomy(name: str, topics: list[str], keywords: dict[str, list[str]]) -> Dictionary:
    rows = tuple((t, i, kw, 1) for i, t in enumerate(topics) for kw in keywords[t])
    return Dictionary(name, "topic string, topic_order int, keyword string, weight int", rows)


TAXONOMY_FIVE_EN = _taxonomy("taxonomy_five_en", TOPICS_FIVE, {
    "in-person shopping": ["store", "shop", "aisle", "checkout", "till", "queue", "trolley", "branch"],
    "delivery experience": ["delivery", "delivered", "driver", "courier", "slot", "late", "parcel"],
    "customer service": ["service", "staff", "helpful", "rude", "complaint", "call", "support"],
    "price": ["price", "prices", "expensive", "cheap", "cost", "value", "offer"],
    "product defects and quality": ["quality", "broken", "damaged", "faulty", "stale", "fresh", "defect"],
})
TAXONOMY_FIVE_FIXTURE = _taxonomy("taxonomy_five_fixture", TOPICS_FIVE, {
    "in-person shopping": ["the", "that"],
    "delivery experience": ["de", "la", "le"],
    "customer service": ["der", "die", "und"],
    "price": ["el", "los", "del"],
    "product defects and quality": ["of", "to", "in"],
})
TAXONOMY_TWO_EN = _taxonomy("taxonomy_two_en", TOPICS_TWO, {
    "onboarding and setup": ["setup", "set", "account", "register", "install", "login", "activate"],
    "experience": ["use", "easy", "support", "help", "app", "website", "experience"],
})
TAXONOMY_TWO_FIXTURE = _taxonomy("taxonomy_two_fixture", TOPICS_TWO, {
    "onboarding and setup": ["the", "of", "de"],
    "experience": ["and", "la", "der", "to"],
})

# Services (multi-label): the first three five-class topics.
SERVICES = ["in-person shopping", "delivery experience", "customer service"]

# Mention phrases: (category, phrase); phrases are space-separated tokens.
PHRASES_EN = Dictionary("phrases_en", "category string, phrase string", (
    ("inflation", "inflation"), ("inflation", "cost of living"), ("inflation", "price rise"),
    ("inflation", "prices have gone up"),
    ("competitors", "tesco"), ("competitors", "sainsbury's"), ("competitors", "aldi"),
    ("competitors", "lidl"), ("competitors", "morrisons"), ("competitors", "waitrose"),
    ("locations", "london"), ("locations", "leeds"), ("locations", "manchester"), ("locations", "birmingham"),
    ("locations", "glasgow"), ("locations", "high street"), ("locations", "city centre"),
    ("employees", "manager"), ("employees", "staff"), ("employees", "cashier"), ("employees", "driver"),
    ("employees", "assistant"), ("employees", "team member"), ("employees", "delivery driver"),
))
PHRASES_FIXTURE = Dictionary("phrases_fixture", "category string, phrase string", (
    ("inflation", "of the"), ("inflation", "de la"), ("inflation", "cost of living"),
    ("competitors", "und"), ("competitors", "que"), ("competitors", "in the"),
    ("locations", "von"), ("locations", "del"), ("employees", "sich"),
))

# Products and emotions: (label, keyword).
PRODUCTS_EN = _pairs("product string, keyword string", "products_en", {
    "bread": ["bread", "loaf"], "milk": ["milk"], "chicken": ["chicken"],
    "fruit": ["fruit", "apples", "bananas"], "vegetables": ["vegetables", "veg"],
})
PRODUCTS_FIXTURE = _pairs("product string, keyword string", "products_fixture", {
    "product_a": ["is", "it"], "product_b": ["en", "et"], "product_c": ["es", "un"],
    "product_d": ["er", "an"],
})
EMOTIONS_EN = _pairs("emotion string, keyword string", "emotions_en", {
    "joy": ["happy", "delighted", "love", "pleased"], "anger": ["angry", "furious", "annoyed"],
    "frustration": ["frustrated", "frustrating", "waiting"], "disappointment": ["disappointed"],
    "trust": ["reliable", "trust"],
})
EMOTIONS_FIXTURE = _pairs("emotion string, keyword string", "emotions_fixture", {
    "joy": ["la", "for"], "anger": ["der"], "frustration": ["of", "was"], "surprise": ["que"],
    "sadness": ["to", "with"],
})

# Aspects (T14): (aspect, keyword); the level comes from the review's polarity band.
ASPECTS_EN = _pairs("aspect string, keyword string", "aspects_en", {
    "price": ["price", "prices", "expensive", "cheap", "cost"],
    "faults": ["broken", "faulty", "damaged", "missing"],
    "quality": ["quality", "fresh", "stale", "mouldy"],
})
ASPECTS_FIXTURE = _pairs("aspect string, keyword string", "aspects_fixture", {
    "price": ["el", "los"], "faults": ["to"], "quality": ["of", "de"],
})

# Gazetteer for entity masking: (label, term) with spaCy-style labels.
GAZETTEER_EN = Dictionary("gazetteer_en", "label string, term string", (
    ("GPE", "london"), ("GPE", "leeds"), ("GPE", "manchester"), ("GPE", "birmingham"),
    ("GPE", "glasgow"), ("GPE", "liverpool"), ("GPE", "new york"), ("PERSON", "john"), ("PERSON", "sarah"), ("PERSON", "ann"),
    ("PERSON", "bob"),
))

# Words of the test text in the place of names, to exercise masking there.
GAZETTEER_FIXTURE = Dictionary("gazetteer_fixture", "label string, term string", (
    ("PERSON", "with"), ("PERSON", "nicht"), ("GPE", "pour"), ("GPE", "para"), ("ORG", "avec"),
))

# Source type (T20): user platforms vs professional sources.
SOURCE_TYPE_EN = Dictionary("source_type_en", "source string, type string", (
    ("review site", "user"), ("yelp", "user"), ("google reviews", "user"),
    ("facebook", "professional"), ("twitter", "professional"), ("youtube", "professional"),
    ("tiktok", "professional"), ("instagram", "professional"),
))


def source_types_fixture(companies: DataFrame) -> DataFrame:
    """Rule for the test companies src0, src1, ...: even number user, odd professional (one row per company)."""
    n = F.regexp_extract("company", "[0-9]+$", 0).try_cast("bigint")
    return companies.select("company").distinct().select(
        "company", F.when(n % 2 == 0, "user").when(n % 2 == 1, "professional").alias("type"))


def company_registry_fixture(companies: DataFrame) -> DataFrame:
    """Company registry (name -> review base URL) of the test companies, by rule (one row per company)."""
    return companies.select("company").distinct().select(
        "company", F.concat(F.lit("https://reviews.example/review/"), "company").alias("base_url"))


# The report's question sets (current report, then the older one).
REPORT_QUESTIONS = [
    "Customer emotions exhibited in reviews",
    "Specific product with most positive feedback",
    "Specific products with most negative feedback ",
    "Specific quality issues mentioned by reviewers",
    "Specific price issues mentioned by reviewers",
    "Number of mentions of Inflation or Cost of Living Crisis",
    "Number of Mentions of Competitors",
]
REPORT_QUESTIONS_OLD = [
    "Customer satisfaction with branch staff and service quality",
    "Customer loyalty and retention rates for branch customers",
    "Customer feedback on the Fairer Share Payment and other member benefits",
    "Customer engagement with branch events and charitable activities",
    "Customer complaints and resolutions for branch-related issues",
    "Customer preferences and expectations for branch versus digital channels",
    "Customer awareness and perception of the mutual ownership model and its advantages",
]


def questions_table(questions: list[str] = REPORT_QUESTIONS) -> Dictionary:
    """Question set as a (question_id, question) table for the QA operators."""
    return Dictionary("questions", "question_id bigint, question string",
                      tuple((i, q) for i, q in enumerate(questions)))
