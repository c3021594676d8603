"""Fixed values and shapes of the graph's tables."""

from __future__ import annotations

# Text languages in order of fallback, the class relation, and limits of the query functions.
LANGUAGES = ("en", "fr", "de", "zh", "ar", "ru")
RARE_LANGUAGES = ("ar", "ru")
INSTANCE_OF = 31
DEFAULT_LIMIT = 200
SEARCH_DEPTH = 4000
SITELINK_WEIGHT, DEGREE_WEIGHT = 2.0, 4.0
BM25_K1, BM25_B = 1.2, 0.75
RANK_TOP, SCOUT_READS, SCOUT_FLOOR = 20, 10, 0.50
HASH_FACTOR, HASH_SPACE = 11400714819323198485, 18446744073709551616
IDENTITY_KEYS = ("qid", "id", "entity", "item", "language", "lang")
FREE_WHEN_SEEN = ("name", "has", "rank")

NODE = "qid long, label_en string, class_id int"
EDGE = "src long, prop int, dst long"
STATEMENT = "subject_id string, statement_id string, property_id string, value_id string, value_type string, rank string"
