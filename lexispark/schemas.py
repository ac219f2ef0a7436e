"""Tables of the lexicon store, its request and response rows, and their fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Feature tags of the input records and their columns.
FEATURE_TAGS = {
    "pos": "part_of_speech",
    "person": "person",
    "number": "number",
    "tense": "tense",
    "mood": "mood",
    "voice": "voice",
    "gender": "gender",
    "case": "grammatical_case",
    "degree": "degree",
    "dialect": "dialect",
    "feature": "other",
    "prefix": "prefix",
    "object": "object",
    "definite": "definite",
    "possessive": "possessive",
}
#: The order in which features are folded into a key.
FEATURES = tuple(sorted(FEATURE_TAGS.values()))
# Languages, lexica by language, and the lexicon of short definitions.
LANGUAGES = {"grc": "Greek", "lat": "Latin", "ara": "Arabic"}
LANGUAGE_CODES = {"greek": "grc", "latin": "lat", "arabic": "ara"}
LEXICA = {
    "grc": ("LSJ", "Middle Liddell", "Logeion-Greek-Shortdef"),
    "lat": ("lewis-short", "Lewis & Short", "Logeion-Latin-Shortdef"),
}
SHORT_DEFINITIONS = {"grc": "Logeion-Greek-Shortdef", "lat": "Logeion-Latin-Shortdef"}


def fields(*parts: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}
    pairs = (x.split() for x in ", ".join(parts).split(", "))
    return T.StructType([T.StructField(name.strip("`"), kinds[kind]) for name, kind in pairs])


_FEATURES = ", ".join(f"{c} string" for c in FEATURES)
LANGUAGE_ROWS = fields("code string, name string")
MORPH_RECORD = fields("form string, lemma string, orth string", ", ".join(f"`{t}` string" for t in FEATURE_TAGS))
LEMMAS = fields("id long, headword string, headword_normalized string, bare_headword string, sequence_number int, language_code string")
PARSES = fields("id long, lemma_id long, form string, form_normalized string, expanded_form string, bare_form string", _FEATURES, "dedup_key string, language_code string")
DOCUMENT_FREQUENCIES = fields("document_id string, lemma_id long, weighted_frequency double")
MORPH_FREQUENCIES = fields("language_code string", _FEATURES, "feature_key string, count double")
PRIOR_FREQUENCIES = fields(
    "language_code string",
    ", ".join(f"previous_{c} string" for c in FEATURES),
    "previous_feature_key string",
    ", ".join(f"current_{c} string" for c in FEATURES),
    "current_feature_key string, count double",
)
SENSES = fields("id long, entry_id string, sense_id string, lemma string, sense string, level int, definition string, document_id string")
ENTRIES = fields("key string, text string, document_id string")
REQUESTS = fields("request_id long, word string, language_code string, document_id string, prior_word string")
#: A word and the one before it in its text.  Without a place it is a seam: the two stand in neighbouring parts of a file.
TOKENS = fields("document_id string, language_code string, pos long, token string, before string")
#: Texts that come in parts: those of one file go on from each other in the order of seq.
PARTS = fields("document_id string, language_code string, file string, seq long, text string")
#: A stored parse, with the numbers of parses and lemmas of its form.
CANDIDATES = T.StructType([*PARSES.fields, *fields("n_parses long, n_lemmas long").fields])
#: A parse under one of its spellings; ways has a bit for each column that is spelled so.
SPELLINGS = T.StructType([*fields("value string, ways int").fields, *PARSES.fields, *fields("headword string, sequence_number int").fields])

#: Schemas, and the column that tells a row's part (document frequencies are written with their lemmas' language).
TABLES = {
    "lemmas": (LEMMAS, "language_code"),
    "parses": (CANDIDATES, "language_code"),
    "spellings": (SPELLINGS, "language_code"),
    "document_frequencies": (DOCUMENT_FREQUENCIES, "language_code"),
    "morph_frequencies": (MORPH_FREQUENCIES, None),
    "prior_frequencies": (PRIOR_FREQUENCIES, None),
    "senses": (SENSES, "document_id"),
    "entries": (ENTRIES, "document_id"),
}
