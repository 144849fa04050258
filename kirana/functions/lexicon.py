"""Synonym dictionaries for catalog search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The grocery synonym dictionary, in the reference's order
# (trigger phrase -> search terms), English, Kannada script and romanised Kannada.
GROCERY_SYNONYMS: list[tuple[str, list[str]]] = [
    ("ಹಾಲು", ["milk", "amul taaza", "amul gold"]),
    ("ಹಾಲಿನ", ["milk", "amul taaza", "amul gold"]),
    ("ಹಾಲಿನ ಪ್ಯಾಕೆಟ್", ["amul taaza", "amul gold", "milk"]),
    ("haalu", ["milk", "amul taaza", "amul gold"]),
    ("milk", ["milk", "amul taaza", "amul gold"]),
    ("ಮೊಸರು", ["milk", "paneer"]),
    ("ಬೆಣ್ಣೆ", ["butter", "amul butter"]),
    ("butter", ["butter", "amul butter"]),
    ("dairy", ["milk", "butter", "paneer"]),
    ("ಪನೀರ್", ["paneer", "amul malai paneer"]),
    ("paneer", ["paneer", "amul malai paneer"]),
    ("ಸಕ್ಕರೆ", ["sugar", "madhur"]),
    ("sakkare", ["sugar", "madhur"]),
    ("sugar", ["sugar", "madhur"]),
    ("ಅಕ್ಕಿ", ["rice", "basmati", "kolam"]),
    ("akki", ["rice", "basmati", "kolam"]),
    ("rice", ["basmati", "rice", "kolam"]),
    ("ಹಿಟ್ಟು", ["atta", "aashirvaad"]),
    ("ಅಟ್ಟಾ", ["atta", "aashirvaad"]),
    ("hittu", ["atta", "aashirvaad"]),
    ("atta", ["atta", "aashirvaad", "wheat"]),
    ("ಗೋಧಿ", ["atta", "aashirvaad"]),
    ("flour", ["atta", "aashirvaad"]),
    ("ಬೇಳೆ", ["toor dal", "moong dal"]),
    ("ತೊಗರಿ ಬೇಳೆ", ["toor dal"]),
    ("ಕಡಲೆ ಬೇಳೆ", ["toor dal"]),
    ("ಹೆಸರು ಬೇಳೆ", ["moong dal"]),
    ("bele", ["toor dal", "moong dal"]),
    ("dal", ["dal", "toor dal", "moong dal"]),
    ("pulses", ["dal", "toor dal", "moong dal"]),
    ("ಉಪ್ಪು", ["salt", "tata salt"]),
    ("uppu", ["salt", "tata salt"]),
    ("salt", ["salt", "tata salt"]),
    ("ಎಣ್ಣೆ", ["sunflower oil", "mustard oil"]),
    ("ಅಡುಗೆ ಎಣ್ಣೆ", ["sunflower oil"]),
    ("ಸೂರ್ಯಕಾಂತಿ ಎಣ್ಣೆ", ["sunflower oil"]),
    ("enne", ["sunflower oil", "mustard oil"]),
    ("oil", ["oil", "sunflower", "mustard"]),
    ("cooking oil", ["sunflower oil", "mustard oil"]),
    ("ತಿಂಡಿ", ["bread", "butter", "milk"]),
    ("tindi", ["bread", "butter", "milk"]),
    ("breakfast", ["bread", "butter", "milk"]),
    ("ಬ್ರೆಡ್", ["bread", "whole wheat bread"]),
    ("bread", ["whole wheat bread", "milk bread"]),
    ("ಮೊಟ್ಟೆ", ["eggs", "farm fresh eggs"]),
    ("motte", ["eggs", "farm fresh eggs"]),
    ("eggs", ["eggs", "farm fresh eggs"]),
    ("egg", ["eggs", "farm fresh eggs"]),
    ("tea", ["red label", "taj mahal", "tea"]),
    ("chai", ["red label", "taj mahal", "tea"]),
    ("ಚಹಾ", ["red label", "taj mahal", "tea"]),
    ("ಟೀ", ["red label", "taj mahal", "tea"]),
    ("ಟೀ ಪುಡಿ", ["red label", "taj mahal", "tea"]),
    ("tea powder", ["red label", "taj mahal", "tea"]),
    ("ಕಾಫಿ", ["nescafe", "bru", "coffee"]),
    ("ಕಾಫಿ ಪುಡಿ", ["nescafe", "bru", "coffee"]),
    ("coffee", ["nescafe", "bru", "coffee"]),
    ("coffee powder", ["nescafe", "bru", "coffee"]),
    ("filter coffee", ["bru", "nescafe", "coffee"]),
    ("ಮ್ಯಾಗಿ", ["maggi", "noodles"]),
    ("maggi", ["maggi", "noodles"]),
    ("maggie", ["maggi"]),
    ("noodles", ["maggi"]),
    ("ಬಿಸ್ಕತ್ತು", ["parle-g", "biscuits"]),
    ("ಬಿಸ್ಕಟ್", ["parle-g", "biscuits"]),
    ("biscuit", ["parle-g", "biscuits"]),
    ("biscuits", ["parle-g", "biscuits"]),
    ("snacks", ["maggi", "chips", "biscuits"]),
    ("ಚಿಪ್ಸ್", ["chips", "lays"]),
    ("chips", ["chips", "lays"]),
    ("ತರಕಾರಿ", ["onions", "potatoes", "tomatoes"]),
    ("tarakari", ["onions", "potatoes", "tomatoes"]),
    ("vegetables", ["onions", "potatoes", "tomatoes"]),
    ("veggies", ["onions", "potatoes", "tomatoes"]),
    ("ಈರುಳ್ಳಿ", ["onions", "red onions"]),
    ("eerulli", ["onions", "red onions"]),
    ("ಆಲೂಗಡ್ಡೆ", ["potatoes"]),
    ("aalugadde", ["potatoes"]),
    ("ಟೊಮೆಟೊ", ["tomatoes"]),
    ("tomato", ["tomatoes"]),
    ("ಸಾಬೂನು", ["soap", "dettol"]),
    ("ಸೋಪು", ["soap", "dettol"]),
    ("saaboonu", ["soap", "dettol"]),
    ("soap", ["dettol", "soap"]),
    ("ಸರ್ಫ್", ["surf excel", "detergent"]),
    ("ವಾಷಿಂಗ್ ಪೌಡರ್", ["surf excel", "detergent"]),
    ("detergent", ["surf excel", "detergent"]),
    ("cleaning", ["detergent", "dishwash", "surf excel", "vim"]),
    ("ವಿಮ್", ["vim", "dishwash"]),
    ("vim", ["vim", "dishwash"]),
]

# The test-catalog dictionary bound to the part table (FIXTURES.md §2).
TEST_SYNONYMS: list[tuple[str, list[str]]] = [
    ("fastener", ["bolt", "rod"]),
    ("machine", ["gear", "widget"]),
    ("bolt", ["bolt", "rod"]),
    ("ring", ["ring", "plate"]),
    ("cool", ["cold"]),
    ("tool", ["anvil", "gizmo"]),
]

# The test search strings (FIXTURES.md §2 v_queries).
TEST_QUERIES = ["I want a red widget", "fastener please", "machine", "cool ring", "string", "xyz", "economy"]

SYNONYM_SCHEMA = "pos INT, trigger STRING, terms ARRAY<STRING>"


def synonyms_frame(spark: SparkSession, entries: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    entries = entries if entries is not None else GROCERY_SYNONYMS
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(entries)], SYNONYM_SCHEMA)
