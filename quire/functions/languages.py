"""The language dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes, English names and Spanish names.
LANGUAGES = (
    ("ar", "Arabic", "Árabe"), ("bg", "Bulgarian", "Búlgaro"), ("ca", "Catalan", "Catalán"), ("cs", "Czech", "Checo"), ("da", "Danish", "Danés"), ("de", "German", "Alemán"),
    ("el", "Greek", "Griego"), ("en", "English", "Inglés"), ("es", "Spanish", "Español"), ("et", "Estonian", "Estonio"), ("fa", "Persian", "Persa"), ("fi", "Finnish", "Finlandés"),
    ("fr", "French", "Francés"), ("he", "Hebrew", "Hebreo"), ("hi", "Hindi", "Hindi"), ("hr", "Croatian", "Croata"), ("hu", "Hungarian", "Húngaro"), ("id", "Indonesian", "Indonesio"),
    ("it", "Italian", "Italiano"), ("ja", "Japanese", "Japonés"), ("ko", "Korean", "Coreano"), ("lt", "Lithuanian", "Lituano"), ("lv", "Latvian", "Letón"), ("ms", "Malay", "Malayo"),
    ("nl", "Dutch", "Holandés"), ("no", "Norwegian", "Noruego"), ("pl", "Polish", "Polaco"), ("pt", "Portuguese", "Portugués"), ("ro", "Romanian", "Rumano"), ("ru", "Russian", "Ruso"),
    ("sk", "Slovak", "Eslovaco"), ("sl", "Slovenian", "Esloveno"), ("sr", "Serbian", "Serbio"), ("sv", "Swedish", "Sueco"), ("th", "Thai", "Tailandés"), ("tr", "Turkish", "Turco"),
    ("uk", "Ukrainian", "Ucraniano"), ("vi", "Vietnamese", "Vietnamita"), ("zh", "Chinese", "Chino"),
)
NAMES = {code: (english, spanish) for code, english, spanish in LANGUAGES}


def dimension(spark: SparkSession) -> DataFrame:
    """(place, code, name_en, name_es, label): 39 rows, in the table's order."""
    rows = spark.createDataFrame([(k, *row) for k, row in enumerate(LANGUAGES)], "place int, code string, name_en string, name_es string")
    return rows.withColumn("label", F.concat_ws(" / ", "name_en", "name_es"))


def label(code: str) -> str:
    """English and Spanish name; KeyError if the code is unknown."""
    return " / ".join(NAMES[code])


def with_names(df: DataFrame, code_col: str) -> DataFrame:
    """df with the names of a code column; the dimension has 39 rows, so it is broadcast."""
    names = dimension(df.sparkSession).select(F.col("code").alias(code_col), "name_en", "name_es", "label")
    return df.join(F.broadcast(names), code_col, "left")


def matches(query: str) -> Column:
    """Whether a dimension row has the query in its code or names, in any case."""
    q = F.lower(F.lit(query))
    return F.lower("code").contains(q) | F.lower("name_en").contains(q) | F.lower("name_es").contains(q)
