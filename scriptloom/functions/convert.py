"""Texts rewritten by a dictionary, the longest phrase first: for example simplified to traditional characters.

The dictionary is the user's: a table (phrase, into), or a text file of lines phrase, tab, one or
more forms, of which the first counts. From left to right the longest phrase that begins at a place
is replaced, and the search goes on behind it; a character that begins no phrase stays. So a phrase
decides about characters that have several forms.

Every different text is worked once. Its substrings of up to the longest phrase meet the dictionary
in an equi-join, the longest at each place is kept, and a fold over the places of one text picks
those that do not overlap. Null texts stay null. Null and empty phrases, and phrases into null, are
no entries; of several entries for a phrase the least counts. An empty dictionary changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, into) from lines ``phrase<tab>form form ...``; other lines are ignored."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where("value like '%\t%'")
    return lines.select(F.trim(F.get(parts, 0)).alias("phrase"), F.get(F.split(F.trim(F.get(parts, 1)), " +"), 0).alias("into")).where("phrase <> '' and into <> ''")


def converted(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(text, into) for each different text that is not null, from (text)."""
    entries = dictionary.where("phrase <> '' and into is not null").groupBy("phrase").agg(F.min("into").alias("into"))
    longest = entries.agg(F.max(F.char_length("phrase"))).first()[0] or 0
    each = texts.where("text is not null").select("text").distinct()
    if not longest:
        return each.withColumn("into", F.col("text"))
    at = each.select("text", F.explode(F.expr("sequence(1, char_length(text))")).alias("p")).where("text <> ''")
    grams = at.select("text", "p", F.explode(F.expr(f"sequence(1, least({longest}, char_length(text) - p + 1))")).alias("size"))
    met = grams.withColumn("phrase", F.expr("substring(text, p, size)")).join(entries, "phrase")
    best = met.groupBy("text", "p").agg(F.max(F.struct("size", "into")).alias("best"))
    found = best.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("p", "best"))).alias("found"))
    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("out"))
    step = lambda s, p: (
        F.when(p < s["next"], s)
        .when(F.col("found")[p].isNotNull(), F.struct((p + F.col("found")[p]["size"]).alias("next"), F.concat(s["out"], F.col("found")[p]["into"]).alias("out")))
        .otherwise(F.struct((p + 1).alias("next"), F.concat(s["out"], F.substring("text", p, F.lit(1))).alias("out")))
    )
    places = F.when(F.char_length("text") > 0, F.expr("sequence(1, char_length(text))")).otherwise(F.expr("cast(array() as array<int>)"))
    folded = F.aggregate(places, start, step)["out"]
    return each.join(found, "text", "left").select("text", F.when(F.col("found").isNull(), F.col("text")).otherwise(folded).alias("into"))


def convert_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``words`` with their texts rewritten, all columns in place."""
    forms = converted(words, dictionary).withColumnRenamed("into", "_into")
    return words.join(forms, "text", "left").withColumn("text", F.col("_into")).select(words.columns)
