"""Regular English forms of words and phrases, as built-in expressions. Null gives null, an empty word an empty array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, trimmed

# Nouns that end in -s or -ie in the singular.
ENDING_IN_S = "alias status canvas basis lens series species corpus analysis hypothesis parenthesis focus virus census radius syllabus bus".split()
ENDING_IN_IE = "movie cookie brownie zombie rookie hippie sweetie pixie goalie junkie lassie tie pie lie die".split()


def _stem(word: Column, off: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - off)


def _consonant_y(word: Column) -> Column:
    return word.rlike("[^aeiouAEIOU]y$")


def plural(word: Column) -> Column:
    return F.when(_consonant_y(word), F.concat(_stem(word, 1), F.lit("ies"))).when(word.rlike("(?i)(?:s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))


def past(word: Column) -> Column:
    return F.when(_consonant_y(word), F.concat(_stem(word, 1), F.lit("ied"))).when(word.rlike("(?i)e$"), F.concat(word, F.lit("d"))).otherwise(F.concat(word, F.lit("ed")))


def gerund(word: Column) -> Column:
    return F.when(word.rlike("(?i)e$") & ~word.rlike("(?i)ee$"), F.concat(_stem(word, 1), F.lit("ing"))).otherwise(F.concat(word, F.lit("ing")))


def word_forms(word: Column) -> Column:
    """The word and its regular forms, each once, in this order: itself, plural, past, gerund."""
    return F.when(word != "", F.array_distinct(F.array(word, plural(word), past(word), gerund(word)))).when(word.isNotNull(), F.array().cast("array<string>"))


def forms(term: Column) -> Column:
    """Every form of a word or phrase; a phrase varies one word at a time, so its number of forms follows its number of words."""

    def of(parts: Column) -> Column:
        def varied(i: Column) -> Column:
            others = lambda v: F.array_join(F.transform(parts, lambda p, j: F.when(j == i, v).otherwise(p)), "")
            return F.transform(F.slice(word_forms(F.get(parts, i)), 2, 3), others)

        words = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i).rlike(r"\S"))
        return F.array_distinct(F.concat(F.array(F.array_join(parts, "")), F.flatten(F.transform(words, varied))))

    parts = F.regexp_extract_all(trimmed(term), F.lit(r"(\S+|\s+)"), F.lit(1))
    return bound(parts, lambda p: F.when(F.size(p) > 0, of(p)).when(p.isNotNull(), F.array().cast("array<string>")))


def singular(noun: Column) -> Column:
    """A key under which a regular noun and its plural are one; irregular ones stay."""
    n = F.lower(noun)
    return (
        F.when(n.isin(ENDING_IN_S + ENDING_IN_IE), n)
        .when(n.endswith("ies") & (F.length(n) > 4), F.when(_stem(n, 1).isin(ENDING_IN_IE), _stem(n, 1)).otherwise(F.concat(_stem(n, 3), F.lit("y"))))
        .when(n.rlike("(?:sses|shes|ches|xes|zes)$"), _stem(n, 2))
        .when(n.endswith("ses") & (F.length(n) > 4) & _stem(n, 2).isin(ENDING_IN_S), _stem(n, 2))
        .when(n.endswith("s") & ~n.endswith("ss"), _stem(n, 1))
        .otherwise(n)
    )
