"""Rendering of options and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The opening words of a translation request per language.
TRANSLATE = {"zh": "请翻译：", "de": "Bitte übersetzen: ", "fr": "Veuillez traduire : ", "es": "Por favor, traduzca: "}
TRANSLATE_OTHER = "Please translate: "


def option_layout(rows: DataFrame, key: str, answer: str, choices: str) -> DataFrame:
    """(key, layout, correct): distinct choices in hash order, labelled from A; the answer's label.

    The order depends on key and choice alone.  Rows without choices give no row; an answer that is
    no choice has no label; more choices than letters fail.  The work stays within the row: no shuffle.
    """
    hashed = F.array_sort(F.transform(F.array_distinct(choices), lambda c: F.struct(F.sha2(F.concat_ws("␟", F.col(key).cast("string"), c), 256).alias("h"), c.alias("choice"))))
    labelled = F.transform(F.col("__order"), lambda s, i: F.struct(F.when(i < len(LABELS), F.substring(F.lit(LABELS), i + 1, F.lit(1))).otherwise(F.raise_error(F.lit("more choices than letters"))).alias("label"), s["choice"].alias("choice")))
    laid = rows.where(F.size(choices) > 0).withColumn("__order", hashed).withColumn("__laid", labelled)
    correct = F.get(F.filter("__laid", lambda s: s["choice"] == F.col(answer)), 0)["label"]
    return laid.select(key, F.array_join(F.transform("__laid", lambda s: F.concat(s["label"], F.lit("="), s["choice"])), ";").alias("layout"), correct.alias("correct"))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("␟", *parts), 256)


def binary_layout(source: Column, distractor_id: Column, language: Column, answer: Column, distractor: Column) -> Column:
    """Struct (a, b, correct): two options; the parity of the hash of source, distractor and language decides which is first."""
    first = F.conv(F.substring(_digest(source, distractor_id, language), 1, 2), 16, 10).cast("int") % 2 == 0
    return F.struct(F.when(first, answer).otherwise(distractor).alias("a"), F.when(first, distractor).otherwise(answer).alias("b"), F.when(first, "A").otherwise("B").alias("correct"))


def target_layout(source: Column, target_id: Column, answer: Column, distractors: Column, options: int) -> Column:
    """Struct (texts, ids, correct, target): three to five options in hash order, labelled from A.

    ``distractors`` is an array of structs (id, text) that holds the target; null where it does not.  The foils
    are the first ``options - 2`` of the others by a hash of source, target and foil; the order of all is by a
    hash of source, the set of ids and the id.
    """
    if not 3 <= options <= 5:
        raise ValueError("three to five options")
    others = F.array_sort(F.transform(F.filter(distractors, lambda x: x["id"] != target_id), lambda x: F.struct(_digest(source, target_id, F.lit("foil"), x["id"]).alias("h"), x["id"].alias("id"), x["text"].alias("text"))))
    chosen = F.concat(F.transform(F.slice(others, 1, options - 2), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))), F.filter(distractors, lambda x: x["id"] == target_id))
    named = F.substring(_digest(source, F.array_join(F.array_sort(F.transform(chosen, lambda x: x["id"])), ",")), 1, 16)
    entries = F.concat(F.array(F.struct(F.lit("__answer__").alias("id"), answer.alias("text"))), chosen)
    laid = F.array_sort(F.transform(entries, lambda x: F.struct(_digest(source, named, F.lit("option-order"), x["id"]).alias("h"), x["id"].alias("id"), x["text"].alias("text"))))
    label = lambda wanted: F.substring(F.lit(LABELS), F.array_position(F.transform(laid, lambda x: x["id"]), wanted).cast("int"), F.lit(1))
    out = F.struct(F.transform(laid, lambda x: x["text"]).alias("texts"), F.transform(laid, lambda x: x["id"]).alias("ids"), label(F.lit("__answer__")).alias("correct"), label(target_id).alias("target"))
    return F.when(F.exists(distractors, lambda x: x["id"] == target_id) & (F.size(chosen) >= 2), out)


def frozen_layout(fact: Column, entries: Column) -> Column:
    """Array of structs (choice, id, text): the options of a fact in one order for all languages and arms."""
    ordered = F.array_sort(F.transform(entries, lambda x: F.struct(_digest(fact, F.lit("option-order-v1"), x["id"]).alias("h"), x["id"].alias("id"), x["text"].alias("text"))))
    return F.transform(ordered, lambda x, i: F.struct(F.substring(F.lit(LABELS), i + 1, F.lit(1)).alias("choice"), x["id"].alias("id"), x["text"].alias("text")))


def render_question(question: Column, choices: Column) -> Column:
    """A question with its options, if it has any, and the place of the answer."""
    ask = F.concat(F.lit("Question: "), question)
    with_options = F.concat(ask, F.lit("\nOptions: "), F.array_join(choices, "; "), F.lit("\nAnswer:"))
    return F.when(choices.isNull(), F.concat(ask, F.lit("\nAnswer:"))).otherwise(with_options)


def translation_prompts(rows: DataFrame, language: str, text: str) -> DataFrame:
    """``rows`` with ``prompt``: the text behind its language's request."""
    chain = None
    for code, opening in TRANSLATE.items():
        chain = F.when(F.col(language) == code, opening) if chain is None else chain.when(F.col(language) == code, opening)
    return rows.withColumn("prompt", F.concat(chain.otherwise(TRANSLATE_OTHER), F.col(text)))
