"""Beam search for questions that models get right in English and wrong elsewhere.

A loop of joins whose width and depth bound every round.  A round grows the queue, has the grown questions
evaluated, keeps the good ones and passes the best of the rest on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factaudit.session import cut

#: A question is good when all models know it in English and at most this share in translation.
GOOD_RATE = 0.4
#: From this share on a question counts towards the cap of its origin.
WEAK_RATE = 0.2


def judged(questions: DataFrame, origin: str, most_good: int) -> DataFrame:
    """``questions`` with rate_ori 1, with ``good`` and ``searched_on``.

    A question goes on to be searched unless no model knows its translation any more, or its origin has
    ``most_good`` weak questions already.  Rows without both rates are left out.
    """
    right = questions.where("rate_ori = 1 AND rate_trans IS NOT NULL")
    counts = right.groupBy(F.col(origin).alias("__o")).agg(F.count_if(F.col("rate_trans") <= WEAK_RATE).alias("__weak"))
    met = right.join(counts, F.col(origin).eqNullSafe(F.col("__o")))
    return met.withColumn("good", F.col("rate_trans") <= GOOD_RATE).withColumn("searched_on", (F.col("rate_trans") > 0) & (F.col("__weak") < most_good)).drop("__o", "__weak")


def beam_search(start: DataFrame, grow: Callable[[DataFrame], DataFrame], evaluate: Callable[[DataFrame], DataFrame], width: int, most_good: int, rounds: int = 3, rounds_after_hit: int = 6) -> DataFrame:
    """(question, origin, rate_ori, rate_trans, value, round): the good questions of all rounds.

    ``start`` (question, origin); ``grow`` turns a queue into more such rows, ``evaluate`` adds rate_ori,
    rate_trans and value.  A round takes the ``width`` rows of the greatest value (ties: the smaller
    question); the search ends after ``rounds``, or ``rounds_after_hit`` once a good question was found, or
    when nothing is left.  The cap of an origin counts weak questions of all rounds.
    """
    queue, found, weak, most, n = start.select("question", "origin"), None, None, rounds, 0
    while n < most:
        tried = cut(evaluate(grow(queue).dropDuplicates(["question"])).where("rate_ori = 1 AND rate_trans IS NOT NULL").withColumn("round", F.lit(n)))
        if tried.isEmpty():
            break
        good = tried.where(F.col("rate_trans") <= GOOD_RATE)
        if not good.isEmpty():
            most = rounds_after_hit
            found = good if found is None else found.unionByName(good)
        new = tried.where(F.col("rate_trans") <= WEAK_RATE).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))
        weak = cut(new if weak is None else weak.unionByName(new).groupBy("origin").agg(F.sum("n").alias("n")))
        left = tried.where("rate_trans > 0").join(weak.where(F.col("n") >= most_good).select("origin"), "origin", "left_anti")
        queue = cut(left.orderBy(F.desc("value"), "question").limit(width).select("question", "origin"))
        n += 1
    columns = ["question", "origin", "rate_ori", "rate_trans", "value", "round"]
    if found is None:
        return start.sparkSession.createDataFrame([], "question string, origin string, rate_ori double, rate_trans double, value double, round int")
    return found.select(*columns)
