"""Folds of equal quotas: exact search for coupled components, singletons fill what is left."""

from __future__ import annotations

import hashlib
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The search is exponential, so it takes few components of more than one fact.
MOST_COMPONENTS = 12
#: More facts than this are more than one task should place.
MOST_FACTS = 1_000_000


def _digest(*parts: object) -> str:
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


def exact_folds(facts: DataFrame, fact: str, component: str, relation: str, folds: list[str], seed: str, strict: bool = True) -> DataFrame:
    """(fact, component, fold): each component in one fold, each relation with the same quota in every fold.

    The quota of a relation is its facts over the folds, rounded up.  Components of several facts are placed
    by exact search: no relation beyond its quota and no fold beyond the sum of quotas; of what is feasible
    the least spread of surplus facts, then the least sum of their squares, then the least hash.  Single
    facts then take the slots left of their relation, both in hash order.  ``strict`` refuses relations whose
    slots and single facts differ in number.
    """
    if facts.count() > MOST_FACTS:
        raise ValueError(f"more than {MOST_FACTS} facts")

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(fact)
        totals = rows[relation].value_counts().to_dict()
        quota = {r: -(-n // len(folds)) for r, n in totals.items()}
        room = sum(quota.values())
        groups = {c: g for c, g in rows.groupby(component, sort=True)}
        coupled = sorted((c for c, g in groups.items() if len(g) > 1), key=lambda c: (-len(groups[c]), _digest(seed, c)))
        if len(coupled) > MOST_COMPONENTS:
            raise ValueError(f"exact search takes at most {MOST_COMPONENTS} components of several facts")
        counts = {c: groups[c][relation].value_counts().to_dict() for c in coupled}
        best = None
        for choice in product(range(len(folds)), repeat=len(coupled)):
            size, held, surplus = [0] * len(folds), {}, [0] * len(folds)
            for c, f in zip(coupled, choice):
                size[f] += len(groups[c])
                surplus[f] += len(groups[c]) - 1
                for r, n in counts[c].items():
                    held[f, r] = held.get((f, r), 0) + n
            if any(n > quota[r] for (_, r), n in held.items()) or any(n > room for n in size):
                continue
            score = (max(surplus) - min(surplus), sum(v * v for v in surplus), _digest(seed, sorted(zip(coupled, choice))))
            if best is None or score < best[0]:
                best = (score, choice, held)
        if best is None:
            raise ValueError("no feasible assignment of the coupled components")
        out = dict(zip(coupled, best[1]))
        for r in sorted(totals):
            singles = sorted((c for c, g in groups.items() if len(g) == 1 and g[relation].iloc[0] == r), key=lambda c: _digest(seed, r, c))
            slots = sorted(((f, k) for f in range(len(folds)) for k in range(quota[r] - best[2].get((f, r), 0))), key=lambda s: _digest(seed, r, folds[s[0]], s[1]))
            if len(singles) > len(slots) or (strict and len(singles) != len(slots)):
                raise ValueError(f"{len(singles)} single facts for {len(slots)} slots of {r}")
            out.update((c, f) for c, (f, _) in zip(singles, slots))
        return pd.DataFrame({fact: rows[fact], component: rows[component], "fold": [folds[out[c]] for c in rows[component]]})

    kinds = {c: facts.schema[c].dataType.simpleString() for c in (fact, component)}
    return facts.select(fact, component, relation).withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(place, f"{fact} {kinds[fact]}, {component} {kinds[component]}, fold string")
