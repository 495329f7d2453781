"""Likeness of entity, relation and dimension models, as column functions inside a pair.

A model is a few arrays of one record, so a comparison reads nothing but the pair. Names are
compared in lower case. Missing arrays count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import name_likeness, word_share

#: Least likeness that counts, and the parts of the scores.
LEAST = 0.3
OVERALL = {"dimension": 0.3, "entity": 0.5, "relation": 0.2}
#: Weights of categories under these names; others weigh 1 / number of compared categories.
WEIGHTS = {"skills": 0.5, "experience": 0.3, "education": 0.2, "certificates": 0.2, "languages": 0.2, "requirements": 0.4, "responsibilities": 0.3}


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _most(c: Column) -> Column:
    return F.coalesce(F.array_max(c), F.lit(0.0))


def near(a: Column, b: Column) -> Column:
    """Whether one name holds the other."""
    return a.contains(b) | b.contains(a)


def coverage(wanted: Column, held: Column) -> Column:
    """How far dimensions (``name``, ``description``) are covered: their best likeness, 0.7 by name and 0.3 by description, from LEAST on; 0 if none is wanted."""
    alike = lambda w, h: 0.7 * name_likeness(w["name"], h["name"]) + 0.3 * word_share(w["description"], h["description"])
    each = F.transform(wanted, lambda w: _most(F.transform(held, lambda h: alike(w, h))))
    return F.coalesce(F.try_divide(total(F.filter(each, lambda x: x >= LEAST)), F.size(wanted)), F.lit(0.0))


def entity_score(wanted: Column, held: Column, likeness: Callable[[Column, Column], Column] = name_likeness) -> Column:
    """Mean over the wanted names of the likeness of the likest held one; null if either side is empty."""
    each = F.transform(wanted, lambda w: F.array_max(F.transform(held, lambda h: likeness(w, h))))
    return F.when((F.size(wanted) > 0) & (F.size(held) > 0), total(each) / F.size(wanted))


def entity_matching(scores: dict[str, Column]) -> Column:
    """Weighted mean of the categories' scores that are not null; 0 if all are."""
    n = sum((s.isNotNull().cast("int") for s in scores.values()), F.lit(0))
    weight = {c: F.when(s.isNotNull(), F.lit(WEIGHTS[c]) if c in WEIGHTS else 1 / n).otherwise(0.0) for c, s in scores.items()}
    top = sum((weight[c] * F.coalesce(s, F.lit(0.0)) for c, s in scores.items()), F.lit(0.0))
    return F.coalesce(F.try_divide(top, sum(weight.values(), F.lit(0.0))), F.lit(0.0))


def relation_matching(wanted: Column, held: Column) -> Column:
    """Relations (``relation``, ``objects``) by their best counterpart of likeness LEAST or more: 0.4 of that and 0.6 of the share of objects found; 0 if none is wanted."""
    found = lambda w, h: F.size(F.filter(w["objects"], lambda o: F.exists(h["objects"], lambda p: near(o, p)))) / F.size(w["objects"])

    def best(w: Column) -> Column:
        alike = F.filter(held, lambda h: name_likeness(w["relation"], h["relation"]) >= LEAST)
        return _most(F.transform(alike, lambda h: 0.4 * name_likeness(w["relation"], h["relation"]) + 0.6 * found(w, h)))

    return F.coalesce(F.try_divide(total(F.transform(wanted, best)), F.size(wanted)), F.lit(0.0))


def overall(dimension: Column, entity: Column, relation: Column) -> Column:
    return OVERALL["dimension"] * dimension + OVERALL["entity"] * entity + OVERALL["relation"] * relation
