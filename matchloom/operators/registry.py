"""Canonical names: an ordered registry of categories and entities of bounded size.

Names join the first registered name they are likest to, so arrival order decides; a registry is
meant for curated vocabularies, not for corpora. It is broadcast as a table when names are
normalised.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Thresholds of likeness; categories that stay when empty; bounds of names; examples a
# proposed category needs, and how many of them it takes.
CATEGORY_LIKE, ENTITY_LIKE = 0.8, 0.85
CORE = ["技能", "工作经验", "教育背景", "行业领域", "职位要求", "工作职责"]
CATEGORY_LONGEST, ENTITY_LENGTHS = 20, (2, 50)
LEAST_EXAMPLES, TAKEN_EXAMPLES = 3, 5
#: ASCII punctuation that no category name holds; these four marks may stand in one.
FORBIDDEN = set(string.punctuation) - set("-_`~")


def likeness(new: str, held: str) -> float:
    """2 M / T over matching blocks; not symmetric, so the new name comes first."""
    return SequenceMatcher(None, new.lower(), held.lower()).ratio()


def alike(new: str, held: Iterable[str], above: float) -> Iterator[tuple[float, str]]:
    """(likeness, name) of the held names that are liker than ``above``, in their order; what can't be by its length isn't compared."""
    for x in held:
        n = len(new) + len(x)
        if n and 2 * min(len(new), len(x)) > above * n and (r := likeness(new, x)) > above:
            yield r, x


class Registry:
    """``entities`` by category, ``descriptions`` of categories, and the ``canonical`` name of every name ever given."""

    def __init__(self, categories: list[str] = CORE, most: int = 100_000) -> None:
        self.entities: dict[str, list[str]] = {c: [] for c in categories}
        self.descriptions: dict[str, str] = {}
        self.canonical: dict[str, str] = {}
        self.most = most

    def add_category(self, name: str, description: str = "") -> str | None:
        """The category a name stands for from now on: itself if new, an older one that is much alike; None if it adds nothing."""
        known = name.lower() in {c.lower() for c in self.entities}
        older = None if known else next(alike(name, self.entities, CATEGORY_LIKE), None)
        fit = len(name) in range(1, CATEGORY_LONGEST + 1) and FORBIDDEN.isdisjoint(name)
        if older is None and fit and not known:
            self.entities[name], self.descriptions[name] = [], description
            older = (1.0, name)
        return older and older[1]

    def propose(self, name: str, description: str, examples: list[str]) -> str | None:
        """A category that comes with at least three examples, and the first five of them."""
        name = name.strip()
        category = self.add_category(name, description.strip()) if name and len(examples) >= LEAST_EXAMPLES else None
        for x in examples[:TAKEN_EXAMPLES] if category else ():
            self.add(category, x)
        return category

    def add(self, category: str, name: str | None, least: int = ENTITY_LENGTHS[0], longest: int = ENTITY_LENGTHS[1]) -> str | None:
        """The canonical form of an entity; None if it is no valid name.

        Lengths are those of the name as given, blanks around it included. A name already known keeps its form,
        whatever the category; unknown categories register nothing.
        """
        if not isinstance(name, str) or not least <= len(name) <= longest:
            return None
        name = name.strip()
        if name in self.canonical or category not in self.entities:
            return self.canonical.get(name, name)
        if len(self.canonical) >= self.most:
            raise ValueError(f"a registry holds at most {self.most} names")
        # Of equally alike names the first; a name unlike all others stands for itself.
        _, form = max(alike(name, self.entities[category], ENTITY_LIKE), key=lambda x: x[0], default=(1.0, name))
        if form == name:
            self.entities[category].append(name)
        self.canonical[name] = form
        return form

    def names(self, category: str | None = None) -> list[str]:
        """Entities of a category, or of all."""
        return [x for c, xs in self.entities.items() if category in (None, c) for x in xs]

    def clean(self, least: int = 1) -> None:
        """Removes categories of fewer than ``least`` entities, the core ones apart."""
        self.entities = {c: xs for c, xs in self.entities.items() if c in CORE or len(xs) >= least}

    def table(self, spark: SparkSession) -> DataFrame:
        category = {x: c for c, xs in self.entities.items() for x in xs}
        rows = [(n, c, category.get(c)) for n, c in self.canonical.items()]
        return spark.createDataFrame(rows, "name string, canonical string, category string")

    def normalised(self, entities: DataFrame) -> DataFrame:
        """``owner``, ``category``, ``entity`` with canonical entities, invalid names left out, each once."""
        held = F.broadcast(self.table(entities.sparkSession).select("name", "canonical"))  # at most ``most`` rows
        e = entities.where(F.length("entity").between(*ENTITY_LENGTHS)).withColumn("name", F.trim("entity"))
        return e.join(held, "name", "left").select("owner", "category", F.coalesce("canonical", "name").alias("entity")).distinct()

    def save(self, path: str, spark: SparkSession) -> None:
        """Writes names, canonical forms and categories with their descriptions as one Parquet table in the order of arrival."""
        category = {x: c for c, xs in self.entities.items() for x in xs}
        rows = [(i, "category", c, self.descriptions.get(c, ""), None) for i, c in enumerate(self.entities)]
        rows += [(i, "name", n, c, category.get(c)) for i, (n, c) in enumerate(self.canonical.items())]
        spark.createDataFrame(rows, "seq int, kind string, name string, value string, category string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession, most: int = 100_000) -> Registry:
        """The registry that ``save`` wrote; at most ``most`` names reach the driver."""
        out = cls([], most)
        for r in spark.read.parquet(path).orderBy("kind", "seq").collect():
            if r["kind"] == "category":
                out.entities[r["name"]] = []
                if r["value"]:
                    out.descriptions[r["name"]] = r["value"]
            else:
                out.canonical[r["name"]] = r["value"]
                if r["name"] == r["value"] and r["category"] in out.entities:
                    out.entities[r["category"]].append(r["name"])
        return out
