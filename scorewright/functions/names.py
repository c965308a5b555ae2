"""Names of run folders, zones and judge models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .citations import literal_map

#: Fixed value: switches thinking off in the chat templates of the models whose names hold one of FAMILIES.
NO_THINK, FAMILIES = "\n\n/no_think", "qwen|glm"


def folder_name(path: Column) -> Column:
    """The last part of a path, without the prefix eval_."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]+)/*$", 1), "^eval_", "")


def title_case(slug: Column) -> Column:
    """A zone's heading: underscores become blanks, words start with a capital."""
    return F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))


def reasons(model: Column) -> Column:
    """Whether a model belongs to a family that thinks aloud; false for null."""
    return F.coalesce(F.lower(model).rlike(FAMILIES), F.lit(False))


def request(model: Column, prompt: Column) -> Column:
    return F.when(reasons(model), F.concat(prompt, F.lit(NO_THINK))).otherwise(prompt)


def budget(model: Column, budgets: dict[str, int], default: int) -> Column:
    """Output tokens that a model may use."""
    own = F.try_element_at(literal_map({k: str(v) for k, v in budgets.items()}), model) if budgets else F.lit(None)
    return F.coalesce(own.cast("long"), F.lit(default).cast("long"))
