"""Attributes of other models, reached over the entities that models share.

A model names its entities by their key columns. Another model describes an entity if it has one row per key, or if it says how its several rows
per key become one; these are grouped to the key before they join, so no join multiplies the rows that are measured.
The way to an attribute is the shortest over such descriptions; where two are equally short, the caller has to say which model is meant.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.joins import FanOut, lookup
from ledgerline.sources.tables import Tables


@dataclass(frozen=True)
class Route:
    """Steps of (entity, model that describes it) from a model to an attribute of the last of them."""

    steps: tuple[tuple[str, str], ...]
    attribute: str

    def __str__(self) -> str:
        return " > ".join(f"{model} by {entity}" for entity, model in self.steps)


class AmbiguousPath(ValueError):
    """Several equally short ways lead to an attribute."""


def one_row_each(model, entity: str) -> bool:
    return model.grain == (model.entities[entity],)


def described(model, entity: str) -> Mapping[str, str | None]:
    """What a model tells of each key of an entity: names, with how several rows become one, or None where there is one row."""
    if entity not in model.entities:
        return {}
    if one_row_each(model, entity):
        return dict.fromkeys([*model.dimensions, *model.entities.values(), *([model.time] if model.time else [])])
    return model.per_key.get(entity, {})


def shortest(models: Mapping, start, entity: str, attribute: str, through: str | None = None) -> list[Route]:
    """All shortest routes from a model to ``entity__attribute``; ``through`` names the model the attribute has to come from."""
    open_routes = [(own, ()) for own in start.entities]
    seen = set(start.entities)
    while open_routes:
        found, further = [], []
        for at, steps in open_routes:
            for name, model in models.items():
                if model is start or any(name == used for _, used in steps):
                    continue
                told = described(model, at)
                if at == entity and attribute in told and through in (None, name):
                    found.append(Route((*steps, (at, name)), attribute))
                further += [(e, (*steps, (at, name))) for e, key in model.entities.items() if e not in seen and key in told]
        if found:
            return found
        seen.update(e for e, _ in further)
        open_routes = further
    return []


def parsed(models: Mapping, dimension: str) -> tuple[str, str | None, str]:
    """Entity, model if one is named, and attribute of ``entity__attribute`` or ``entity__model__attribute``."""
    entity, _, rest = dimension.partition("__")
    model, _, attribute = rest.partition("__")
    return (entity, model, attribute) if attribute and model in models else (entity, None, rest)


def route(models: Mapping, start, dimension: str) -> Route:
    """The one shortest route to a dimension such as ``customer__region`` or ``account__interest__product_id``."""
    entity, through, attribute = parsed(models, dimension)
    found = shortest(models, start, entity, attribute, through)
    if len(found) > 1:
        ways = ", ".join(f"{entity}__{r.steps[-1][1]}__{attribute}" if len(r.steps) == 1 else str(r) for r in found)
        raise AmbiguousPath(f"{dimension} of {start.mart} is told by several models: {ways}")
    if found:
        return found[0]
    for model in models.values():
        if model is not start and entity in start.entities and entity in model.entities and attribute in (*model.dimensions, model.time):
            raise FanOut(f"{model.mart} has several rows per {entity} and no rule for {attribute}; it cannot describe {start.mart}")
    raise ValueError(f"{start.mart} has no dimension {dimension!r}")


def described_frame(tables: Tables, model, entity: str, names: Sequence[str]) -> DataFrame:
    """One row per key of an entity: ``_key`` and the named attributes. Rows without a key describe nothing."""
    key, told = model.entities[entity], described(model, entity)
    rows = tables.ref(model.mart).where(F.col(key).isNotNull())
    if one_row_each(model, entity):
        return rows.select(F.col(key).alias("_key"), *[F.expr(model.dimensions.get(n, n)).alias(n) for n in names])
    return rows.groupBy(F.col(key).alias("_key")).agg(*[F.expr(told[n]).alias(n) for n in names])


def attributes(tables: Tables, models: Mapping, start, dimensions: Mapping[str, Route]) -> DataFrame:
    """Dimensions that share their steps, by the key of the first: the start's own key column and a column for each dimension."""
    steps = next(iter(dimensions.values())).steps
    frame, key = None, "_key"
    for i, (entity, name) in enumerate(steps):
        model = models[name]
        then = models[name].entities[steps[i + 1][0]] if i + 1 < len(steps) else None
        wanted = [then] if then else list(dict.fromkeys(r.attribute for r in dimensions.values()))
        step = described_frame(tables, model, entity, wanted)
        if frame is None:
            frame = step
        else:
            frame = lookup(frame.withColumnRenamed(key, "_next"), step.withColumnRenamed("_key", "_next"), "_next", "left").drop("_next")
            frame = frame.withColumnRenamed("_first", "_key")
        if then:
            frame = frame.withColumnRenamed("_key", "_first")
            key = then
    own = start.entities[steps[0][0]]
    return frame.select(F.col("_key").alias(own), *[F.col(r.attribute).alias(d) for d, r in dimensions.items()])
