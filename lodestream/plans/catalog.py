"""All registries of the core."""

from __future__ import annotations

from lodestream.plans import files, general, graphs, mining, ratings, reviews, streams
from lodestream.plans.registry import Registry


def registries() -> list[Registry]:
    return [m.R for m in (reviews, mining, ratings, streams, graphs, general, files)]
