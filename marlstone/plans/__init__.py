"""Queries of every operator, by subject."""

from __future__ import annotations


def all_registries() -> list:
    from marlstone.plans import pipeline, posts, records, topics

    return [records.registry, posts.registry, topics.registry, pipeline.registry]
