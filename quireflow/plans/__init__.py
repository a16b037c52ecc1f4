"""Queries over the driver's tables, one per operator, each with its SQL twin where SQL can tell."""

from __future__ import annotations

from quireflow.catalog import Catalog


def catalog() -> Catalog:
    from quireflow.plans import aggregates, boxes, chunks, evaluation, ordered, records, search, texts, transcripts, wordboxes

    c = Catalog()
    for module in (texts, chunks, boxes, search, aggregates, evaluation, ordered, records, transcripts, wordboxes):
        module.register(c)
    return c
