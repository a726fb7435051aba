"""Prompts from templates with named places, as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.functions.text import empty_if_null

#: Characters of context on either side of a passage.
CONTEXT = 500


def fill(template: str, **values: Column) -> Column:
    """template with each {name} replaced by the value of that name; null counts as empty, a name without value raises KeyError."""
    parts = []
    for before, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(before))
        if name is not None:
            parts.append(empty_if_null(values[name].cast("string")))
    return F.concat(*parts) if parts else F.lit("")


def ending(text: Column, n: int = CONTEXT) -> Column:
    """The last n characters; null is empty."""
    return F.right(empty_if_null(text), F.lit(n))


def opening(text: Column, n: int = CONTEXT) -> Column:
    return F.substring(empty_if_null(text), 1, n)


def naive() -> Column:
    return F.lit(vocab.PROMPTS["naive"])


def topical(topic: Column, domain: Column) -> Column:
    return fill(vocab.PROMPTS["topical"], topic=topic, domain=domain)


def contextual(section: Column, text: Column, start: Column, end: Column, n: int = CONTEXT) -> Column:
    """For the passage [start, end) of text: n characters before it and n after it, of whatever text there is."""
    whole = empty_if_null(text)
    before = F.substring(whole, F.greatest(start - n, F.lit(0)) + 1, F.least(F.greatest(start, F.lit(0)), F.lit(n)))
    after = F.substring(whole, F.greatest(end, F.lit(0)) + 1, F.lit(n))
    return fill(vocab.PROMPTS["contextual"], section=section, preceding=before, following=after)
