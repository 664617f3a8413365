"""Writing memory facts: what says nearly the same as a known fact updates it, the rest is added."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.session import ship

#: The likeness from which a fact counts as known, and how many of the newest facts are looked at.
KNOWN, NEWEST = 0.5, 300
_WORD = re.compile(r"[a-z0-9]+")

EVENTS = "fact_id string, event string, previous string, next string"


def fact_words(text: str) -> frozenset[str]:
    """Lower-cased runs of a-z and 0-9."""
    return frozenset(_WORD.findall((text or "").lower()))


def likeness(a: frozenset[str], b: frozenset[str]) -> float:
    """The Jaccard coefficient; 0 if both are empty."""
    return len(a & b) / len(a | b) if a or b else 0.0


class Newest:
    """The newest facts of one scope: id, text and words, the oldest first."""

    def __init__(self, most: int = NEWEST):
        self.most, self.facts = most, OrderedDict()

    def add(self, fact_id: str, text: str, known: float) -> tuple[str, str, str | None]:
        """(fact id, event, previous text) of a new text: the most alike of the newest facts gets it, if it is alike enough; of equally alike ones the newest."""
        words, best, at = fact_words(text), known, None
        for k, (_, theirs) in reversed(self.facts.items()):
            score = likeness(words, theirs)
            if score > best or (at is None and score >= best):
                best, at = score, k
        previous = self.facts.pop(at)[0] if at is not None else None
        self.facts[at or fact_id] = (text, words)
        if len(self.facts) > self.most:
            self.facts.popitem(last=False)
        return at or fact_id, "add" if at is None else "update", previous


def write_facts(facts: DataFrame, scope: str, order: list[str], fact_id: str, content: str, known: float = KNOWN, newest: int = NEWEST) -> DataFrame:
    """(scope, order..., fact_id, event, previous, next): what writing the facts of each scope in order does, an event a fact.

    A scope's facts are written one after the other. event: 'add', or 'update' with the text that is replaced; fact_id is
    that of the fact that is added or updated. Texts are trimmed; null and blank ones are not written. A null scope is a
    scope. Rows are sorted by scope in the shuffle and streamed, so a task holds the newest facts of one scope at a
    time, however many it writes; the scopes are what is dealt out. Rows of equal order are written by fact_id.
    """
    ship(facts.sparkSession)
    text = F.trim(content)
    rows = facts.where(F.length(text) > 0).select(F.col(scope).alias("_scope"), *order, F.col(fact_id).cast("string").alias("fact_id"), text.alias("next"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-2])

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope_now, held = object(), Newest(newest)
        for f in frames:
            out = []
            for s, i, t in zip(f["_scope"].tolist(), f["fact_id"].tolist(), f["next"].tolist(), strict=True):
                s = None if s is None or s != s else s
                if s != scope_now:
                    scope_now, held = s, Newest(newest)
                out.append(held.add(i, t, known))
            yield f[["_scope", *order]].assign(fact_id=[x[0] for x in out], event=[x[1] for x in out], previous=[x[2] for x in out], next=f["next"])

    sorted_ = rows.repartition("_scope").sortWithinPartitions("_scope", *order, "fact_id")
    return sorted_.mapInPandas(kernel, f"{kinds}, {EVENTS}").withColumnRenamed("_scope", scope)


def facts_after(events: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """(scope, fact_id, content, writes): the facts as the events leave them."""
    last = F.max_by("next", F.struct(*order, "event"))
    return events.groupBy(scope, "fact_id").agg(last.alias("content"), F.count(F.lit(1)).alias("writes"))
