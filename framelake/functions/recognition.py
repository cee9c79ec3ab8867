"""What a line recogniser's output says: labels, decoding, confidence."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def dictionary(entries: list[str], count: int | None = None, sha256: str | None = None) -> list[str]:
    """Labels 1, 2, ... of a recogniser: the entries, then a space. They must be non-empty, unique and without a space of their own;
    count and sha256 (over the entries, each with a line feed) are checked where given."""
    if count is not None and len(entries) != count:
        raise ValueError(f"{len(entries)} entries, not {count}")
    if "" in entries or " " in entries or len(set(entries)) < len(entries):
        raise ValueError("an entry is empty, a space, or there twice")
    if sha256 is not None and hashlib.sha256("".join(e + "\n" for e in entries).encode()).hexdigest() != sha256:
        raise ValueError("not the entries that were expected")
    return [*entries, " "]


def best_labels(steps: Column) -> Column:
    """Per step (an array of scores) the place of its highest score, the first of equal ones. Scores that are not finite are an error."""
    bad = F.exists(steps, lambda s: F.coalesce(F.exists(s, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True)))
    found = F.transform(steps, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))
    return F.when(bad, F.raise_error(F.lit("a score is not finite"))).otherwise(found)


def ctc_text(steps: Column, labels: list[str]) -> Column:
    """The text of a line: labels unlike the step's before and not blank (0), joined. One expression a row, so nothing is shuffled.

    Null steps give null; a step of another number of classes than labels and blank is an error.
    """
    words = F.array(*map(F.lit, ["", *labels]))
    fits = F.forall(steps, lambda s: F.size(s) == len(labels) + 1)
    ids = best_labels(steps)
    kept = F.filter(F.arrays_zip(ids.alias("now"), F.concat(F.array(F.lit(0)), F.slice(ids, 1, F.greatest(F.size(steps) - 1, F.lit(0)))).alias("before")), lambda p: (p["now"] != 0) & (p["now"] != p["before"]))
    text = F.array_join(F.transform(kept, lambda p: F.element_at(words, p["now"] + 1)), "")
    return F.when(steps.isNull(), None).when(~fits, F.raise_error(F.lit("a step has another number of classes"))).otherwise(text)
