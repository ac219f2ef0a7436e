"""All subsets of a row's present features, by bit mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(features: tuple[str, ...]) -> Column:
    """Array of (name, value) of the features that aren't null, in order."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in features))
    return F.filter(pairs, lambda x: x["value"].isNotNull())


def subsets(pairs: Column) -> Column:
    """Array of all subsets (the empty one too) of an array of pairs, each in the array's order.

    A subset is an array of pairs; there are 2**k of them, so call this on
    distinct feature vectors only.
    """
    masks = F.sequence(F.lit(0), F.pow(F.lit(2), F.size(pairs)).cast("int") - 1)
    return F.transform(masks, lambda m: F.filter(pairs, lambda _, k: F.getbit(m, k) == 1))
