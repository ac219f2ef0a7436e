"""Fill-in-the-middle transformation by lookaround splitting.

A text is cut into units: runs of a class of characters, and single characters
of no class.  A unit grammar becomes a regex of zero width, which matches
between two neighbours unless both are of one class, and Spark's ``split`` at it
keeps every character.  Two cuts, drawn from a digest of the document's id,
give prefix, middle and suffix, which sentinels put in one of two orders.

All of it is expressions over a row: no shuffle, no Python.

Defined results: a null or empty text has no units (``split`` would give one
empty piece) and stays plain and empty; so does a text that holds a sentinel
stay as it is; a null id is drawn as the id without digits; repeated rows each
get the same answer; an empty table gives an empty result; other columns stay,
unless they have the name of a column that is added, whose place it takes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import fresh

#: Unit grammars: the classes whose characters form runs.
LETTERS = ("A-Za-z",)
WORDS_AND_SPACES = (r"\p{L}\p{M}\p{N}", r"\s")
CHARACTERS = ()


@dataclass(frozen=True)
class Settings:
    classes: Sequence[str] = LETTERS
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    #: Of 100 documents, those that are transformed, and of these, those with the suffix first.
    transformed: int = 90
    suffix_first: int = 20
    seed: int = 1


def boundary(classes: Sequence[str]) -> str:
    """The regex of zero width between two units; the classes have no character in common.

    Java looks at a pair of surrogates as two places: the one between them is no boundary.
    """
    alone = f"(?<![{''.join(classes)}])" if classes else ""
    between = "|".join([*(f"(?<=[{c}])(?![{c}])" for c in classes), alone])
    return rf"(?!\A)(?!\z)(?![\x{{DC00}}-\x{{DFFF}}])(?:{between})"


def units(text: Column, classes: Sequence[str] = LETTERS) -> Column:
    """The text's units in order; none of an empty or null text."""
    body = F.coalesce(text, F.lit(""))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, boundary(classes), -1))


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, settings: Settings = Settings(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix, middle and suffix (null if plain) and output."""
    s = settings
    added = ("n", "form", "prefix", "middle", "suffix", "output")
    docs = docs.select(*(c for c in docs.columns if c.lower() not in {*added} - {text.lower(), key.lower()}))
    pieces, h, low, high = fresh(docs, "_units", "_draws", "_low", "_high")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn(pieces, units(F.col(text), s.classes)).withColumn(h, F.array(*draws(F.col(key), s.seed)))
    n, cut = F.size(pieces), lambda k: (F.col(h)[k] % (F.size(pieces) + 1)).cast("int")
    marked = body.rlike("|".join(map(re.escape, (s.prefix, s.suffix, s.middle))))
    plain = (body == "") | marked | (F.col(h)[2] % 100 >= s.transformed)
    form = F.when(plain, "plain").when(F.col(h)[3] % 100 < s.suffix_first, "spm").otherwise("psm")
    rows = rows.select("*", n.cast("long").alias("n"), form.alias("form"), F.least(cut(0), cut(1)).alias(low), F.greatest(cut(0), cut(1)).alias(high))
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice(pieces, start, size), ""))
    rows = rows.select(
        *docs.columns, "n", "form",
        part(F.lit(1), F.col(low)).alias("prefix"),
        part(F.col(low) + 1, F.col(high) - F.col(low)).alias("middle"),
        part(F.col(high) + 1, F.col("n").cast("int") - F.col(high)).alias("suffix"),
    )
    p, m, x = (F.concat(F.lit(mark), F.col(c)) for mark, c in ((s.prefix, "prefix"), (s.middle, "middle"), (s.suffix, "suffix")))
    output = F.when(F.col("form") == "psm", F.concat(p, x, m)).when(F.col("form") == "spm", F.concat(x, p, m)).otherwise(body)
    return rows.select("*", output.alias("output"))


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that an output of that form was made from."""
    s = settings
    parts = F.split(output, "|".join(map(re.escape, (s.prefix, s.suffix, s.middle))), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
