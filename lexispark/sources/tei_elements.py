"""TEI text as a list of its elements: a table function, and what lies in what by numbers.

Elements and pieces of text are numbered in the order in which they begin.  An
element's end is the last number in it, so whatever has a number from its start
to its end lies in it: ancestors are found by a join on intervals.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ELEMENTS = "start: int, end: int, depth: int, tag: string, attributes: map<string, string>, text: string"


def parsed(text: str) -> list[list]:
    """[start, end, depth, tag, attributes, text] of elements and of pieces of text, which have no tag."""
    out: list[list] = []
    above: list[list] = []

    def start(tag: str, attributes: dict[str, str]) -> None:
        out.append([len(out), len(out), len(above), tag, attributes, None])
        above.append(out[-1])

    def end(_: str) -> None:
        above.pop()[1] = len(out) - 1

    def data(piece: str) -> None:
        if above and out[-1][3] is None and out[-1][2] == len(above) and out[-1][0] > above[-1][0]:
            out[-1][5] += piece
        else:
            out.append([len(out), len(out), len(above), None, None, piece])

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.Parse(text, True)
    return out


def element_list(text: str) -> list[list]:
    """Rows of a text: as it is, if it is XML; else in a span, if that makes it so; else the whole as one piece of text."""
    for attempt in (text, f"<span>{text}</span>"):
        try:
            return parsed(attempt)
        except expat.ExpatError:
            continue
    return [[0, 0, 0, None, None, text]]


@F.udtf(returnType=ELEMENTS)
class TeiElements:
    """TeiElements(text): nothing of a null text."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            yield from map(tuple, element_list(text))


def elements(rows: DataFrame, column: str) -> DataFrame:
    """rows with an element or piece of text of the column in each."""
    return rows.lateralJoin(TeiElements(F.col(column).outer()))


def text_within(found: DataFrame, key: str, tag: str) -> DataFrame:
    """(key, text): what stands in elements of a tag, each piece once though they lie in each other."""
    outer = found.where(F.col("tag") == tag).select(key, F.col("start").alias("first"), F.col("end").alias("last"))
    pieces = found.where("tag is null").select(key, "start", "text")
    within = pieces.join(outer, key).where("start between first and last").select(key, "start", "text").distinct()
    return within.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))
