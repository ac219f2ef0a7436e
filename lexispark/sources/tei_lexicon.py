"""TEI lexica: senses and entries, from a parser that keeps one entry at a time, and from the splits of large files.

A file is read as what stands between its '>' signs, so Spark's reader splits
it anywhere.  Each split tells how it changes the state of a reader (inside a
comment, a quoted attribute, so many entries) whatever the state it starts
with; one row a split, put together, tells where each one starts.  Then every
piece knows the entry it belongs to, entries go to the task of their number,
and are parsed there.  What stands outside entries is checked as a document of
its own, so a malformed file fails as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_MEANING = "[no specified meaning]"
LEXICON_ROWS = "file string, kind string, entry long, inner long, ordinal long, key string, xml_id string, sense string, level string, text string"
COLUMNS = ["file", "kind", "entry", "inner", "ordinal", "key", "xml_id", "sense", "level", "text"]
#: A file's document type declaration goes to every task, so it must be small.
MOST_DECLARED = 1 << 16


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    children: list[Node | str] = field(default_factory=list)

    def iter(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, Node)]


def is_entry(tag: str) -> bool:
    return tag.lower() in ("entry", "entryfree")


class EntryParser:
    """Feeds text, gives outermost entries as they end: names as they are written, entities of an unread DTD passed over."""

    def __init__(self):
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self._start, self._end, self._text
        self.parser.SkippedEntityHandler = lambda *_: None
        self.open: list[Node] = []
        self.done: list[Node] = []

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        if self.open or is_entry(tag):
            e = Node(tag, attributes)
            if self.open:
                self.open[-1].children.append(e)
            self.open.append(e)

    def _end(self, tag: str) -> None:
        if self.open:
            e = self.open.pop()
            if not self.open:
                self.done.append(e)

    def _text(self, data: str) -> None:
        if self.open:
            children = self.open[-1].children
            if children and isinstance(children[-1], str):
                children[-1] += data
            else:
                children.append(data)

    def feed(self, data: str | bytes, last: bool = False) -> list[Node]:
        self.parser.Parse(data, last)
        out, self.done = self.done, []
        return out


def _escaped(s: str, quoted: bool = False) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return s.replace('"', "&quot;") if quoted else s


def written_xml(e: Node) -> str:
    """An element's subtree as XML, attributes in order of their names."""
    attributes = "".join(f' {k}="{_escaped(v, True)}"' for k, v in sorted(e.attributes.items()))
    return f"<{e.tag}{attributes}>{inner_xml(e)}</{e.tag}>"


def inner_xml(e: Node) -> str:
    return "".join(written_xml(c) if isinstance(c, Node) else _escaped(c) if c.strip() else "" for c in e.children)


def meaning(e: Node, tag: str) -> str:
    """A sense's own text: nested senses left out, tr, gloss and hi under the lexicon's tag, other elements as XML."""
    out = []
    for c in e.children:
        if isinstance(c, str):
            out.append(c if c.strip() else "")
        elif (kind := c.tag.lower()) in ("tr", "gloss", "hi"):
            out.append(f"<{tag}>{meaning(c, tag)}</{tag}>")
        elif kind != "sense":
            out.append(written_xml(c))
    return "".join(out)


def rows_of(outer: Node, number: int, tag: str) -> Iterator[dict]:
    """Rows of an outermost entry (inner 0): its senses, then itself; so for each entry in it, whose senses are told again."""
    ordinal = 0
    for inner, entry in enumerate(e for e in outer.iter() if is_entry(e.tag)):
        key = entry.attributes.get("key")
        for s in entry.iter():
            if s is not entry and s.tag.lower() == "sense":
                text = meaning(s, tag)
                yield {"kind": "sense", "entry": number, "inner": inner, "ordinal": ordinal, "key": key, "xml_id": s.attributes.get("id"), "sense": s.attributes.get("n"), "level": s.attributes.get("level"), "text": text if text.strip() else NO_MEANING}
                ordinal += 1
        yield {"kind": "entry", "entry": number, "inner": inner, "ordinal": -1, "key": key, "xml_id": None, "sense": None, "level": None, "text": inner_xml(entry)}


def lexicon_rows(data: bytes, tag: str, chunk: int = 1 << 16) -> Iterator[dict]:
    """Rows of kind sense and entry in document order; an entry's senses come before it, nested ones for both."""
    parser, number = EntryParser(), 0
    for at in range(0, len(data) + 1, chunk):
        for outer in parser.feed(data[at : at + chunk], at + chunk > len(data)):
            yield from rows_of(outer, number, tag)
            number += 1


def lexicon_of(files: DataFrame, tag: str) -> DataFrame:
    """LEXICON_ROWS of (file, content) rows, each content one TEI document."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                for row in lexicon_rows(content, tag):
                    rows.append({"file": file, **row})
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows = []
        yield pd.DataFrame(rows, columns=COLUMNS)

    return files.mapInPandas(parse, LEXICON_ROWS)


# States of a reader between two pieces.
PLAIN, COMMENT, CDATA, PI, DOCTYPE = "", "!--", "![CDATA[", "?", "!DOCTYPE"
#: Inside an attribute's quotes, of a tag that opens an entry or of another.
QUOTED = ['"', "'", '"e', "'e"]
STATES = [PLAIN, COMMENT, CDATA, PI, DOCTYPE, *QUOTED]
#: How the sections of markup end, before the '>'.
ENDS = {COMMENT: "--", CDATA: "]]", PI: "?", DOCTYPE: "]"}
_NAME = re.compile(r"<(/?)([^\s/<>]+)")
_QUOTES = re.compile("[\"']")


def _unquoted(text: str, quote: str | None) -> str | None:
    """The quote that is open at the text's end."""
    at = 0
    while True:
        if quote:
            at = text.find(quote, at) + 1
            if not at:
                return quote
            quote = None
        else:
            m = _QUOTES.search(text, at)
            if not m:
                return None
            quote, at = m[0], m.end()


def step(state: str, piece: str) -> tuple[str, int]:
    """The state after a piece and its '>', and by how much it changes the number of open entries (0 of one that is empty)."""
    if state in ENDS:
        return (PLAIN if (piece.rstrip() if state == DOCTYPE else piece).endswith(ENDS[state]) else state), 0
    opening = state.endswith("e")
    if state:
        rest, quote = piece, state[0]
    else:
        at = piece.find("<")
        if at < 0:
            return PLAIN, 0
        rest, quote = piece[at:], None
        for kind in (COMMENT, CDATA, PI):
            if rest.startswith(f"<{kind}"):
                return (PLAIN if rest[len(kind) + 1 :].endswith(ENDS[kind]) else kind), 0
        if rest.startswith("<!"):
            return (DOCTYPE if "[" in rest and not rest.rstrip().endswith("]") else PLAIN), 0
        m = _NAME.match(rest)
        named = bool(m) and is_entry(m[2])
        if named and m[1]:
            return PLAIN, -1
        opening = named
    quote = _unquoted(rest, quote)
    if quote:
        return quote + ("e" if opening else ""), 0
    return PLAIN, int(opening and not rest.endswith("/"))


def _begins(state: str, piece: str) -> bool:
    """Whether an entry's tag begins in a piece."""
    if state or (at := piece.find("<")) < 0:
        return False
    m = _NAME.match(piece, at)
    return bool(m) and not m[1] and is_entry(m[2])


class Reader:
    """The state through pieces, with the number of outermost entries that began."""

    def __init__(self, state: str = PLAIN, depth: int = 0, number: int = 0):
        self.state, self.depth, self.number = state, depth, number

    def take(self, piece: str) -> tuple[int, int]:
        """(number of the entry that holds the piece, or 0; where in the piece it begins)."""
        at = 0
        if self.depth == 0 and _begins(self.state, piece):
            self.number += 1
            at = piece.find("<")
            holds = self.number
        else:
            # The rest of a quoted tag that opens an outermost entry, or what is in one.
            holds = self.number if self.depth or self.state.endswith("e") else 0
        self.state, change = step(self.state, piece)
        self.depth += change
        return holds, at


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    meta = "_metadata"
    rows = spark.read.option("lineSep", ">").text(paths)
    return rows.select(F.col(f"{meta}.file_path").alias("file"), F.col(f"{meta}.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("piece"))


def _merged(runs: list[list]) -> list[list]:
    """Runs that don't differ any more, as one."""
    out: dict[tuple, list] = {}
    for run in runs:
        same = out.setdefault((run[0], run[1], tuple(run[2].items()), run[3]), run)
        if same is not run:
            same[4] += run[4]
    return [*out.values()]


def _summaries(pieces: DataFrame) -> DataFrame:
    """For every split and state before it: the state after it, the change of depth, and how many entries begin at each depth under the first."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, int], list[list]] = {}
        for batch in batches:
            for file, start, piece in zip(batch["file"], batch["start"], batch["piece"], strict=True):
                # Runs that have come to one state and depth go on as one: [state, depth, {depth: entries that begin there}, declaration, states before].
                runs = found.setdefault((file, start), [[x, 0, {}, "", [k]] for k, x in enumerate(STATES)])
                steps = {}
                for run in runs:
                    state = run[0]
                    if run[1] <= 0 and _begins(state, piece):
                        run[2][run[1]] = run[2].get(run[1], 0) + 1
                    if (state == DOCTYPE and len(run[3]) <= MOST_DECLARED) or (not state and "<!DOCTYPE" in piece):
                        run[3] += (piece if state else piece[piece.index("<!DOCTYPE") :]) + ">"
                    if state not in steps:
                        steps[state] = step(state, piece)
                    run[0], change = steps[state]
                    run[1] += change
            found = {split: _merged(runs) for split, runs in found.items()}
        rows = [(file, start, k, run[0], run[1], [*run[2]], [*run[2].values()], run[3]) for (file, start), runs in found.items() for run in runs for k in run[4]]
        yield pd.DataFrame(rows, columns=["file", "start", "before", "after", "change", "depths", "begun", "declared"])

    return pieces.drop("place").mapInPandas(tell, "file string, start long, before int, after string, change int, depths array<int>, begun array<int>, declared string")


def lexicon(spark: SparkSession, paths: list[str], tag: str) -> DataFrame:
    """LEXICON_ROWS of TEI files in UTF-8; malformed XML fails, as nothing of a lexicon must go missing."""
    pieces = _pieces(spark, paths)
    told: dict[str, dict[int, dict[int, tuple]]] = {}
    declared: dict[str, str] = {}
    for r in _summaries(pieces).collect():  # a few rows for each split of a file
        told.setdefault(r.file, {}).setdefault(r.start, {})[r.before] = (r.after, r.change, dict(zip(r.depths, r.begun, strict=True)), r.declared)
    begins: dict[tuple[str, int], tuple[str, int, int]] = {}
    for file, splits in told.items():
        state, depth, number = PLAIN, 0, 0
        for start in sorted(splits):
            begins[file, start] = (state, depth, number)
            after, change, begun, declaration = splits[start][STATES.index(state)]
            declared[file] = declared.get(file, "") + declaration
            state, number, depth = after, number + begun.get(-depth, 0), depth + change
    if any(len(x) > MOST_DECLARED for x in declared.values()):
        raise ValueError(f"a document type declaration has more than {MOST_DECLARED} characters")
    known = spark.sparkContext.broadcast((begins, declared))  # a row a split, and small declarations

    def put(rows: list[list], file: str, number: int, start: int, place: int, text: str) -> None:
        if rows and rows[-1][0] == file and rows[-1][1] == number and rows[-1][2] == start:
            rows[-1][4].append(text)
        else:
            rows.append([file, number, start, place, [text]])

    def belong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[tuple[str, int], Reader] = {}
        names = ["file", "number", "start", "place", "text"]
        for batch in batches:
            rows: list[list] = []  # what follows in one entry, or outside of all, is one row
            for file, start, place, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "place", "piece")), strict=True):
                reader = readers.get((file, start)) or readers.setdefault((file, start), Reader(*known.value[0][file, start]))
                number, at = reader.take(piece)
                if at or not number:
                    put(rows, file, 0, start, place, piece[:at] if number else piece + ">")
                if number:
                    put(rows, file, number, start, place, piece[at:] + ">")
            for row in rows:
                row[4] = "".join(row[4])
            columns = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        at, texts, rows = None, [], []

        def closed() -> list[dict]:
            file, number = at
            data, declaration = "".join(texts), known.value[1].get(file, "")
            if not number:
                _check_outside(file, data)
                return []
            found = EntryParser().feed(declaration + data, True)
            return [{"file": file, **row} for outer in found for row in rows_of(outer, number - 1, tag)]

        for batch in batches:
            for file, number, text in zip(*(batch.column(c).to_pylist() for c in ("file", "number", "text")), strict=True):
                if (file, number) != at:
                    rows += closed() if at else []
                    at, texts = (file, number), []
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, ROWS)
                        rows = []
                texts.append(text)
        rows += closed() if at else []
        yield pa.RecordBatch.from_pylist(rows, ROWS)

    order = ["file", "number", "start", "place"]
    dealt = pieces.mapInArrow(belong, "file string, number long, start long, place long, text string").repartition("file", "number").sortWithinPartitions(*order)
    return dealt.mapInArrow(parse, LEXICON_ROWS)


ROWS = pa.schema([(name, pa.int64() if name in ("entry", "inner", "ordinal") else pa.string()) for name in COLUMNS])
_ENCODING = re.compile(r"""^﻿?<\?xml[^>]*encoding=["']([\w.-]+)""")


def _check_outside(file: str, text: str) -> None:
    """What stands outside entries must be a document, and say that it is in UTF-8 if anything."""
    last = text.rpartition(">")[0]
    if "<" not in last.rpartition(">")[2]:
        text = last  # the '>' put behind what follows the last one of the file
    m = _ENCODING.match(text)
    if m and m[1].lower() not in ("utf-8", "utf8", "us-ascii", "ascii"):
        raise ValueError(f"{file} is in {m[1]}; UTF-8 is read")
    parser = expat.ParserCreate("utf-8")
    parser.SkippedEntityHandler = lambda *_: None
    parser.Parse(text.lstrip("﻿").encode(), True)
