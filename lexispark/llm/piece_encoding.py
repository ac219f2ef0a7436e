"""SentencePiece encoding and decoding of merge-type models, by backtracking.

A sequence of pieces is what merging gives exactly if every two neighbours,
merged anew on their own, come out as those two: a merge across their border
would have been the best one there, too.  So a text is encoded from left to
right: an Aho-Corasick automaton tells the longest piece that starts at each
place, neighbours are checked by merging them again, and where a piece fits
nothing the next shorter one is tried, then the piece before is given up.  A bit
for each place remembers where no piece could go on, so no place is tried twice
and the time is linear in the text.

No merge crosses two characters that stand beside each other in no piece, so a
text is cut there first; short parts (words) are remembered by each worker.

Models: of the merge type, with the identity as normaliser (spaces become the
model's mark, one is put before the text), with byte fallback; others are refused.

Defined results: a null or empty text has the end id alone, and decodes to the
empty text; repeated rows each get the same answer; an empty table gives an
empty result; other columns stay, unless they have the name of the added one.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexispark.llm.common import bounded_batches, fresh, slices, sole_cache

SPACE = "▁"
#: Parts that a worker remembers, in two generations, and how long a remembered part may be.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
PAIRS = 1_000_000
#: Texts that normalisers, other kinds of models and other treatments of spaces would change.
TELLING = ("ﬁ① É", "  two  spaces ", " ", "unbelievably misinterpreted", "\n\tlines", "日本語 \U0001f600")


class PieceModel:
    """The pieces of a model file, and what encoding and decoding need of them."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        everything = range(lib.vocab_size())
        self.end = lib.eos_id()
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in everything if lib.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError(f"{path} has no byte fallback")
        usual = [i for i in everything if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in usual}
        self.scores = {lib.id_to_piece(i): lib.get_score(i) for i in usual}
        #: id -> what it stands for; a byte's is itself, a control's nothing.
        self.surface = [b""] * len(everything)
        for piece, i in self.ids.items():
            self.surface[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        self.unknown = lib.unk_id()
        self.surface[self.unknown] = lib.decode([lib.unk_id()]).encode()
        self.is_byte = np.zeros(len(everything), bool)
        self.is_byte[[*self.bytes.values()]] = True
        self.decimals = [str(i).encode() for i in everything]
        # Characters that meet inside a piece; a text is cut between all others.
        inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.spaced = not any(x[1] == SPACE and x[0] != SPACE for x in inner)
        self.inner = inner
        reached = [p for p in self.ids if len(p) == 1 or self.merged(p) == (p,)]
        self.automaton = ahocorasick.Automaton()
        for p in reached:
            self.automaton.add_word(p[::-1], p)
        self.automaton.make_automaton()
        known = {*reached}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known or k == 1), None) for p in reached}
        self.fits: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.words = Words(self)
        if any(lib.encode(x, add_eos=True) != self.encode(x).tolist() for x in TELLING):
            raise ValueError(f"{path} isn't of the merge type, or normalises texts")

    def merged(self, text: str) -> tuple[str, ...]:
        """The pieces of a short text by merging: the best pair first, of equal ones the leftmost."""
        score, none = self.scores.get, -math.inf
        parts = list(text)
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
        return tuple(parts)

    def fit(self, one: str, other: str) -> bool:
        """Whether two pieces stay as they are beside each other."""
        if one[-1] + other[0] not in self.inner:
            return True
        if self.pairs >= PAIRS:
            self.fits, self.pairs = {}, 0
        self.pairs += 1
        found = self.fits.setdefault(one, {})[other] = self.merged(one + other) == (one, other)
        return found

    def pieces(self, part: str) -> list[str]:
        """The pieces of a text (spaces marked) by backtracking."""
        last = len(part) - 1
        # Matches ending at one place come with the longest first, and the last of a key counts.
        longest = dict(reversed([*self.automaton.iter(part[::-1])])).get
        failed, fits, shorter, none = bytearray((last + 1 >> 3) + 1), self.fits, self.shorter, {}
        out: list[str] = []
        at, piece, before = 0, longest(last) or part[0], None  # a character that is no piece stands for its bytes
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                good = True if before is None else fits.get(before, none).get(piece)
                if self.fit(before, piece) if good is None else good:
                    out.append(piece)
                    if end > last:
                        return out
                    at, before, piece = end, piece, longest(last - end) or part[end]
                    continue
            if (next_one := shorter.get(piece)) is not None:
                piece = next_one
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                before = out[-1] if out else None

    def ids_of(self, part: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.pieces(part):
            i = self.ids.get(piece)
            if i is None:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(i)
        return tuple(out)

    def parts(self, text: str) -> list[str]:
        """What no merge crosses, each without the mark that it begins with."""
        if self.spaced and SPACE not in text and "  " not in text and text[0] != " " != text[-1]:
            return text.split(" ")
        text = SPACE + text.replace(" ", SPACE)
        if self.spaced:
            return [x[1:] for x in WORD.findall(text)]
        edges = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.inner]
        return [text[a:b] for a, b in zip([0, *edges], [*edges, len(text)])]

    def encode(self, text: str | None, end: bool = True) -> np.ndarray:
        found = [] if not text else map(self.words.__getitem__, self.parts(text)) if self.spaced else [array("i", self.ids_of(x)).tobytes() for x in self.parts(text)]
        return np.frombuffer(b"".join([*found, array("i", [self.end]).tobytes() if end else b""]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: runs of bytes that are no UTF-8 become replacement characters, the first mark goes."""
        parts = [*map(self.surface.__getitem__, ids.tolist())]
        marks = self.is_byte[ids]
        if marks.any() and (b"" in parts[:-1] or self._broken(b"".join(parts))):
            edges = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                parts[a:b] = [replaced(b"".join(parts[a:b])), *[b""] * (b - a - 1)]
        first = next((k for k, x in enumerate(parts) if x), None)
        if first is not None and parts[first].startswith(b" ") and ids[first] != self.unknown and not marks[: first + 1].any():
            parts[first] = parts[first][1:]
        return b"".join(parts).decode("utf-8")

    @staticmethod
    def _broken(data: bytes) -> bool:
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            return True
        return False


class Words(dict):
    """A word (a part without its first mark) -> its ids as bytes; two generations bound the memory."""

    def __init__(self, owner: PieceModel):
        super().__init__()
        self.owner, self.older = owner, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word) or array("i", self.owner.ids_of(SPACE + word)).tobytes()
        if len(word) < REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


#: A mark or several, and what stands before the next.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def replaced(data: bytes) -> bytes:
    """Bytes as UTF-8, each of those that aren't as one replacement character."""
    out, k = [], 0
    while k < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[k : k + n].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        k += n
    return "".join(out).encode()


@lru_cache(maxsize=1)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def model(path: str) -> PieceModel:
    """The worker's model: it and the words it has met stay known between tasks."""
    sole_cache("sentence-pieces", _model.cache_clear)
    return _model(path)


def _added(rows: DataFrame, source: str, makers: Mapping[str, tuple[T.DataType, Callable[[pa.Array], pa.Array]]]) -> DataFrame:
    """rows with columns, each made of the one before it, the first of source; all in one pass of a batch."""
    taken = {n.lower() for n in makers}
    kept = [f for f in rows.schema.fields if f.name.lower() not in taken]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            columns, last = [batch.column(f.name) for f in kept], batch.column(source)
            for _, make in makers.values():
                last = make(last)
                columns.append(last)
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *makers])

    bounded_batches(rows)
    return rows.mapInArrow(add, T.StructType([*kept, *(T.StructField(n, kind) for n, (kind, _) in makers.items())]))


def arrays(lists: pa.Array) -> Iterator[np.ndarray | None]:
    """The lists of a column; null ones are None."""
    values, edges, valid = lists.values.to_numpy(zero_copy_only=False).astype(np.int32, copy=False), lists.offsets.to_numpy().tolist(), lists.is_valid().to_pylist()
    return (values[a:b] if v else None for a, b, v in zip(edges, edges[1:], valid, strict=False))


def encoded(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None, end: bool = True) -> DataFrame:
    """docs with the ids of their whole texts (and the end id if asked for); with the texts that these decode to, where a name is given for them."""
    makers = {ids: (T.ArrayType(T.IntegerType()), lambda texts: _encoded(model(path), texts, end))}
    if decoded:
        makers[decoded] = (T.StringType(), lambda lists: _decoded(model(path), lists))
    return _added(docs, text, makers)


def decoded(rows: DataFrame, path: str, *, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with the texts of their ids; null ids have none."""
    return _added(rows, ids, {name: (T.StringType(), lambda lists: _decoded(model(path), lists))})


def _encoded(m: PieceModel, texts: pa.Array, end: bool) -> pa.Array:
    found = [m.encode(x, end) for x in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(found) if found else np.zeros(0, np.int32))


def _decoded(m: PieceModel, lists: pa.Array) -> pa.Array:
    return pa.array([None if x is None else m.decode(x) for x in arrays(lists)], pa.string())


def digested(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 (decimal ids joined by one space, the end id among them) and decoded_sha256 of their texts."""

    def digests(texts: pa.Array) -> pa.Array:
        m = model(path)
        lists = _encoded(m, texts, True)
        some = [hashlib.sha256(b" ".join(map(m.decimals.__getitem__, x.tolist()))).hexdigest() for x in arrays(lists)]
        back = [hashlib.sha256(x.encode()).hexdigest() for x in _decoded(m, lists).to_pylist()]
        return pa.StructArray.from_arrays([pa.array(np.diff(lists.offsets.to_numpy()), pa.int64()), pa.array(some), pa.array(back)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    (name,) = fresh(docs, "_digests")
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    added = set(kind.names)
    return _added(docs, text, {name: (kind, digests)}).select(*(c for c in docs.columns if c.lower() not in added), f"{name}.*")
