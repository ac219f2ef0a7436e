"""Token ids of whole texts, with the public tokenizers library.

``encoder(path).encode(text)`` equals ``Tokenizer.encode(text,
add_special_tokens=False)``.  For vocabularies whose normaliser and splitter
are the word-level ones below, a text is cut at ASCII white space and, if it is
plain Latin text, between letters, digits and marks (always boundaries there);
each distinct piece goes through the library's own BPE model once per worker,
and a text is the concatenation of its pieces.  Pieces whose
splitting is not plain (apostrophes, controls, anything outside Latin) and
texts holding a special token's opening mark go through the whole library
pipeline; so does every text of any other vocabulary.

``encoder(path).encode_all(texts)`` is the same for many texts at once: pieces
are cut and looked up as arrays, and only unknown ones become Python objects.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexispark.llm.common import sole_cache

PIECE_LIMIT = 250_000
# The normaliser and splitter for which pieces may be encoded one by one.
WORD_NORMALIZER = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLOCK = 1 << 22  # bytes of texts whose pieces are looked up at a time
WHITE = re.compile(rb"[\t-\r ]")
# Kinds of bytes, for plain lower-cased texts and for those cut at white space alone.
SPACE, LETTER, DIGIT, MARK = range(4)
PLAIN_KINDS = bytes(SPACE if WHITE.match(b) else DIGIT if b.isdigit() else LETTER if b.islower() or b >= b"\x80" else MARK for b in (bytes([k]) for k in range(256)))
OTHER_KINDS = bytes(SPACE if WHITE.match(bytes([k])) else MARK for k in range(256))


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs of the given starts and sizes, one run behind another."""
    ends = sizes.cumsum()
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class PieceEncoder(dict):
    """piece (ASCII lower-cased bytes) -> its ids as little-endian bytes.

    Two generations of at most ``limit`` pieces each bound the memory; pieces
    that keep occurring move to the younger one and are never lost.  ``encode_all``
    has a table of its own, cut to the ``limit`` pieces used last when it holds twice as many.
    """

    def __init__(self, path: str, limit: int = PIECE_LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit, self.older = limit, {}
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self.kind = (np.dtype("<u2"), "H") if small else (np.dtype("<u4"), "I")
        # Byte-level letters: printable Latin-1 stands for itself, other bytes follow from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.known = pa.array([], pa.binary())  # pieces, and where their ids lie in known_ids
        self.known_ids, self.sizes, self.used, self.turn = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.letters = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - printable))}
        self.plain = re.compile(r"[!-&(-~À-ÖØ-öø-įı-ɏ]+").fullmatch
        self.plain_text = re.compile(r"[\t-\r !-&(-~À-ÖØ-öø-įı-ɏ]*").fullmatch
        self.split = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^\t-\r a-z0-9\x80-\xff]+").findall
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        normalizers = [x["type"] for x in (config.get("normalizer") or {}).get("normalizers", [])]
        patterns = [x.get("pattern", {}).get("Regex") for x in (config.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = normalizers == WORD_NORMALIZER and patterns == [WORD_PATTERN, None]

    def ids_of(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one run of letters, one digit or one run of marks, in byte-level letters."""
        return array(self.kind, [t.id for t in self.model.tokenize(word)]).tobytes()

    def unknown(self, piece: bytes) -> bytes:
        """Ids of a piece that isn't remembered."""
        if piece.isalpha():
            return self.word(piece.decode())
        if not self.plain(text := piece.decode("utf-8", "replace")):
            return self.ids_of(text)
        if len(parts := self.split(text.lower().encode())) > 1:
            return b"".join([self[p] for p in parts])
        return self.word(parts[0].decode("latin-1").translate(self.letters))

    def __missing__(self, piece: bytes) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = self.unknown(piece)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a UTF-8 text; null counts as empty."""
        if not text:
            return b""
        if not self.by_word or b"<|" in text:
            return self.ids_of(text.decode("utf-8", "replace"))
        whole = text.decode("utf-8", "replace")
        if self.plain_text(whole):  # letters, digits and marks can be told apart on bytes
            return b"".join(map(self.__getitem__, self.split(whole.lower().encode())))
        return b"".join(map(self.__getitem__, text.lower().split()))

    def encode_all(self, texts: list[bytes | None], block: int = BLOCK) -> list[bytes]:
        """encode() of each text; long ones are cut at white space, which no piece crosses."""
        out: list[list[bytes]] = [[] for _ in texts]
        owners, parts, size = [], [], 0

        def flush() -> None:
            for k, ids in zip(owners, self.encode_block(parts), strict=True):
                out[k].append(ids)

        for k, text in enumerate(texts):
            start = 0
            while text and start < len(text):
                end = found.end() if (found := WHITE.search(text, start + block)) else len(text)
                if parts and size + end - start > block:
                    flush()
                    owners, parts, size = [], [], 0
                owners.append(k)
                parts.append(text[start:end])
                size, start = size + end - start, end
        flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def encode_block(self, texts: list[bytes]) -> list[bytes]:
        """encode() of each text, none of them empty, by one look-up of all their pieces."""
        out, at, lowered, kinds = [b""] * len(texts), [], [], []
        for k, text in enumerate(texts):
            whole = text.decode("utf-8", "replace")
            if not self.by_word or b"<|" in text:
                out[k] = self.ids_of(whole)
                continue
            plain = self.plain_text(whole)
            at.append(k)
            lowered.append(low := whole.lower().encode() if plain else text.lower())
            kinds.append(low.translate(PLAIN_KINDS if plain else OTHER_KINDS))
        if not at:
            return out
        begins = np.cumsum([0, *map(len, lowered[:-1])])
        data, kind = (np.frombuffer(b"".join(x), np.uint8) for x in (lowered, kinds))
        first, inside = kind == DIGIT, kind != SPACE
        first[1:] |= kind[1:] != kind[:-1]
        first[begins] = True
        first &= inside
        counts = np.add.reduceat(first, begins, dtype=np.int64)
        data, first = data[inside], np.flatnonzero(first[inside])
        offsets = np.append(first, len(data)).astype(np.int32)
        places = self.places(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
        sizes = self.sizes[places]
        ids = self.known_ids[runs((self.sizes.cumsum() - self.sizes)[places], sizes)].tobytes()
        ends = np.append(0, sizes.cumsum())[counts.cumsum()] * self.dtype.itemsize
        start = 0
        for k, end in zip(at, ends.tolist(), strict=True):
            out[k], start = ids[start:end], end
        self.shrink()
        return out

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece stands among the known ones; the others are added to them."""
        found = pc.index_in(pieces, value_set=self.known)
        places = found.fill_null(0).to_numpy().astype(np.int64)
        if found.null_count:
            missing = found.is_null()
            new = pieces.filter(missing).dictionary_encode()
            places[missing.to_numpy(zero_copy_only=False)] = new.indices.to_numpy().astype(np.int64) + len(self.known)
            ids = [self.unknown(x) for x in new.dictionary.to_pylist()]
            self.known = pa.concat_arrays([self.known, new.dictionary])
            self.known_ids = np.concatenate([self.known_ids, np.frombuffer(b"".join(ids), self.dtype)])
            self.sizes = np.concatenate([self.sizes, np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize])
            self.used = np.concatenate([self.used, np.zeros(len(ids), np.int64)])
        self.turn += 1
        self.used[places] = self.turn
        return places

    def shrink(self) -> None:
        if len(self.used) > 2 * self.limit:
            kept = np.sort(np.argsort(-self.used, kind="stable")[: self.limit])
            self.known_ids = self.known_ids[runs((self.sizes.cumsum() - self.sizes)[kept], self.sizes[kept])]
            self.known, self.sizes, self.used = self.known.take(pa.array(kept)), self.sizes[kept], self.used[kept]


@lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder: pieces stay known between the tasks of a worker."""
    sole_cache("pieces", _encoder.cache_clear)
    return _encoder(path)
