"""Encoding and decoding with a merge-type sentencepiece vocabulary, without replaying the merges of a text.

A sequence of pieces is the merge encoding of its text exactly if each two neighbours are: merging the text of
the two gives these two again. So a text is encoded from left to right by the longest piece at each place, found
by an Aho-Corasick automaton; a piece that doesn't suit its left neighbour gives way to a shorter one, and where
none is left, the place is marked as failed in a bit field and the piece before it gives way. No place is marked
twice, so the work grows with the text. Compatibility of two pieces is found by merging them again, and kept.

Characters without a piece are spelled in bytes and separate what is left and right of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import batch, held, ship, slices

SPACE = "▁"


class _Chunks(dict):
    """Chunk -> its ids, found when first asked for."""

    def __init__(self, pieces: PieceEncoder, entries: int):
        self.pieces, self.entries = pieces, entries

    def __missing__(self, text: str) -> tuple[int, ...]:
        if 2 < len(text) <= 64 and text[-2:] not in self.pieces.joined:
            return self[text[:-1]] + self[text[-1]]  # a mark behind a word: the word is enough to keep
        found = self.pieces.chunk(text)
        if len(self) < self.entries and len(text) <= 64:
            self[text] = found
        return found


class PieceEncoder:
    """`ids(text)`: the ids that the sentencepiece library gives for a merge-type model without normalization rules.

    entries: chunks and pairs kept, each at most; the answer doesn't depend on it.
    """

    def __init__(self, path: str, entries: int = 700_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model, n = self.library, self.library.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = {b: model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        if not all(model.is_byte(i) for i in self.bytes.values()):
            raise ValueError("the vocabulary has no piece for each byte")
        # What the rules below rely on; another model's texts would be changed before they are encoded.
        probe = " \t a  ﬁ　Ａ "
        if "".join(model.id_to_piece(i) if not model.is_byte(i) else "" for i in model.encode(probe)).count(SPACE) != probe.count(" ") + 1:
            raise ValueError("the model does not keep white space as it is, or puts no space before a text")
        # Merges never join two characters that stand side by side in no piece: a text may be cut between them.
        self.joined = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.letters = {c for p in self.id for c in p}
        apart = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in self.letters)
        self.unit = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+|[{apart}]+")
        if any(c[1] == SPACE != c[0] for c in self.joined):
            self.unit = re.compile(".+", re.DOTALL)  # some piece reaches over the start of a word
        self.entries = entries
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known = _Chunks(self, entries)
        # Pieces that their own text doesn't lead to are never an answer.
        usable = [p for p in self.id if len(p) == 1 or self.merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in usable:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        usable = set(usable)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in usable), None) for p in usable}

    def merged(self, text: str) -> list[str]:
        """The merge encoding by its definition: the best-scored neighbours first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (joint := parts[a] + parts[b]) in self.score:
                heap.append((-self.score[joint], a, b, joint))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        heapify(heap)
        while heap:
            _, a, b, joint = heappop(heap)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != joint:
                continue
            parts[a], parts[b] = joint, None
            right[a] = right[b]
            if right[a] < len(parts):
                left[right[a]] = a
            for x, y in ((left[a], a), (a, right[a])):
                if x >= 0 and y < len(parts) and (wider := parts[x] + parts[y]) in self.score:
                    heappush(heap, (-self.score[wider], x, y, wider))
        return [p for p in parts if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the two pieces' text anew ends with these two."""
        found = self.pairs.get((a, b))
        if found is None:
            found = self.merged(a + b) == [a, b]
            if len(self.pairs) < self.entries:
                self.pairs[a, b] = found
        return found

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters have a piece, by backtracking."""
        longest = [0] * len(text)
        for end, n in self.automaton.iter(text):  # ends rise, so the last piece from a place is its longest
            longest[end - n + 1] = n
        failed = bytearray(len(text) // 8 + 1)
        out: list[str] = []
        at, p = 0, text[: longest[0]] if text else ""
        while at < len(text):
            end = at + len(p)
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], p)):
                out.append(p)
                at = end
                p = text[at : at + longest[at]] if at < len(text) else ""
            elif (less := self.shorter[p]) is not None:
                p = less
            else:
                failed[at >> 3] |= 1 << (at & 7)
                p = out.pop()
                at -= len(p)
        return out

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of one chunk."""
        if self.letters.issuperset(text):
            return tuple([self.id[p] for p in self.pieces(text)])
        ids: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in self.letters:
                if start < i:
                    ids += [self.id[p] for p in self.pieces(text[start:i])]
                ids += [self.bytes[b] for b in c.encode("utf-8")]
                start = i + 1
        if start < len(text):
            ids += [self.id[p] for p in self.pieces(text[start:])]
        return tuple(ids)

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        parts = self.unit.findall((SPACE + text).replace(" ", SPACE))
        return list(chain.from_iterable(map(self.known.__getitem__, parts)))

    def text(self, ids: list[int]) -> str:
        """The library's text of the ids."""
        return self.library.decode(ids)


def encoder(path: str, entries: int = 700_000) -> PieceEncoder:
    """The encoder of a worker process."""
    return held(("pieces", path, entries), lambda: PieceEncoder(path, entries))


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of each row's whole text.

    A null text counts as empty and has no ids; null and repeated ids keep their rows, other columns are ignored;
    no rows give no rows. model: a sentencepiece file at the same path on each machine.
    """
    ship(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model)
        for rows in batches:
            texts, names = rows.column("text").to_pylist(), rows.column("doc_id")
            for a, b in slices(texts):
                yield batch(out, [names.slice(a, b - a), [pieces.ids(t) for t in texts[a:b]]])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows of doc_id and ids, as the library decodes them; null ids and no ids are an empty text."""
    ship(encoded.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model)
        for rows in batches:
            yield batch(out, [rows.column("doc_id"), [pieces.text(i or []) for i in rows.column("ids").to_pylist()]])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 of each row's whole text.

    Rows are treated as `encode` says; ids and decoded texts stay in the task that made them.
    """
    ship(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model)
        decimal = held_decimals(pieces)
        for rows in batches:
            texts, names = rows.column("text").to_pylist(), rows.column("doc_id")
            for a, b in slices(texts):
                counts, written, decoded = [], [], []
                for t in texts[a:b]:
                    ids = pieces.ids(t)
                    counts.append(len(ids))
                    written.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(pieces.text(ids).encode("utf-8")).hexdigest())
                yield batch(out, [names.slice(a, b - a), counts, written, decoded])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def held_decimals(pieces: PieceEncoder) -> list[str]:
    return [str(i) for i in range(pieces.library.get_piece_size())]
