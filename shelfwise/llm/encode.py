"""Token ids of whole texts by the tokenizers library, with a bounded cache of encoded words.

Both vocabularies split a text before each space that precedes a non-space character, whatever stands
around it: byte_bpe_50k's pattern binds that space to what follows, word_bpe_49k drops white space.
So a text's ids are the ids of those chunks in a row, and a chunk seen before needs no new encoding.
A chunk of letters is one word to either pattern and goes to the library's model directly.
word_bpe_49k's chunks end at line feeds too, and runs of letters and of ASCII marks in them are pieces of their own.
A text with a special token's string, whose neighbours are split differently, is encoded as a whole.
"""

from __future__ import annotations

import re
import struct
import unicodedata

from shelfwise.llm.common import held

_CHUNKS = re.compile(r" (?=\S)")
_MARKS = ".,;:!?"
# Runs of letters, or of ASCII marks but the apostrophe, which may bind the letter behind it ('s).
_RUNS = re.compile(r"[^\W\d_]+|[!-&(-/:-@\[-`{-~]+")


def byte_letters() -> dict[int, int]:
    """str.translate table of the byte-level alphabet: printable bytes are themselves, others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + n for n, b in enumerate(others)}


_PACK = [struct.Struct(f"<{n}I").pack for n in range(65)]


def packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


class _Cache(dict):
    """Chunk without its leading space -> little-endian ids; None where a chunk isn't a chunk."""

    def __init__(self, encoder: ChunkEncoder, entries: int):
        self.encoder, self.entries = encoder, entries
        self.marks = {m: encoder.whole(m) for m in _MARKS}

    def __missing__(self, chunk: str):
        if not chunk or chunk[0].isspace():
            return None
        word, mark = chunk[:-1], chunk[-1]
        if chunk.isalpha():
            found = self.encoder.word(chunk)
        elif mark in _MARKS and word.isalpha() and word[-1].lower().isalpha():
            # The patterns split letters from the mark behind them, so a known word is enough.
            found = self[word] + self.marks[mark]
        else:
            found = self.encoder.whole(" " + chunk)
        if len(self) < self.entries and len(chunk) <= 64:
            self[chunk] = found
        return found


class _LowerCache(dict):
    """Chunk without white space around it -> little-endian ids, for a vocabulary that drops white space.

    Of several runs in a chunk each is looked up; such chunks have a quarter of the entries, single runs the rest.
    """

    def __init__(self, encoder: ChunkEncoder, entries: int):
        self.encoder, self.entries, self.joined = encoder, entries, entries // 4
        self[""] = b""

    def __missing__(self, chunk: str):
        if chunk.isalpha():
            found = self.encoder.word(chunk)
        else:
            runs = _RUNS.findall(chunk)
            # What changes when it is folded or composed may become another run.
            if len(runs) > 1 and sum(map(len, runs)) == len(chunk) and folded(chunk) == chunk:
                found = b"".join([self[run] for run in runs])
                if self.joined <= 0:
                    return found
                self.joined -= 1
            else:
                found = self.encoder.whole(" " + chunk)
        if len(self) < self.entries and len(chunk) <= 64:
            self[chunk] = found
        return found


def folded(text: str) -> str | None:
    """The text in lower case, where Python's way is the library's: composed, then character by character."""
    if text.isascii():
        return text.lower()
    if "Σ" in text or not unicodedata.is_normalized("NFC", text):
        return None
    lower = text.lower()
    # What composes only now, the library leaves as it is.
    return lower if unicodedata.is_normalized("NFC", lower) else None


class ChunkEncoder:
    """`ids(text)`: the text's ids as little-endian unsigned 32-bit bytes; null counts as empty."""

    def __init__(self, path: str, entries: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A vocabulary of lower-case words: texts are lower-cased first, so that fewer different words are met.
        self.lower = '"Lowercase"' in self.tokenizer.to_str()[:4096]
        self.letters = byte_letters()
        self.space = "" if self.lower else chr(self.letters[32])
        self.cache = (_LowerCache if self.lower else _Cache)(self, entries)

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, letters: str) -> bytes:
        """Ids of a space and letters."""
        if self.lower and folded(letters) != letters:
            return self.whole(" " + letters)
        spelled = letters if letters.isascii() else letters.encode("utf-8").decode("latin-1").translate(self.letters)
        return packed([t.id for t in self.model.tokenize(self.space + spelled)])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        known = self.cache.__getitem__
        if self.lower:
            lower = folded(text)
            return b"".join(map(known, (text if lower is None else lower).replace("\n", " ").split(" ")))
        head, *rest = text.split(" ")
        first = self.whole(head) if head else b""
        try:
            return first + b"".join(map(known, rest))
        except TypeError:  # several white space characters in a row
            head, *rest = _CHUNKS.split(text)
            return (self.whole(head) if head else b"") + b"".join(map(known, rest))


def encoder(path: str, entries: int = 300_000) -> ChunkEncoder:
    """The encoder of a worker process; entries: words it may keep, about 200 bytes each."""
    return held((path, entries), lambda: ChunkEncoder(path, entries))
