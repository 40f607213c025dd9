"""Byte-level BPE through a cache of pre-tokens.

A pre-token is what the tokenizer's pattern cuts a text into before any merge, so its ids do not
depend on its neighbours and can be kept. Only the pieces that are not kept go to the library.
Texts with characters in ``ODD``, where the pattern's classes differ between libraries or versions of
Unicode, are cut by the library's own pre-tokenizer; their pieces are kept with the others. Only texts
with a special token's string go to the library as a whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any

from tokenizers import Tokenizer

# Fixed value: the pattern of the byte-level pre-tokenizer, for the characters below.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Not among the characters of which the pattern's classes hold: Latin, Greek accents and Cyrillic,
#: without digits raised or in fractions, and without rare white space.
ODD = re.compile("[^\t\n\r -~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u0377\u0400-\u04ff]")
#: A place where every cut of the pattern falls: between a non-space and one space before another.
SEAM = re.compile(r"\S(?= \S)")
#: The same for any text: these characters are letters, digits and spaces to everyone.
ODD_SEAM = re.compile(r"[A-Za-z0-9](?= [A-Za-z])")
#: The longest piece that is kept, and the characters of all that are (twice over), so that words of megabytes
#: are encoded where they stand and no cache outgrows its worker.
LONGEST, KEPT_CHARACTERS = 64, 1 << 22
#: Characters of text that are cut into pre-tokens at once.
SLICE = 1 << 18


@lru_cache(maxsize=8)
def load(path: str) -> Tokenizer:
    """The tokenizer of a file, once per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(tokenizer: Tokenizer) -> list[str]:
    return [token.content for token in tokenizer.get_added_tokens_decoder().values()]


def slices(text: str, size: int = SLICE, seams: re.Pattern = SEAM) -> Iterator[str]:
    """The text in order in parts of about ``size``, cut only where pre-tokens end."""
    start = 0
    while len(text) - start > 2 * size:
        seam = seams.search(text, start + size)
        if seam is None:
            break
        yield text[start:seam.end()]
        start = seam.end()
    yield text[start:] if start else text


def _alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (byte for byte in range(256) if byte not in plain)
    return {byte: chr(byte) for byte in plain} | {byte: chr(256 + k) for k, byte in enumerate(others)}


ALPHABET = _alphabet()


def model_ids(tokenizer: Tokenizer) -> Callable[[str], list[int]]:
    """The ids of a piece, straight from the library's model: nothing is left to cut or to normalise in it."""
    tokens = tokenizer.model.tokenize
    return lambda piece: [t.id for t in tokens(piece.encode().decode("latin-1").translate(ALPHABET))]


def library_pieces(tokenizer: Tokenizer) -> Callable[[str], list[str]]:
    """Cuts any normal text into its pieces by the library's pre-tokenizer."""
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    return lambda text: [text[start:end] for _, (start, end) in cut(text)]


class Generations:
    """Values by key, of the keys asked for of late: at most ``limit`` of them, or those of one part of a text, twice over.

    When ``kept`` is full, by its keys or their characters, it becomes the older generation, from which keys
    that are asked for again come back without being made again. Keys over ``LONGEST`` are never kept.
    """

    def __init__(self, limit: int, make: Callable[[set], dict], fixed: dict | None = None):
        self.limit, self.make, self.fixed = limit, make, fixed or {}
        self.kept, self.old, self.characters = dict(self.fixed), {}, 0

    def need(self, keys: set) -> None:
        """Sees to it that all these keys are in ``kept``."""
        missing = keys.difference(self.kept)
        if not missing:
            return
        more = sum(map(len, missing))
        if len(self.kept) + len(missing) > self.limit + len(self.fixed) or self.characters + more > KEPT_CHARACTERS:
            self.old, self.kept, self.characters = self.kept, dict(self.fixed), 0
            missing = keys.difference(self.kept)
            more = sum(map(len, missing))
        self.characters += more
        again = {key for key in missing if key in self.old}
        self.kept.update((key, self.old[key]) for key in again)
        self.kept.update(self.make(missing.difference(again)))

    def values(self, keys: list[str]) -> Iterable:
        """The values of these keys in order; to be read before the next ones are asked for."""
        own = set(keys)
        if own and max(map(len, own)) > LONGEST:
            self.need({key for key in own if len(key) <= LONGEST})
            return (self.kept[key] if len(key) <= LONGEST else self.make({key})[key] for key in keys)
        self.need(own)
        return map(self.kept.__getitem__, keys)


class PieceCache:
    """What ``value`` makes of the ids of a piece. ``fixed`` are values that are known beforehand and stay."""

    def __init__(self, path: str, value: Callable, limit: int, fixed: dict | None = None):
        self.tokenizer, self.value = load(path), value
        self.special = special_strings(self.tokenizer)
        self.pieces = Generations(limit, self.made, fixed)
        self.cut, self.cut_odd = re.compile(PATTERN).findall, library_pieces(self.tokenizer)

    def made(self, pieces: set[str]) -> dict:
        ids = model_ids(self.tokenizer)
        return {piece: self.value(ids(piece)) for piece in pieces}

    def direct(self, text: str):
        return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def plain(self, text: str) -> bool:
        return not any(s in text for s in self.special)

    def parts(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text without special strings, part by part."""
        odd = ODD.search(text)
        for part in slices(text, seams=ODD_SEAM if odd else SEAM):
            yield self.cut_odd(part) if odd else self.cut(part)

    def values(self, text: str) -> Iterator[Iterable]:
        """The values of the text's pieces in order, part by part of a plain text."""
        return map(self.pieces.values, self.parts(text))


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


_worker: dict[str, Any] = {}


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """The cache of this Python worker under ``name``; it outlives a task, but not a newer name."""
    if name not in _worker:
        _worker.clear()
        _worker[name] = make()
    return _worker[name]
