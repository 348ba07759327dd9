"""Whole-text encoding with the ``tokenizers`` library, a bounded cache of pieces in front."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex

from blockloom.llm.common import claim

#: Bytes of text that one call hands to the library.
CHUNK_BYTES = 1 << 18
#: Letters, digits and signs below the combining marks, and line feeds: here lower-casing
#: and white space mean the same in Python and in the library.
_PLAIN = re.compile("[\n!-~¡-ɏ]*").fullmatch


class _Unsafe(Exception):
    """A piece whose tokens depend on what stands beside it."""


def _byte_letters() -> dict[int, int]:
    """Code point of the letter that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 signs stand for themselves; the other bytes follow in order from 256.
    """
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(rest)}


class _Pieces(dict):
    """Token ids of text pieces as bytes; a missing piece is encoded when first asked for.

    Holds at most ``most`` pieces in two generations: when the young one is full it
    becomes the old one, and pieces still in use are taken over from there.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Encodes whole texts as the file's tokenizer does, as little-endian ids.

    A text is cut at single spaces.  A tokenizer whose pre-tokens never cross
    such a cut gives each piece the same ids wherever it stands, so the pieces'
    ids are cached (at most ``cache`` of them) and joined.  Texts with pieces
    that start or end with white space, and tokenizers of another build, go to
    the library whole, and so do texts with the string of a token that the file
    adds to the vocabulary.  ``tests/llm/test_tokens.py`` holds the two ways equal.

    Such strings become the added token's id, as the library has it by default;
    ``special_as_text`` reads those of special tokens as ordinary text.
    """

    def __init__(self, path: str, cache: int, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        added = [t for t in spec.get("added_tokens") or [] if not (special_as_text and t["special"])]
        self.added = tuple(t["content"] for t in added)
        self.model = self.library.model
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.lower = self.spaced = False
        self.split = None if any(t["normalized"] for t in added) else self._pattern(spec)
        self.pieces = _Pieces(self._piece, cache)
        self.heads = _Pieces(self._head, 50_000)
        self.tokens = _Pieces(self._token, 200_000)
        self.stops = {x: self._token(x) for x in ".,"} if self.split else {}

    def _pattern(self, spec: dict):
        """The pre-tokenizer's pattern if the cut at spaces is known to be right, or None."""
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if spec["model"]["type"] != "BPE" or spec["model"].get("dropout") or spec.get("post_processor"):
            return None
        if pre.get("type") == "ByteLevel" and not norm and pre.get("use_regex") and not pre.get("add_prefix_space"):
            import public_tokenizers

            self.spaced = True
            return regex.compile(public_tokenizers.PATTERN)
        steps = pre.get("pretokenizers") or []
        names = [n["type"] for n in (norm or {}).get("normalizers", [])]
        if [s["type"] for s in steps] == ["Split", "ByteLevel"] and names == ["NFC", "Replace", "Lowercase"]:
            first = steps[0]
            if first["behavior"] == "Removed" and first["invert"] and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex"):
                self.lower = True
                return regex.compile(first["pattern"]["Regex"])
        return None

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def _token(self, token: str) -> bytes:
        """Ids of one pre-token."""
        plain = token if token.isalpha() and token.isascii() else token.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.model.tokenize(plain)])

    def _word(self, word: str, space: str) -> bytes:
        """Ids of letters only: one pre-token, after its space."""
        if self.lower and not (word := word.lower()).isalpha():  # a capital may lower to a letter and a mark
            return self._ids(word)
        if word.isascii():
            return self._pack([t.id for t in self.model.tokenize("Ġ" + word if space else word)])
        return self._token(space + word)

    def _ids(self, text: str) -> bytes:
        if not _PLAIN(text.removeprefix(" ") if self.spaced else text):
            return self.whole([text])[0]
        return b"".join(map(self.tokens.__getitem__, self.split.findall(text.lower() if self.lower else text)))

    def _piece(self, piece: str) -> bytes:
        """Ids of what follows a single space.

        Letters before a full stop or comma are looked up by themselves.
        """
        space = " " if self.spaced else ""
        if self.spaced and (not piece or piece[0].isspace() or piece[-1].isspace()):
            raise _Unsafe
        if _PLAIN(piece):
            if piece.isalpha():
                return self._word(piece, space)
            if piece[-1:] in (".", ",") and piece[:-1].isalpha():
                return self.pieces[piece[:-1]] + self.stops[piece[-1]]
        return self._ids(space + piece)

    def _head(self, piece: str) -> bytes:
        if piece and piece[-1].isspace() or not piece and self.spaced:
            raise _Unsafe
        return self._ids(piece)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if self.split is None or any(map(text.__contains__, self.added)):
            return self.whole([text])[0]
        if not text:
            return b""
        try:
            head, *rest = text.split(" ")
            return b"".join([self.heads[head], *map(self.pieces.__getitem__, rest)])
        except _Unsafe:
            return self.whole([text])[0]


#: Pieces of text that a worker's encoder remembers.
CACHE = 700_000

_ENCODERS: dict[tuple[str, int, bool], Encoder] = {}


def encoder(path: str, cache: int = CACHE, special_as_text: bool = False) -> Encoder:
    """One encoder a worker process, kept between its tasks."""
    key = path, cache, special_as_text
    claim(f"tokens {key}", lambda: _ENCODERS.pop(key, None))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def rows(batches, *columns: str, step: int = 256):
    """Python tuples of the named columns, ``step`` rows converted at a time."""
    for batch in batches:
        at = [batch.schema.get_field_index(c) for c in columns]
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield from zip(*(part.column(k).to_pylist() for k in at), strict=True)
