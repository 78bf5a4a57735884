"""Token ids of whole texts through the tokenizers library, with caches of pieces between white space and of their parts.

Two kinds of vocabulary split texts at white space before they merge, so a piece has the same ids alone as in its text; they
are told by the normaliser and pre-tokeniser that their file states. A new piece of Latin letters is split by the file's own
pattern and its parts go to the library's model; other pieces go through the whole tokenizer. Texts with control characters
that libraries class differently as white space, and all texts of other kinds of vocabulary, go through it unsplit.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pieces, and parts, of one generation of a worker's caches; two generations are held, and what was used last stays.
CACHE_PIECES = 150_000
#: Characters that are cut into words at once, about.
BATCH_CHARS = 6_000_000

_ODD_SPACE = re.compile("[\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff]")
#: White space other than a space or line feed; spaces and line feeds that do not stand alone between words.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_NOT_ALONE = "  ", " \n", "\n ", "\n\n\n"
_BETWEEN = re.compile(r"\S (?=\S)")
_LEAD = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: The vocabularies' own patterns (fixed values): words on lower-cased text, and words with a space before them.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a file of each kind states before its model (fixed values).
_LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_DROP = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: A letter beyond this, or a dotted capital I, may be composed or lower-cased differently.
_BEYOND = re.compile("[\u0130\u0250-\U0010ffff]")
_SELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
_REST = [b for b in range(256) if b not in _SELF]
#: The character that stands for each byte in a byte-level vocabulary.
_BYTE = [chr(b) if b in _SELF else chr(256 + _REST.index(b)) for b in range(256)]
_LOADED: dict[str, Encoder] = {}


class _Cache(dict):
    """What make() gives for each key, in two generations: keys that are asked for move to the new one."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > CACHE_PIECES:
            self.old = dict(self)
            self.clear()


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.size = self.tokenizer.model, self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        before = stated.get("normalizer"), stated.get("pre_tokenizer")
        plain = stated["model"].get("type") == "BPE" and not any(stated["model"].get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix"))
        plain = plain and all(t.get("special") and not t.get("normalized") for t in stated.get("added_tokens", []))
        #: drop: white space is left out; lead: a space belongs to the word after it; whole: neither is known.
        self.kind = "drop" if plain and before == (_LOWER, _DROP) else "lead" if plain and before == (None, _BYTES) else "whole"
        self.find = regex.compile(_WORDS if self.kind == "drop" else _SPACED).findall
        self.parts = _Cache(self._part)
        self.pieces = _Cache(self._piece)
        self.spaced = _Cache(self._spaced)

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _LOADED:
            _LOADED[path] = Encoder(path)
        return _LOADED[path]

    def _direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():
            spelt = part
        elif part[0] == " " and part.isascii() and part[1:].isalpha():
            spelt = _BYTE[32] + part[1:]
        else:
            spelt = "".join([_BYTE[b] for b in part.encode()])
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() and _BEYOND.search(piece):
            return self._direct(piece)
        if self.kind == "drop":
            piece = piece.lower()
        if piece.isalpha() or piece[0] == " " and piece[1:].isalpha():  # one part, as most are
            return self._part(piece)
        # parts that are words are held as such
        return b"".join([self.pieces[p] if p.isalpha() else self.spaced[p[1:]] if p[0] == " " and p[1:].isalpha() else self.parts[p] for p in self.find(piece)])

    def _spaced(self, word: str) -> bytes:
        return self._piece(" " + word)

    def _apart(self, text: str) -> bytes | None:
        """The ids of a text that is not cut into words with the others; None if it can be."""
        if self.kind == "whole" or _ODD_SPACE.search(text):
            return self._direct(text)
        if self.kind == "lead" and (text[0] == " " or text[-1] in " \n" or any(x in text for x in _NOT_ALONE) or _OTHER_SPACE.search(text)):
            return b"".join(map(self.pieces.__getitem__, _LEAD.findall(text)))
        return None

    def _words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are words between white space: each distinct word of the batch is looked up once."""
        if not texts:
            return []
        column = pa.array(texts, pa.large_string())
        if self.kind == "lead":  # only single spaces, and line feeds, which are words of their own
            column = pc.split_pattern(pc.replace_substring(column, "\n", " \n "), " ")
        else:
            column = pc.utf8_split_whitespace(column)
        ends, found = column.offsets.to_numpy(), column.flatten().dictionary_encode()
        codes, words = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.kind == "lead":
            first, line, none = np.zeros(len(codes) + 1, bool), *(words.index(x) if x in words else -1 for x in ("\n", ""))
            there = codes != none  # two line feeds have an empty word between them
            first[ends[:-1]] = True
            start = np.concatenate(([0], np.cumsum(there)))
            first, codes, ends = first[:-1][there], codes[there], start[ends]
            first[1:] |= codes[:-1] == line
            # words after a space and words after none are looked up apart
            alone = codes[first | (codes == line)]
            codes = np.where(first | (codes == line), codes + len(words), codes)
            used = np.zeros(2 * len(words), bool)
            used[codes] = True
            values = [b""] * (2 * len(words))
            for k in np.flatnonzero(used[: len(words)]).tolist():
                values[k] = self.spaced[words[k]]
            for k in set(alone.tolist()):
                values[len(words) + k] = self.pieces[words[k]]
        else:
            values = [b"" if not w else self.pieces[w] for w in words]
        sizes = np.fromiter(map(len, values), "i8", len(values)) // 4
        flat, starts = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
        own = sizes[codes]
        after = np.concatenate(([0], np.cumsum(own)))
        ids = flat[np.repeat(starts[codes] - after[:-1], own) + np.arange(after[-1])].tobytes()
        cuts = (4 * after[ends]).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text has none. Very long texts are cut at spaces."""
        out: list[bytes] = []
        counts: list[int] = []  # parts of each text
        held, chars = [], 0

        def flush():
            nonlocal held, chars
            for cache in (self.parts, self.pieces, self.spaced):
                cache.turn()
            apart = [self._apart(x) for x in held]
            rest = iter(self._words([x for x, ids in zip(held, apart, strict=True) if ids is None]))
            out.extend(next(rest) if ids is None else ids for ids in apart)
            held, chars = [], 0

        for text in texts:
            own = self._segments(text) if text else []
            counts.append(len(own))
            for x in own:
                held.append(x)
                chars += len(x)
                if chars >= BATCH_CHARS:
                    flush()
        flush()
        ends = list(accumulate(counts))
        return [out[b - 1] if n == 1 else b"".join(out[b - n : b]) for n, b in zip(counts, ends, strict=True)]

    def _segments(self, text: str) -> list[str]:
        """text in parts of about BATCH_CHARS characters, each but the first from a space between two words on."""
        if len(text) <= BATCH_CHARS or self.kind == "whole" or _ODD_SPACE.search(text):
            return [text]
        out, at = [], 0
        while cut := _BETWEEN.search(text, at + BATCH_CHARS):
            out.append(text[at : cut.start() + 1])
            at = cut.start() + 1
        return [*out, text[at:]]


def batches(rows, text_of, limit: int, count: int):
    """Lists of rows of about limit characters or count rows."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(text_of(row) or "")
        if chars >= limit or len(held) >= count:
            yield held
            held, chars = [], 0
    if held:
        yield held
