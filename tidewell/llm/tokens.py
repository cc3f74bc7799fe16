"""Ids of a word-level BPE tokenizer, word by word and cached.

The tokenizer of ``word_bpe_49k.json`` splits at white space before anything else, so the ids of a text are those of its
words in turn. A corpus repeats its words, so a worker keeps the ids of the words that it has met, as little-endian
unsigned 32-bit integers, and joins them. Words of Latin letters go straight to the library's BPE model after the
tokenizer's own lower-casing and splitting; every other word, and every text that holds a special token or a control
character which Python counts as white space, goes through the whole tokenizer.

Texts of Latin letters alone are taken together: Arrow lower-cases and splits them, finds their distinct words, and parts
each into letters and the marks behind them, so a worker keeps one entry for a word however it is written. Each distinct
part is looked up once, and numpy puts the ids in the words' places. The more text is taken together, the fewer look-ups.
"""

from __future__ import annotations

import codecs
import os
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes, as estimated from lengths, of each of the two generations of words and pieces that a worker keeps; when the
#: younger is full, the older goes. Longer words are encoded each time they are met.
CACHE_BYTES, LONGEST = 96 << 20, 64
#: The tokenizer's own split pattern (fixed values: its JSON file holds the same).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that may end a word: a run of them behind letters is one piece.
MARKS = string.punctuation
#: The letters below U+0250, and their lower case, which may be above.
LETTERS = "".join(sorted({x for c in map(chr, range(0x250)) for x in c + c.lower() if x.isalpha()}))
#: Bytes of text that are taken together, and words whose ids are placed at once.
TOGETHER, PLACED = 16 << 20, 1 << 20
#: What no text that is taken with others holds: controls, the no-break space, the soft hyphen, the dotted capital I, and all
#: from U+0250 (as RE2). So white space is ASCII there, and Arrow's ASCII functions do: its utf8_split_whitespace leaves
#: white space at the end of an array's last text, behind utf8_lower.
APART = r"[\x00-\x08\x0E-\x1F\x7F-\xA0\xAD\x{130}]|[^\x00-\x{24F}]"
#: Control characters that str.split() takes for white space and the tokenizer may not.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")


def default_vocabulary() -> str:
    """The installed public vocabulary; ``public_tokenizers.path`` gives its place on each machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> str:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join([chr(b) if b in plain else chr(next(spare)) for b in range(256)])


def _placed(ids: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs of ``ids``, of these sizes and in this order, that ``places`` names, one after another."""
    starts, out = np.cumsum(sizes) - sizes, [ids[:0]]
    for a in range(0, len(places), PLACED):
        at = places[a : a + PLACED]
        n = sizes[at]
        out.append(ids[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    return np.concatenate(out)


class WordEncoder:
    """Encodes whole texts to the bytes of their ids."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path or default_vocabulary())
        self.model = self.tokenizer.model
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = "|".join([APART, *map(re.escape, self.special)])
        self.letters = _byte_letters()
        self.split = regex.compile(PIECES).findall
        self.known = _Known(self._word, self._piece)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else codecs.charmap_decode(piece.encode(), "strict", self.letters)[0]
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _word(self, word: str) -> bytes:
        # Below U+0250, but for the dotted capital I, nothing composes and lower case is letter by letter.
        if not word.isprintable() or not (word.isascii() or max(word) < "ɐ" and "İ" not in word):
            return self._whole(word)
        low = word.lower()
        if low.isalpha():
            return self._piece(low) if low == word else self.known[low]
        core = low.rstrip(MARKS)
        pieces = [core, low[len(core) :]] if core != low and core.isalpha() else self.split(low)
        # A piece is a word of one piece, so words and pieces share one cache.
        return self._piece(low) if len(pieces) == 1 else b"".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text; a null text has none."""
        if not text:
            return b""
        if ODD_SPACE.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        return b"".join(map(self.known.__getitem__, text.split()))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """As ``encode`` gives them, in order."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        a, base = 0, 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, base + TOGETHER, side="right")))
            some = texts.slice(a, b - a)
            apart = pc.match_substring_regex(some, self.apart)
            alike = self._together(some.filter(pc.invert(apart)))
            for k, odd in enumerate(apart.to_pylist()):
                yield self.encode(some[k].as_py()) if odd else next(alike)
            a, base = b, int(ends[b - 1])

    def _together(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of texts that hold nothing of ``apart``."""
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        words = lists.flatten().dictionary_encode()
        cores = pc.ascii_rtrim(words.dictionary, characters=MARKS)
        alone = pc.utf8_is_alpha(cores)
        heads = pc.if_else(alone, cores, words.dictionary).dictionary_encode()
        marks = pc.if_else(alone, pc.utf8_ltrim(words.dictionary, characters=LETTERS), "").dictionary_encode()
        found = self.known.all(np.concatenate([x.dictionary.to_numpy(zero_copy_only=False) for x in (heads, marks)]).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        parts = np.stack([heads.indices.to_numpy(), marks.indices.to_numpy() + len(heads.dictionary)], axis=1)
        ids = _placed(np.frombuffer(b"".join(found), "<u4"), sizes, parts.ravel())
        sizes, places = sizes[parts].sum(axis=1), words.indices.to_numpy()
        whole = _placed(ids, sizes, places)
        ends = np.concatenate([[0], np.cumsum(sizes[places])])[lists.offsets.to_numpy()]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield whole[a:b].tobytes()


class _Known(dict):
    """Word to ids, filled as words are met; a word of the older generation moves to the younger when met again."""

    def __init__(self, make, make_letters):
        self.make, self.make_letters, self.older, self.held = make, make_letters, {}, 0

    def all(self, keys: list[str]) -> list[bytes]:
        """Ids of words or pieces of texts that hold nothing of ``apart``; an empty one has none. Arrow leaves a few capitals, which ``make`` lowers."""
        found = list(map(self.get, keys))
        for k, got in enumerate(found):
            if got is None:
                key = keys[k]
                found[k] = self._kept(key, self.make_letters if key.islower() and key.isalpha() else self.make) if key else b""
        return found

    def __missing__(self, key: str) -> bytes:
        return self._kept(key, self.make)

    def _kept(self, key: str, make) -> bytes:
        if len(key) > LONGEST:
            return make(key)
        if self.held >= CACHE_BYTES:
            self.older, self.held = dict(self), 0
            self.clear()
        got = self.older.get(key)
        if got is None:
            got = make(key)
        self[key] = got
        self.held += 170 + len(key) + len(got)  # a key, a value and their place in the table
        return got


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> WordEncoder:
    """One for each worker and vocabulary."""
    return WordEncoder(path)
