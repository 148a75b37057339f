"""Token ids of whole texts by the tokenizers library, with a cache of words.

Both vocabularies split texts before they merge: at white space, and between letters and punctuation. So a
text's ids are those of its words one after another, and a word's are those of its letters and its marks. The
words of many texts are numbered and cut by Arrow, letters and marks met before are found by Arrow, and ids are
put together by numpy, so Python only handles letters and marks that are new to its worker.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gauge.llm.common import worker_caches

#: Letters, and marks, that a worker keeps, about.
CACHE_WORDS = 200_000
#: Letters that both vocabularies treat as letters and that no normalisation joins; punctuation that no contraction begins with.
_STEM, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]*"
_PLAIN = f"^(?P<stem>{_STEM})(?P<marks>{_MARKS})$"
_TWO_LINES = f"^(?P<stem>{_STEM})(?P<marks>{_MARKS})\n(?P<stem2>{_STEM})(?P<marks2>{_MARKS})$"
#: Byte-level vocabularies write a byte as itself where that is a visible character, else as the next one from U+0100.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LEVEL = np.arange(256, dtype="<u4")
_BYTE_LEVEL[[b for b in range(256) if b not in _VISIBLE]] = np.arange(0x100, 0x100 + 256 - len(_VISIBLE))

_Ids = tuple[np.ndarray, np.ndarray]


def _joined(found: list[bytes]) -> _Ids:
    return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4


def _gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids from each start on, so many, one after another."""
    ends = np.cumsum(size, dtype=np.int64)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(ids)) < 1 << 30 else np.int64
    places = np.repeat((start - (ends - size)).astype(kind), size)
    places += np.arange(n, dtype=kind)
    return ids[places]


class Units:
    """Strings met before with their ids. ``learn`` gives those of others; beyond ``most`` strings the half used last stays."""

    def __init__(self, learn: Callable[[pa.Array], _Ids], most: int):
        self.learn, self.most, self.turn = learn, most, 0
        self.texts, self.used = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        self.ids, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def find(self, texts: pa.Array) -> _Ids:
        """The ids of ``texts``, which are distinct, one after another, and how many each has."""
        self.turn += 1
        if len(self.texts) > self.most:
            kept = np.sort(np.argpartition(-self.used, self.most // 2)[: self.most // 2])
            self.ids = _gathered(self.ids, (np.cumsum(self.size) - self.size)[kept], self.size[kept])
            self.texts, self.used, self.size = self.texts.take(pa.array(kept)), self.used[kept], self.size[kept]
        at = pc.index_in(texts, value_set=self.texts)
        new = texts.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            ids, size = self.learn(new)
            at[at < 0] = len(self.texts) + np.arange(len(new))
            self.texts, self.used = pa.concat_arrays([self.texts, new]), np.concatenate([self.used, np.zeros(len(new), np.int64)])
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        self.used[at] = self.turn
        size = self.size[at]
        return _gathered(self.ids, (np.cumsum(self.size) - self.size)[at], size), size


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers, equal to ``encode(text, add_special_tokens=False)``.

    ``spaced``: words keep the space before them (byte-level vocabularies); else spaces and case are dropped.
    """

    def __init__(self, path: str, spaced: bool, words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.model, self.lead = self.tokenizer.model, " " if spaced else ""
        #: Letters, in spaced vocabularies after a space; those that begin a line; marks; words of another form.
        self.stems = Units(lambda x: self._merged(x, self.lead), words)
        self.line_stems = Units(lambda x: self._merged(x, ""), words) if spaced else self.stems
        self.marks = Units(lambda x: _joined(self._encode(x.to_pylist())), words)
        self.others = Units(lambda x: _joined(self._encode([self.lead + w for w in x.to_pylist()])), words)
        # a line break between letters or marks is a unit of its own, and no space is before what follows it
        self.line_end = _joined(self._encode(["\n"]))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))]

    def _merged(self, stems: pa.Array, lead: str) -> _Ids:
        """Ids of stems, with ``lead`` before them; each is one unit for the merges, which see its bytes as characters."""
        merge, ids, size = self.model.tokenize, [], []
        _, offsets, data = stems.cast(pa.large_binary()).buffers()
        offsets = np.frombuffer(offsets, np.int64)[stems.offset : stems.offset + len(stems) + 1]
        text = _BYTE_LEVEL[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]].tobytes().decode("utf-32-le")
        head, offsets = "".join(chr(_BYTE_LEVEL[b]) for b in lead.encode()), (offsets - offsets[0]).tolist()
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            found = merge(head + text[a:b])
            size.append(len(found))
            ids += [t.id for t in found]
        return np.array(ids, "<u4"), np.array(size, np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, each with the space before it if words are spaced, how many each has, and odd words.

        Odd are those that texts cannot be cut at: empty, or with other white space at an end.
        """
        start, size = (np.zeros((len(words), 5 if self.spaced else 2), np.int64) for _ in range(2))
        pools, left, n = [], np.arange(len(words)), 0

        def put(rows: np.ndarray, column: int, found: _Ids, at: np.ndarray) -> None:
            nonlocal n
            ids, many = found
            start[rows, column], size[rows, column] = (n + np.cumsum(many) - many)[at], many[at]
            pools.append(ids)
            n += len(ids)

        for pattern in (_PLAIN, _TWO_LINES) if self.spaced else (_PLAIN,):
            parts = pc.extract_regex(words, pattern)
            fits = parts.is_valid()
            parts, on = parts.filter(fits), fits.to_numpy(zero_copy_only=False)
            rows = left[on]
            for column, name, units in ((0, "stem", self.stems), (1, "marks", self.marks), (3, "stem2", self.line_stems), (4, "marks2", self.marks)):
                if column < 3 or pattern is _TWO_LINES:
                    part = parts.field(name)
                    coded = (pc.utf8_lower(part) if units is self.stems and not self.spaced else part).dictionary_encode()
                    put(rows, column, units.find(coded.dictionary), coded.indices.to_numpy())
            if pattern is _TWO_LINES:
                put(rows, 2, self.line_end, np.zeros(len(rows), np.int64))
            words, left = words.filter(pc.invert(fits)), left[~on]
        put(left, 0, self.others.find(words), np.arange(len(words)))
        odd = [not w or w[0].isspace() or w[-1].isspace() for w in words.to_pylist()] if self.spaced else []
        return _gathered(np.concatenate(pools), start.ravel(), size.ravel()), size.sum(axis=1), left[np.array(odd, bool)] if odd else left[:0]

    def ids(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        parts = pc.split_pattern(column if self.spaced else pc.replace_substring(column, "\n", " "), " ")
        offsets, coded = parts.offsets.to_numpy(), parts.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        ids, size, odd = self._words(coded.dictionary)
        counts = size[at]
        if self.spaced:
            counts[offsets[:-1]] = 0  # the first word has no space before it
        out = _gathered(ids, (np.cumsum(size) - size)[at], counts).tobytes()
        bound = (np.concatenate([[0], np.cumsum(counts)])[offsets] * 4).tolist()
        if not self.spaced:
            return [out[bound[i] : bound[i + 1]] for i in range(len(texts))]
        heads = self._encode([t.partition(" ")[0] for t in texts])
        found = [head + out[bound[i] : bound[i + 1]] for i, head in enumerate(heads)]
        # words are only cut at single spaces between other characters
        if len(odd):
            bad = np.zeros(len(size), bool)
            bad[odd] = True
            for i in np.unique(np.searchsorted(offsets, np.flatnonzero(bad[at]), side="right") - 1).tolist():
                found[i] = b"".join(self._encode(list(_chunks(texts[i]))))
        return found


def _chunks(text: str) -> Iterator[str]:
    """Parts of a text with odd white space that are encoded on their own: cut before single spaces between other characters."""
    at = 0
    for m in re.finditer(r"(?<=\S) (?=\S)", text):
        if m.start() > at:
            yield text[at : m.start()]
            at = m.start()
    yield text[at:]


_encoders: dict[tuple[str, bool], WordEncoder] = {}
worker_caches.append(_encoders)


def encoder(path: str, spaced: bool, words: int = CACHE_WORDS) -> WordEncoder:
    """This worker's encoder; its cache outlives tasks, until another operator's tasks need the memory."""
    if (path, spaced) not in _encoders:
        _encoders.clear()
        _encoders[path, spaced] = WordEncoder(path, spaced, words)
    pa.default_memory_pool().release_unused()
    return _encoders[path, spaced]


def strings(column: pa.Array) -> list[str]:
    """An Arrow column's texts; null is empty, and bytes that are no UTF-8 become U+FFFD."""
    return ["" if x is None else x if isinstance(x, str) else x.decode("utf-8", "replace") for x in column.to_pylist()]


def groups(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of texts with about ``most`` bytes together, or one longer text, and the texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, end, strings(column[at:end])
        pa.default_memory_pool().release_unused()
        at = end
