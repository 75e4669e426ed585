"""Public tokenizers inside Arrow functions: texts are encoded unit by unit through a bounded cache."""

from __future__ import annotations

import array
import ctypes
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units kept per worker process (about 200 bytes each).
CACHE_UNITS = 300_000
#: Bytes of distinct units that are joined into one string for the library, of texts in one step, and of texts that are encoded at once.
JOIN_BYTES = 4096
JOIN_UNITS = 1024
STEP_BYTES = 4 << 20
ENCODE_BYTES = 1 << 20

# White space of the tokenizers' pattern that is not ASCII, and ASCII controls that are, or that
# other definitions count as white space.
_WIDE_SPACE = "\x85\xa0  -     　"
_ODD_ASCII = re.compile(r"[\x1c-\x1f]")
_ODD_RUN = re.compile(rf"[\x0b\x0c\x1c-\x1f]|[{_WIDE_SPACE}](?=[ \t\n\r])")
_MARKS = re.compile("[̀-ͯ]")
# The tokenizers' own patterns (fixed values) on ASCII; words with other letters stay whole.
_BYTES = rb"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
_BYTES_ASCII = re.compile(_BYTES)
_BYTES_MIXED = re.compile(rb"[ \t\n\r]*[^ \t\n\r]*[\x80-\xff][^ \t\n\r]*|" + _BYTES)
_WORDS = rb"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\sa-z0-9]+"
_WORDS_ASCII = re.compile(_WORDS)
_WORDS_MIXED = re.compile(rb"(?<!\S)\S*[\x80-\xff]\S*|" + _WORDS)
# Letters U+00C0 to U+024F, but for the one that lower-casing splits.
_LETTERS = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc9[\x80-\x8f])+"
_WORD = rb"(?:[!-/:-@\[-`{-~]+|[0-9]|%s)" % _LETTERS
_ONE_WORD, _ONLY_WORDS = re.compile(_WORD), re.compile(rb"(?:%s\n)*%s" % (_WORD, _WORD))
# Units that a tokenizer of the bytes kind cuts off where the next one begins with a space.
_AFTER_SPACE = rb" (?:[!-~]|\xc3[\x80-\xbf]|[\xc4-\xc9][\x80-\xbf])+"
_SPACED, _ONLY_SPACED = re.compile(_AFTER_SPACE), re.compile(rb"(?:%s\n)*%s" % (_AFTER_SPACE, _AFTER_SPACE))

# The same patterns as classes of bytes.
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[list(b" \t\n\x0b\x0c\r")] = _SPACE
_CLASS[list(range(0x30, 0x3A))] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x80:] = _OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Second bytes of the letters above, by their first byte.
_LATIN = np.zeros((256, 256), bool)
for _lead, _first, _last in ((0xC3, 0x80, 0xBF), (0xC4, 0x80, 0xBF), *((x, 0x80, 0xBF) for x in range(0xC5, 0xC9)), (0xC9, 0x80, 0x8F)):
    _LATIN[_lead, _first : _last + 1] = True
_LATIN[0xC3, [0x97, 0xB7]] = _LATIN[0xC4, 0xB0] = False
# Bytes of texts that ``Encoder.units`` cuts: of marks that are composed; of controls and white space that is not ASCII.
_ODD_WORDS, _ODD_BYTES = np.zeros(256, bool), np.zeros(256, bool)
_ODD_WORDS[[0xCC, 0xCD]] = True
_ODD_BYTES[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _classes(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Class of every byte; a run without white space that holds any other letter is of one class.  ``begins``: where a text begins."""
    found = _CLASS[raw]
    high = np.flatnonzero(raw >= 0x80)
    if not len(high):
        return found
    latin = high[:-1][_LATIN[raw[high[:-1]], raw[high[:-1] + 1]]]
    found[latin] = found[latin + 1] = _LETTER
    other = high[found[high] == _OTHER]
    if len(other):
        solid = found != _SPACE
        head = solid & begins
        head[1:] |= solid[1:] & ~solid[:-1]
        tail = solid.copy()
        tail[:-1] &= ~solid[1:] | begins[1:]
        heads, tails = np.flatnonzero(head), np.flatnonzero(tail) + 1
        runs = np.unique(np.searchsorted(heads, other, side="right") - 1)
        change = np.zeros(len(raw) + 1, np.int8)
        change[heads[runs]] += 1
        change[tails[runs]] -= 1
        found[np.cumsum(change[:-1], dtype=np.int8) > 0] = _OTHER
    return found


def cut_words(raw: np.ndarray, begins: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes to look up, which of the given bytes they are and at which of the given bytes a unit begins.

    ``raw`` are the bytes of texts one after the other, ``begins`` tells where each begins; ``lower``: the words kind, else the bytes kind.
    """
    if lower:
        raw = _LOWER[raw]
    of = _classes(raw, begins)
    space = of == _SPACE
    first = begins.copy()
    first[1:] |= of[1:] != of[:-1]
    if lower:
        first |= of == _DIGIT
    else:
        # A space goes to what follows it, other white space before a word is apart; a run with other letters takes it all.
        at = np.flatnonzero(first[1:] & space[:-1] & ~space[1:] & ~begins[1:]) + 1
        plain = raw[at - 1] == 0x20
        whole = of[at] == _OTHER
        first[at[plain | whole]] = False
        first[at[~whole] - 1] = True
    mark = np.flatnonzero((raw == 0x27) & (of == _MARK))
    if len(mark):
        before = np.maximum(mark - 1, 0)
        taken = (of[before] == _MARK) if lower else (of[before] == _MARK) | (raw[before] == 0x20)
        mark = mark[begins[mark] | ~taken]
        padded = np.concatenate([raw, np.zeros(3, np.uint8)])
        open_ = np.concatenate([~begins, np.zeros(3, bool)])  # a text goes on here
        one, two = padded[mark + 1], padded[mark + 2]
        short = open_[mark + 1] & np.isin(one, list(b"stmd"))
        long = open_[mark + 1] & open_[mark + 2] & (((np.isin(one, list(b"rv"))) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        ends = np.concatenate([mark[short] + 2, mark[long] + 3])
        first[mark[short | long] + 1] = False
        first[ends[ends < len(first)]] = True
    return raw, ~space if lower else np.ones(len(raw), bool), first


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``limit`` bytes of ``column``; no row is cut."""
    for batch in batches:
        lengths = np.asarray(
            pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False),
            dtype=np.int64,
        )
        ends = np.cumsum(lengths)
        first = 0
        while first < len(lengths):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def _parts(raw: bytes, ends: np.ndarray) -> Iterator[bytes]:
    """Parts of ``raw`` that follow each other up to these ends."""
    cuts = ends.tolist()
    return map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts))


def _joined(units: list[bytes], by: bytes, one: re.Pattern, only: re.Pattern) -> list[tuple[list[bytes], bytes]]:
    """Groups of the units that match ``one`` and hold no special string, and their units joined; ``only`` tests a group at once, in lines."""
    found = []
    for i in range(0, len(units), JOIN_UNITS):
        group = units[i : i + JOIN_UNITS]
        lines = b"\n".join(group)
        if b"<|" in lines or not only.fullmatch(lines):
            group = [unit for unit in group if one.fullmatch(unit) and b"<|" not in unit]
        if group:
            found.append((group, by.join(group)))
    return found


class Encoder:
    """Ids of whole texts, exactly as the library gives them for the whole text.

    A text is cut into *units* that no token can reach across.  ASCII and Latin words are cut as the tokenizer's own
    pattern cuts them, all texts of a step at once (``cut_words``):

    * words kind (white space is dropped, ASCII letters are lowered): letters, single digits and runs of marks;
      a word with any other letter stays whole, with the marks on it;
    * bytes kind (byte-level pattern): the same with the space before; a word with any other letter stays whole,
      with the white space before it.  A text where white space of both kinds meets is encoded in one piece.

    Texts with special strings, composed marks or odd white space are cut one by one (``units``).
    The distinct units of a step that the cache does not hold are joined by spaces where the tokenizer cuts there, else
    by a special token, and given to the library in batches of about equal bytes.  Units that themselves hold the start
    of a special string go through the library one by one, so these strings are handled
    as the library does by default, or as text (``plain``).
    """

    def __init__(self, path: str, plain: bool = False, cache_units: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.path, self.plain, self.single = path, plain, self.library
        self.cache_units = cache_units
        self.words = self.library.normalizer is not None
        added = self.library.get_added_tokens_decoder().items()
        self.separator_id, separator = max((i, t) for i, t in added if t.special and not (t.lstrip or t.rstrip or t.normalized))
        self.separator = separator.content
        vocabulary = self.library.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for name, i in vocabulary.items() if name.endswith("</w>")]] = True
        #: Bytes of every token of the bytes kind, whose names have a letter for each byte.
        self.sizes = np.zeros(len(self.closing), np.int64)
        self.sizes[list(vocabulary.values())] = [len(name) for name in vocabulary]
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def units(self, text: str) -> list[bytes] | None:
        """Units of a text, or None where it must stay whole."""
        raw = text.encode()
        if self.words:
            # The tokenizer lowers letters itself; special strings are matched before that, and marks are composed.
            if b"<|" in raw:
                return raw.split()
            if raw.isascii():
                return _WORDS_ASCII.findall(raw.lower())
            if _MARKS.search(text):
                return [unit.lower() if unit.isascii() else unit for unit in raw.split()]
            return _WORDS_MIXED.findall(raw.lower())
        if b"<|" in raw:
            return None
        if raw.isascii():
            return None if _ODD_ASCII.search(text) else _BYTES_ASCII.findall(raw)
        return None if _ODD_RUN.search(text) else _BYTES_MIXED.findall(raw)

    def whole(self, text: str) -> bytes:
        if self.plain and self.single is self.library:
            from tokenizers import Tokenizer

            self.single = Tokenizer.from_file(self.path)
            self.single.no_truncation()
            self.single.no_padding()
            self.single.encode_special_tokens = True
        return array.array("I", self.single.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, missing: list[bytes]) -> None:
        """Ids of units that the cache lacks."""
        self._learn_units(self._learn_words(missing) if self.words else self._learn_spaced(missing))

    def _learn_spaced(self, missing: list[bytes]) -> list[bytes]:
        """Ids of units that begin with a space and hold no other: joined as they are, cut by the bytes of their tokens; returns the others."""
        groups = _joined(missing, b"", _SPACED, _ONLY_SPACED)
        texts = [text.decode() for _, text in groups]
        for (group, _), encoded in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, dtype="<u4")
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))
            at = np.searchsorted(ends, wanted)
            if at[-1] != len(ends) - 1 or not np.array_equal(ends[at], wanted):
                raise ValueError("a token reaches over a unit")
            self.cache.update(zip(group, _parts(ids.tobytes(), (at + 1) * 4), strict=True))
        return [unit for unit in missing if unit not in self.cache]

    def _learn_words(self, missing: list[bytes]) -> list[bytes]:
        """Ids of units that are one word of the tokenizer each: joined by spaces, cut after tokens that close a word; returns the others."""
        groups = _joined(missing, b" ", _ONE_WORD, _ONLY_WORDS)
        texts = [text.decode() for _, text in groups]
        for (group, _), encoded in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, dtype="<u4")
            ends = (np.flatnonzero(self.closing[ids]) + 1) * 4
            if len(ends) != len(group):
                raise ValueError("a unit holds more than one word")
            self.cache.update(zip(group, _parts(ids.tobytes(), ends), strict=True))
        return [unit for unit in missing if unit not in self.cache]

    def _learn_units(self, missing: list[bytes]) -> None:
        """Ids of units: joined by a special token, encoded in batches and cut again there."""
        groups: list[list[bytes]] = [[]]
        size = 0
        for unit in missing:
            if b"<|" in unit:
                self.cache[unit] = self.whole(unit.decode())
                continue
            if size + len(unit) > JOIN_BYTES and groups[-1]:
                groups.append([])
                size = 0
            groups[-1].append(unit)
            size += len(unit) + len(self.separator)
        texts = [self.separator.join(u.decode() for u in group) for group in groups if group]
        for group, encoded in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=False):
            ids = np.array(encoded.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.separator_id)
            if len(cuts) != len(group) - 1:
                raise ValueError("a unit holds the separator")
            raw = ids.tobytes()
            begins = [0, *((cuts + 1) * 4).tolist()]
            ends = [*(cuts * 4).tolist(), len(raw)]
            self.cache.update((unit, raw[b:e]) for unit, b, e in zip(group, begins, ends, strict=True))

    def _known(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units.  Of the units that the cache holds, those that later steps use outlive a change of generations."""
        cache, older = self.cache, self.older
        missing = [unit for unit in units if unit not in cache]
        if older:
            cache.update((unit, older[unit]) for unit in missing if unit in older)
            missing = [unit for unit in missing if unit not in cache]
        if len(cache) + len(missing) > self.cache_units // 2:
            self.older, self.cache = cache, {unit: cache[unit] for unit in units if unit in cache}
        if missing:
            self._learn(missing)
        return list(map(self.cache.__getitem__, units))

    def _encode_apart(self, text: str) -> np.ndarray:
        units = self.units(text)
        raw = self.whole(text) if units is None else b"".join(map(dict(zip(seen := list(set(units)), self._known(seen), strict=True)).__getitem__, units))
        return np.frombuffer(raw, "<u4")

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column one after the other, and where each text's begin and the last one's end (null: none)."""
        column = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        local = offsets - offsets[0]
        odd = (_ODD_WORDS if self.words else _ODD_BYTES)[raw]
        odd[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        apart = np.unique(np.searchsorted(local, np.flatnonzero(odd), side="right") - 1)
        del odd
        if not len(apart):
            return self._encode_raw(raw, local)
        chosen = np.ones(len(column), bool)
        chosen[apart] = False
        sizes = np.diff(local)
        ids, begins = self._encode_raw(raw[np.repeat(chosen, sizes)], np.append(0, np.cumsum(sizes * chosen)))
        own = {int(i): self._encode_apart(raw[local[i] : local[i + 1]].tobytes().decode()) for i in apart}
        counts = np.diff(begins)
        counts[apart] = [len(own[int(i)]) for i in apart]
        parts = [ids[: begins[apart[0]]]]
        for i, after in zip(apart, [*apart[1:], len(column)], strict=True):
            parts += [own[int(i)], ids[begins[i + 1] : begins[after]]]
        return np.concatenate(parts), np.append(0, np.cumsum(counts))

    def _encode_raw(self, raw: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_column`` for the bytes of texts that begin and end at ``local``."""
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(local), np.int64)
        begins = np.zeros(len(raw), bool)
        begins[local[:-1][local[:-1] < len(raw)]] = True
        lowered, kept, first = cut_words(raw, begins, self.words)
        at = np.flatnonzero(first & kept)
        unit_of = np.searchsorted(at, local)
        if self.words:
            lowered = lowered[kept]
            at = np.flatnonzero(first[kept])
        bounds = pa.py_buffer(np.append(at, len(lowered)).astype(np.int64))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, bounds, pa.py_buffer(lowered)]).dictionary_encode()
        distinct = units.dictionary
        names = bytes(distinct.buffers()[2] or b"")
        known = self._known(list(_parts(names, np.frombuffer(distinct.buffers()[1], np.int64)[1 : len(distinct) + 1])))
        code = units.indices.to_numpy()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        pool = np.frombuffer(b"".join(known), "<u4")
        counts = sizes[code]
        ends = np.cumsum(counts)
        shift = (np.cumsum(sizes) - sizes)[code] - (ends - counts)
        ids = pool[np.arange(len(code) and int(ends[-1])) + np.repeat(shift, counts)]
        return ids, np.append(0, ends)[unit_of]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text (null: none)."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
        raw, ends = ids.tobytes(), (ends * 4).tolist()
        return [raw[b:e] for b, e in zip(ends[:-1], ends[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cache_units: int = CACHE_UNITS) -> Encoder:
    """One encoder per worker process and tokenizer file; it keeps as many units as its latest caller wants."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, cache_units=cache_units)
    _ENCODERS[path].cache_units = cache_units
    return _ENCODERS[path]


def release_encoders() -> None:
    """Let go of the encoders that the worker holds from a stage before, for stages that encode nothing."""
    if _ENCODERS:
        _ENCODERS.clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library keeps freed pages otherwise
            trim(0)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
