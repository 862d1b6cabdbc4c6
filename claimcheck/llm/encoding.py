"""Byte-level encoding of whole texts with the tokenizers library, one library call per new word.

The library splits a text before merging, and a split never lies inside a word. A space or line end between
two characters that are no white space always begins a new piece, so a text may be cut there and the parts
encoded on their own. A batch of texts is cut and its parts are numbered in Arrow; only different parts are
looked up, and their ids are put together again by one gather. Most parts repeat; their ids are kept per
Python worker, in two dictionaries of bounded size: when the newer one is full it takes the place of the older
one, and words met again move back into the new one, so the frequent ones stay. A text that has white space
beside white space or at an end is cut at its other spaces only.
"""

from __future__ import annotations

import os
import re
from itertools import compress, islice
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space at either end of a text or beside other white space.
BESIDE = re.compile(r" \s|\s |\A\s|\s\Z")
#: For Arrow: white space at an end or beside other white space, or the character that marks cuts.
CUT = "\x01"
_SPACE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{180e}\pZ]"
ODD = rf"{_SPACE}{_SPACE}|\A{_SPACE}|{_SPACE}\z|\x01"
#: Letters with ASCII marks after them: the marks are a piece of their own.
MARKED = re.compile(r"([ ]?)([^\s!-~]*[^\s!-/:-@\[-`{-~]+)([!-/:-@\[-`{-~]+)")
CACHED_WORDS = 1_000_000
GROUP_BYTES = 4 << 20
_ENCODERS: dict[str, WordEncoder] = {}


def words_of(text: str) -> list[str]:
    """The text cut at every space that has no white space beside it; joined by spaces they give it back."""
    parts = text.split(" ")
    if not BESIDE.search(text):
        return parts
    joined = [parts[0]]
    for part in parts[1:]:
        left = joined[-1]
        if left and part and not left[-1].isspace() and not part[0].isspace():
            joined.append(part)
        else:
            joined[-1] = f"{left} {part}"
    return joined


class WordEncoder:
    """Encodes texts into little-endian unsigned 32-bit ids. encode_words gives the ids of many strings."""

    def __init__(self, encode_words):
        self.encode_words = encode_words
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        (self.line_end,) = encode_words(["\n"])

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text (null: none)."""
        texts = pc.fill_null((pa.array(texts, pa.string()) if isinstance(texts, list) else texts).cast(pa.large_string()), "")
        group = np.cumsum(pc.binary_length(texts).to_numpy()) // GROUP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        return [ids for a, b in zip(cuts, cuts[1:], strict=False) for ids in self._group(texts.slice(a, b - a))]

    def _group(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, ODD)
        cut = texts
        for mark in (" ", "\n"):
            cut = pc.replace_substring(cut, mark, CUT + mark)
        # odd texts are cut here too, but what comes of them is not used
        lists = pc.split_pattern(pc.if_else(odd, "", cut), CUT)
        parts = lists.flatten().dictionary_encode()
        # through numpy, as to_pylist makes a scalar of each
        pool, starts, lengths = self._pool(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = parts.indices.to_numpy()
        size = lengths[at]
        ends = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(size, out=ends[1:])
        # one text may hold more ids than an int32 counts
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        where = np.repeat(starts[at] - ends[:-1].astype(kind), size)
        where += np.arange(len(where), dtype=kind)
        raw = pool[where].tobytes()
        offsets = (4 * ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        out = [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        cut = [words_of(texts[i].as_py()) for i in odd_at]
        found = iter(self._look_up([w if k == 0 else f" {w}" for words in cut for k, w in enumerate(words)]))
        for i, words in zip(odd_at, cut, strict=True):
            out[i] = b"".join(islice(found, len(words)))
        return out

    def _pool(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the parts in a row; where each part's begin, and how many they are."""
        found = self._look_up(parts)
        lengths = np.fromiter(map(len, found), np.int32, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), (np.cumsum(lengths) - lengths).astype(np.int32), lengths

    def _look_up(self, parts: list[str]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS // 2:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, parts))
        new = [part for part, ids in zip(parts, found, strict=True) if ids is None]
        if new:
            self._learn(self._unknown(list(dict.fromkeys(new))))
            found = list(map(self.known.__getitem__, parts))
        return found

    def _unknown(self, new: list[str]) -> list[str]:
        """Those of the words that are not among the older ones either; the others are taken over."""
        if not self.older:
            return new
        found = list(map(self.older.get, new))
        self.known.update((word, ids) for word, ids in zip(new, found, strict=True) if ids is not None)
        return [word for word, ids in zip(new, found, strict=True) if ids is None]

    def _learn(self, new: list[str]) -> None:
        """Of a part: its line end, letters and marks are pieces whose ids are found on their own."""
        # most parts are a word with or without a space before it
        plain = [part[-1:].isalnum() and part[0] != "\n" for part in new]
        whole, cut = list(compress(new, plain)), []
        for part in compress(new, map(not_, plain)):
            line = part[:1] == "\n" and not part[1:2].isspace() and len(part) > 1
            bare = part[1:] if line else part
            found = None if bare[-1:].isalnum() else MARKED.fullmatch(bare)
            if found is not None and found[2].isalpha():
                cut.append((part, line, found[1] + found[2], found[3]))
            elif line:
                cut.append((part, line, bare, ""))
            else:
                whole.append(part)
        bodies = self._unknown(list({body for _, _, body, _ in cut if body not in self.known}.difference(whole)))
        unknown = [*whole, *bodies]
        self.known.update(zip(unknown, self.encode_words(unknown), strict=True))
        marks = list({mark for _, _, _, mark in cut} - self.marks.keys())
        self.marks.update(zip(marks, self.encode_words(marks), strict=True))
        known, marks, line_end = self.known, self.marks, self.line_end
        for part, line, body, mark in cut:
            ids = known[body] + marks[mark]
            known[part] = line_end + ids if line else ids


def library_encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file of the tokenizers library, one for each Python worker."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def each(words: list[str]) -> list[bytes]:
            found = tokenizer.encode_batch_fast(words, add_special_tokens=False)
            return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

        line_end = each(["\n"])[0]

        def encode_words(words: list[str]) -> list[bytes]:
            """As texts of many lines: a line end between two words is a piece, and here one id, of its own."""
            if len(line_end) != 4:
                return each(words)
            plain = [w for w in words if w and "\n" not in w]
            if len(plain) < len(words):
                other = [w for w in words if not w or "\n" in w]
                found = dict(zip([*plain, *other], [*encode_words(plain), *each(other)], strict=True))
                return [found[w] for w in words]
            groups = [words[i : i + 2000] for i in range(0, len(words), 2000)]
            found = tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False)
            out = []
            for group, encoded in zip(groups, found, strict=True):
                ids = np.array(encoded.ids, dtype="<u4")
                ends = np.flatnonzero(ids == int.from_bytes(line_end, "little"))
                if len(ends) != len(group) - 1:
                    return each(words)
                raw, cuts = ids.tobytes(), [-4, *(4 * ends).tolist(), 4 * len(ids)]
                out += [raw[a + 4 : b] for a, b in zip(cuts, cuts[1:], strict=False)]
            return out

        _ENCODERS[path] = WordEncoder(encode_words)
    return _ENCODERS[path]
