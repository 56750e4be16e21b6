"""Byte-level BPE ids through the tokenizers library, asked once for each piece of text.

The library's ids for a text are the concatenation of its ids for pieces, wherever a cut
falls just before a space that a visible character follows: the pre-tokenizer never joins
across such a place. The same holds before a comma or full stop that follows a letter or
digit, and around a line end between visible characters. Arrow cuts a batch of texts at
these places and numbers the distinct pieces; the library sees only pieces that this worker process has not met; NumPy then
gathers the ids of all texts at once.
"""

from __future__ import annotations

import os
import re
import threading
import time
import weakref
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from archipel.llm.common import tidy

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Stands before the first piece of a text, which has no space before it.
_FIRST = "\x02"
#: A space, as byte-level vocabularies write it.
_SPACE = "\u0120"
#: Words that the library gets as one text: a call a word costs nearly twice as much.
JOINED = 32
_CUT = re.compile(r" (?=\S)")
#: Texts that Arrow's plain cuts would cut in a wrong place: special strings, the mark itself, a space or line end next to
#: another blank or an end of the text, a comma or full stop after anything but a letter or digit.
_GAP = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf"<\||\x02| (?:[{_GAP}]|\z)|\n(?:[{_GAP}]|\z)|[{_GAP}]\n|\A[\n,.]|[^\p{{L}}\p{{N}}][,.]"
#: One memo a process and vocabulary; Python workers are reused between tasks.
_MEMOS: dict[str, PieceMemo] = {}


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def text_slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about `most_bytes` at most (one text may hold more).

    Slices are copies: some of Arrow's string functions read sliced columns from the wrong place.
    """
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = (np.cumsum(sizes) // most_bytes).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.take(pa.array(np.arange(lo, hi)))


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start:start+length] for each pair, end to end."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    return values[at]


class Recent:
    """What was met lately, in at most `most_bytes`: two halves, of which the older goes when the newer is full. What is found there moves on."""

    def __init__(self, most_bytes: int):
        self.now: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.half, self.held = most_bytes // 2, 0

    def find(self, keys: list[str]) -> list:
        """The value of each key; None for unknown ones."""
        found = list(map(self.now.get, keys))
        if self.old:
            for i, value in enumerate(found):
                if value is None and (value := self.old.get(keys[i])) is not None:
                    found[i] = value
                    self.put(keys[i], value, 8)
        return found

    def put(self, key: str, value, size: int) -> None:
        if self.held > self.half:
            self.now, self.old, self.held = {}, self.now, 0
        self.now[key] = value
        self.held += len(key) + size + 200  # what the objects and the table's slots take besides


class PieceMemo:
    """Piece -> ids. A key stands for the piece after a space, or for the start of a text if it begins with a mark."""

    def __init__(self, path: str, most_bytes: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known = Recent(most_bytes)
        self.used = time.monotonic()
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)  # ids that begin with a space
        self.spaced[[i for token, i in vocabulary.items() if token[0] == _SPACE]] = True

    def library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def after_spaces(self, words: list[str]) -> list[bytes]:
        """The ids of each word after a space. Words without one inside are asked JOINED at a time, as a text that falls apart at the ids that begin with a space."""
        out: list[bytes | None] = [None] * len(words)
        plain = [i for i, word in enumerate(words) if " " not in word and "<|" not in word]
        groups = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        wide = self.dtype.itemsize
        for group, raw in zip(groups, self.library([" " + " ".join([words[i] for i in group]) for group in groups]), strict=True):
            at = [*(np.flatnonzero(self.spaced[np.frombuffer(raw, self.dtype)]) * wide).tolist(), len(raw)]
            if len(at) == len(group) + 1:
                for i, lo, hi in zip(group, at, at[1:], strict=False):
                    out[i] = raw[lo:hi]
        left = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(left, self.library([" " + words[i] for i in left]), strict=True):
            out[i] = ids
        return out

    def of_pieces(self, keys: list[str]) -> list[bytes]:
        """The ids of each key."""
        found = self.known.find(keys)
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            first = [i for i in missing if keys[i][0] == _FIRST]
            later = [i for i in missing if keys[i][0] != _FIRST]
            new = [*self.library([keys[i][1:] for i in first]), *self.after_spaces([keys[i] for i in later])]
            for i, ids in zip([*first, *later], new, strict=True):
                found[i] = ids
                self.known.put(keys[i], ids, len(ids))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and where each text's ids begin (one more number: where they end); null is empty."""
        self.used = time.monotonic()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        plain = pc.if_else(pa.array(odd), _text(""), texts)
        for mark, cuts in ((",", f" {_FIRST},"), (".", f" {_FIRST}."), ("\n", f" {_FIRST}\n {_FIRST}")):
            plain = pc.replace_substring(plain, mark, cuts)
        cut = pc.split_pattern(pc.binary_join_element_wise(_text(_FIRST), plain, _text("")), " ")
        coded = pc.list_flatten(cut).dictionary_encode()
        own = self.of_pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())  # half the cost of to_pylist
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // self.dtype.itemsize
        values = np.frombuffer(b"".join(own), dtype=self.dtype)
        index = np.asarray(coded.indices)
        count = lengths[index]
        ids = ragged_take(values, (np.cumsum(lengths) - lengths)[index], count)
        first = np.asarray(cut.offsets) - cut.offsets[0].as_py()
        begins = np.append(0, np.cumsum(count))[first]
        if odd.any():
            ids, begins = self._with_odd(texts, np.flatnonzero(odd), ids, begins)
        self.used = time.monotonic()
        return ids, begins

    def _with_odd(self, texts: pa.Array, odd: np.ndarray, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts in the ids of texts that Arrow's plain split can't cut."""
        out, lengths, last = [], np.diff(begins), 0
        for i in odd.tolist():
            text = texts[i].as_py()
            if "<|" in text or _FIRST in text:
                own = self.library([text])[0]
            else:
                pieces = _CUT.split(text)
                own = b"".join(self.of_pieces([_FIRST + pieces[0], *pieces[1:]]))
            out += [ids[begins[last] : begins[i]], np.frombuffer(own, dtype=self.dtype)]
            lengths[i], last = len(out[-1]), i + 1
        return np.concatenate([*out, ids[begins[last] :]]), np.append(0, np.cumsum(lengths))


#: Bytes that a worker process keeps of pieces.
MEMO_BYTES = 32 << 20
#: The same for byte-level pieces: over three files of check_l the library was asked 2.07 million times with 96 MB, 3.85 with 32.
PIECE_BYTES = 96 << 20
#: Seconds after which a worker that gets nothing to tokenize gives its pieces back: an idle worker holds memory that its neighbours may need.
IDLE_S = 4.0


def memo(path: str) -> PieceMemo:
    if path not in _MEMOS:
        _MEMOS[path] = PieceMemo(path, PIECE_BYTES)
        threading.Thread(target=_forget_idle, args=(path, weakref.ref(_MEMOS[path])), daemon=True).start()
    return _MEMOS[path]


def forget() -> None:
    """Drops what this worker process holds of pieces: for operators that do not tokenize but reuse a worker that did."""
    if _MEMOS:
        _MEMOS.clear()
        tidy()


def _forget_idle(path: str, own: weakref.ref) -> None:
    """Waits until a memo has not been used for IDLE_S, or is another one's place by now. A task under way keeps it to its end."""
    while (held := own()) is not None and _MEMOS.get(path) is held:
        left = held.used + IDLE_S - time.monotonic()
        del held
        if left <= 0:
            _MEMOS.pop(path, None)
            tidy()
            return
        time.sleep(left)
