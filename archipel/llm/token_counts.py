"""Token counts by rank-synchronous merging of byte-pair symbols in NumPy arrays."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipel.llm.common import tidied
from archipel.llm.token_memo import MEMO_BYTES, Recent, text_slices

#: Fixed values of the vocabulary's format: what its normaliser takes for white space, and how texts are cut into pre-tokens.
_WHITE = "\t-\r \x85\xa0  -     　"
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts that need more care than Arrow's cuts give: control characters that only Python takes for white space, a comma or full stop after another mark.
_ODD = r"[\x1c-\x1fİ]|[^\p{L}\p{N} \n][,.]"
_COUNTERS: dict[str, WordBpeCounter] = {}


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _normal(piece: str) -> str:
    """Composed and lower-cased letter by letter: no rule for a sigma at a word's end."""
    piece = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
    return "".join(c.lower() for c in piece) if "Σ" in piece else piece.lower()


class WordBpeCounter:
    """How many symbols are left of a text, for a byte-level BPE vocabulary with word ends."""

    def __init__(self, path: str, most_bytes: int = MEMO_BYTES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges, end = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        self.width = len(vocab)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.known = Recent(most_bytes)

    def _rank(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each symbol; len(merged) where none does."""
        rank = np.full(len(symbols), len(self.merged), dtype=np.int64)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        key = symbols[inside] * self.width + symbols[inside + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        rank[inside] = np.where(self.keys[at] == key, self.ranks[at], len(self.merged))
        return rank

    def merge(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols left of each pre-token.

        All words lie end to end in one array. In each round every word's lowest-ranked
        pair is merged wherever it occurs in that word, all words at once; words without a
        pair left fall out.
        """
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        left = sizes.copy()
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        owner = np.repeat(np.arange(len(words)), sizes)
        symbols = self.inner[raw]
        last = np.cumsum(sizes)[sizes > 0] - 1
        symbols[last] = self.final[raw[last]]
        none = len(self.merged)
        while len(symbols):
            rank = self._rank(symbols, owner)
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, begins)
            least_here = np.repeat(least, np.diff(np.append(begins, len(symbols))))
            hit = (rank == least_here) & (rank < none)
            # A pair of one symbol with itself overlaps in runs: every other place of a run counts.
            place = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, -1))
            hit &= (place - run_start) % 2 == 0
            symbols[hit] = self.merged[rank[hit]]
            gone = np.append(False, hit[:-1])
            left -= np.bincount(owner[gone], minlength=len(left))
            stay = ~gone & (least_here < none)
            symbols, owner = symbols[stay], owner[stay]
        return left

    def of_pieces(self, pieces: list[str]) -> np.ndarray:
        """Token counts of pieces without white space. Composing and lower-casing never reach across white space."""
        found = self.known.find(pieces)
        missing = [i for i, n in enumerate(found) if n is None]
        if missing:
            cut = [_PRE_TOKEN.findall(_normal(pieces[i])) for i in missing]
            distinct = list({t for own in cut for t in own})
            count = dict(zip(distinct, self.merge([t.encode() for t in distinct]).tolist(), strict=True))
            for i, own in zip(missing, cut, strict=True):
                found[i] = sum(count[t] for t in own)
                self.known.put(pieces[i], found[i], 32)
        return np.array(found, dtype=np.int64)

    def _slow(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            pieces = [p for p in re.split(f"[{_WHITE}]+", part) if p]
            total += int(self.of_pieces(pieces).sum()) if pieces else 0
        return total

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Token counts of whole texts; null is empty."""
        raw = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(raw, _ODD + (f"|{self.special.pattern}" if self.special else "")))
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), raw)
        for mark in (",", "."):
            plain = pc.replace_substring(plain, mark, " " + mark)
        cut = pc.utf8_split_whitespace(plain)
        coded = pc.list_flatten(cut).dictionary_encode()
        each = self.of_pieces(coded.dictionary.to_pylist())[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
        sums = np.append(0, np.cumsum(each))
        begins = np.asarray(cut.offsets) - cut.offsets[0].as_py()
        out = sums[begins[1:]] - sums[begins[:-1]]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._slow(raw[i].as_py())
        return out


def counter(path: str) -> WordBpeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = WordBpeCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of `docs`: a map without a shuffle.

    Null and empty texts have no bytes and no tokens. Rows with null or repeated ids keep
    a row each. Nothing is cut, however long a text is; memory is bounded by the longest.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer)
        for batch in tidied(batches):
            for part in text_slices(batch, 1):
                n_bytes = pc.fill_null(pc.binary_length(part.column(1)).cast(pa.int64()), 0)
                n_tokens = of.counts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), n_bytes, pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
