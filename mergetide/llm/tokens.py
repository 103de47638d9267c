"""Encoding whole Arrow columns with a public tokenizer, each distinct stretch of text once.

Texts are split where no token can reach across, the distinct pieces of a batch are
encoded by the library in batches balanced by bytes (plain ones joined, many to a call), and the results are dealt back to
the texts with array arithmetic. Frequent pieces stay known between batches.
Between an ASCII letter and a full stop or comma both kinds of file cut, too.

Safe boundaries. Byte-level files keep white space, so a piece starts at a single space
or newline standing between two characters that are no white space; a text with any
other white space is cut only at spaces between two printable ASCII characters. Word
files drop white space, so their pieces lie between runs of ASCII white space.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 1 << 18
PIECE_BYTES = 1 << 14
JOINED = 1 << 10
KNOWN = 300_000
KNOWN_BYTES = 64
# White space of any definition but single spaces and newlines between other characters.
_ODD_SPACE = (
    r"[ \n][ \n]|^[ \n]|[ \n]$|"
    r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]"
)
_STOP = r"([A-Za-z])([.,])"
# Where lower-casing first could tell: marks that compose with a small letter only, and special strings.
_NOT_LOWERED = r"\p{M}|<\|"
_SAFE_SPACE = re.compile("(?<=[!-~]) (?=[!-~])")
_JOINS, _JOINS_AFTER_SPACE = r"\A[!-~]+\z", r"\A [!-~]([ -~]*[!-~])?\z"
_loaded: dict[str, PieceEncoder] = {}


def encoder(path: str, known: int = KNOWN) -> PieceEncoder:
    """The encoder of a tokenizer file, loaded once in each worker. ``known`` pieces are remembered, some 100 bytes each."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = PieceEncoder(path)
    _loaded[path].most = known
    return _loaded[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class PieceEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.keeps_space = _keeps_space(spec)
        self.lowers = "Lowercase" in [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.known: dict[str, bytes] = {}
        self.most = KNOWN

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more entry than texts). Null is empty."""
        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        pieces, owners = self._pieces(texts)
        coded = pieces.dictionary_encode()
        parts = self._encode_distinct(coded.dictionary)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        flat = np.frombuffer(b"".join(parts), np.uint32)
        codes = coded.indices.to_numpy()
        begins = np.concatenate(([0], np.cumsum(lengths)))[codes]
        taken = lengths[codes]
        ends = np.cumsum(taken)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - taken), taken)
        starts = np.concatenate(([0], ends))[np.searchsorted(owners, np.arange(len(texts) + 1))]
        return flat[place], starts

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text; the ids themselves are not laid out."""
        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
        if not len(texts):
            return np.zeros(0, np.int64)
        pieces, owners = self._pieces(texts)
        coded = pieces.dictionary_encode()
        parts = self._encode_distinct(coded.dictionary)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        ends = np.concatenate(([0], np.cumsum(lengths[coded.indices.to_numpy()])))
        return np.diff(ends[np.searchsorted(owners, np.arange(len(texts) + 1))])

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces in order of the texts, and the number of the text each belongs to, ascending."""
        texts = texts.cast(pa.large_string())
        if not self.keeps_space:
            texts = pc.replace_substring_regex(texts, _STOP, r"\1 \2")  # a new array, not a slice, as lower-casing needs it
            if self.lowers:
                as_is = pc.match_substring_regex(texts, _NOT_LOWERED).to_numpy(zero_copy_only=False)
                both = pa.concat_arrays([pc.ascii_lower(texts), texts])
                texts = both.take(pa.array(np.arange(len(texts)) + len(texts) * as_is))
            return _lists(pc.ascii_split_whitespace(texts))
        odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._regular(texts)
        at = np.flatnonzero(~odd)
        pieces, owners = self._regular(texts.take(pa.array(at)))
        rest = np.flatnonzero(odd)
        cut = [_cut(t) for t in texts.take(pa.array(rest)).to_pylist()]
        more = pa.array([p for parts in cut for p in parts], pa.large_string())
        all_owners = np.concatenate((at[owners], np.repeat(rest, [len(p) for p in cut])))
        order = np.argsort(all_owners, kind="stable")
        return pa.concat_arrays([pieces, more]).take(pa.array(order)), all_owners[order]

    def _regular(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        # "a b.\nc" -> "a", " b", ".", "\nc": a mark before every boundary, which no regular text holds.
        texts = pc.replace_substring_regex(texts, _STOP, "\\1\r\\2")
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\r\n"), " ", "\r ")
        return _lists(pc.split_pattern(marked, "\r"))

    def _encode_distinct(self, distinct: pa.Array) -> list[bytes]:
        known = self.known
        pieces = distinct.to_numpy(zero_copy_only=False).tolist()
        out = list(map(known.get, pieces))
        missing = np.array([i for i, ids in enumerate(out) if ids is None], np.int64)
        joins = self._joins(distinct.take(pa.array(missing)))
        together, alone = missing[joins].tolist(), missing[~joins].tolist()
        for part in _portions(alone, pieces, BATCH_BYTES):
            found = self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)
            for i, encoding in zip(part, found, strict=True):
                out[i] = np.array(encoding.ids, np.uint32).tobytes()
        for part in _portions(together, pieces, BATCH_BYTES):
            for i, ids in zip(part, self._encode_together([pieces[i] for i in part]), strict=True):
                out[i] = ids
        for i in missing.tolist()[: max(0, self.most - len(known))]:
            if len(pieces[i]) <= KNOWN_BYTES:
                known[pieces[i]] = out[i]
        return out

    def _joins(self, pieces: pa.Array) -> np.ndarray:
        """Whether a cut is safe on both sides of a piece among others of its kind: printable ASCII, no special string."""
        plain = pc.match_substring_regex(pieces, _JOINS_AFTER_SPACE if self.keeps_space else _JOINS)
        return pc.and_not(plain, pc.match_substring(pieces, "<|")).to_numpy(zero_copy_only=False)

    def _encode_together(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of pieces that join, many to a call: the place where a token begins tells whose it is."""
        gap = "" if self.keeps_space else " "
        parts = list(_portions(list(range(len(pieces))), pieces, JOINED))
        texts = [gap.join([pieces[i] for i in part]) for part in parts]
        for part, encoding in zip(parts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            begins = np.array([o[0] for o in encoding.offsets], np.int64)
            ends = np.cumsum([len(pieces[i]) + len(gap) for i in part])
            data, at = np.array(encoding.ids, np.uint32).tobytes(), 0
            for stop in (4 * np.searchsorted(begins, ends)).tolist():
                yield data[at:stop]
                at = stop


def _portions(numbers: list[int], pieces: list[str], size: int) -> Iterator[list[int]]:
    """``numbers`` in order, in runs whose pieces have ``size`` characters or a little more."""
    run, held = [], 0
    for i in numbers:
        run.append(i)
        held += len(pieces[i])
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def _keeps_space(spec: dict) -> bool:
    """Whether the file is of the plain byte-level kind; else it must be one that drops white space."""
    pre = spec["pre_tokenizer"]
    if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None:
        return True
    splits = pre.get("pretokenizers", [{}])
    if splits[0].get("behavior") == "Removed" and splits[0].get("invert") and r"[^\s" in splits[0]["pattern"].get("Regex", ""):
        return False
    raise ValueError("no safe boundaries are known for this kind of tokenizer")


def _lists(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())


def _cut(text: str) -> list[str]:
    """A text in pieces of about PIECE_BYTES characters, cut before single spaces between printable ASCII."""
    pieces, at = [], 0
    while len(text) - at > PIECE_BYTES and (found := _SAFE_SPACE.search(text, at + PIECE_BYTES)):
        pieces.append(text[at : found.start()])
        at = found.start()
    return [*pieces, text[at:]]
