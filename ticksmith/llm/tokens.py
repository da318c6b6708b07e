"""Token ids of whole texts by the ``tokenizers`` library, with the work shared between equal words.

Byte-level and word-level BPE never merge across the start of a space-delimited word, so a text's ids are the joined
ids of its space-delimited segments. Texts are split in Arrow, a few MB at a time, and each distinct segment is looked up
once in a bounded table that a Python worker keeps. A new segment is cut into the words, numbers and marks that the
file's own pattern tells apart, whose ids are in a second bounded table; the library encodes each new one. Segments of
other characters than ``_LETTER``, ASCII marks and line ends go to the library uncut, and texts for which the split
could matter (white space runs around a space, special strings) whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments that a worker keeps, and two thirds of the words; the most frequent come early and stay.
CACHE_SEGMENTS = 400_000
#: Words that go to the library as one text.
GROUP = 400
#: Characters whose segments are looked up together.
BLOCK_CHARS = 2_000_000

#: A space after white space that is not followed by a visible character belongs to a longer white space token.
_RUN = re.compile(r"\s (?!\S)")
#: The same in Arrow's pattern language.
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ARROW_RUN = rf"{_SPACE} ({_SPACE}|\z)"

#: Letters in any version of Unicode, each its own NFC form, with lower-case forms of one character.
_LETTER = "A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-žА-яЁё"
_CUT = re.compile(rf"[!-~ \n{_LETTER}]*")
#: The tokenizer files' own patterns, over those characters; fixed values.
_PIECES = {
    "spaces": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+").findall,
    "words": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+").findall,
}

#: Ids of many strings, one behind the other, and how many each has.
Flat = tuple[np.ndarray, np.ndarray]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Table:
    """Ids of strings; ``room`` of them are kept, others are forgotten after their block."""

    def __init__(self, room: int, dtype: np.dtype, make: Callable[[list[str]], Flat]):
        self.room, self.make, self.kept = room, make, 0
        self.known: dict[str, int] = {}
        self.ids, self.begin = np.zeros(0, dtype), np.zeros(1, np.int64)

    def gather(self, names: list[str], code: np.ndarray | None = None) -> Flat:
        """Ids of ``names``, or of ``names[code]``."""
        found = list(map(self.known.get, names))
        if None in found:
            new = list(dict.fromkeys(s for s, k in zip(names, found, strict=True) if k is None))
            places = dict(zip(new, range(self.kept, self.kept + len(new)), strict=True))
            found = [places[s] if k is None else k for s, k in zip(names, found, strict=True)]
            ids, sizes = self.make(new)
            self.ids, self.begin = np.concatenate([self.ids, ids]), np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
            keep = min(self.room - self.kept, len(new))
            self.known.update(zip(new[:keep], range(self.kept, self.kept + keep), strict=True))
            self.kept += keep
        place = np.array(found, np.int64)
        begin = self.begin[place]
        n = self.begin[place + 1] - begin
        if code is not None:
            begin, n = begin[code], n[code]
        at = np.repeat((begin - np.cumsum(n) + n).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        out = self.ids[at]
        self.begin = self.begin[: self.kept + 1]
        self.ids = self.ids[: self.begin[-1]]
        return out, n


class SegmentEncoder:
    """``encode(texts)`` gives each text's ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, cache_segments: int = CACHE_SEGMENTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 0xFFFF else "<u4")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.mode = _mode(spec)
        vocabulary = self.tok.get_vocab()
        #: Tokens that begin with the space byte, or end a word: exactly one of each word that the pattern finds.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for token, i in vocabulary.items() if (token.startswith("Ġ") if self.mode == "spaces" else token.endswith("</w>"))]] = True
        self.segments = Table(cache_segments, self.dtype, self._segments)
        self.pieces = Table(cache_segments * 3 // 2, self.dtype, self._pieces)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.flat(texts)
        data, ends = ids.tobytes(), (np.cumsum(sizes) * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []

    def flat(self, texts: list[str]) -> Flat:
        """The ids of all texts, one text behind the other, and how many each has."""
        done, block, size = [], [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                done.append(self._block(block))
                block, size = [], 0
        if block or not done:
            done.append(self._block(block))
        ids, sizes = zip(*done, strict=True)
        return np.concatenate(ids), np.concatenate(sizes)

    def _block(self, texts: list[str]) -> Flat:
        rows = pa.array(texts, pa.large_string())
        alone = self._alone(rows)
        if not alone.any():
            return self._split(rows)
        split, whole = self._split(rows.filter(pa.array(~alone))), self._library([t for t, a in zip(texts, alone, strict=True) if a])
        sizes = np.empty(len(texts), np.int64)
        sizes[alone], sizes[~alone] = whole[1], split[1]
        ids, of_whole = np.empty(sizes.sum(), self.dtype), np.repeat(alone, sizes)
        ids[of_whole], ids[~of_whole] = whole[0], split[0]
        return ids, sizes

    def _alone(self, texts: pa.Array) -> np.ndarray:
        """Which texts the library gets uncut."""
        if self.mode != "spaces":
            return np.full(len(texts), self.mode == "whole")
        found = pc.match_substring_regex(texts, _ARROW_RUN).to_numpy(zero_copy_only=False)
        for s in self.specials:
            found = found | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return found

    def _split(self, texts: pa.Array) -> Flat:
        """Texts by segments."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if self.mode == "words":
            texts = pc.replace_substring(texts, "\n", " ")
        parts = pc.split_pattern(texts, " ")
        at, parts = parts.offsets.to_numpy()[:-1], parts.flatten().dictionary_encode()
        names, code = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()
        if self.mode == "spaces":  # a text's first segment has no space before it; its name has one, which others lack
            first: dict[str, int] = {}
            code = code.copy()
            code[at] = [first.setdefault(" " + names[k], len(names) + len(first)) for k in code[at].tolist()]
            names += first
        ids, n = self.segments.gather(names, code)
        return ids, np.add.reduceat(n, at)

    def _library(self, texts: list[str]) -> Flat:
        found = [np.asarray(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, self.dtype), np.array([len(x) for x in found], np.int64)

    def _segments(self, segments: list[str]) -> Flat:
        """New segments, each as it stands behind a space, or in front of a text where its name begins with one."""
        if self.mode == "spaces":
            segments = [s[1:] if s[:1] == " " else " " + s for s in segments]
        if _CUT.fullmatch("".join(segments)) and not any(x in s for s in segments if "<|" in s for x in self.specials):
            return self._cut(segments)
        fits = np.array([_CUT.fullmatch(s) is not None and not any(x in s for x in self.specials) for s in segments], bool)
        odd = self._library([s for s, f in zip(segments, fits, strict=True) if not f])
        plain = self._cut([s for s, f in zip(segments, fits, strict=True) if f])
        sizes = np.empty(len(segments), np.int64)
        sizes[fits], sizes[~fits] = plain[1], odd[1]
        ids, of_plain = np.empty(sizes.sum(), self.dtype), np.repeat(fits, sizes)
        ids[of_plain], ids[~of_plain] = plain[0], odd[0]
        return ids, sizes

    def _cut(self, segments: list[str]) -> Flat:
        """By words, numbers and marks; most segments are one word."""
        cut = _PIECES[self.mode]
        if self.mode == "words":
            segments = [s.lower() for s in segments]
        lists = [(s,) if s[1:].isalpha() and (s[0] == " " or s[0].isalpha()) else cut(s) for s in segments]
        ids, n = self.pieces.gather(list(chain.from_iterable(lists)))
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        before = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(before[ends], prepend=0)

    def _pieces(self, pieces: list[str]) -> Flat:
        """New words by groups, of which each is cut at its words' edges again; others go one by one."""
        grouped = np.array([self.mode == "words" or p[0] == " " for p in pieces], bool)
        words = [p for p, g in zip(pieces, grouped, strict=True) if g]
        groups = [words[k : k + GROUP] for k in range(0, len(words), GROUP)]
        joint = "" if self.mode == "spaces" else " "
        ids, _ = self._library([joint.join(g) for g in groups])
        edges = np.flatnonzero(self.edge[ids])
        n = np.diff(edges, append=len(ids)) if self.mode == "spaces" else np.diff(edges, prepend=-1)
        if grouped.all():
            return ids, n
        other = self._library([p for p, g in zip(pieces, grouped, strict=True) if not g])
        sizes = np.empty(len(pieces), np.int64)
        sizes[grouped], sizes[~grouped] = n, other[1]
        out, of = np.empty(sizes.sum(), self.dtype), np.repeat(grouped, sizes)
        out[of], out[~of] = ids, other[0]
        return out, sizes


def _mode(spec: dict) -> str:
    """spaces: words carry the space before them; words: white space is dropped; whole: nothing is known."""
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaces"
    steps = pre.get("pretokenizers") or [{}]
    if spec["model"].get("end_of_word_suffix") and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
        return "words"
    return "whole"


@lru_cache(maxsize=4)
def encoder(path: str) -> SegmentEncoder:
    """One encoder for each worker process and file."""
    return SegmentEncoder(path)
