"""Token ids of whole texts, each different piece of a batch being encoded once.

Texts are normalised, cut at blanks by Arrow and dictionary-encoded; a task keeps the ids of the pieces that it has met, so
that only new pieces go to the encoder of words (`encode`). Or batches of some size are cut first and their dictionaries
joined, so that words are encoded once a group and no piece is looked up in Python (`grouped`). A tokenizer file of the
plain kind (NFC, blanks, lower case; split by letters, digits and the rest) allows this. Python's Unicode tables may differ
from the library's: each character is compared when a task first meets it, and texts with one that differs are encoded
whole, as the library does. Other files are encoded whole as well.
"""

from __future__ import annotations

import json
import re
import string
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECES = 300_000  # a task's pieces, forgotten all at once beyond that
GROUP = 32_000_000  # characters of a group; it holds about as many bytes of numbers and different pieces
WORDS = 1 << 16  # words that are encoded in one go
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
NO_MODEL = {"type": "BPE", "vocab": {}, "merges": []}

#: words -> (how many ids each has, all ids)
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: a byte that is printable in Latin-1 is itself, the others are counted up from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(1)
def library(spec: str) -> Any:
    """The library's tokenizer, kept for the later tasks of a worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for; `fresh` has the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


def gathered(starts: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[starts[0] : starts[0] + counts[0]], and so on, one after the other."""
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0)
    return values[at + np.repeat(starts - ends + counts, counts)]


def joined(number: np.ndarray, bounds: np.ndarray, slow: dict[int, np.ndarray], starts: np.ndarray, counts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of texts: the pieces' ids one after the other, or those of slow; number: row of each piece in starts and counts."""
    n = counts[number]
    ids = gathered(starts[number], n, values)
    offsets = np.concatenate([[0], np.cumsum(n)])[bounds]
    if not slow:
        return offsets, ids
    parts = [slow.get(i, ids[offsets[i] : offsets[i + 1]]) for i in range(len(bounds) - 1)]
    return np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.concatenate(parts)


def last_bytes(strings: pa.LargeStringArray, rows: np.ndarray, n: np.ndarray) -> pa.LargeStringArray:
    """The last n bytes of those rows."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int64)[strings.offset + rows + 1] if len(rows) else rows
    own = np.concatenate([[0], np.cumsum(n)])
    found = gathered(ends - n, n, np.frombuffer(data, np.uint8)) if len(rows) else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(own), pa.py_buffer(found))


class Lexer:
    """Cuts texts into blank-separated pieces and keeps the ids of the pieces met."""

    def __init__(self, spec: str, kind: str, words: Encoder | None = None, most: int = PIECES) -> None:
        """words: ids of words (normalised and pre-split); by the library's model if None."""
        parsed = json.loads(spec)
        self.ids = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        # with an encoder of words the library only normalises and cuts, so its model and special tokens are left out
        self.tokenizer = library(json.dumps(parsed | {"model": NO_MODEL, "added_tokens": []}) if words else spec)
        self.own, self.words = words is not None, words or self.library_words
        self.kind, self.most = np.dtype(kind), most
        self.plain = parsed["normalizer"] == PLAIN and json.dumps(parsed["pre_tokenizer"]).count('"Split"') == 1
        self.marks = string.punctuation if json.dumps(SPLIT) in json.dumps(parsed["pre_tokenizer"]) else ""  # a run of them is one word
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.ids, key=len, reverse=True))) + ")") if self.ids else None
        self.chars = byte_chars()
        self.known: set[str] = set()
        self.blank: set[str] = set()
        self.odd: set[str] = set()
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.starts, self.counts, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def library_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        model, chars, counts, values = self.tokenizer.model, self.chars, [], []
        for word in words:
            if not word.isascii() or not word.isalpha():
                word = "".join(map(chars.__getitem__, word.encode()))
            ids = [t.id for t in model.tokenize(word)]
            counts.append(len(ids))
            values += ids
        return np.array(counts, np.int64), np.array(values, self.kind)

    # ---- characters

    def learn(self, char: str) -> None:
        """Whether the library takes the character for a blank, or as Python's tables have it; else texts with it are odd."""
        self.known.add(char)
        normal = self.tokenizer.normalizer.normalize_str
        if normal(f"a{char}b") == "a b":
            self.blank.add(char)
            return
        around = (char, f"a{char}", f"a\u0323{char}", f"a\u0301{char}\u0323", f"{char}\u0301")
        low = unicodedata.normalize("NFC", char).lower()
        cut = len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{low}a"))
        if any(normal(x) != "".join(map(str.lower, unicodedata.normalize("NFC", x))) for x in around) or low.isalpha() != (cut == 1):
            self.odd.add(char)

    def usual(self, text: str) -> str | None:
        """The text normalised, with blanks between pieces; None if it must be encoded whole."""
        seen = set(text)
        for char in seen - self.known:
            self.learn(char)
        if not self.plain or (self.odd and seen & self.odd) or ("<" in seen and self.special and self.special.search(text)):
            return None
        for char in seen & self.blank:
            text = text.replace(char, " ")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # the library lowers each character by itself; only the capital sigma depends on its place in str.lower
        return text.lower() if "\u03a3" not in seen else "".join(map(str.lower, text))

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text, normalised and cut by the library."""
        if not self.own:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        out = [np.zeros(0, self.kind)]
        for part in self.special.split(text) if self.special else [text]:
            if part in self.ids:
                out.append(np.array([self.ids[part]], self.kind))
            elif part:
                low = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                words = [low[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(low)]
                out.append(self.words(words)[1] if words else out[0])
        return np.concatenate(out)

    # ---- texts

    def cut(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, dict[int, np.ndarray]]:
        """Pieces of the texts, where each text's begin and end, and the ids of texts that are encoded whole (these have one empty piece)."""
        rows = [self.usual(x) for x in texts]
        lists = pc.split_pattern(pa.array([x or "" for x in rows], pa.large_string()), " ")
        slow = {i: self.whole(x) for i, (x, row) in enumerate(zip(texts, rows, strict=True)) if row is None}
        return lists.flatten().dictionary_encode(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), slow

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids of texts."""
        if len(self.numbers) > self.most:
            self.clear()
        pieces, bounds, slow = self.cut(texts)
        place = np.fromiter(map(self.numbers.__getitem__, pieces.dictionary.to_pylist()), np.int64, len(pieces.dictionary))
        self.add()
        return joined(place[pieces.indices.to_numpy()], bounds, slow, self.starts, self.counts, self.values)

    def grouped(self, batches: Iterable[tuple[Any, list[str]]], most: int = GROUP) -> Iterator[tuple[Any, np.ndarray, np.ndarray]]:
        """Each batch's key with offsets and ids of its texts, in order. Texts are not kept until a group of `most` characters is full, only the numbers of their pieces are."""
        held, size = [], 0
        for key, texts in batches:
            held.append((key, *self.cut(texts)))
            size += sum(map(len, texts))
            if size >= most:
                yield from self.ids_of(held)
                held, size = [], 0
        yield from self.ids_of(held)

    def ids_of(self, held: list[tuple[Any, pa.DictionaryArray, np.ndarray, dict[int, np.ndarray]]]) -> Iterator[tuple[Any, np.ndarray, np.ndarray]]:
        if not held:
            return
        pieces = pa.concat_arrays([x.dictionary for _, x, _, _ in held]).dictionary_encode()
        starts, counts, values = self.looked_up(pieces.dictionary)
        place, at = pieces.indices.to_numpy(), 0
        for key, part, bounds, slow in held:
            here = place[at : at + len(part.dictionary)]
            at += len(here)
            yield key, *joined(here[part.indices.to_numpy()], bounds, slow, starts, counts, values)

    def looked_up(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each different piece's ids start, how many it has, and all ids. Most pieces are letters, marks or letters before marks: one word or two.

        Each different word is encoded once, and once more if it is also within pieces that the library must cut.
        """
        stems = pc.ascii_rtrim(pieces, characters=self.marks) if self.marks else pieces
        length, kept = (pc.binary_length(x).to_numpy() for x in (pieces, stems))
        coded = stems.dictionary_encode()
        names, stem = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        letters = np.fromiter(map(str.isalpha, names), bool, len(names))
        number = np.cumsum(letters) - 1
        words = [names[i] for i in np.flatnonzero(letters)]
        usual = letters[stem] | (kept == 0)

        marked = np.flatnonzero(usual & (length > kept))
        runs, first_run = last_bytes(pieces, marked, (length - kept)[marked]).dictionary_encode(), len(words)
        words += runs.dictionary.to_pylist()

        rest, others, n_words, cut = np.flatnonzero(~usual), Numbers(), [], []
        for piece in pieces.take(pa.array(rest)).to_pylist():
            numbers = [others[piece[a:b]] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]
            n_words.append(len(numbers))
            cut += numbers
        first_other = len(words)
        words += others.fresh

        each = (kept > 0).astype(np.int64) + (length > kept)
        each[rest] = n_words
        first = np.cumsum(each) - each
        word = np.zeros(each.sum(), np.int64)
        lettered = np.flatnonzero(usual & (kept > 0))
        word[first[lettered]] = number[stem[lettered]]
        word[first[marked] + (kept[marked] > 0)] = first_run + runs.indices.to_numpy()
        word[gathered(first[rest], each[rest], np.arange(len(word)))] = first_other + np.array(cut, np.int64)

        found = [self.words(words[i : i + WORDS]) for i in range(0, len(words), WORDS)] or [(np.zeros(0, np.int64), np.zeros(0, self.kind))]
        counts, values = (np.concatenate(x) for x in zip(*found, strict=True))
        n_ids = counts[word]
        ends = np.concatenate([[0], np.cumsum(n_ids)])
        return ends[first], ends[first + each] - ends[first], gathered((np.cumsum(counts) - counts)[word], n_ids, values.astype(self.kind))

    def add(self) -> None:
        """Encodes the pieces that are new. One of several words is the ids of these, which are pieces themselves."""
        fresh, single, several = self.numbers.fresh, [], []
        first = len(self.numbers) - len(fresh)
        for i, piece in enumerate(fresh):  # grows by the words of pieces
            if piece.isalpha():
                single.append(i)
            elif piece[-1:] in (".", ",", "!", "?", ";", ":") and piece[:-1].isalpha():
                several.append((i, [self.numbers[piece[:-1]], self.numbers[piece[-1]]]))
            elif piece:
                words = [piece[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]
                if words == [piece]:
                    single.append(i)
                else:
                    several.append((i, [self.numbers[w] for w in words]))
        if not fresh:
            return
        counts = np.zeros(len(fresh), np.int64)
        counts[single], values = self.words([fresh[i] for i in single])
        starts = np.cumsum(counts) - counts + len(self.values)
        self.values = np.concatenate([self.values, values.astype(self.kind)])
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])
        if several:
            parts = np.array([n for _, ns in several for n in ns], np.int64)
            owner = np.repeat(np.arange(len(several)), [len(ns) for _, ns in several])
            own = np.array([first + i for i, _ in several])
            total = np.bincount(owner, weights=self.counts[parts], minlength=len(several)).astype(np.int64)
            more = gathered(self.starts[parts], self.counts[parts], self.values)
            self.starts[own], self.counts[own] = np.cumsum(total) - total + len(self.values), total
            self.values = np.concatenate([self.values, more])
        self.numbers.fresh = []


def list_array(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32)))
