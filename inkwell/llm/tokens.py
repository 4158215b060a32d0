"""Exact token counts and ids of public tokenizers, with a whole-token shortcut and caches.

A text is cut at spaces between other characters into chunks whose tokens don't depend on their
neighbours; a chunk's tokens are looked up, or found with the library on first sight. Only texts
with special strings, or with characters that the library is found to class otherwise than the
pattern here, go to it whole, so results are always the library's.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import text_batches

#: The pattern that splits text before byte-level merges (fixed by the vocabulary's format).
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters up to here are looked at one by one; texts with others go to the library.
_LAST = 0x1FFFF
#: Texts without a match have nothing that needs a closer look.
_UNCOMMON = regex.compile(r"[^\n\x20-\x7eÀ-ÿ]|\s\s")
_DOUBLE = regex.compile(r"\s\s")
_SINGLE_SPACE = regex.compile(r"(?<=\S) (?=\S)")
_COMMON_WORD = regex.compile(r"[\x21-\x7eÀ-ÿ]+")
_RARE_WORDS = regex.compile(r"[^\t\n\r\x0b\x0c\x20-\x7eÀ-ÿ]")
_ASCII_SPACE = regex.compile(r"[\x20\x09-\x0D]+")
CACHE_ENTRIES = 400_000
CACHE_LENGTH = 200


class _Bounded(dict):
    """A cache that computes what is missing, in two generations: when one is full it becomes the
    old one, whose entries move back when they are used. Long keys are not kept."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.compute(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def load(path: str):
    """A tokenizer without truncation or padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _byte_alphabet() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write bytes with, by their rule:
    printable characters stand for themselves, the rest are shifted up from 256 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and encode alone as one token, proved by
    encoding each."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    alphabet, pattern, strings = _byte_alphabet(), regex.compile(PRETOKEN), []
    for token in spec["model"]["vocab"]:
        if token in special or any(c not in alphabet for c in token):
            continue
        try:
            text = bytes(alphabet[c] for c in token).decode()
        except UnicodeDecodeError:
            continue
        if (m := pattern.match(text)) and m.end() == len(text):
            strings.append(text)
    t = load(path)
    encoded = t.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded) if len(e.ids) == 1)


@lru_cache(maxsize=4)
def doubtful(path: str) -> str:
    """A pattern of the characters that the library at ``path`` cuts text at otherwise than
    ``PRETOKEN`` does (Unicode tables differ by their age), or that are over ``_LAST``.

    Each is tried after a letter, a digit, a sign and a space, which tells letters, numbers, signs
    and white space apart.
    """
    split, pattern = load(path).pre_tokenizer.pre_tokenize_str, regex.compile(PRETOKEN)

    def differing(chars: list[str]) -> list[str]:
        text = "".join(f"a{c}1{c}!{c} {c}\n" for c in chars)
        if [at for _, at in split(text)] == [m.span() for m in pattern.finditer(text)]:
            return []
        half = len(chars) // 2
        return chars if not half else differing(chars[:half]) + differing(chars[half:])

    found = [x for lo in range(0, _LAST, 1024) for x in differing([chr(c) for c in range(lo, lo + 1024) if not 0xD800 <= c < 0xE000] or ["a"])]
    ranges: list[list[int]] = []
    for c in map(ord, found):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    ranges.append([_LAST + 1, 0x10FFFF])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


def make_counter(path: str, whole: frozenset[str], rare: str):
    """A function text -> number of tokens; ``rare`` is the pattern of ``doubtful``."""
    t, unsure = load(path), regex.compile(rare)
    pattern = regex.compile(PRETOKEN)
    special = [x.content for x in t.get_added_tokens_decoder().values()]

    def library(text: str) -> int:
        return len(t.encode(text, add_special_tokens=False).ids)

    merged = _Bounded(library)

    def chunk(text: str) -> int:
        return sum(1 if p in whole else merged[p] for p in pattern.findall(text))

    first, later = _Bounded(chunk), _Bounded(lambda text: chunk(" " + text))

    def count(text: str | None) -> int:
        if not text:
            return 0
        closer = _UNCOMMON.search(text)
        if closer and not text.isascii() and unsure.search(text) or any(s in text for s in special):
            return library(text)
        # single spaces all begin a chunk; where white space meets white space, only those between others do
        head, *rest = _SINGLE_SPACE.split(text) if closer and _DOUBLE.search(text) else text.split(" ")
        return first[head] + sum(map(later.__getitem__, rest))

    return count


_counters: dict = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` of every whole text, as the library for the
    byte-level vocabulary at ``path`` counts them, without added special tokens.

    Pre-tokens that are proved whole tokens count 1; only the rest are merged. Null and empty
    texts have 0 of both. Special strings in a text are the library's tokens. Repeated rows
    repeat; other columns are not read. ``path`` must exist on every executor. A narrow map.
    """
    known = docs.sparkSession.sparkContext.broadcast((whole_tokens(path), doubtful(path)))  # bounded by the vocabulary and Unicode

    def run(batches):
        if path not in _counters:  # Python workers serve many tasks
            _counters[path] = make_counter(path, *known.value)
        count = _counters[path]
        for b in batches:
            texts = b.column(1).to_pylist()
            n = pa.array([count(t) for t in texts], type=pa.int64())
            size = pa.array([len(t.encode()) if t else 0 for t in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return text_batches(src).mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def make_id_encoder(path: str):
    """A function text -> the ids as little-endian unsigned 32-bit integers, for a lower-casing
    vocabulary whose pre-tokens never hold white space (it is dropped).

    Letters and the punctuation after them are always pre-tokens of their own, so "word," costs
    no merges once "word" and "," are known; a word of ASCII letters alone needs the merges only.
    """
    t = load(path)
    merge, letter = t.model.tokenize, {b: c for c, b in _byte_alphabet().items()}

    def pack(ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def library(text: str) -> bytes:
        return pack(t.encode(text, add_special_tokens=False).ids)

    def word(chunk: str) -> bytes:
        if chunk.isalpha():
            if chunk.isascii():
                return pack([x.id for x in merge(chunk)])
            if _COMMON_WORD.fullmatch(chunk):  # letters that composing leaves alone: merged as their bytes
                return pack([x.id for x in merge("".join(map(letter.__getitem__, chunk.encode())))])
            return library(chunk)
        if len(chunk) > 1 and chunk[-1] in ".,!?;:" and chunk[:-1].isalpha():
            return words[chunk[:-1]] + words[chunk[-1]]
        return library(chunk)

    words = _Bounded(word)
    # a word with other characters is the library's, which lower-cases and composes it by its own tables;
    # neither reaches over white space, so a word's ids don't depend on its neighbours
    any_words = _Bounded(lambda chunk: words[chunk.lower()] if _COMMON_WORD.fullmatch(chunk) else library(chunk))

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return library(text)
        if _RARE_WORDS.search(text):
            return b"".join(map(any_words.__getitem__, filter(None, _ASCII_SPACE.split(text))))
        return b"".join(map(words.__getitem__, text.lower().split()))

    return encode
