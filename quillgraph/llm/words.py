"""Ids of texts under a tokenizers file whose pre-tokenizer never joins what white space parts: word by word."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import LOWER, Words, byte_classes, words

#: White space of the pre-tokenizer: ASCII, and a pattern for the rest.
WHITE = byte_classes(b" \t\n\v\f\r")
FURTHER = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
AS_WRITTEN = np.arange(256, dtype=np.uint8)
#: A byte that no UTF-8 text has marks added tokens.
ADDED = b"\xff"
#: Words that every Unicode version lower-cases and classes alike: ASCII and Latin letters up to U+024F.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Pre-tokens whose ids are remembered.
KNOWN = 30_000


def byte_characters() -> dict[int, int]:
    """The printable character that byte-level BPE writes for each byte: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


def token_names(tokenizer_file: str) -> list[str | None]:
    """The token of each id of a tokenizers file."""
    with open(tokenizer_file, encoding="utf-8") as file:
        said = json.load(file)
    named = {i: t for t, i in said["model"]["vocab"].items()} | {t["id"]: t["content"] for t in said["added_tokens"]}
    return [named.get(i) for i in range(max(named) + 1)]


class Merges:
    """Ids of single words, found by the merges of a tokenizers file; what normalises and splits a word is the file's own."""

    def __init__(self, tokenizer_file: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as file:
            said = json.load(file)
        model = said["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        kinds = [[s["type"] for s in said[part][steps]] for part, steps in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        if odd or kinds != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or said["normalizer"]["normalizers"][1] != {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} or said["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"]:
            raise ValueError(f"words of this file may depend on what stands around them: {kinds} {odd}")
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        tokens = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized or t.content.split() != [t.content] for t in tokens.values()):
            raise ValueError(f"added tokens are not taken from the raw text as they stand: {tokens}")
        self.added = {t.content: i for i, t in tokens.items()}
        self.model = self.tokenizer.model
        self.pattern = regex.compile(said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.characters = byte_characters()
        self.known: dict[str, list[int]] = {}

    def merged(self, piece: str) -> list[int]:
        """Ids of a pre-token by the file's merges."""
        if (found := self.known.get(piece)) is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            found = self.known[piece] = [t.id for t in self.model.tokenize(piece)]
        return found

    def pieces(self, word: str) -> list[str]:
        """The pre-tokens of a word. Those of words in plain Latin letters are found here, others by the file's own steps."""
        if not PLAIN.fullmatch(word):
            return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))]
        low = word.lower()
        found = [low] if low.isalpha() else self.pattern.findall(low)
        return found if low.isascii() else [p.encode().decode("latin-1").translate(self.characters) for p in found]

    def ids(self, raw: bytes) -> list[int]:
        """Ids of a word of split()."""
        if raw.isalpha():  # of ASCII letters alone
            return [t.id for t in self.model.tokenize(raw.decode().lower())]
        if raw.startswith(ADDED):
            return [self.added[raw[len(ADDED) :].decode()]]
        word = raw.decode()
        pieces = self.pieces(word)
        return [t.id for t in self.model.tokenize(pieces[0])] if len(pieces) == 1 else [i for piece in pieces for i in self.merged(piece)]

    def split(self, texts: pa.Array) -> Words:
        """The words of texts; added tokens are words of their own, behind a byte that no text has. A-Z are lower-cased here
        unless some text has combining marks, with which lower-casing and composing do not commute."""
        texts = pc.replace_substring_regex(texts, FURTHER, " ").cast(pa.binary())
        for token in sorted(self.added, key=len, reverse=True):
            texts = pc.replace_substring(texts, token, b" " + ADDED + token.encode() + b" ")
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        return words(texts, WHITE, AS_WRITTEN if ((data == 0xCC) | (data == 0xCD)).any() else LOWER)


def laid_out(split: Words, lists: pa.ListArray, rows: int) -> pa.ListArray:
    """The ids of each text, given those of each distinct word."""
    lengths = lists.value_lengths().to_numpy()[split.codes].astype(np.int64)
    ends = np.append(0, np.cumsum(lengths))
    offsets = ends[np.searchsorted(split.row, np.arange(rows + 1))]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), lists.take(pa.array(split.codes)).flatten())


class WordEncoder:
    """Ids of texts; remembers those of at most so many words. added: whether the file's added tokens are found in texts."""

    def __init__(self, tokenizer_file: str, added: bool = False, remembered: int = 200_000) -> None:
        self.remembered = remembered
        self.merges = Merges(tokenizer_file)
        if not added:
            self.merges.added = {}
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; null counts as empty."""
        split = self.merges.split(texts.fill_null(""))
        distinct = split.distinct.to_pylist()
        of_words = [*map(self.known.get, distinct)]
        new = [i for i, found in enumerate(of_words) if found is None]
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
        ids = self.merges.ids
        for i in new:
            of_words[i] = self.known[distinct[i]] = array("I", ids(distinct[i])).tobytes()
        offsets = np.append(0, np.cumsum(np.fromiter(map(len, of_words), np.int64, len(of_words)))) // 4
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(of_words), "<u4")))
        return laid_out(split, lists, len(texts))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = self.encode(pa.array(texts, pa.string()))
        ends, flat = out.offsets.to_numpy(), out.values.to_numpy()
        return [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=1)
def word_encoder(tokenizer_file: str, remembered: int = 200_000) -> WordEncoder:
    """One for each worker process."""
    return WordEncoder(tokenizer_file, True, remembered)
