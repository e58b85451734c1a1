"""Byte-level BPE of whole texts by way of their distinct words.

A text is cut into words before each single space that starts one. No token of the public
byte-level vocabularies reaches across such a cut (a token begins with at most one space, and
a run of white space is cut only before its last space), so the ids of a text are the ids of
its words in order, and each distinct word needs encoding once.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from itertools import islice

import numpy as np

#: The vocabulary as ranks for the faster library, and as a table for the exact one.
RANKS, TABLE = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"

_CUT = re.compile(r"(?<=\S)(?= \S)")


def vocabulary_path(name: str = TABLE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(2)
def _fast(path: str, ranks: str):
    """The same vocabulary in tiktoken, with the special tokens of the table."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path) as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)


@lru_cache(2)
def pieces(path: str) -> list[bytes]:
    """Bytes of each id: the table of pieces. Byte-level tables write each byte as a printable
    character: itself if it is one, else the next free one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path) as f:
        table = json.load(f)
    vocab = table["model"]["vocab"] | {x["content"]: x["id"] for x in table["added_tokens"]}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte[c] for c in token)
    return out


@lru_cache(2)
def _starts_word(path: str) -> np.ndarray:
    """Whether the piece of an id begins with a space."""
    return np.fromiter((x[:1] == b" " for x in pieces(path)), bool)


def _joins(word: str) -> bool:
    """Whether a word keeps its ids when other such words stand before and after it, and only
    its first token begins with a space: Latin, one leading space, no white space at the ends."""
    return len(word) > 1 and word[0] == " " and word.find(" ", 1) < 0 and word[1] > " " and word[-1] > " " and (word.isascii() or max(word) < "ɐ" and word.replace("\n", "").isprintable()) and "<|" not in word


#: Words in one call of the faster library.
CALL = 20_000


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each word, and all ids. Words of Latin characters go through the
    faster library, many in one call; its character classes and those of the exact one agree
    there. All other words go through the exact one."""
    fast, starts = _fast(path, path.removesuffix(".json") + ".tiktoken"), _starts_word(path)
    lengths, parts, order = np.zeros(len(words), np.int32), [], []
    rest, plain = [], []
    for i, w in enumerate(words):
        (plain if _joins(w) else rest).append(i)
    for at in range(0, len(plain), CALL):
        some = plain[at : at + CALL]
        ids = np.array(fast.encode_ordinary("".join([words[i] for i in some])), np.uint32)
        first = np.flatnonzero(starts[ids])
        if len(first) != len(some):  # cannot happen with byte-level pieces; the exact way then
            rest += some
            continue
        lengths[some] = np.diff(first, append=len(ids))
        parts.append(ids)
        order += some
    for at in range(0, len(rest), CALL):
        some = rest[at : at + CALL]
        for i, e in zip(some, tokenizer(path).encode_batch([words[i] for i in some], add_special_tokens=False), strict=True):
            lengths[i] = len(e.ids)
            parts.append(np.array(e.ids, np.uint32))
        order += some
    flat = np.concatenate([*parts, np.empty(0, np.uint32)])
    done = np.array(order, np.int64)  # ids lie in this order; bring them into that of the words
    at = np.zeros(len(words), np.int64)
    at[done] = np.cumsum(lengths[done]) - lengths[done]
    return lengths, flat[spread(lengths, at, np.arange(len(words)))]


class _Codes(dict):
    def __missing__(self, key):
        code = self[key] = len(self)
        return code


def split_words(text: str) -> list:
    """The words of a text; a string stands for a space and the string, a tuple for its item."""
    words: list = text.split(" ")
    if "" in words or "\n \n" in text or not text.replace("\n", "").isprintable():
        return [(w,) for w in _CUT.split(text)] if text else []
    words[0] = (words[0],)
    return words


def code_texts(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of the texts, the codes of all their words, and the words in each text."""
    seen = _Codes()
    coded = [np.fromiter(map(seen.__getitem__, words), np.int32, len(words)) for words in map(split_words, texts)]
    counts = np.fromiter(map(len, coded), np.int64, len(coded))
    return [" " + k if type(k) is str else k[0] for k in seen], np.concatenate([*coded, np.empty(0, np.int32)]), counts


def spread(lengths: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of the ids of words by code: starts[c], starts[c] + 1, ... for each c in turn."""
    n = lengths[codes]
    ends = np.cumsum(n)
    return np.repeat(starts[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Encodes blocks of texts; a word known from an earlier block is not encoded again. Known
    words are forgotten when there are more than ``most``."""

    def __init__(self, path: str, most: int = 1_000_000):
        self.path, self.most = path, most
        self._forget()

    def _forget(self) -> None:
        self.seen, self.lengths, self.ids = _Codes(), np.empty(0, np.int32), np.empty(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.seen) > self.most:
            self._forget()
        coded = [np.fromiter(map(self.seen.__getitem__, words), np.int32, len(words)) for words in map(split_words, texts)]
        fresh = islice(self.seen, len(self.lengths), None)
        lengths, ids = encode_words([" " + k if type(k) is str else k[0] for k in fresh], self.path)
        self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        codes = np.concatenate([*coded, np.empty(0, np.int32)])
        flat = self.ids[spread(self.lengths, starts, codes)]
        per_code = np.concatenate([[0], np.cumsum(self.lengths[codes], dtype=np.int64)])
        at = per_code[np.concatenate([[0], np.cumsum([len(c) for c in coded], dtype=np.int64)])]
        return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text, encoding each distinct word of the texts once."""
    return Encoder(path).encode(texts)
