"""Byte-level BPE ids in Python tasks, word by word with a bounded cache.

No token of this vocabulary's pattern crosses from a character that is not white space to a space, so
a text may be cut there and its parts encoded alone.  Parts repeat a lot; their ids are kept.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np

#: Parts kept by one Python worker (two generations of this size): about 200 MB at most.
PARTS = 500_000
#: Letters for which both libraries' character classes are known to agree; other parts go to tokenizers.
_PLAIN = re.compile(r"[\n -~¡-¬®-ɏ]*")
_SPACE_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """The usual printable stand-ins of bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Parts(dict):
    """Two generations of parts: what is not asked for again is forgotten."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        return self.older[part]

    def keep(self, found: dict[str, bytes]) -> None:
        if len(self) > PARTS:
            self.older = dict(self)
            self.clear()
        self.update(found)

    def missing(self, parts: set[str]) -> list[str]:
        lacking = [p for p in parts if p not in self]
        older = self.older
        self.update((p, older[p]) for p in lacking if p in older)
        return [p for p in lacking if p not in older]


class ByteEncoder:
    """Ids of texts as the tokenizers library gives them, as little-endian 32-bit numbers.

    The merges of the file are run by the faster tiktoken library for parts of plain letters; parts
    with other characters and texts that hold a special token's string go to tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        self.special = [t["content"] for t in read["added_tokens"]]
        byte = _byte_of_char()
        special = set(self.special)
        ranks = {bytes(byte[c] for c in t): i for t, i in read["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("parts", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 2, dtype=bool)
        for t, i in ranks.items():
            self.opens[i] = t[:1] == b" "
        self.parts = Parts()  # of ' ' + key

    def slow(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def one(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text):
            return self.slow(text)
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def _learn(self, lacking: list[str]) -> None:
        joint = [p for p in lacking if p and not p[-1].isspace() and _PLAIN.fullmatch(p)]
        found = {p: self.one(" " + p) for p in set(lacking).difference(joint)}
        for at in range(0, len(joint), 20_000):
            some = joint[at:at + 20_000]
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(some)), dtype="<u4")
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(some):
                raise AssertionError("a part was cut inside")
            data, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
            found.update((p, data[a:b]) for p, a, b in zip(some, (4 * cuts).tolist(), ends, strict=True))
        self.parts.keep(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 200):
            some = texts[at:at + 200]
            split = [None if _SPACE_RUN.search(t) or any(s in t for s in self.special) else t.split(" ") for t in some]
            wanted: set[str] = set()
            for s in split:
                wanted.update(s or ())
            self._learn(self.parts.missing(wanted))
            get = self.parts.__getitem__
            out += [self._odd(t) if s is None else self.one(s[0]) + b"".join(map(get, s[1:]))
                    for t, s in zip(some, split, strict=True)]
        return out

    def _odd(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.slow(text)
        return b"".join(map(self.one, _CUT.split(text)))


@cache
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for each Python worker."""
    return ByteEncoder(path)


#: What the word vocabulary's pattern calls a word, once lower-cased.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"


class WordEncoder:
    """Ids of texts for the lower-casing vocabulary whose words end in ``</w>`` and that drops white space.

    A cut before a space or a line feed never changes the ids on either side, so parts between them
    are encoded alone and kept.  Parts of plain letters run through the model alone; others go through
    the whole library.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        self.special = [t["content"] for t in read["added_tokens"]]
        self.model = Tokenizer.from_str(json.dumps(
            {**read, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.words = regex.compile(r"\n|" + _WORD_PATTERN)
        self.chars = {b: c for c, b in _byte_of_char().items()} | {32: " "}
        size = max(read["model"]["vocab"].values(), default=0)
        size = max([size, *(t["id"] for t in read["added_tokens"])]) + 1
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        self.token_bytes = np.array([t.encode() for t in self.tokens], dtype=object)
        self.number_bytes = np.array([b"%d" % i for i in range(size)], dtype=object)
        self.ends = np.array([t.endswith(_WORD_END) for t in self.tokens])
        self.parts = Parts()

    def slow(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _learn(self, lacking: list[str]) -> None:
        plain = [p for p in lacking if _PLAIN.fullmatch(p) and not ("<|" in p and any(s in p for s in self.special))]
        found = {p: self.slow(p) for p in set(lacking).difference(plain)}
        for at in range(0, len(plain), 20_000):
            some = plain[at:at + 20_000]
            words = self.words.findall("\n".join(some).lower())  # no part holds a line feed
            breaks = [i for i, w in enumerate(words) if w == "\n"]
            after = np.array([0, *breaks, len(words)]) - np.arange(len(some) + 1).clip(1) + 1
            after[0] = 0
            line = " ".join(w for w in words if w != "\n").encode().decode("latin-1").translate(self.chars)
            ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1)) if len(ids) else np.zeros(1, dtype=int)
            if len(ends) != after[-1] + 1:
                raise AssertionError("a word has no end")
            cuts = ids.itemsize * ends[after]
            data = ids.tobytes()
            found.update((p, data[a:b]) for p, a, b in zip(some, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        self.parts.keep(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as ``kind``."""
        out: list[bytes] = []
        for at in range(0, len(texts), 200):
            split = [t.replace("\n", " ").split(" ") for t in texts[at:at + 200]]
            self._learn(self.parts.missing(set().union(*split)))
            get = self.parts.__getitem__
            out += [b"".join(map(get, s)) for s in split]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode without skipping special tokens: the vocabulary has no decoder, so a space joins tokens."""
        return self.decoded_bytes(ids).decode()

    def decoded_bytes(self, ids: np.ndarray) -> bytes:
        return b" ".join(self.token_bytes[ids].tolist())


@cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)
