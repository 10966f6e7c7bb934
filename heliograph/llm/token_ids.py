"""Token ids of whole texts, with what each Python worker has already encoded kept by word.

No token of a tokenizer that drops white space reaches over white space, so a text's ids are those of its
words in turn; and a run of letters ends at the next ASCII sign, so a word like `thing,` has the ids of
`thing` and of `,`. Both hold for tokenizers like word_bpe_49k.json (NFC, white space to a space, lower
case; letters, digits and signs split apart, the space between dropped); `WordEncoder` refuses files of
another kind. Words outside the plain case (contractions, digits, combining marks, special tokens) are
encoded by the tokenizer as they stand. Tests compare whole texts with plain `encode`.
"""

from __future__ import annotations

import functools
import json
import re
import struct

import numpy as np

LETTERS = "a-zà-öø-ÿÀ-ÖØ-Þß"
PLAIN = re.compile(rf"([{LETTERS}]+)([!-/:-@\[-`{{-~]*)").fullmatch
#: Entries of each of the two halves of the memory of words.
REMEMBERED = 400_000


class _Memory(dict):
    """word -> ids as little-endian 32-bit bytes. Two generations bound it: words not asked for lately go."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["post_processor"] or spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed":
            raise ValueError(f"{path}: words of this tokenizer can't be encoded apart")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(0xDF, 0x100)]) if c.isalpha()}
        self.memory = _Memory(self._word, most)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if (m := PLAIN(text)) is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif m[2]:
            return self.memory[m[1].encode()] + self.memory[m[2].encode()]
        else:  # one run of letters is one piece for the vocabulary
            ids = [x.id for x in self.tokenizer.model.tokenize(text.lower().translate(self.table))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str | None) -> bytes:
        """ids of the whole text as little-endian unsigned 32-bit integers; none for null."""
        raw = (text or "").encode("utf-8", "replace")
        if b"<|" in raw and any(x in raw for x in self.special):
            words = raw.split()  # the strings of special tokens count in their own case only
        else:
            words = raw.lower().split()  # bytes: A-Z only, as the tokenizer's own lower case does to them
        return b"".join(map(self.memory.__getitem__, words))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each file in a worker; batches and tasks share what it remembers."""
    return WordEncoder(path)


def document_ids(path: str, text: str | None, end_id: int) -> np.ndarray:
    return np.frombuffer(encoder(path)(text) + struct.pack("<I", end_id), dtype="<u4")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
