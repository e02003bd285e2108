"""Token ids of whole texts by a public tokenizer file, with every distinct chunk encoded once per memo."""

from __future__ import annotations

import json
import os
import re
from array import array

# white space of the tokenizers' patterns (Unicode White_Space); a pre-token never spans it, but for a leading blank
SPACE = "\t-\r \x85\xa0  -     　"
# fixed values: the split pattern of the word vocabulary, and the same over lower-case chunks of the characters of SAFE
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SAFE = re.compile("[!-~ß-öø-ÿ]+")
SAFE_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

# how byte-level vocabularies spell bytes: those of printable Latin-1 stand for themselves, others from U+0100 on
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PLAIN)}

# memo entries before it starts anew: bounds the memory of a task
MEMO = 400_000


def tokenizer(path: str):
    """A tokenizer file, loaded in the calling process, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to those of the library for the whole text.

    ``keep_space``: blanks are tokens (byte-level vocabularies); else they only part words.  A text that may hold a
    special token next to blanks is encoded whole."""

    def __init__(self, path: str, keep_space: bool):
        self.tokenizer, self.keep_space, self.memo = tokenizer(path), keep_space, {}
        self.pattern = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+" if keep_space else f"[^{SPACE}]+")
        self.words = None if keep_space or json.dumps(WORD_PATTERN) not in self.tokenizer.to_str() else {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def chunks(self, text: str) -> list[str]:
        """Parts of the text that are encoded apart without changing any id."""
        if self.keep_space:
            return [text] if any(s in text for s in self.special) else self.pattern.findall(text)
        if self.words is not None and text.isascii() and "<|" not in text:  # the file lower-cases: fewer distinct chunks
            text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blanks to str.split, but not to the pattern
            return self.pattern.findall(text)
        return text.split()

    def learn(self, chunks, keep: bool = False) -> None:
        """Encode what the memo lacks; a memo over its bound starts anew unless it must be kept."""
        if len(self.memo) > MEMO and not keep:
            self.memo.clear()
            if self.words:
                self.words.clear()
        new = list(set(chunks).difference(self.memo))
        if self.words is not None:
            new = [c for c in new if not self._learn_words(c)]
        for i in range(0, len(new), 10_000):
            part = new[i:i + 10_000]
            for chunk, found in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                self.memo[chunk] = array("I", found.ids).tobytes()

    def _learn_words(self, chunk: str) -> bool:
        """The model alone does a chunk of common characters, word by word; False if the library must do it."""
        lower = chunk.lower()
        if not SAFE.fullmatch(lower) or "<|" in chunk:
            return False
        parts = []
        for word in SAFE_WORDS.findall(lower):
            if (ids := self.words.get(word)) is None:
                spelled = word if word.isascii() else "".join(map(BYTE_LETTERS.__getitem__, word.encode()))
                ids = self.words[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
            parts.append(ids)
        self.memo[chunk] = b"".join(parts)
        return True

    def encode(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        parts = [self.chunks(t) for t in texts]
        self.learn(c for p in parts for c in p)
        get = self.memo.__getitem__
        return [b"".join(map(get, p)) + end for p in parts]
