"""Token ids of whole texts by a public tokenizer file, one library call for each new word."""

from __future__ import annotations

import re

import numpy as np

#: The id that ends each document.
END = 1

def vocabulary_path() -> str:
    """The default vocabulary file; every operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words a process remembers, and the longest it remembers.
REMEMBERED, LONGEST = 500_000, 18

#: Words of lower-case Latin letters: already normalized, and one pre-token each.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Not in a simple text: what isn't ASCII or a Latin-1 letter, and a comma or stop after neither letter, digit nor blank; a special token.
_FOREIGN = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
_LONE = re.compile("[.,](?<=[\x00-\x08\x0e-\x1f!-/:-@\\[-`{-\x7f][.,]) ")


def _hard(text: str) -> bool:
    """Whether a text is no simple one. Each pattern begins with one set of characters, which is quick to look for."""
    return "<|" in text or _LONE.search(text) is not None or not text.isascii() and _FOREIGN.search(text) is not None


class Encoder:
    """Ids as the tokenizers library gives them for a whole text, without special tokens added.

    The vocabulary's tokens never span a blank or a line end, and its normalizer works on single
    characters and their combining marks, so a text's ids are those of its pieces between ASCII
    blanks and line ends, joined. A simple text is lower-cased first, and its commas and stops between a word and a
    blank become pieces. A piece is encoded once while it is remembered. Words of Latin letters go through the same
    model without the normalizer, many in one call, since each ends in a token that ends a word;
    all else goes through the whole tokenizer. `check` compares with the library's answer for
    whole texts.
    """

    def __init__(self, path: str, dtype: str = "<u4"):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.dtype = dtype
        self.known: dict[str, bytes] = {}

    def _plainly(self, words: list[str]) -> list[bytes]:
        """Words that match _PLAIN, 1000 to a call."""
        lines = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        size, out = np.dtype(self.dtype).itemsize, []
        for e in self.plain.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(e.ids, dtype=self.dtype)
            raw, lo = ids.tobytes(), 0
            for hi in ((np.flatnonzero(self.last[ids]) + 1) * size).tolist():
                out.append(raw[lo:hi])
                lo = hi
        return out

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        plain, rest = [], []
        for p in pieces:
            (plain if _PLAIN.fullmatch(p) else rest).append(p)
        found = dict(zip(plain, self._plainly(plain), strict=True))
        found.update((p, np.array(e.ids, dtype=self.dtype).tobytes()) for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of this encoder's dtype, without the end id."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = []
        for t in texts:
            t = t.replace("\n", " ")
            if not _hard(t):
                t = t.lower().replace(", ", " , ").replace(". ", " . ")
            split.append(t.split(" "))
        new = set().union(*split).difference(known)
        if new:
            known.update(self._encode(list(new)))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out

    def check(self, texts: list[str]) -> bool:
        whole = [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return whole == self.encode(texts)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """This process's encoder for a file; its words stay known from task to task."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = Encoder(path, dtype)
    return _ENCODERS[path, dtype]
