"""Token ids of texts by a public tokenizer file, with a memory of words.

White space always separates pieces of the split rule, so texts within Latin-1 are split at white space here
and each distinct word is encoded by the tokenizers library once; everything else goes to
the library as a whole. Both ways give the library's ids for the whole text.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The split rule and white space of word_bpe_49k.json, within Latin-1 and in lower case.
_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \u0085 "
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{_SPACES}]+")
#: Characters that str.split takes as white space and the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
CACHED_WORDS = 1_000_000
#: Unknown words that the tokenizer gets as one text; its work on a text grows a little faster than the text.
JOINED_WORDS = 50
END = 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Memory(dict):
    """Numbers of words; an unknown word gets the next number and is put down as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Ids of batches of texts; the word memory is bounded and lives with the Python worker."""

    def __init__(self, path: str, split_here: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split_here = os.path.basename(path) == "word_bpe_49k.json" if split_here is None else split_here
        self.closing = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # ids that end a piece
        self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.number = _Memory()
        self.flat, self.begins, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.held = 0

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        texts = [" ".join(words[at : at + JOINED_WORDS]) for at in range(0, len(words), JOINED_WORDS)]
        ids = np.array(list(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))), np.int32)
        ends = np.flatnonzero(self.closing[ids])
        last = np.cumsum([1 if w.isalpha() else len(_PIECES.findall(w)) for w in words])
        if len(ends) != last[-1]:
            found = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            return np.array(list(chain.from_iterable(found)), np.int32), np.fromiter(map(len, found), np.int64, len(found))
        return ids, np.diff(ends[last - 1], prepend=-1)

    def _learn(self) -> None:
        words, self.number.new = self.number.new, []
        for at in range(0, len(words), 1000):
            ids, sizes = self._encoded(words[at : at + 1000])
            first = len(self.number) - len(words) + at
            while first + len(sizes) > len(self.begins):
                self.begins, self.sizes = np.concatenate([self.begins, self.begins]), np.concatenate([self.sizes, self.sizes])
            while self.held + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, self.flat])
            self.flat[self.held : self.held + len(ids)] = ids
            self.begins[first : first + len(sizes)] = self.held + np.cumsum(sizes) - sizes
            self.sizes[first : first + len(sizes)] = sizes
            self.held += len(ids)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """int32 ids of each text; a null text has none."""
        out: list[np.ndarray | None] = [None] * len(texts)
        here, lowered, whole = [], [], []
        for at, text in enumerate(texts):
            if not text:
                out[at] = np.zeros(0, np.int32)
            elif self.split_here and "<|" not in text and (text.isascii() or _latin(text)) and not _NOT_SPACE.search(text):
                here.append(at)
                lowered.append(text.lower())
            else:
                whole.append(at)
        for at, found in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False) if whole else (), strict=True):
            out[at] = np.array(found.ids, np.int32)
        if here:
            if len(self.number) > CACHED_WORDS:
                self._clear()
            lists = pc.utf8_split_whitespace(pa.array(lowered, pa.large_string()))
            counts, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
            codes, blank = flat.indices.to_numpy(), pc.index(flat.dictionary, "").as_py()
            if blank >= 0:  # beside white space at either end of a text
                real = codes != blank
                counts, codes = np.bincount(np.repeat(np.arange(len(counts)), counts)[real], minlength=len(counts)), codes[real]
            # each distinct word of the texts is looked up once; the blank has no place among them
            distinct = np.array([self.number[w] if w else -1 for w in flat.dictionary.to_numpy(zero_copy_only=False)], np.int64)
            self._learn()
            held = np.where(distinct < 0, 0, self.sizes[distinct])
            # the ids of these words alone are a small table, and so are their places there
            table, begins = _gathered(self.flat, self.begins[distinct], held), np.cumsum(held) - held
            sizes = held.take(codes)
            ends = np.cumsum(sizes)
            ids = _gathered(table, begins.take(codes), sizes)
            last = np.concatenate([[0], ends])[np.cumsum(counts)]
            begin = 0
            for at, end in zip(here, last.tolist(), strict=True):
                out[at] = ids[begin:end]
                begin = end
        return out

    def closed(self, texts: list[str | None], end: int = END) -> list[np.ndarray]:
        """Ids of each text with the end id behind them."""
        return [np.append(ids, np.int32(end)) for ids in self(texts)]


def _gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of `flat` from `begins`, of the given sizes, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((begins - ends + sizes).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat.take(at)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
