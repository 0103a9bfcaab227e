"""Byte-level BPE encoding with the tokenizers library, fast enough for whole corpora.

The library's pre-tokenizer breaks before a lone space and on both sides of a lone newline. Encoding the words
between such breaks apart gives the same ids as encoding the whole text, and natural text repeats its words. So
a batch of texts is split into words as an Arrow array, only its different words are looked up, those that the worker
has not met yet go to the library as one text, and the ids of all words are put together by one gather. A text
with any other white space, or with two white-space characters in a row, goes to the library whole.

Strings of special tokens in a text are ordinary text, as the vocabulary's own description prescribes.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that the library gets whole.
_ODD_SPACE = r"[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| $"
#: Words that a worker remembers (some 150 bytes each) and ids that it keeps for them; beyond that the less used half goes.
MEMORY_WORDS = 400_000
MEMORY_IDS = 4_000_000
#: Bytes of text whose words are looked up at once, if they are several texts.
BLOCK_BYTES = 2 << 20
END_ID = 0
_ENDINGS = (".", ",", ";", ":", "!", "?")


def _byte_letters() -> list[str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the runs start, start + 1, ... of the given sizes, one run after the other."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - ends + sizes, sizes)
    at += np.arange(len(at))
    return at


_encoders: dict[str, Encoder] = {}


class Encoder:
    """A word is remembered with what comes before it: "\\nword" at the start of a line, "word" after a space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that start with a space or a newline
        self.begins[[i for token, i in vocabulary.items() if token[0] in (letters[0x20], letters[0x0A])]] = True
        self._empty()
        newline = self.library("\n")
        self._remember(["\n"], newline, np.array([len(newline)]))

    def library(self, text: str) -> np.ndarray:
        """The ids of a text as the library gives them."""
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _remember(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.slots)
        self.slots.update(zip(words, range(n, n + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), dtype=np.int32)])

    def _forget(self, keep: int) -> None:
        """Keep the words that most batches had, and the newline."""
        self.uses[0] = np.iinfo(np.int32).max
        kept = np.sort(np.argpartition(-self.uses, keep)[:keep])
        words, uses = list(self.slots), self.uses[kept] // 2
        starts, sizes = self.ends[kept], np.diff(self.ends)[kept]
        ids = self.ids[_gather(starts, sizes)]
        self._empty()
        self._remember([words[k] for k in kept], ids, sizes)
        self.uses = uses

    def _empty(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.ends, self.uses = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _learn(self, new: set[str]) -> None:
        # ASCII letters and an ending are two pieces for the pre-tokenizer
        ended = [w for w in new if w[-1] in _ENDINGS and w[:-1].isalpha() and w.isascii()]
        new.difference_update(ended)
        new.update(w for w in {w[:-1] for w in ended} if w not in self.slots)
        words = list(new)
        if words:
            ids = self.library("".join([w if w[0] == "\n" else " " + w for w in words]))
            self._remember(words, ids, np.diff(np.flatnonzero(self.begins[ids]), append=len(ids)))
        if ended:
            marks = {c: self.library(c) for c in _ENDINGS}
            tails = [marks[w[-1]] for w in ended]
            stems = np.array([self.slots[w[:-1]] for w in ended])
            sizes, more = self.ends[stems + 1] - self.ends[stems], np.array([len(t) for t in tails])
            begin = np.cumsum(sizes + more) - sizes - more
            ids = np.zeros(int((sizes + more).sum()), dtype="<u4")
            ids[_gather(begin, sizes)] = self.ids[_gather(self.ends[stems], sizes)]
            ids[_gather(begin + sizes, more)] = np.concatenate(tails)
            self._remember(ended, ids, sizes + more)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (unsigned 32-bit) of all texts, one after the other, and where each text's ids end. Null: no ids."""
        if len(texts) > 1 and texts.nbytes > BLOCK_BYTES:
            half = len(texts) // 2
            (a, a_ends), (b, b_ends) = self.encode_all(texts.slice(0, half)), self.encode_all(texts.slice(half))
            return np.concatenate([a, b]), np.concatenate([a_ends, b_ends + len(a)])
        if len(self.slots) > MEMORY_WORDS or len(self.ids) > MEMORY_IDS:
            self._forget(MEMORY_WORDS // 2 if len(self.ids) <= MEMORY_IDS else 1)
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        whole = {int(k): self.library(texts[int(k)].as_py()) for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
        if whole:
            texts = pc.if_else(odd, "", texts)
        # "a b\nc" becomes the words "\na", "b", "\nc"; the id of the newline before the first one is left out again
        split = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        last = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        one = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        words = pc.binary_join(one, " ")[0].as_py().split(" ") if len(coded.dictionary) else []
        found = list(map(self.slots.get, words))
        at = [k for k, slot in enumerate(found) if slot is None]
        if at:
            self._learn({words[k] for k in at})
            for k in at:
                found[k] = self.slots[words[k]]
        slots = np.array(found, dtype=np.int64)
        self.uses[slots] += 1
        starts, sizes = self.ends[slots][coded.indices], np.diff(self.ends)[slots][coded.indices]
        starts[last[:-1]] += self.ends[1]
        sizes[last[:-1]] -= self.ends[1]
        ids, ends = self.ids[_gather(starts, sizes)], np.cumsum(np.add.reduceat(sizes, last[:-1])) if len(texts) else last[1:]
        if whole:
            parts = [whole.get(k, part) for k, part in enumerate(np.split(ids, ends[:-1]))]
            ids, ends = np.concatenate(parts), np.cumsum([len(part) for part in parts])
        return ids, ends

    def encode_ended(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Like encode_all, with END_ID after each text."""
        ids, ends = self.encode_all(texts)
        return np.insert(ids, ends, END_ID), ends + np.arange(1, len(ends) + 1)

    def encode(self, text: str) -> bytes:
        """The ids of one whole text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
