"""Exact token ids of public vocabularies, faster than encoding every text anew.

Both encoders cut texts where no merge can reach across and look the words of many texts
up at once, by 64-bit hashes, in a table of flat arrays. The table starts with the words that
the vocabulary encodes alone as one token, proved by asking for each; only words that are
not in it are merged, all unknown words of a group in one call, and kept while the table's
bytes allow. The table belongs to the Python worker, and its size does not grow with the
input. Two different short words share a hash with a probability of 2^-64.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from keelson.llm.shingles import hash_words

#: Bytes of a worker's table of words; a full one begins anew with the whole-token words.
CACHE_BYTES = 32 << 20
#: Longer words are not kept.
LONG_WORD = 160
#: Bytes of text that are looked up at a time, less than are hashed at a time.
GROUP = 1 << 17

# fixed values: the shape of the word vocabulary's file for which parts between white space are independent
_WORD_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Characters for which NFC does nothing and lower case is one character each.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD_END = "</w>"


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable character: printable Latin-1 as itself, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def word_ranks(vocab: dict[str, int], special: set[int]) -> dict[bytes, int]:
    """Vocabulary as bytes -> id; the end of a word is written as the byte FF, which UTF-8 never holds."""
    back = {c: b for b, c in byte_letters().items()}
    ranks = {}
    for token, number in vocab.items():
        if number not in special:
            end = token.endswith(_WORD_END)
            body = token[: -len(_WORD_END)] if end else token
            ranks[bytes(back[c] for c in body) + b"\xff" * end] = number
    return ranks


class WordTable:
    """Ids of words by hash: open addressing in flat arrays."""

    def __init__(self, dtype: np.dtype) -> None:
        self.ids = np.zeros(1 << 16, dtype)
        self.used = self.words = 0
        self._slots(1 << 15)

    def _slots(self, n: int) -> None:
        self.keys, self.at, self.n = np.zeros(n, np.uint64), np.zeros(n, np.uint32), np.zeros(n, np.uint16)

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.at.nbytes + self.n.nbytes + self.ids.nbytes

    def grown(self, words: int) -> int:
        """Bytes of the table with so many more words."""
        size = len(self.keys)
        while 2 * (self.words + words) > size:
            size *= 2
        return 14 * size + self.ids.nbytes

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where there is none."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (keys & mask).astype(np.int64)
        there = self.keys[slot]
        found = np.where(there == keys, slot, -1)
        rest = np.flatnonzero((there != keys) & (there != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & int(mask)
            there = self.keys[slot[rest]]
            hit = there == keys[rest]
            found[rest[hit]] = slot[rest[hit]]
            rest = rest[~hit & (there != 0)]
        return found

    def append(self, ids: np.ndarray) -> int:
        """Put ids behind the others; where they begin."""
        begin, end = self.used, self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), self.ids.dtype)))
        self.ids[begin:end] = ids
        self.used = end
        return begin

    def add(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Distinct keys that are not in the table, with place and number of their ids."""
        size = len(self.keys)
        while 2 * (self.words + len(keys)) > size:
            size *= 2
        if size > len(self.keys):
            held = np.flatnonzero(self.keys)
            old = self.keys[held], self.at[held], self.n[held]
            self._slots(size)
            self._place(*old)
        self._place(keys, at, n)
        self.words += len(keys)

    def _place(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.at[slot[won]], self.n[slot[won]] = keys[won], at[won], n[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & mask


class Coder:
    """Ids of many texts through a table of words; subclasses know the vocabulary.

    ``blank`` marks the bytes between words, ``joint`` is one of them.
    """

    dtype: np.dtype
    blank: np.ndarray
    joint: bytes

    def separable(self, text: bytes) -> bool:
        """Whether the words of the text can be encoded one by one."""
        raise NotImplementedError

    def code(self, words: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def library_ids(self, text: str) -> list[int]:
        raise NotImplementedError

    def _seed(self, words: list[bytes]) -> None:
        """Start the table with those of ``words`` that are encoded alone as one token."""
        coded = self.code(words)
        whole = [(w, c) for w, c in zip(words, coded) if len(c) == 1 and len(w) <= LONG_WORD]
        self.whole = {w: np.array(c, self.dtype).tobytes() for w, c in whole}
        self.table = WordTable(self.dtype)
        for at in range(0, len(whole), 10_000):
            part = whole[at : at + 10_000]
            keys, _, _ = hash_words(np.frombuffer(self.joint.join(w for w, _ in part), np.uint8), self.blank)
            begin = self.table.append(np.array([c[0] for _, c in part], self.dtype))
            self.table.add(keys, np.arange(begin, begin + len(part)), np.ones(len(part), np.uint16))
        self._first = self.table.keys.copy(), self.table.at.copy(), self.table.n.copy(), self.table.ids[: self.table.used].copy(), self.table.words

    def _begin(self) -> None:
        """The table as it was at first."""
        keys, at, n, ids, words = self._first
        self.table = WordTable(self.dtype)
        self.table.keys, self.table.at, self.table.n = keys.copy(), at.copy(), n.copy()
        self.table.append(ids)
        self.table.words = words

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that together are not much longer than GROUP."""
        buffer = self.joint.join(texts)
        keys, starts, ends = hash_words(np.frombuffer(buffer, np.uint8), self.blank)
        table, slot = self.table, self.table.find(keys)
        unknown = np.flatnonzero(slot < 0)
        at, n = table.at[slot].astype(np.int64), table.n[slot].astype(np.int64)
        fresh = ()
        if len(unknown):
            new, first, which = np.unique(keys[unknown], return_index=True, return_inverse=True)
            first = unknown[first]
            coded = self.code([buffer[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            begin = table.append(np.fromiter(chain.from_iterable(coded), self.dtype, int(sizes.sum())))
            places = begin + np.cumsum(sizes) - sizes
            at[unknown], n[unknown] = places[which], sizes[which]
            short = (ends[first] - starts[first]) <= LONG_WORD
            fresh = new[short], places[short], sizes[short]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = table.ids[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
        if len(fresh):
            if table.grown(len(fresh[0])) > CACHE_BYTES:
                self._begin()
            else:
                table.add(*fresh)
        cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])[:-1])
        return np.split(ids, total[cuts])

    def _long(self, text: bytes) -> np.ndarray:
        """A text longer than GROUP, cut between words; by the library if a word is that long."""
        found, at = [], 0
        while at < len(text):
            end = at + GROUP
            if end < len(text):
                end = max(text.rfind(bytes([b]), at, end) for b in np.flatnonzero(self.blank))
                if end <= at:
                    return np.array(self.library_ids(text.decode("utf-8", "replace")), self.dtype)
            found += self._group([text[at:end]])
            at = end + 1
        return np.concatenate(found)

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them."""
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        group: list[int] = []
        held = 0

        def close() -> None:
            if group:
                for k, ids in zip(group, self._group([texts[k] for k in group])):
                    out[k] = ids

        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.separable(text):
                out[k] = np.array(self.library_ids(text.decode("utf-8", "replace")), self.dtype)
            elif len(text) > GROUP:
                out[k] = self._long(text)
            else:
                if held + len(text) > GROUP:
                    close()
                    group, held = [], 0
                group.append(k)
                held += len(text) + 1
        close()
        return out

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0].tobytes()


class WordVocab(Coder):
    """Ids of a word-end BPE vocabulary (a ``tokenizers`` file), without added special tokens.

    The file drops white space and lower-cases character by character, so text between
    ASCII white space is encoded on its own. Plain words are merged by rank with
    ``tiktoken``; a merge by the joined string equals a merge by pair because every
    vocabulary string, alone, merges to itself (proved for all of them in the tests).
    Everything else goes through the library. Ids take 16 or 32 bits (``dtype``).
    """

    joint = b"\n"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 65536 else "<u4")
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        cuts = (shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_part = (
            (shape.get("normalizer") or {}).get("normalizers") == _WORD_NORMALIZERS
            and cuts[0].get("pattern") == {"Regex": _WORD_SPLIT}
            and shape.get("post_processor") is None
            and shape["model"].get("end_of_word_suffix") == _WORD_END
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in shape["added_tokens"])
        )
        self._special = re.compile("|".join(re.escape(x["content"]) for x in shape["added_tokens"]) or "(?!)")
        alone: list[bytes] = []
        if self.by_part:
            ranks = word_ranks(vocab, {x["id"] for x in shape["added_tokens"]})
            self._merge = tiktoken.Encoding("word", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
            self._signs: dict[str, list[int]] = {}
            alone = [t[:-1] for t in ranks if t[-1:] == b"\xff" and t[:-1].isalnum()]
        self._seed(alone)

    def separable(self, text: bytes) -> bool:
        return self.by_part

    def library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def code(self, words: list[bytes]) -> list[list[int]]:
        return list(map(self._code, words))

    def _code(self, word: bytes) -> list[int]:
        if word.isalpha():  # ASCII letters
            return self._merge(word.lower() + b"\xff")
        text = word.decode("utf-8", "replace")
        if len(word) > LONG_WORD or not _PLAIN.fullmatch(text) or ("<" in text and self._special.search(text)):
            return self.library_ids(text)
        text = text.lower()
        body = text.rstrip(_SIGNS)
        if body.isalpha():  # letters, then one run of signs
            ids = self._merge(body.encode() + b"\xff")
            return ids + self._sign_ids(text[len(body) :]) if len(body) < len(text) else ids
        ids = []
        for piece in _PIECES.findall(text):
            ids += self._merge(piece.encode() + b"\xff")
        return ids

    def _sign_ids(self, signs: str) -> list[int]:
        found = self._signs.get(signs)
        if found is None:
            found = self._merge(signs.encode() + b"\xff")
            if len(self._signs) < 10_000:
                self._signs[signs] = found
        return found


class PieceVocab(Coder):
    """Ids of a sentencepiece vocabulary whose pieces hold the space mark only in front.

    Then no merge reaches over a single space, and the words of a text are encoded one
    by one. Texts with runs of spaces, spaces at an end, or the mark itself go through
    the library whole. Ids take 16 bits.
    """

    MARK = "▁"
    joint = b" "

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.by_word = len(pieces) < 65536 and not any(self.MARK in p.lstrip(self.MARK) for p in pieces)
        self.dtype = np.dtype("<u2" if len(pieces) < 65536 else "<u4")
        self.blank = np.zeros(256, bool)
        self.blank[0x20] = True
        self.is_byte = np.array([self.library.is_byte(i) for i in range(len(pieces))])
        #: whole-token shortcut: the words that the library, asked about each, encodes alone as one token
        self._seed([p[1:].encode() for p in pieces if p[:1] == self.MARK and self.MARK not in p[1:] and " " not in p and len(p) > 1])

    def separable(self, text: bytes) -> bool:
        return self.by_word and not (b"  " in text or text[:1] == b" " or text[-1:] == b" " or b"\xe2\x96\x81" in text)

    def library_ids(self, text: str) -> list[int]:
        return self.library.encode(text)

    def code(self, words: list[bytes]) -> list[list[int]]:
        return self.library.encode([w.decode("utf-8", "replace") for w in words], num_threads=1) if words else []


_kept: dict[tuple[type, str], Coder] = {}


def _only(kind: type, path: str) -> Coder:
    """The worker's vocabulary; another one, asked for by a later stage, takes its place and frees its table."""
    if (kind, path) not in _kept:
        _kept.clear()
        _kept[kind, path] = kind(path)
    return _kept[kind, path]


def word_vocab(path: str) -> WordVocab:
    return _only(WordVocab, path)


def piece_vocab(path: str) -> PieceVocab:
    return _only(PieceVocab, path)


def release() -> None:
    """Free the worker's vocabulary; called where a stage that uses none starts."""
    _kept.clear()
