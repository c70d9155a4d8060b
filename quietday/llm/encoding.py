"""Token ids of whole texts, each distinct chunk encoded once, all else on flat arrays.

Byte-level BPE with the vocabularies' split pattern never merges across pre-tokens; a run of white space
always starts one, as do marks after a letter or digit. So a text can be cut there, and its ids are those of its
chunks in order. Cuts are found on the bytes of a whole batch, chunks become distinct in Arrow, only
the distinct ones are looked up, and ids are gathered from one flat array.
"""

from __future__ import annotations

import os
from itertools import compress

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks, their characters and ids that a worker remembers; a memo that is full starts anew with the next batch.
MEMO_CHUNKS, MEMO_CHARS, MEMO_IDS = 600_000, 1 << 24, 1 << 23
#: Unknown chunks that are encoded as one text.
GROUP = 2000

# kinds of bytes
_BLANK, _MARK, _WHITE, _LETTER = 1, 2, 4, 8
_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in ((_BLANK, b" \n"), (_MARK, b".,;:!?*#%&$"), (_WHITE, bytes([*range(9, 14), *range(28, 33)])), (_LETTER, bytes(b for b in range(128) if chr(b).isalnum()))):
    _KINDS[np.frombuffer(_bytes, np.uint8)] |= _kind

_encoders: dict[str, "LibraryIds"] = {}


def take_runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after the other."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a pre-token starts: marks after a letter or digit, blanks and line feeds after anything but white space.

    Not all such places, but no others: white space beyond ASCII has two bytes that begin with C2, or three that
    begin with E1, E2 or E3, and letters are told by ASCII and by those that begin with C3.
    """
    kinds = _KINDS[data]
    at = np.nonzero(kinds & (_BLANK | _MARK))[0]
    one, two, three = (np.where(at >= n, data[at - n], 0) for n in (1, 2, 3))
    white = (_KINDS[one] & _WHITE != 0) | (two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & (two >= 0x80))
    letter = (_KINDS[one] & _LETTER != 0) | ((two == 0xC3) & (one != 0x97) & (one != 0xB7))
    return at[np.where(kinds[at] & _MARK, letter, ~white)]


def split_chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts in order, and where each text's chunks begin (with the end of the last)."""
    texts = texts.cast(pa.string())
    edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    values = texts.buffers()[2] if len(texts) else None
    if edges[-1] == edges[0]:
        return pa.array([], pa.string()), np.zeros(len(edges), np.int64)
    data = np.frombuffer(values, np.uint8, edges[-1])[edges[0] :]
    begins = np.zeros(len(data), bool)
    begins[cuts(data)] = True
    begins[(edges[:-1] - edges[0])[np.diff(edges) > 0]] = True
    starts = np.nonzero(begins)[0] + edges[0]
    offsets = np.append(starts, edges[-1]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), values), np.searchsorted(starts, edges)


class ChunkIds:
    """Encodes texts by their chunks; `encode` does the work for chunks that aren't known yet."""

    def __init__(self):
        self.clear()

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, and how many each has."""
        raise NotImplementedError

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.chars = self.used = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, at = len(chunks), len(self.memo)
        if at + n > len(self.sizes):
            self.starts, self.sizes = (np.resize(x, 2 * (at + n)) for x in (self.starts, self.sizes))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[at : at + n], self.sizes[at : at + n] = self.used + offsets_of(sizes)[:-1], sizes
        self.used += len(ids)
        self.chars += sum(map(len, chunks))
        self.memo.update(zip(chunks, range(at, at + n), strict=True))

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls), one after the other, and where each text's begin (with the end of the last)."""
        chunks, first = split_chunks(texts)
        if not len(chunks):
            return np.zeros(0, np.uint32), first
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.memo) > MEMO_CHUNKS or self.chars > MEMO_CHARS or self.used > MEMO_IDS:
            self.clear()
        new = [c for c in distinct if c not in self.memo]
        if new:
            self._add(new, *self.encode(new))
        places = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        sizes = self.sizes[places]
        return take_runs(self.flat, self.starts[places], sizes), offsets_of(sizes)[first]


class LibraryIds(ChunkIds):
    """Ids by the tokenizers library, as its file says; `special_as_text` reads special tokens' strings in texts as ordinary ones."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        vocab = self.tokenizer.get_vocab()
        self.leads = {}
        for lead in " \n":
            sign = self.tokenizer.pre_tokenizer.pre_tokenize_str(f"{lead}a")[0][0][0]
            self.leads[lead] = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.leads[lead][[i for t, i in vocab.items() if t.startswith(sign)]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of a blank or line feed and no other white space are encoded together: a token with that sign starts each."""
        out: list[np.ndarray] = []
        where: list[np.ndarray] = []
        rest = np.ones(len(chunks), bool)
        sizes = np.zeros(len(chunks), np.int64)
        for lead, starts in self.leads.items():
            own = np.array([i for i, c in enumerate(chunks) if c[:1] == lead and len(c) > 1 and c[1:].split() == [c[1:]]], np.int64)
            groups = [own[a : a + GROUP] for a in range(0, len(own), GROUP)]
            for group, ids in zip(groups, self._ids(["".join([chunks[i] for i in g]) for g in groups]), strict=True):
                at = np.nonzero(starts[ids])[0]
                if len(at) != len(group) or at[0]:
                    continue  # one by one, below
                sizes[group] = np.diff(np.append(at, len(ids)))
                rest[group] = False
                out.append(ids)
                where.append(group)
        left = np.nonzero(rest)[0]
        single = self._ids(list(compress(chunks, rest)))
        sizes[left] = [len(x) for x in single]
        out += single
        where.append(left)
        order = np.concatenate(where)
        starts = np.empty(len(chunks), np.int64)
        starts[order] = offsets_of(sizes[order])[:-1]
        return take_runs(np.concatenate(out) if out else np.zeros(0, np.uint32), starts, sizes), sizes


def library(path: str, special_as_text: bool = False) -> LibraryIds:
    """One encoder for each vocabulary file and worker process."""
    key = f"{path}\n{special_as_text}"
    if key not in _encoders:
        _encoders[key] = LibraryIds(path, special_as_text)
    return _encoders[key]
