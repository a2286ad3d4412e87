"""Token ids of whole texts, with a bounded cache of the pieces between single spaces."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
END = 0
CACHE_PIECES = 1_500_000
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def wide(ids: bytes | memoryview, size: int) -> bytes:
    """Ids of ``size`` bytes as little-endian unsigned 32-bit bytes."""
    return bytes(ids) if size == 4 else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()


class Encoder:
    """Ids of whole texts as bytes, equal to encoding each text with the library.

    An id takes ``size`` bytes, 2 if the vocabulary fits, else 4 (unsigned, little-endian).

    The tokenizer's pattern starts a new unit at a single space between two other characters, so the ids of a text are
    the ids of its pieces, each with its leading space. Pieces are encoded once and kept; a text whose pieces are empty
    or begin or end with white space (runs of spaces) is encoded whole. Letters followed by ASCII punctuation are two
    units as well and are looked up apart. The cache is emptied when it holds ``CACHE_PIECES`` pieces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.size == 2 else "I"
        self.pieces: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {"": b""}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this Python worker; it lives on between tasks."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in got]

    def _learn(self, missing: set[str]) -> None:
        pieces = self.pieces
        whole, cores, new = [], [], set()
        for piece in missing:
            if len(piece.strip()) < len(piece) or not piece:
                pieces[piece] = None
                continue
            core = piece.rstrip(_PUNCTUATION)
            if len(core) < len(piece) and core and core[-1].isalpha() and "<|" not in piece:
                whole.append(piece)
                cores.append(core)
                if core not in pieces:
                    new.add(core)
            else:
                new.add(piece)
        new = list(new)
        pieces.update(zip(new, self._encode([" " + p for p in new])))
        tails = list({piece[len(core):] for piece, core in zip(whole, cores)}.difference(self.tails))
        self.tails.update(zip(tails, self._encode(tails)))
        for piece, core in zip(whole, cores):
            pieces[piece] = pieces[core] + self.tails[piece[len(core):]]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        split = [text.split(" ") for text in texts]
        missing = set()
        for pieces in split:
            missing.update(pieces[1:])
        self._learn(missing.difference(self.pieces))
        heads = self._encode([pieces[0] for pieces in split])
        known = self.pieces.__getitem__
        out, whole = [], []
        for i, pieces in enumerate(split):
            head = pieces[0]
            try:
                if len(pieces) > 1 and (not head or head[-1].isspace()):
                    raise TypeError
                out.append(heads[i] + b"".join(map(known, pieces[1:])))
            except TypeError:
                out.append(b"")
                whole.append(i)
        for i, ids in zip(whole, self._encode([texts[i] for i in whole])):
            out[i] = ids
        return out


def encoded(batches: Iterator, path: str, rows: int = 256) -> Iterator[tuple[list, list[bytes], int]]:
    """(doc ids, ids of each text with the end id, bytes per id) for a few rows at a time of batches of (doc_id, text)."""
    encoder = Encoder.of(path)
    end = array(encoder.code, [END]).tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            texts = [t or "" for t in part.column(1).to_pylist()]
            yield part.column(0).to_pylist(), [ids + end for ids in encoder.encode(texts)], encoder.size
