"""Exact token ids and counts for batches of texts, word by word.

Where a vocabulary has no token across a blank, a text's tokens are those of its words. In
a batch, Arrow splits the texts and lists the distinct words; the library encodes each new word
once, and a worker keeps what it has learnt in a table of bounded size. Words for which this
isn't plain - characters outside a safe range, runs of blanks, special strings - go to
the library as they are.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most words that a worker remembers, and bytes of text that are split at once.
REMEMBERED, AT_ONCE = 120_000, 6_000_000


def slices(batch: pa.RecordBatch, column: str = "text", at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """batch in slices of about at_once bytes of text; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + at_once, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
    # Workers live on through stages whose memory is another's: what Arrow keeps for later goes back.
    pa.default_memory_pool().release_unused()


def filled(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column), "")


class WordIds:
    """Token ids of a JSON tokenizer: word by word if it is a BPE vocabulary whose words are lower-cased and end-marked, else text by text."""

    # How such a tokenizer normalises and splits, and its splitting pattern on the safe range of characters.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
    BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    SAFE = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        told = json.loads(Path(path).read_text("utf-8"))
        splits = {"type": "Sequence", "pretokenizers": [self.SPLIT, self.BYTES]}
        specials = [t["content"] for t in told["added_tokens"]]
        self.by_word = told["normalizer"] == self.NORMALIZER and told["pre_tokenizer"] == splits and told["model"]["type"] == "BPE" and all(x.startswith("<|") for x in specials)
        self.model = self.full.model
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # Byte-level vocabularies write bytes as printable characters: those that aren't printable
        # Latin-1 follow from U+0100 on, in order.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printable]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.shown = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.shown))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if not self.SAFE.fullmatch(word) or "<|" in word:
            ids = self.full.encode(word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        out, known = [], self.pieces
        for piece in self.PIECES.findall(word.lower()):
            got = known.get(piece)
            if got is None:
                got = known[piece] = self._piece(piece)
            out.append(got)
        return out[0] if len(out) == 1 else b"".join(out)

    def __call__(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The ids of all texts as little-endian unsigned 32-bit numbers, and where each text's begin and end, in bytes."""
        if not self.by_word:
            whole = [e.ids for at in range(0, len(texts), 256) for e in self.full.encode_batch(texts.slice(at, 256).to_pylist(), add_special_tokens=False)]
            return memoryview(np.fromiter((i for ids in whole for i in ids), "<u4").tobytes()), np.cumsum([0, *(4 * len(ids) for ids in whole)])
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        flat = parts.flatten().dictionary_encode()
        listed = flat.dictionary.to_pylist()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        known, word = self.words, self._word
        for w in listed:
            if w not in known:
                known[w] = word(w)
        ids = pa.array([known[w] for w in listed], pa.large_binary()).take(flat.indices)
        offsets = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        bounds = offsets[parts.offsets.to_numpy()]
        data = ids.buffers()[2]
        return memoryview(data) if data is not None else memoryview(b""), bounds


class PieceCounts:
    """Token counts of a sentencepiece model whose pieces have the blank mark in front only."""

    MARK = "▁"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.plain = not any("\n" in p or self.MARK in p.lstrip(self.MARK) for p in pieces)
        self.words: dict[str, int] = {}

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            for w, ids in zip(some, self.model.encode(some, num_threads=1), strict=True):
                # A word after a line feed has no mark of its own.
                self.words[w] = len(ids) - w.startswith("\n")

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        marked = pc.replace_substring(texts, "\n", " \n")
        hard = pc.or_(pc.match_substring(marked, "  "), pc.match_substring(marked, self.MARK))
        hard = pc.or_(hard, pc.or_(pc.starts_with(marked, " "), pc.ends_with(marked, " "))).to_numpy(zero_copy_only=False)
        if not self.plain:
            hard[:] = True
        some = np.flatnonzero(hard)
        for at in range(0, len(some), 256):
            ids = self.model.encode(texts.take(pa.array(some[at : at + 256])).to_pylist(), num_threads=1)
            out[some[at : at + 256]] = [len(x) for x in ids]
        easy = np.flatnonzero(~hard)
        if len(easy):
            parts = pc.split_pattern(marked.take(pa.array(easy)), " ")
            flat = parts.flatten().dictionary_encode()
            listed = flat.dictionary.to_pylist()
            if len(self.words) > REMEMBERED:
                self.words.clear()
            self._learn([w for w in listed if w not in self.words])
            counts = np.fromiter((self.words[w] for w in listed), np.int64, len(listed))[flat.indices.to_numpy()]
            out[easy] = np.add.reduceat(counts, parts.offsets.to_numpy()[:-1])
        return out


_made: dict[tuple[type, str], object] = {}


def of_worker(kind: type, path: str):
    """One encoder for each worker process and file."""
    key = (kind, path)
    if key not in _made:
        _made[key] = kind(path)
    return _made[key]
