"""Token ids by public tokenizer files, encoded word by word through a bounded cache."""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: The characters that the tokenizers' patterns count as white space.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Punctuation that may end a unit; an apostrophe is not among it.
ENDS = ".,!?;:#$%&*|)"
BYTES = 2  # of an id as it is stored; both vocabularies have under 65,536 ids


@contextmanager
def uncollected() -> Iterator[None]:
    """Python's search for cycles stands still: units, ids and rows form none, and it would go through all that are
    held again and again."""
    held = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if held:
            gc.enable()


class WordEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Neither tokenizer merges across a change from other characters to white space (one leading space belongs to the
    word), so a text's ids are those of its units in turn. Units repeat, so the ids of about ``room`` units and unit
    cores are kept; the rest are encoded with their batch. ``room`` bounds memory and changes no result.
    """

    def __init__(self, path: str, spaced: bool, room: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.units = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall
        self.spaced, self.room = spaced, room
        self.kept: dict[str, bytes] = {"": b""}
        # the byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for U+0100 and on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: 0x100 + i for i, b in enumerate(others)}

    def split(self, text: str) -> list[str]:
        if self.spaced:
            return self.units(text)
        # white space is dropped: plain spaces and line feeds part units, and units hold any other white space
        return text.replace("\n", " ").split(" ")

    def core_ids(self, cores: Iterable[str]) -> dict[str, bytes]:
        """Latin-1 letters, after a space or not, are one word in both patterns and need no normal form but lower
        case, so the merges alone are asked for; other cores take the whole tokenizer."""
        tokenize = self.tokenizer.model.tokenize
        fast, slow, ids, ends = [], [], [], [0]
        for w in cores:
            word = w[1:] if self.spaced and w[0] == " " else w
            if word.isascii() and word.isalpha():
                piece = "\u0120" + word if word is not w else word
            elif word.isalpha() and max(word) <= "\u00ff":
                piece = w.encode().decode("latin-1").translate(self.alphabet)
            else:
                slow.append(w)
                continue
            fast.append(w)
            ids += [t.id for t in tokenize(piece)]
            ends.append(BYTES * len(ids))
        raw = np.array(ids, "<u2").tobytes()
        out = {w: raw[a:b] for w, a, b in zip(fast, ends, ends[1:])}
        for w, e in zip(slow, self.tokenizer.encode_batch_fast(slow, add_special_tokens=False)):
            out[w] = array("H", e.ids).tobytes()
        return out

    def missing(self, words: set[str]) -> dict[str, bytes]:
        """Ids of new units. Punctuation after a letter is apart from it in both patterns, so a unit's end is looked up
        apart from its core."""
        kept, lower, wanted, tailed = self.kept, not self.spaced, set(), []
        for w in words:
            core, tail = w, ""
            if w[-1] in ENDS:
                bare = w.rstrip(ENDS)
                if bare and bare[-1].isalpha():
                    core, tail = bare, w[len(bare) :]
            # other letters' lower case is the tokenizer's to find, but for Latin-1 both agree
            if lower and (core.isascii() or core.isalpha() and max(core) <= "\u00ff"):
                core = core.lower()
            wanted.add(core)
            if core != w:
                wanted.add(tail)
                tailed.append((w, core, tail))
        out = {x: kept[x] for x in wanted if x in kept}
        new = self.core_ids(wanted.difference(out))
        out.update(new)
        new.update((w, out[a] + out[b]) for w, a, b in tailed)
        if len(kept) < self.room:
            kept.update(new)
        out.update(new)
        return out

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """The ids of each text and ``end``, as little-endian unsigned 16-bit integers."""
        stop = np.array([end], "<u2").tobytes()
        with uncollected():
            split = [self.split(t) if t else [] for t in texts]
            # the few ids that this batch needs lie closer together in memory than all that are kept
            words, kept = set().union(*split), self.kept
            ids = {w: kept[w] for w in words if w in kept}
            ids.update(self.missing(words.difference(ids)))
            return [b"".join(map(ids.__getitem__, x)) + stop for x in split]


@lru_cache(maxsize=2)
def encoder(name: str, spaced: bool) -> WordEncoder:
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(public_tokenizers.path(name), spaced)


def pieces(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``most`` bytes of text each."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def token_ids(docs: DataFrame, vocabulary: str, end: int, spaced: bool, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` (16-bit little-endian, ``end`` last) and ``n_tokens`` of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, spaced)
        for whole in batches:
            for batch in pieces(whole, 1):
                ids = own.encode(batch.column(1).to_pylist(), end)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // BYTES for x in ids], pa.int64())], names=[key, "ids", "n_tokens"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, ids binary, n_tokens long")


def widen(ids: bytes) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, "<u2").astype("<u4")
