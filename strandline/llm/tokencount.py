"""Operator 8: token counts with overlap resynchronisation for huge documents.

Every text of up to ``chunk`` code points is encoded at once. The UTF-8 of a longer text is cut into chunks that overlap. Each
chunk is encoded with offsets, and two neighbours are spliced at a position in their overlap that

* is a token boundary in both encodings, and
* is proven stable: no piece of the vocabulary holds the two characters around it one after the other, so no merge
  can ever cross the position, whatever stands left or right of it.

The proof needs only the vocabulary: a merge that crosses the position would make a piece with that pair of characters
inside. A text's encoding therefore is the concatenation of the encodings on both sides. Where an overlap has no such
position the overlap is doubled, up to the whole rest of the text, so every count is exact.

Null text counts as empty: 0 bytes and 0 tokens. Ties don't arise. Rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

import functools
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_batches

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class ChunkedEncoder:
    """Exact token counts of texts of any length, in memory bounded by the chunk where the text has stable positions."""

    def __init__(self, model_path: str, chunk: int, overlap: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()) if not self.sp.is_byte(i) and not self.sp.is_control(i)]
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # The proof is about merges, so it needs an encoder that leaves the characters as they are.
        sample = "a  b\tcﬁ"
        self.plain = self.sp.decode(self.sp.encode(sample)) == sample

    def count(self, text: str) -> int:
        if len(text) <= self.chunk or not self.plain:
            return len(self.sp.encode(text))
        return self._spliced(text.encode())

    def count_all(self, texts: list[str]) -> list[int]:
        short = [len(t) <= self.chunk for t in texts]
        counts = iter(self.sp.encode([t for t, s in zip(texts, short) if s], num_threads=1))
        return [len(next(counts)) if s else self.count(t) for t, s in zip(texts, short)]

    def stable(self, data: bytes, at: int) -> bool:
        """At a space that follows another character; the model's own leading space then replaces it in a new chunk."""
        if data[at] != 0x20 or data[at - 1] == 0x20:
            return False
        before = data[max(0, at - 4) : at].decode(errors="ignore")[-1:]
        return before + SPACE not in self.inside

    def _boundaries(self, data: bytes, start: int, stop: int) -> list[int]:
        """Where tokens begin in data[start:stop], as positions of data; start is 0 or the place of a space."""
        lead = 1 if start else 0  # the encoder puts this space in front itself
        text = data[start + lead : stop].decode(errors="ignore")  # a character cut at the end isn't spliced at
        out = []
        for p in self.sp.encode(text, return_type="proto").pieces:
            # the token that begins with the space in front begins at the chunk's own start
            out.append(start + lead + p.begin if out else start)
        return out

    def _spliced(self, data: bytes) -> int:
        total, start, n = 0, 0, len(data)
        stop = min(n, self.chunk)
        left = self._boundaries(data, start, stop)
        while stop < n:
            overlap = min(self.overlap, stop - start - 1)
            cut, right, end = None, [], stop
            while cut is None:
                begin = next((i for i in range(max(start + 1, stop - overlap), stop) if self.stable(data, i)), None)
                if begin is not None:
                    end = min(n, stop + self.chunk)
                    right = self._boundaries(data, begin, end)
                    cut = next((i for i in sorted(set(left).intersection(right)) if self.stable(data, i)), None)
                if cut is None and overlap >= stop - start - 1:
                    break
                overlap = min(2 * overlap, stop - start - 1)
            if cut is None:  # nowhere to splice in the whole chunk: make it longer
                stop = min(n, stop + max(self.chunk, stop - start))
                left = self._boundaries(data, start, stop)
                continue
            total += sum(b < cut for b in left)
            left = [b for b in right if b >= cut]
            start, stop = cut, end
        return total + len(left)


class UnitEncoder:
    """Token ids of whole texts, unit by unit: a run of spaces with what stands up to the next one.

    A unit's tokens depend on nothing around it where no piece of the vocabulary goes on from another character to a
    space, by the proof above. So each distinct word of a batch is encoded once, and the words that came before not
    again, up to ``MOST_WORDS`` and ``MOST_CHARS`` of them in a task; the first ``KEPT_WORDS``, which hold the frequent
    ones, stay for the next task. Other models encode each text at once.
    """

    MOST_WORDS, MOST_CHARS, KEPT_WORDS = 400_000, 1 << 23, 150_000
    #: Words that are encoded as one text: more cost more each, as the encoder sorts all their pairs together.
    TOGETHER = 16
    PART = 1 << 20

    def __init__(self, model_path: str):
        self.sp = (chunked := encoder(model_path, 1 << 30, 1)).sp
        self.safe = chunked.plain and not any(p[0] != SPACE and p[1] == SPACE for p in chunked.inside)
        self.end = self.sp.eos_id()
        self.lead = len(self.sp.encode("a"))
        self.begins = np.array([self.sp.id_to_piece(i).startswith(SPACE) for i in range(self.sp.vocab_size())])
        self.kind = np.uint16 if self.sp.vocab_size() <= 1 << 16 else np.int32
        self.forget()

    def forget(self) -> None:
        self.number = pa.array([], pa.string())  # each word stands at its number
        self.tokens, self.starts = np.empty(0, self.kind), np.zeros(1, np.int64)

    def end_task(self) -> None:
        if len(self.number) > self.KEPT_WORDS:
            self.number = self.number.take(pa.array(np.arange(self.KEPT_WORDS)))
            self.starts = self.starts[: self.KEPT_WORDS + 1].copy()
            self.tokens = self.tokens[: self.starts[-1]].copy()

    def ids(self, text: str) -> np.ndarray:
        """Of one text, with any spaces in it."""
        if not self.safe or not text:
            return np.array(self.sp.encode(text), self.kind)
        text = " " + text
        out, at = [], 0
        while at < len(text):
            # parts end before a space that follows another character
            m = _NEXT.search(text, at + self.PART)
            stop = m.start() + 1 if m else len(text)
            out += [np.array(x[self.lead :], self.kind) for x in self.sp.encode(["a" + u for u in _UNIT.findall(text, at, stop)], num_threads=1)]
            at = stop
        return np.concatenate(out)

    def all_ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Of a column of texts; null gives none."""
        texts = pc.fill_null(texts, "")
        # words with one space between them are split by the column's own functions
        plain = pc.invert(pc.match_substring_regex(texts, f"^$|^ | $|  |{SPACE}")).to_numpy(zero_copy_only=False) & self.safe
        out: list[np.ndarray] = [None] * len(texts)
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self.ids(texts[i].as_py())
        if plain.any():
            split = pc.split_pattern(texts.filter(pa.array(plain)), " ")
            word = self._numbers(split.flatten())
            size = self.tokens.itemsize
            known = pa.Array.from_buffers(pa.large_binary(), len(self.number), [None, pa.py_buffer(self.starts * size), pa.py_buffer(self.tokens)])
            _, ends, tokens = known.take(word).buffers()
            ends, tokens = np.frombuffer(ends, np.int64, len(word) + 1) // size, np.frombuffer(tokens, self.kind)
            cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
            for k, i in enumerate(np.flatnonzero(plain).tolist()):
                out[i] = tokens[cuts[k] : cuts[k + 1]]
        return out

    def _numbers(self, words: pa.Array) -> pa.Array:
        """The number of each word. One dictionary over the words that came before and these: those keep their numbers."""
        chars = lambda: pc.sum(pc.binary_length(self.number)).as_py() or 0
        if len(self.number) > self.MOST_WORDS or chars() > self.MOST_CHARS:
            self.end_task()
            if chars() > self.MOST_CHARS:
                self.forget()
        before = len(self.number)
        numbered = pa.chunked_array([self.number, words]).dictionary_encode().chunks[-1]
        self.number = numbered.dictionary
        if new := len(self.number) - before:
            # several words at a time, as one text: of each word the first token alone begins with the mark of its space
            at = np.append(np.arange(0, new, self.TOGETHER), new)
            together = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), self.number[before:]), " ")
            got = self.sp.encode(together.to_pylist(), num_threads=1)
            flat = np.fromiter(chain.from_iterable(got), self.kind, sum(map(len, got)))
            begins = np.flatnonzero(self.begins[flat])
            self.starts = np.concatenate([self.starts, len(self.tokens) + np.append(begins[1:], len(flat))])
            self.tokens = np.concatenate([self.tokens, flat])
        return numbered.indices


# the mark that stands for a space counts as one
_UNIT = re.compile("[ ▁]+[^ ▁]*")
_NEXT = re.compile("[^ ▁][ ▁]")


@functools.lru_cache(maxsize=2)
def unit_encoder(model_path: str) -> UnitEncoder:
    return UnitEncoder(model_path)


@functools.lru_cache(maxsize=2)
def encoder(model_path: str, chunk: int, overlap: int) -> ChunkedEncoder:
    return ChunkedEncoder(model_path, chunk, overlap)


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = 4096, chunk: int = 32_768, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text)."""
    path = model_path or default_model_path()

    def count(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        n = encoder(path, chunk, overlap).count_all(texts)
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), count, SCHEMA, ARROW)
