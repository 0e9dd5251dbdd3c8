"""Whole texts through the tokenizers library, cut where no pre-token can cross.

A space or newline right after a printable character always starts a pre-token of the
byte-level pattern, whatever stands around it; so does plain punctuation after a letter or digit,
and a letter or digit after plain punctuation.  The strings of special tokens are chunks of their own, as
the library cuts them out before anything else.  Texts are cut there, equal chunks are
encoded once and kept in a bounded cache, and the ids of a text are those of its chunks in a row:
exactly the ids of the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from homologrid.llm.common import kept_by_worker

BATCH_BYTES = 1 << 20
# Offsets take more room than ids.
CACHE_CHUNKS = 400_000
CACHE_IDS = 1_500_000
# Chunks that go to the library in one string, a special token between them.
JOINED_CHUNKS = 512


def _ascii_kinds() -> np.ndarray:
    """1 for ASCII letters and digits, 2 for ASCII punctuation but for the apostrophe, else 0."""
    kinds = np.zeros(256, np.uint8)
    for code in range(0x21, 0x7F):
        kinds[code] = 1 if chr(code).isalnum() else 2
    kinds[ord("'")] = 0
    return kinds


ASCII_KINDS = _ascii_kinds()


def cut(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Byte offsets of all chunks of texts that begin at ``text_starts``; empty texts have none."""
    blank = (data == 0x20) | (data == 0x0A)
    printable = (data > 0x20) & (data < 0x7F)
    # The second byte of a two-byte letter; white space of that length has a smaller lead.
    second = np.zeros(len(data), bool)
    second[1:] = (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    kind = ASCII_KINDS[data]
    word, mark = kind == 1, kind == 2
    # Letters of two bytes that are surely letters: the signs at 0x97 and 0xB7 are not.
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    start = np.zeros(len(data), bool)
    start[1:] = blank[1:] & (printable | second)[:-1]
    start[1:] |= mark[1:] & (word | latin)[:-1]
    start[1:] |= word[1:] & mark[:-1]
    start[text_starts[text_starts < len(data)]] = True
    return np.flatnonzero(start)


def parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of whole texts of bounded total size; a longer text is a run of its own."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > BATCH_BYTES:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


class ChunkEncoder:
    """Encodes runs of texts; one per worker process and vocabulary file."""

    def __init__(self, path: str, offsets: bool = False):
        # A task has one core: the library's own threads would only wait for one another.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.between = self._separator()
        self.most = CACHE_CHUNKS if offsets else CACHE_IDS
        self.offsets = offsets
        self.cache: dict[bytes, object] = {}

    def _separator(self) -> bytes | None:
        """The only special token, if it cannot overlap itself and takes nothing of what is around it."""
        tokens = [*self.tokenizer.get_added_tokens_decoder().values()]
        if len(tokens) != 1 or tokens[0].lstrip or tokens[0].rstrip or tokens[0].single_word or tokens[0].normalized:
            return None
        text = tokens[0].content
        if any(text.startswith(text[i:]) for i in range(1, len(text))):
            return None
        return text.encode()

    def _encode(self, chunks: list[bytes]) -> list:
        if self.between and not self.offsets:
            return self._encode_joined(chunks)
        texts = [c.decode() for c in chunks]
        if self.offsets:
            # Characters of the chunk, and the span of characters of every token.
            every = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [
                (len(t), np.array(e.offsets, np.int32).reshape(-1, 2)) for t, e in zip(texts, every)
            ]
        every = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, every), np.int64, len(every))) * 4
        flat = np.fromiter(chain.from_iterable(every), np.uint32, int(ends[-1]) // 4).tobytes()
        ends = ends.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _encode_joined(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of many chunks a call: the library cuts a special token out before it looks at what is around it."""
        own = self.tokenizer.token_to_id(self.between.decode())
        plain = chunks
        if self.special.search(b"".join(chunks)):
            plain = [c for c in chunks if not self.special.search(c)]
        rows = [plain[a : a + JOINED_CHUNKS] for a in range(0, len(plain), JOINED_CHUNKS)]
        texts = [(self.between.join(row) + self.between).decode() for row in rows]
        every = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(every), np.uint32, sum(map(len, every)))
        ends = (np.flatnonzero(flat == own) * 4).tolist()
        raw = flat.tobytes()
        found = [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]
        if len(plain) == len(chunks):
            return found
        by_chunk = dict(zip(plain, found))
        for c in chunks:
            if c not in by_chunk:
                ids = self.tokenizer.encode(c.decode(), add_special_tokens=False).ids
                by_chunk[c] = np.array(ids, np.uint32).tobytes()
        return [by_chunk[c] for c in chunks]

    def _around_special(self, joined: bytes, starts: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Starts of chunks with one at both ends of every special token, and none inside."""
        spans = np.array([m.span() for m in self.special.finditer(joined)], np.int64)
        # What begins in one text and ends in the next is no token.
        inside = np.searchsorted(text_starts, spans[:, 0], "right") == np.searchsorted(text_starts, spans[:, 1] - 1, "right")
        first, last = spans[inside].T
        at = np.searchsorted(first, starts, "left") - 1
        outside = (at < 0) | (starts >= last[np.maximum(at, 0)]) if len(first) else np.ones(len(starts), bool)
        return np.unique(np.concatenate((starts[outside], first, last[last < len(joined)])))

    def _starts(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts in a row, where their chunks start, and the number of chunks of every text."""
        joined = b"".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        text_starts = np.cumsum(lengths) - lengths
        if not joined:
            return joined, np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        starts = cut(np.frombuffer(joined, np.uint8), text_starts)
        if self.special and self.special.search(joined):
            starts = self._around_special(joined, starts, text_starts)
        first = np.searchsorted(starts, text_starts)
        return joined, starts, np.append(first[1:], len(starts)) - first

    def chunks(self, texts: list[bytes]) -> tuple[list, np.ndarray]:
        """What each chunk is encoded to, and the number of chunks of every text.

        Ids are the bytes of 32-bit numbers; with offsets, see ``_encode``.
        """
        joined, starts, counts = self._starts(texts)
        if not joined:
            return [], counts
        ends = np.append(starts[1:], len(joined))
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        return self._found(pieces), counts

    def _found(self, pieces: list[bytes]) -> list:
        """What every piece is encoded to, from the cache or the library."""
        found = list(map(self.cache.get, pieces))
        absent = [i for i, f in enumerate(found) if f is None]
        if absent:
            missing = list({pieces[i] for i in absent})
            new = dict(zip(missing, self._encode(missing)))
            for i in absent:
                found[i] = new[pieces[i]]
            if len(self.cache) + len(new) > self.most:
                # Full: only what these texts use is kept.
                self.cache = dict(zip(pieces, found))
            else:
                self.cache.update(new)
        return found

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of every text.

        Equal chunks of these texts are looked up once; their ids are spread over the places by index.
        """
        joined, starts, counts = self._starts(texts)
        if not joined:
            return np.empty(0, np.uint32), counts
        ends = np.append(starts, len(joined)).astype(np.int64)
        every = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(joined)]
        ).dictionary_encode()
        own = self._found(every.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(own), np.uint32)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        places = every.indices.to_numpy()
        lengths = sizes[places]
        stops = np.cumsum(lengths)
        # Id j of a chunk lies j behind the first id of its distinct chunk.
        shift = (np.cumsum(sizes) - sizes)[places] - (stops - lengths)
        ids = flat[np.repeat(shift, lengths) + np.arange(stops[-1])]
        last = np.append(0, stops)[np.cumsum(counts)]
        return ids, np.diff(last, prepend=0)


def chunk_encoder(path: str, offsets: bool = False) -> ChunkEncoder:
    return kept_by_worker(("chunk encoder", path, offsets), lambda: ChunkEncoder(path, offsets))
