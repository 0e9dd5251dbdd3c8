"""Byte-level BPE encoding and decoding over numpy arrays.

*Pre-tokens* are found without a regular expression.  Every code point has a class; a
class is a transition function of a small automaton; functions compose associatively,
so all states come from a scan: blocks compose their functions side by side, the block
functions are chained, and the blocks are run again from their entry states.  A token starts
where the state before, the class and the state behind say so.

*Merging*: slices of the text's bytes are looked up in a bounded cache; the slices that it
lacks are merged together, one merge per slice and step, always the lowest rank, leftmost
first.  Very long slices are merged one by one with a heap, so time stays near linear.

*Offsets* of tokens are byte offsets in the text, kept beside the ids; the ids decode to
exactly the bytes of the text.

Defined results: null counts as empty; an empty text has no ids; rows keep their other columns;
repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.llm.common import bounded_batches, documents, extended, free_names, kept_by_worker, quoted, text_bytes

RANKS = "byte_bpe_50k.tiktoken"
# Bytes of text taken together, and slices kept with their ids per worker.
BATCH_BYTES = 1 << 20
CACHE_SLICES = 200_000
# Slices longer than this are merged on their own.
LONG_SLICE = 128

# The classes of the pattern, and the letters of its contractions.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, STMD, LL, RV, E_LETTER, END = range(11)
# States: after the end or a closed token; inside a run; after an opening quote; after
# an opening quote and a letter that needs one more; after a blank before anything else.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, QUOTED, HALF_L, HALF_RV = range(9)
STATES = 9


def _transitions() -> np.ndarray:
    """State after each class, by class and state."""
    table = np.empty((11, STATES), np.uint8)
    for kind, state in (
        (LETTER, IN_LETTERS), (STMD, IN_LETTERS), (LL, IN_LETTERS), (RV, IN_LETTERS),
        (E_LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (SPACE, AFTER_SPACE),
        (BLANK, IN_BLANKS), (END, CLOSED),
    ):
        table[kind] = state
    # A quote opens a contraction unless it continues a run or follows the space it takes along.
    table[QUOTE] = QUOTED
    table[QUOTE, [IN_OTHERS, AFTER_SPACE, QUOTED]] = IN_OTHERS
    table[STMD, QUOTED] = CLOSED
    table[LL, QUOTED], table[LL, HALF_L] = HALF_L, CLOSED
    table[RV, QUOTED], table[E_LETTER, HALF_RV] = HALF_RV, CLOSED
    return table


TRANSITIONS = _transitions()


def class_table() -> np.ndarray:
    """The class of every code point."""
    return kept_by_worker(("classes of code points",), _class_table)


def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        found = "".join(regex.findall(pattern, every)).encode("utf-32-le")
        table[np.frombuffer(found, "<u4")] = kind
    for letters, kind in (("stmd", STMD), ("l", LL), ("rv", RV), ("e", E_LETTER), (" ", SPACE), ("'", QUOTE)):
        table[[ord(c) for c in letters]] = kind
    return table


def scan(classes: np.ndarray) -> np.ndarray:
    """The state after every class, starting closed."""
    n = len(classes)
    step = max(1, int(n**0.5))
    rows = -(-n // step)
    # Columns are the blocks, so that one step handles a row of contiguous memory.
    grid = np.full(rows * step, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, step).T)
    flat = TRANSITIONS.reshape(-1)
    base = grid.astype(np.int16) * STATES
    composed = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, axis=1)
    for line in base:
        composed = flat[line + composed]
    entry = np.empty(rows, np.uint8)
    state = CLOSED
    for block in range(rows):
        entry[block] = state
        state = composed[state, block]
    states = np.empty((step, rows), np.uint8)
    for at, line in enumerate(base):
        entry = states[at] = flat[line + entry]
    return np.ascontiguousarray(states.T).reshape(-1)[:n]


def _code_points(data: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Code points of the characters that start at ``leads``."""
    first = data[leads].astype(np.uint32)
    wide = np.flatnonzero(first >= 0x80)
    at = leads[wide]
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    lead, c1, c2, c3 = (padded[at + i].astype(np.uint32) for i in range(4))
    two = (lead & 0x1F) << 6 | c1 & 0x3F
    three = (lead & 0x0F) << 12 | (c1 & 0x3F) << 6 | c2 & 0x3F
    four = (lead & 0x07) << 18 | (c1 & 0x3F) << 12 | (c2 & 0x3F) << 6 | c3 & 0x3F
    first[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    return first


def _one_of(states: np.ndarray, *wanted: int) -> np.ndarray:
    table = np.zeros(STATES, bool)
    table[list(wanted)] = True
    return table[states]


def slice_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Byte offsets where pre-tokens start; ``text_starts`` are the offsets of the texts in ``data``.

    Texts never share a pre-token.
    """
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    kinds = class_table()[_code_points(data, leads)]
    # An end stands before every text.
    ends = np.searchsorted(leads, text_starts)
    classes = np.insert(kinds, ends, END)
    places = np.insert(leads, ends, text_starts)
    states = scan(classes)
    n = len(classes)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = CLOSED, states[:-1]
    behind = np.append(classes[1:], END)
    letter = (classes == LETTER) | ((classes >= STMD) & (classes <= E_LETTER))
    blank = (classes == SPACE) | (classes == BLANK)
    in_blanks = (before == IN_BLANKS) | (before == AFTER_SPACE)
    start = (before == CLOSED) & (classes != END)
    # Runs of one kind go on; the space in front of them belongs to them.
    start |= letter & ~_one_of(before, IN_LETTERS, AFTER_SPACE, QUOTED, HALF_L, HALF_RV)
    start |= (classes == NUMBER) & ~_one_of(before, IN_NUMBERS, AFTER_SPACE)
    others = (classes == OTHER) | (classes == QUOTE)
    start |= others & ~_one_of(before, IN_OTHERS, AFTER_SPACE, QUOTED)
    # White space is one token but for its last character, if something follows.
    more = np.append(blank[1:], False)
    last = ~more & (behind != END)
    start |= blank & (~in_blanks | last)
    # After a quote, letters that complete no contraction start a token of their own.
    first_letter = letter & (before == QUOTED)
    closed_later = np.append(states[1:], CLOSED) == CLOSED
    follows = np.append(classes[1:] != END, False)
    completes = (states == CLOSED) | (_one_of(states, HALF_L, HALF_RV) & closed_later & follows)
    start |= first_letter & ~completes
    # A half contraction that was not completed has started its letters already.
    return places[start]


class Ranks:
    """Token ids by bytes, and the merged id of every pair of ids that can merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = [b""] * (1 + max(self.ids.values()))
        for token, number in self.ids.items():
            self.bytes[number] = token
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (left << 32 | right, number)
            for token, number in self.ids.items()
            for cut in range(1, len(token))
            if (left := self.ids.get(token[:cut])) is not None
            and (right := self.ids.get(token[cut:])) is not None
        ]
        keys, merged = np.array(pairs, np.int64).T
        del pairs
        # Open addressing, for whole arrays of keys.
        self.bits = int(2 * len(keys)).bit_length()
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.merged = np.full(self.mask + 1, NO_MERGE, np.int64)
        at = self._home(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            # Of several keys that want a slot the last written one has it.
            self.keys[at[free]] = keys[free]
            done = self.keys[at[left]] == keys[left]
            self.merged[at[left[done]]] = merged[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return mixed.astype(np.int64)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to; NO_MERGE where it does not."""
        keys = left << 32 | right
        at = self._home(keys)
        out = np.full(len(keys), NO_MERGE, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = (at[open_] + 1) & self.mask
        return out

    def merge_one(self, piece: bytes) -> bytes:
        """A single long slice: a heap of candidate merges over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        given = np.array(ids, np.int64)
        first = self.merge_of(given[:-1], given[1:])
        known: dict[tuple[int, int], int] = {}

        def merged_of(left: int, right: int) -> int:
            if (left, right) not in known:
                one = self.merge_of(np.array([left]), np.array([right]))
                known[left, right] = int(one[0])
            return known[left, right]

        heap = [(m, i, ids[i], ids[i + 1]) for i, m in enumerate(first.tolist()) if m != NO_MERGE]
        heapq.heapify(heap)
        while heap:
            merged, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := merged_of(merged, ids[after[i]])) != NO_MERGE:
                    heapq.heappush(heap, (m, i, merged, ids[after[i]]))
            if (k := before[i]) >= 0 and (m := merged_of(ids[k], merged)) != NO_MERGE:
                heapq.heappush(heap, (m, k, ids[k], merged))
        return np.array([x for x in ids if x >= 0], np.uint32).tobytes()

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """All slices at once: every step makes the best merge of each slice."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        # The right neighbour's merge; the last id of a slice has none.
        rank = np.full(len(ids), NO_MERGE, np.int64)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        rank[same] = self.merge_of(ids[same], ids[same + 1])
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(ids)))
            best = np.minimum.reduceat(rank, starts)
            going = np.repeat(best != NO_MERGE, sizes)
            if not going.all():
                finished.append((owner[~going], ids[~going]))
                ids, owner, rank = ids[going], owner[going], rank[going]
                if not len(ids):
                    break
                sizes, best = sizes[best != NO_MERGE], best[best != NO_MERGE]
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            candidates = np.flatnonzero(rank == np.repeat(best, sizes))
            first = np.concatenate(([True], owner[candidates][1:] != owner[candidates][:-1]))
            at = candidates[first]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            # Only the merges on either side of the new ids change.
            rank[at] = NO_MERGE
            right = at[at + 1 < len(ids)]
            right = right[owner[right] == owner[right + 1]]
            rank[right] = self.merge_of(ids[right], ids[right + 1])
            left = at[at > 0] - 1
            left = left[owner[left] == owner[left + 1]]
            rank[left] = self.merge_of(ids[left], ids[left + 1])
        owners = np.concatenate([o for o, _ in finished])
        every = np.concatenate([i for _, i in finished])
        order = np.argsort(owners, kind="stable")
        counts = np.bincount(owners, minlength=len(pieces))
        flat = every[order].astype(np.uint32).tobytes()
        ends = np.cumsum(counts) * 4
        return [flat[a:b] for a, b in zip((ends - counts * 4).tolist(), ends.tolist())]


NO_MERGE = 1 << 40


class Encoder:
    """Encodes texts with cached slices; one per worker process and vocabulary."""

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        # Slices and their ids, 32 bits each.
        self.cache: dict[bytes, bytes] = {}

    def _encoded(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """The ids of slices that the cache lacks."""
        new: dict[bytes, bytes] = {}
        whole, short = self.ranks.ids, []
        for piece in pieces:
            number = whole.get(piece)
            if number is not None:
                new[piece] = number.to_bytes(4, sys.byteorder)
            elif len(piece) > LONG_SLICE:
                new[piece] = self.ranks.merge_one(piece)
            else:
                short.append(piece)
        if short:
            new.update(zip(short, self.ranks.merge_many(short)))
        return new

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the number of ids of each text, and the byte offset of each id in its text."""
        joined = b"".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        text_starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if texts else lengths
        if not joined:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64), np.empty(0, np.int64)
        starts = slice_starts(np.frombuffer(joined, np.uint8), text_starts)
        ends = np.append(starts[1:], len(joined))
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        found = list(map(self.cache.get, pieces))
        absent = [i for i, f in enumerate(found) if f is None]
        if absent:
            new = self._encoded({pieces[i] for i in absent})
            for i in absent:
                found[i] = new[pieces[i]]
            if len(self.cache) + len(new) > CACHE_SLICES:
                # Full: only what these texts use is kept.
                self.cache = dict(zip(pieces, found))
            else:
                self.cache.update(new)
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), np.uint32)
        first = np.searchsorted(starts, text_starts)
        # Slices of text i: first[i] up to the first slice of the next text.
        upto = np.append(first[1:], len(starts))
        sums = np.concatenate(([0], np.cumsum(counts)))
        per_text = sums[upto] - sums[first]
        sizes = self.sizes[ids]
        offsets = np.cumsum(sizes) - sizes - np.repeat(text_starts, per_text)
        return ids, per_text, offsets

    @property
    def sizes(self) -> np.ndarray:
        if not hasattr(self, "_sizes"):
            self._sizes = np.fromiter(map(len, self.ranks.bytes), np.int64, len(self.ranks.bytes))
        return self._sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        return b"".join(map(self.ranks.bytes.__getitem__, ids.tolist()))


def encoder(path: str) -> Encoder:
    return kept_by_worker(("byte-level encoder", path), lambda: Encoder(path))


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
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


def encoded(
    docs: DataFrame,
    text: str = "text",
    path: str | None = None,
    into: tuple[str, str] = ("ids", "offsets"),
    digest: str | None = None,
) -> DataFrame:
    """All columns of ``docs`` with the ids of the text and the byte offset of each id.

    With ``digest``, a column of that name holds the SHA-256 of the bytes that the ids decode to.
    Names that ``docs`` has already get an underscore.
    """
    path = path or public_tokenizers.path(RANKS)
    columns = docs.columns
    more = free_names(columns, *into, *([digest] if digest else []))
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            at = 0
            for part in _parts(text_bytes(batch.column(text))):
                ids, per_text, offsets = own.encode(part)
                bounds = pa.array(np.concatenate(([0], np.cumsum(per_text))), pa.int32())
                rows = batch.slice(at, len(part))
                at += len(part)
                added = [
                    pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))),
                    pa.ListArray.from_arrays(bounds, pa.array(offsets.astype(np.int32))),
                ]
                if digest:
                    upto = np.cumsum(per_text).tolist()
                    decoded_texts = (own.decode(ids[a:b]) for a, b in zip([0, *upto], upto))
                    added.append(pa.array([hashlib.sha256(t).hexdigest() for t in decoded_texts], pa.string()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], names=[*columns, *more])

    kinds = ("array<int>", "array<int>", "string")
    return docs.mapInArrow(run, extended(docs.schema, ", ".join(f"{quoted(n)} {k}" for n, k in zip(more, kinds))))


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id; all that decoding needs."""
    with open(path, "rb") as lines:
        known = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [known.get(i, b"") for i in range(1 + max(known))]


def decoded(coded: DataFrame, ids: str = "ids", path: str | None = None, into: str = "decoded") -> DataFrame:
    """All columns of ``coded`` with the bytes of the ids; a taken name gets an underscore."""
    path = path or public_tokenizers.path(RANKS)
    columns = coded.columns
    (into,) = free_names(columns, into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept_by_worker(("token bytes", path), lambda: token_bytes(path))
        for batch in batches:
            lists = batch.column(ids)
            texts = []
            for row in range(len(lists)):
                numbers = lists[row].values
                texts.append(b"" if numbers is None else b"".join(map(own.__getitem__, numbers.to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary())], names=[*columns, into]
            )

    return coded.mapInArrow(run, extended(coded.schema, f"`{into}` binary"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids (little-endian, 32 bits) and of the decoded bytes."""
    path = path or public_tokenizers.path(RANKS)
    kind = dict(docs.dtypes)[key]
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for part in _parts(text_bytes(batch.column("text"))):
                ids, per_text, _ = own.encode(part)
                raw, at = ids.astype("<u4"), 0
                for count in per_text.tolist():
                    mine = raw[at : at + count]
                    at += count
                    counts.append(count)
                    of_ids.append(hashlib.sha256(mine.tobytes()).hexdigest())
                    of_bytes.append(hashlib.sha256(own.decode(mine)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    thin = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return thin.mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("id", key)


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(documents(spark, folder))


def round_trip(docs: DataFrame) -> DataFrame:
    """``docs`` with ids, offsets and the SHA-256 of the bytes that the ids decode to, in one pass."""
    return encoded(docs, digest="decoded_sha256")


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLES: dict[str, str] = {}
