"""Conversation structure repair by rank-convergent parallel Viterbi.

The cheapest edits that turn the role initials of a conversation into ``(s?(ua)+)?`` are a shortest
path over four states.  Costs run backward, from the last row to the first.

1. Rows stand in one global order (conversation, turn, content) and get ordered numbers; equal rows
   of a turn are one row with a count.  Blank and repeated rows must go: they cost 2 in every state and
   take no part in the search.
2. The live rows are cut into chunks of ``CHUNK_ROWS``, whatever conversations they belong to.  Where a
   conversation goes on in the next chunk, this one starts from a speculative cost vector.
3. Fix-up passes: a chunk whose start vector differs from what the next chunk now offers by more
   than a constant runs again; the passes end when no vector changes.  Edit costs bound the
   differences of a vector, so a few rows usually make it forget where it started.
4. Tracing goes forward over the stitched costs and takes the ASCII-least edit that stays cheapest.  A chunk
   that continues a conversation is traced from each state; the right one is chosen when the chunks of the
   conversation are put in order, one short row per chunk.
5. The digest of the repaired text is sequential by definition: rows stream in order through one
   task per conversation, which keeps a hash and the audit only, never the texts.

Defined results: a null turn, role or text counts as one space in the damage and as such a text; null turns
come first; equal turns stand by role, then by the SHA-256 of role and text, which also stands for their
contents when repeats are sought; null conversations are one conversation; texts of any length are read whole;
an empty table gives an empty table; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homologrid.llm.common import bounded_batches, quoted, table
from homologrid.staging import StageArea

# Edit costs and what a truncated row adds when it is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# Live rows of one chunk; bounds the memory of a task.
CHUNK_ROWS = 32_768
NEVER = 1 << 40

# The states of (s?(ua)+)?: nothing yet, after s, after u, after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = ("u", "u", "a", "u")
ENDS = (0, NEVER, NEVER, 0)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

WHITE = " \t\n\x0b\f\r"


def _with_inserts(base: tuple) -> tuple:
    """Costs of the states when rows may be inserted first."""
    costs = list(base)
    for _ in range(2):
        for state in range(4):
            costs[state] = min(costs[state], INSERT + costs[NEXT[state, WANTED[state]]])
    return tuple(costs)


END = _with_inserts(ENDS)


def _before(code: str, later: tuple) -> tuple:
    """Costs before a live row, without insertions, from the costs after it."""
    initial, extra = code[0], TRUNCATED if code[1] == "t" else 0
    out = []
    for state in range(4):
        keep = later[NEXT[state, initial]] if (state, initial) in NEXT else NEVER
        rerole = later[NEXT[state, WANTED[state]]]
        out.append(min(DELETE + later[state], extra + keep, extra + REROLE + rerole))
    return tuple(out)


def reduced(costs: tuple) -> tuple[tuple, int]:
    """The vector without its constant, and the constant."""
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(maxsize=1 << 16)
def _step(code: str, later: tuple) -> tuple[tuple, int, tuple]:
    """Reduced costs before the row, their constant, and per state its edits and the state after."""
    before = _with_inserts(_before(code, later))
    extra = TRUNCATED if code[1] == "t" else 0
    moves = []
    for start in range(4):
        state, letters = start, ""
        while True:
            cost, wanted = before[state], NEXT[state, WANTED[state]]
            # In ASCII order: D, I, K, R.
            if cost == DELETE + later[state]:
                letters += "D"
            elif cost == INSERT + before[wanted]:
                letters, state = letters + "I", wanted
                continue
            elif (state, code[0]) in NEXT and cost == extra + later[NEXT[state, code[0]]]:
                letters, state = letters + "K", NEXT[state, code[0]]
            else:
                letters, state = letters + "R", wanted
            break
        moves.append((letters, state))
    costs, least = reduced(before)
    return costs, least, tuple(moves)


def _tail(state: int) -> str:
    """Insertions that end a conversation in ``state``."""
    letters = ""
    while ENDS[state]:
        letters, state = letters + "I", NEXT[state, WANTED[state]]
    return letters


def backward(codes: list[str], later: tuple) -> tuple:
    """The reduced costs before the first row."""
    for code in reversed(codes):
        later = _step(code, later)[0]
    return later


def traced(codes: list[str], later: tuple, ends: bool, starts: tuple[int, ...]) -> tuple[list[list[str]], list[int]]:
    """Per start state: the edits of every row (insertions before its own letter), and the state after.

    Insertions that end the conversation follow the last letter.
    """
    moves = []
    for code in reversed(codes):
        later, _, move = _step(code, later)
        moves.append(move)
    moves.reverse()
    edits, after = [], []
    for state in starts:
        letters = []
        for move in moves:
            word, state = move[state]
            letters.append(word)
        if ends:
            letters[-1] += "." + _tail(state)
        edits.append(letters)
        after.append(state)
    return edits, after


def damaged(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, copies`` after the contract's damage; nulls count as one space."""
    place = F.concat(
        F.coalesce(F.col("conv").cast("string"), F.lit(" ")),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), F.lit(" ")),
    )
    fault = F.pmod(F.crc32(place.cast("binary")), F.lit(20))
    text = F.coalesce("text", F.lit(" "))
    return rows.where(fault != 0).select(
        "conv",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, F.lit(""))
        .when(fault == 2, F.regexp_replace(text, r"[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        F.when(fault == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows in the order of conversations and turns, with ordered numbers ``no`` and their flags.

    The order is dealt by ranges of conversation, turn and content, so a conversation of any
    size spreads over partitions.
    """
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    once = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        once.withColumn("key", key)
        .withColumn("content", content)
        .repartitionByRange(width, "key", F.asc_nulls_first("turn"), "role", "content")
        .sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "content")
        .select(
            F.monotonically_increasing_id().alias("no"),
            "key", "turn", "role", "text", "copies", "content",
            (last == "").alias("blank"),
            (~last.isin(".", "!", "?")).alias("cut"),
        )
    )


def live_rows(rows: DataFrame) -> DataFrame:
    """``no, key, code, chunk`` of the rows that may stay; ``rows`` is the written table of ``ordered``."""
    # Equal contents meet in an aggregate; what comes back are unique numbers.
    firsts = rows.where("not blank").groupBy("key", "content").agg(F.min("no").alias("no")).select("no")
    initial = F.substring("role", 1, 1)
    code = F.concat(
        F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("-")),
        F.when(F.col("cut"), F.lit("t")).otherwise(F.lit("-")),
    )
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    return (
        rows.select("no", "key", code.alias("code"))
        .join(firsts, "no", "left_semi")
        .repartitionByRange(width, "no")
        .sortWithinPartitions("no")
        .withColumn("place", place)
        .select(
            "no", "key", "code",
            # Places count on within a partition and start anew in the next one, 2^33 further.
            F.expr(f"place div {CHUNK_ROWS}").alias("chunk"),
        )
    )


def _runs(group: pa.Table) -> Iterator[tuple[str, list[int], list[str]]]:
    """The conversations of a chunk in order: key, numbers, codes."""
    group = group.sort_by("no")
    keys, numbers, codes = (group[c].to_pylist() for c in ("key", "no", "code"))
    start = 0
    for at in range(1, len(keys) + 1):
        if at == len(keys) or keys[at] != keys[start]:
            yield keys[start], numbers[start:at], codes[start:at]
            start = at


def _vectors(key: tuple, group: pa.Table) -> pa.Table:
    """Cost vector at the start of the one conversation of these rows, from their ``given`` vector."""
    group = group.sort_by("no")
    given = tuple(group["given"][0].as_py())
    offered = backward(group["code"].to_pylist(), given)
    return pa.table({"segment": group["segment"].slice(0, 1), "offered": pa.array([list(offered)], pa.list_(pa.int64()))})


def _traces(key: tuple, group: pa.Table) -> pa.Table:
    # At most the first and the last conversation of a chunk are parts of longer ones.
    given, follows, parts = {}, set(), {}
    for name, vector, later, part in zip(*(group[c].to_pylist() for c in ("key", "given", "follows", "segment"))):
        if part is not None:
            parts[name] = part
        if vector is not None:
            given[name] = tuple(vector)
        if later:
            follows.add(name)
    numbers, segments, edits, after = [], [], [], []
    for name, nos, codes in _runs(group):
        starts = (0, 1, 2, 3) if name in follows else (0,)
        own, ends = traced(codes, given.get(name, END), name not in given, starts)
        numbers += nos
        segments += [parts.get(name)] * len(nos)
        edits += [list(e) for e in zip(*own)]
        after += [None] * (len(nos) - 1) + [ends]
    texts = pa.list_(pa.string())
    return pa.table(
        {
            "no": pa.array(numbers, pa.int64()),
            "segment": pa.array(segments, pa.int64()),
            "edits": pa.array(edits, texts),
            "after": pa.array(after, pa.list_(pa.int32())),
        }
    )


def _segments(live: DataFrame) -> DataFrame:
    """Parts of the conversations that lie in more than one chunk, each with the next one."""
    parts = live.groupBy("key", "chunk").agg(F.min("no").alias("segment"))
    order = Window.partitionBy("key").orderBy("chunk")
    return (
        parts.withColumn("next", F.lead("segment").over(order))
        .withColumn("first", F.lag("segment").over(order).isNull())
        .where("next is not null or not first")
    )


def stitched(live: DataFrame, area: StageArea) -> tuple[DataFrame, int]:
    """Parts of conversations over several chunks with their final start vectors, and the passes made."""
    parts = area.write(_segments(live).withColumn("given", F.array(*[F.lit(c).cast("long") for c in END])), "parts")
    offered = None
    redo, passes = parts.select("segment", "chunk", "key", "given"), 0
    while not redo.isEmpty():
        passes += 1
        rows = live.join(redo.withColumnRenamed("key", "part_key"), "chunk").where("key = part_key")
        new = rows.groupBy("segment").applyInArrow(_vectors, "segment long, offered array<long>")
        if offered is not None:
            kept = offered.join(redo, "segment", "left_anti")
            new = kept.unionByName(new)
        offered = area.write(new, "vectors")
        told = offered.select(F.col("segment").alias("next"), F.col("offered").alias("told"))
        # Vectors are kept without their constant, so equal means equal up to a constant.
        after = area.write(
            parts.join(told, "next", "left").select(
                "segment", "chunk", "key", "next", "first",
                F.coalesce("told", "given").alias("given"),
                (F.col("told").isNotNull() & (F.col("told") != F.col("given"))).alias("changed"),
            ),
            "parts",
        )
        redo = after.where("changed").select("segment", "chunk", "key", "given")
        parts = after.drop("changed")
    return parts, passes


def _start_states(parts: DataFrame, traces: DataFrame) -> DataFrame:
    """``segment, state``: the state in which each part of a conversation starts; one short row per part."""
    ends = traces.where("segment is not null and after is not null").select("segment", "after")
    ordered_parts = (
        parts.select("key", "segment")
        .join(ends, "segment")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("segment", "after"))).alias("parts"))
    )
    state = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<segment:long,state:int>>").alias("starts")),
        lambda now, part: F.struct(
            F.when(F.size(part["after"]) == 1, part["after"][0])
            .otherwise(F.get(part["after"], now["state"]))
            .alias("state"),
            F.concat(
                now["starts"],
                F.array(F.struct(part["segment"].alias("segment"), now["state"].alias("state"))),
            ).alias("starts"),
        ),
        lambda now: now["starts"],
    )
    return ordered_parts.select(F.explode(state).alias("start")).select("start.segment", "start.state")


def edits(rows: DataFrame, area: StageArea) -> DataFrame:
    """``no, letters`` of every live row; letters of the end of a conversation follow a point."""
    live = area.write(live_rows(rows), "live")
    parts, _ = stitched(live, area)
    open_parts = parts.select(
        "chunk",
        F.col("key").alias("part_key"),
        F.when(F.col("next").isNotNull(), F.col("given")).alias("given"),
        (~F.col("first")).alias("follows"),
        "segment",
    )
    # Unique on both columns, and a chunk has at most two such conversations.
    wide = live.join(open_parts, (live.chunk == open_parts.chunk) & (F.col("key") == F.col("part_key")), "left").select(
        live.chunk, "key", "no", "code", "given", "follows", "segment"
    )
    traces = area.write(
        wide.groupBy("chunk").applyInArrow(
            _traces, "no long, segment long, edits array<string>, after array<int>"
        ),
        "traces",
    )
    starts = _start_states(parts, traces)
    several = traces.where("segment is not null").join(starts, "segment").select("no", F.get("edits", "state").alias("letters"))
    single = traces.where("segment is null").select("no", F.col("edits")[0].alias("letters"))
    return single.unionByName(several)


class _Conversation:
    """What one task keeps of the conversation that streams through it."""

    def __init__(self, key: str):
        self.key, self.state, self.tail, self.last = key, 0, "", None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def _edit(self, letter: str, role: str, text: str, cut: bool) -> None:
        self.audit.append(letter)
        if letter == "D":
            self.cost += DELETE
            return
        wanted = WANTED[self.state]
        if letter == "I":
            self.cost += INSERT
            self._line(ROLES[wanted], "")
        elif letter == "R":
            self.cost += REROLE + TRUNCATED * cut
            self._line(ROLES[wanted], text)
        else:
            self.cost += TRUNCATED * cut
            wanted = role[:1]
            self._line(role, text)
        self.state = NEXT[self.state, wanted]

    def row(self, role: str, text: str, copies: int, blank: bool, cut: bool, letters: str | None) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        if copies > 1 and initial * 2 not in LEGAL:
            self.illegal += copies - 1
        self.last = initial
        dead = copies
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - (letters is not None)
            if letters is not None:
                dead -= 1
                self.truncated += cut
                own, _, self.tail = letters.partition(".")
                for letter in own:
                    self._edit(letter, role, text, cut)
        self.audit.append("D" * dead)
        self.cost += DELETE * dead

    def result(self) -> tuple:
        for letter in self.tail:
            self._edit(letter, "", "", False)
        return (
            self.key, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
            "".join(self.audit), self.digest.hexdigest(),
        )


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and number; a row's letters come right before it."""
    now, letters = None, None

    def told(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
        names = ["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        columns = zip(*done) if done else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        done = []
        columns = (batch.column(c).to_pylist() for c in ("key", "role", "text", "copies", "blank", "cut", "letters"))
        for key, role, text, copies, blank, cut, edit in zip(*columns):
            if now is None or key != now.key:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(key)
            if edit is not None:
                letters = edit
                continue
            now.row(role, text, copies, blank, cut, letters)
            letters = None
        yield told(done)
    if now is not None:
        yield told([now.result()])


def repaired(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits, and the digest of what they give."""
    spark = rows.sparkSession
    bounded_batches(spark)
    area = StageArea(spark, "repair")
    given = rows.select(
        F.col(quoted(conv)).alias("conv"), F.col(quoted(turn)).alias("turn"),
        F.col(quoted(role)).alias("role"), F.col(quoted(text)).alias("text"),
    )
    placed = area.write(ordered(damaged(given)), "ordered")
    changes = edits(placed, area)
    keyed = changes.join(placed.select("no", "key"), "no")
    stream = (
        placed.select("key", "no", F.lit(1).alias("kind"), "role", "text", "copies", "blank", "cut")
        .withColumn("letters", F.lit(None).cast("string"))
        .unionByName(keyed.select("key", "no", F.lit(0).alias("kind"), "letters"), allowMissingColumns=True)
        .repartition("key")
        .sortWithinPartitions("key", "no", "kind")
    )
    audited = stream.mapInArrow(
        _audits,
        "key string, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string",
    )
    # Decimal, as the ends of the range of longs may be far apart.
    wide = F.col("turn").cast("decimal(20,0)")
    turns = placed.groupBy("key").agg(
        F.try_subtract(F.max(wide) - F.min(wide) + 1, F.count_distinct("turn")).try_cast("long").alias("gaps")
    )
    every = given.select("conv").distinct().withColumn(
        "key", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    )
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        every.join(turns, "key", "left")
        .join(audited, "key", "left")
        .select(
            F.col("conv").alias(conv),
            *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
    )


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(table(spark, folder, "conversations"))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
# Shortest edit paths with ordered ties have no practical SQL form; tests hold a brute-force search against them.
ORACLES: dict[str, str] = {}
