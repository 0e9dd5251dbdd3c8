"""Spelling variants by dense prefix-suffix tiling.

1. Words: maximal runs of letters, A-Z lower-cased, a fixed share of the runs with one letter
   deleted (the contract's damage); counted with map-side combining.
2. Tiles: two words at one edit whose longer one has ``m`` letters share at least ``m - 1`` letters
   of prefix and suffix together, so the first or the last ``m // 2`` letters agree.  A word of
   length ``m`` enters the tiles of ``m`` and ``m + 1``, by its prefix and by its suffix.
3. A tile is compared in full: its words stand in padded code-point matrices, once aligned
   left and once aligned right; common prefix plus common suffix reaching the longer length
   less one is a single edit.  A pair that agrees at both ends counts by its prefix only.  Tiles over
   ``TILE_ROWS`` words are cut into blocks, and every block meets every other one in a task of its own.
4. A block returns, per word, how many near words it saw and the best of them, never the pairs.
5. Forms are followed to their last word by pointer doubling; a form is at least ten times as
   frequent, so chains are short.

Defined results: null and empty texts give no words; a null id counts as an empty string in the damage;
texts of any length are read whole; repeated rows count again; ties in frequency go to the smaller word in
code-point order; an empty table gives an empty table; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.llm.common import documents, quoted
from homologrid.staging import StageArea

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTER = r"[A-Za-zÀ-ÿ]"
LEAST_LETTERS = 7
LEAST_COUNT = 2
DAMAGE_MODULUS = 31
FORM_RATIO = 10
# Words of one side of a comparison; bounds the memory of a task.
TILE_ROWS = 2048
# Copies of words that one task compares, over all of its tiles.
TASK_ROWS = 16_384
# Pairs compared at once.
PAIRS = 1 << 17


def damaged(run: Column, key: Column) -> Column:
    """The run without one letter where the checksum of id and run says so."""
    mark = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(mark, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(mark, F.lit(DAMAGE_MODULUS)) == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough."""
    # Shorter runs cannot give a word of the least length.
    runs = F.regexp_extract_all(
        F.translate(F.col(quoted(text)), UPPER, UPPER.lower()), F.lit(LETTER + f"{{{LEAST_LETTERS},}}"), F.lit(0)
    )
    return (
        docs.select(F.col(quoted(key)).alias("id"), F.explode(runs).alias("run"))
        .select(damaged(F.col("run"), F.col("id")).alias("word"))
        .where(F.length("word") >= LEAST_LETTERS)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def _copies(words: DataFrame) -> DataFrame:
    """Every word once for each tile it enters: longer length, side, and the shared letters."""
    length = F.length("word")
    return (
        words.select("word", "n", length.alias("letters"), F.explode(F.array(length, length + 1)).alias("m"))
        .withColumn("half", F.floor(F.col("m") / 2).cast("int"))
        .select(
            "word", "n", "m",
            (F.col("letters") == F.col("m")).alias("long"),
            F.explode(
                F.array(
                    F.concat(F.lit("<"), F.expr("left(word, half)")),
                    F.concat(F.lit(">"), F.expr("right(word, half)")),
                )
            ).alias("part"),
        )
    )


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left and aligned right (padding 0) and the lengths."""
    raw = [w.encode("utf-32-le") for w in words]
    lengths = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
    points = np.frombuffer(b"".join(raw), "<u4")
    width = int(lengths.max()) + 1
    row = np.repeat(np.arange(len(raw)), lengths)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # Letters of the runs lie below 256; anything else keeps its full width.
    kind = np.uint8 if not len(points) or points.max() < 256 else np.uint32
    left = np.zeros((len(raw), width), kind)
    left[row, place] = points
    right = np.zeros((len(raw), width), kind)
    right[row, np.repeat(lengths, lengths) - 1 - place] = points
    return left, right, lengths


def _agreeing(a: np.ndarray, b: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """How many leading places of the rows agree, at most ``upto``."""
    differs = a != b
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])
    return np.minimum(first, upto)


def _is_near(sheets: tuple, m: np.ndarray, suffix: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs ``(i, j)`` are at exactly one edit and belong to the tile they stand in."""
    left, right, lengths = sheets
    shorter, longer = np.minimum(lengths[i], lengths[j]), np.maximum(lengths[i], lengths[j])
    prefix = _agreeing(left[i], left[j], shorter)
    common = prefix + _agreeing(right[i], right[j], shorter)
    near = (common >= longer - 1) & ((longer > shorter) | (prefix < shorter))
    # Both ends agree: the prefix tile has the pair.
    return near & (~suffix[i] | (prefix < m[i] // 2))


def near_pairs(
    words: list[str], tile: np.ndarray, resident: np.ndarray, m: np.ndarray, suffix: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (resident, probe) of rows of one tile at exactly one edit."""
    sheets = _padded(words)
    order = np.lexsort((resident, tile))
    tile, resident = tile[order], resident[order]
    starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(tile))))
    probes = np.bincount(own[~resident], minlength=len(starts))
    hosts = np.flatnonzero(resident)
    hosts = hosts[probes[own[hosts]] > 0]
    found_a, found_b = [order[:0]], [order[:0]]
    # A run of residents with about PAIRS pairs at a time.
    run = np.cumsum(probes[own[hosts]]) // PAIRS
    for part in np.split(hosts, np.flatnonzero(np.diff(run)) + 1):
        each = probes[own[part]]
        a = np.repeat(part, each)
        within = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)
        i, j = order[a], order[starts[own[a]] + within]
        near = _is_near(sheets, m, suffix, i, j)
        found_a.append(i[near])
        found_b.append(j[near])
    return np.concatenate(found_a), np.concatenate(found_b)


def _compare(table: pa.Table) -> pa.Table:
    words = table["word"].to_pylist()
    counts = table["n"].to_numpy()
    resident = table["resident"].to_numpy(zero_copy_only=False)
    is_long = table["long"].to_numpy(zero_copy_only=False)
    m = table["m"].to_numpy().astype(np.int64)
    parts = table["part"].to_pylist()
    keys = list(zip(m.tolist(), parts, table["block"].to_pylist(), table["probe"].to_pylist()))
    number: dict = {}
    tile = np.fromiter((number.setdefault(k, len(number)) for k in keys), np.int64, len(keys))
    suffix = np.fromiter((p[0] == ">" for p in parts), bool, len(parts))
    a, b = near_pairs(words, tile, resident, m, suffix)
    # Two words of the longer length meet from both sides; each counts the other as resident.
    both = ~is_long[b]
    seen = np.concatenate((a, b[both]))
    other = np.concatenate((b, a[both]))
    best: dict[str, tuple] = {}
    for i, j in zip(seen.tolist(), other.tolist()):
        mark = (-int(counts[j]), words[j])
        had = best.get(words[i])
        best[words[i]] = (1, *mark) if had is None else (had[0] + 1, *min(had[1:], mark))
    return pa.table(
        {
            "word": pa.array(list(best), pa.string()),
            "seen": pa.array([v[0] for v in best.values()], pa.int64()),
            "best_n": pa.array([-v[1] for v in best.values()], pa.int64()),
            "best": pa.array([v[2] for v in best.values()], pa.string()),
        }
    )


def near_words(words: DataFrame) -> DataFrame:
    """Per word with near words: ``n_near`` and the most frequent of them, ``best`` with ``best_n``.

    ``words`` is a written table ``(word, n)`` of distinct words.
    """
    total = words.count()
    copies = _copies(words)
    # Tiles of one word, or of shorter words only, have no pair.
    sizes = (
        copies.groupBy("m", "part")
        .agg(F.count("*").alias("rows"), F.count_if("long").alias("longs"))
        .where("rows > 1 and longs > 0")
        .select(
            F.col("m").alias("tile_m"),
            F.col("part").alias("tile_part"),
            F.ceil(F.col("longs") / TILE_ROWS).alias("blocks"),
            F.ceil(F.col("rows") / TILE_ROWS).alias("probes"),
        )
    )
    mixed = F.xxhash64("word")
    own_block = F.pmod(mixed, "blocks")
    own_probe = F.pmod(F.shiftright(mixed, 20), "probes")

    def counted(n: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    here = copies.join(sizes, (F.col("m") == F.col("tile_m")) & (F.col("part") == F.col("tile_part")))
    columns = ["word", "n", "m", "long", "part", "block", "probe"]
    residents = (
        here.where("long").withColumn("block", own_block).withColumn("probe", F.explode(counted("probes")))
    ).select(*columns, F.lit(True).alias("resident"))
    probes = (
        here.withColumn("probe", own_probe).withColumn("block", F.explode(counted("blocks")))
    ).select(*columns, F.lit(False).alias("resident"))
    tasks = max(1, 8 * total // TASK_ROWS)
    return (
        residents.union(probes)
        .withColumn("task", F.pmod(F.xxhash64("m", "part", "block", "probe"), F.lit(tasks)))
        .groupBy("task")
        .applyInArrow(_compare, "word string, seen long, best_n long, best string")
        .groupBy("word")
        .agg(F.sum("seen").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("first"))
        .select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.n")).alias("best_n"))
    )


def roots(forms: DataFrame, area: StageArea) -> DataFrame:
    """``(word, root)`` of all words with a form; ``forms`` is a written table ``(word, form)``."""
    now = area.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        # A last word has no row here; as a form grows tenfold a step, the rounds are few.
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        after = area.write(
            now.join(onward, "root", "left").select(
                "word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")
            ),
            "roots",
        )
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        area.forget(now)
        now = after.select("word", "root")
        now._stage_path = after._stage_path


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word: its form, the root of its chain of forms, and their counts."""
    area = StageArea(docs.sparkSession, "spelling")
    words = area.write(word_counts(docs, key, text), "words")
    frequent = F.col("best_n") >= FORM_RATIO * F.col("n")
    named = area.write(
        words.join(near_words(words), "word", "left").select(
            "word", "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(frequent, F.col("best")).alias("form"),
            F.when(frequent, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(named.where("form is not null").select("word", "form"), area)
    return named.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(documents(spark, folder))


# The checksum by its bitwise definition; single edits as equal words after one letter is masked or deleted.
SQL = r"""
with recursive
remainders as (
    select list(r order by byte) as steps from (
        select byte, list_reduce(
            list_prepend(byte, [1, 2, 3, 4, 5, 6, 7, 8]::bigint[]),
            lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end
        ) as r
        from (select unnest(range(256)) as byte)
    )
),
runs as (
    select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_text
    from documents
),
occurring as (
    select doc_id, run, count(*) as times from (
        select doc_id, unnest(regexp_extract_all(lower_text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from runs
    )
    where length(run) >= 7
    group by doc_id, run
),
marked as (
    select run, times, xor(list_reduce(
        list_prepend(4294967295::bigint, list_transform(
            regexp_extract_all(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), '..'),
            lambda pair: ('0x' || pair)::bigint
        )),
        lambda crc, byte: xor(crc >> 8, steps[(xor(crc, byte) & 255) + 1])
    ), 4294967295) as h
    from occurring, remainders
),
words as (
    select word, sum(times)::bigint as n from (
        select times, case when h % 31 = 0
            then left(run, (h % length(run))::int) || substring(run, (h % length(run))::int + 2)
            else run end as word
        from marked
    )
    where length(word) >= 7
    group by word
    having sum(times) >= 2
),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
masked as (
    select word, n, left(word, (i - 1)::int) || '_' || substring(word, (i + 1)::int) as mask,
        left(word, (i - 1)::int) || substring(word, (i + 1)::int) as less
    from places
),
pairs as (
    select a.word, b.word as near, b.n as near_n from masked a join masked b on a.mask = b.mask where a.word <> b.word
    union
    select a.word, b.word, b.n from masked a join words b on a.less = b.word
    union
    select b.word, a.word, a.n from masked a join words b on a.less = b.word
),
ranked as (
    select word, near, near_n, count(*) over (partition by word) as n_near,
        row_number() over (partition by word order by near_n desc, near) as place
    from pairs
),
formed as (
    select w.word, w.n, coalesce(r.n_near, 0) as n_near,
        case when r.near_n >= 10 * w.n then r.near end as form,
        case when r.near_n >= 10 * w.n then r.near_n end as form_n
    from words w left join ranked r on r.word = w.word and r.place = 1
),
chains as (
    select word, word as root, 0 as steps from formed
    union all
    select c.word, f.form, c.steps + 1 from chains c join formed f on f.word = c.root where f.form is not null
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n
from formed f join (select word, arg_max(root, steps) as root from chains group by word) c on c.word = f.word
"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op13_spelling_variants": SQL}
