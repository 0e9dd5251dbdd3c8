"""Personal data by fixed patterns and bootstrapped contexts, all in DataFrame functions.

1. *Seeds.* E-mail addresses, IP addresses, card and telephone numbers are matched leftmost and
   non-overlapping, checked, and kept with their places.  Every pattern is possessive or
   anchored where a run begins, so long runs cost linear time and no stack.  One pass over
   the texts writes the matches; everything after works on that small table.
2. *Contexts.* The word on the left, the word on the right and the pair of both around a seed, or
   around any other token or run of digit groups that looks like an identifier, are lexical patterns.
   Words are those of the text, whether or not they are matches themselves.  Patterns and distinct
   identifiers form a graph, so copies of documents count once.
3. *Scores.* A pattern's confidence for a kind is the share of its identifiers that are of that kind,
   given enough of them; an unseen identifier's is the noisy-or of its confident patterns.
   Accepted identifiers count as seeds of the next round.  Rounds go on until none is added and no
   trust changes (to nine digits); scores only grow, so they end.
4. *Discovery.* Tokens and runs of accepted identifiers in a confident context are added as spans; of
   spans of a kind one within another, only the outer one.
   Spans of the fixed patterns are never changed.

Defined results: null counts as empty text; a text without matches has zero counts, the digest of the
empty string and empty spans; repeated rows are rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homologrid.llm.common import documents, quoted, whole_text
from homologrid.staging import StageArea

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, written so that each run is tried once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Tokens with a digit or an at sign: what contexts may reveal.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
# Groups of digits with spaces, dots, hyphens and brackets between them.
RUN = r"(?<![\p{L}0-9@.+(-])\(?\+?[0-9](?:[\x20().-]{0,3}[0-9])++"
UNSEEN = {"token": TOKEN, "run": RUN}
NEEDED = {"email": "@", "ip": r"[0-9]\.", "card": "[0-9]", "phone": r"\+[0-9]", "token": "[0-9@]", "run": "[0-9][().-]*[\x20]"}

CONTEXT_CHARS = 48
# A match and the gap beside it have two characters at least: so many of them fill a context.
CONTEXT_MATCHES = CONTEXT_CHARS // 2
# Distinct identifiers that a pattern needs, and the confidence from which it counts.
MIN_SUPPORT = 5
PATTERN_CONFIDENCE = 0.8
ACCEPTED = 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    places = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(
        F.transform(
            places,
            lambda i: _doubled(F.substring(digits, -i, F.lit(1)).cast("int"), i),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    return total % 10 == 0


def _doubled(digit: Column, place: Column) -> Column:
    twice = digit * 2
    return F.when(place % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    octets = F.forall(
        F.split(value, r"\."),
        lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3)
        & (F.coalesce(F.substring(F.ltrim(part, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255),
    )
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", octets)
        .when(kind == "card", F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


def _likely(kind: str, value: Column) -> Column:
    """Whether a token may be an identifier of a kind at all, without meeting its pattern."""
    digits = F.length(_digits(value))
    return {
        "email": value.rlike(r"^[^@\s]+@[^@\s]+$"),
        "ip": value.rlike(r"^[0-9A-Fa-f.:]++$")
        & (F.length(F.regexp_replace(value, "[^.:]", "")) >= 2)
        & (digits >= 4),
        "card": value.rlike(r"^[0-9]++(?:[\x20-]++[0-9]++)*+$") & digits.between(12, 19),
        "phone": value.rlike(r"^[0-9().+/\x20-]+$") & digits.between(7, 15),
    }[kind]


def _found(text: Column, name: str, pattern: str) -> Column:
    """Matches of a pattern: length of the gap before, the match, and the ends of the gaps around it."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    n = F.size(matches)
    # Whole arrays are zipped: inside the function below nothing is matched again.
    zipped = F.arrays_zip(
        matches.alias("value"), F.slice(gaps, F.lit(1), n).alias("gap"), F.slice(gaps, F.lit(2), n).alias("next")
    )
    rows = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(name).alias("kind"),
            i.alias("number"),
            F.length(z["gap"]).alias("gap"),
            z["value"].alias("value"),
            F.substring(z["gap"], -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"),
            F.substring(z["next"], 1, CONTEXT_CHARS).alias("after"),
        ),
    )
    empty = F.array().cast(
        "array<struct<kind:string,number:int,gap:int,value:string,before:string,after:string>>"
    )
    return F.when(text.rlike(NEEDED[name]), rows).otherwise(empty)


class PersonalData:
    """Spans of personal data of a table: ``base`` by fixed patterns, ``added`` by contexts."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text"):
        area = StageArea(docs.sparkSession, "pii")
        whole = F.col("text")
        given = docs.select(F.col(quoted(key)).alias("id"), whole_text(text).alias("text"))
        self.rows = area.write(
            given.select(
                F.monotonically_increasing_id().alias("row"),
                "id",
                F.when(
                    whole.rlike("[0-9@]"),
                    F.concat(*[_found(whole, k, p) for k, p in (PATTERNS | UNSEEN).items()]),
                ).alias("found"),
            ),
            "matches",
        )
        self.spans = area.write(self._placed(), "spans")
        self.base = self.spans.where(~F.col("kind").isin(*UNSEEN)).select("row", "kind", "start", "end", "value", "left", "right")
        self.tokens = area.write(self._unseen(), "tokens")
        self.added = self._discovered(area)

    def _placed(self) -> DataFrame:
        """Checked matches with their places in code points."""
        each = self.rows.where("found is not null").select("row", F.inline("found"))
        upto = Window.partitionBy("row", "kind").orderBy("number")
        gaps = F.sum("gap").over(upto.rowsBetween(Window.unboundedPreceding, 0))
        spent = F.coalesce(
            F.sum(F.length("value")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
        # Where a gap is short, the context goes on with the matches and gaps beyond it.
        sooner = F.collect_list(F.right(F.concat("before", "value"), F.lit(CONTEXT_CHARS)))
        later = F.collect_list(F.left(F.concat("value", "after"), F.lit(CONTEXT_CHARS)))
        before = F.concat(F.array_join(sooner.over(upto.rowsBetween(-CONTEXT_MATCHES, -1)), ""), "before")
        after = F.concat("after", F.array_join(later.over(upto.rowsBetween(1, CONTEXT_MATCHES)), ""))
        return (
            each.select(
                "row",
                "kind",
                "value",
                (gaps + spent).alias("start"),
                F.right(before, F.lit(CONTEXT_CHARS)).alias("before"),
                F.left(after, F.lit(CONTEXT_CHARS)).alias("after"),
            )
            .where("kind <> 'run' or contains(value, ' ')")
            .where(_valid(F.col("kind"), F.col("value")))
            .select(
                "row",
                "kind",
                "start",
                (F.col("start") + F.length("value")).alias("end"),
                "value",
                F.lower(F.regexp_extract("before", r"(\S+)\s*$", 1)).alias("left"),
                F.lower(F.regexp_extract("after", r"^\s*(\S+)", 1)).alias("right"),
            )
        )

    def _unseen(self) -> DataFrame:
        """Tokens and runs without their outer punctuation that no span of the fixed patterns touches."""
        by = Window.partitionBy("row").orderBy("start", "kind")
        based = ~F.col("kind").isin(*UNSEEN)
        earlier = F.max(F.when(based, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
        later = F.min(F.when(based, F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
        outer = r"^[^\p{L}0-9+(]*+"
        lead = F.length(F.regexp_extract("value", outer, 0))
        trail = F.length(F.regexp_extract(F.reverse("value"), r"^[^\p{L}0-9)]*+", 0))
        return (
            self.spans.withColumn("earlier", F.coalesce(earlier, F.lit(-1)))
            .withColumn("later", F.coalesce(later, F.col("end")))
            .where(~based)
            .where("earlier <= start and later >= end")
            .withColumn("lead", lead)
            .withColumn("trail", trail)
            .where("lead + trail < length(value)")
            .select(
                "row",
                (F.col("start") + F.col("lead")).alias("start"),
                (F.col("end") - F.col("trail")).alias("end"),
                F.expr("substring(value, lead + 1, length(value) - lead - trail)").alias("value"),
                "left",
                "right",
            )
        )

    @staticmethod
    def _patterns() -> Column:
        """The contexts of a row; ends of the text are contexts of their own."""
        return F.array(
            F.concat(F.lit("l "), F.col("left")),
            F.concat(F.lit("r "), F.col("right")),
            F.concat(F.lit("b "), F.col("left"), F.lit(" "), F.col("right")),
        )

    def _discovered(self, area: StageArea) -> DataFrame:
        """Unseen tokens with the kind that their contexts give them."""
        named = self.base.select("kind", "value", F.explode(self._patterns()).alias("pattern"))
        bare = self.tokens.select(F.lit("").alias("kind"), "value", F.explode(self._patterns()).alias("pattern"))
        edges = area.write(named.union(bare).distinct(), "graph")
        accepted = area.write(
            edges.where("kind <> ''").select("kind", "value", F.lit(1.0).alias("trust")).distinct(), "trusted"
        )
        mark = self._mark(accepted)
        while True:
            patterns = area.write(self._confident(edges, accepted), "patterns")
            new = self._accepted(edges, patterns)
            known = edges.where("kind <> ''").select("kind", "value", F.lit(1.0).alias("trust")).distinct()
            accepted = area.write(known.union(new), "trusted")
            before, mark = mark, self._mark(accepted)
            if mark == before:
                break
        occurrences = self.tokens.withColumn("pattern", F.explode(self._patterns()))
        found = (
            occurrences.join(patterns.select("pattern", "kind"), "pattern")
            .join(accepted.where("trust < 1").select("kind", "value"), ["kind", "value"])
            .select("row", "kind", "start", "end")
            .distinct()
        )
        by = Window.partitionBy("row", "kind").orderBy("start", F.desc("end"))
        reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
        return found.withColumn("reached", reached).where("reached is null or reached < end").drop("reached")

    @staticmethod
    def _mark(accepted: DataFrame) -> tuple:
        """Count and an order-free digest of the accepted identifiers and their trust."""
        each = F.xxhash64("kind", "value", F.round("trust", 9))
        return tuple(accepted.agg(F.count("*"), F.bit_xor(each)).first())

    @staticmethod
    def _confident(edges: DataFrame, accepted: DataFrame) -> DataFrame:
        """``pattern, kind, confidence`` of patterns with enough identifiers, mostly of one kind."""
        rated = edges.select("pattern", "value").distinct().join(accepted, "value", "left")
        # A value of two kinds counts once among all values of the pattern.
        sums = [
            F.sum(F.when(F.col("kind") == k, F.col("trust")).otherwise(0.0)).alias(k) for k in KINDS
        ]
        totals = edges.groupBy("pattern").agg(F.count_distinct("value").alias("all"))
        scored = rated.groupBy("pattern").agg(*sums).join(totals, "pattern")
        long = scored.select(
            "pattern",
            "all",
            F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("support")) for k in KINDS])),
        )
        return long.where(
            (F.col("support") >= MIN_SUPPORT) & (F.col("support") >= PATTERN_CONFIDENCE * F.col("all"))
        ).select("pattern", "kind", F.least(F.col("support") / F.col("all"), F.lit(0.999)).alias("confidence"))

    @staticmethod
    def _accepted(edges: DataFrame, patterns: DataFrame) -> DataFrame:
        """Unseen identifiers whose contexts give them enough trust."""
        unseen = edges.where("kind = ''").select("pattern", "value")
        trust = 1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))
        likely = reduce(
            lambda a, b: a | b, [(F.col("kind") == k) & _likely(k, F.col("value")) for k in KINDS]
        )
        return (
            unseen.join(patterns, "pattern")
            .where(likely)
            .groupBy("kind", "value")
            .agg(trust.alias("trust"))
            .where(F.col("trust") >= ACCEPTED)
            .select("kind", "value", F.least("trust", F.lit(0.999)).alias("trust"))
        )

    def listed(self) -> DataFrame:
        """One row per document: counts and digest of the fixed patterns, and all spans."""
        base = self.base.select("row", "kind", "start", "end", F.lit(True).alias("fixed"))
        added = self.added.select("row", "kind", "start", "end", F.lit(False).alias("fixed"))
        order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
        item = F.struct("start", order.alias("order"), "end", "fixed", F.concat_ws(":", "kind", "start", "end").alias("as"))
        sums = [F.count_if((F.col("kind") == k) & F.col("fixed")).alias(f"n_{k}") for k in KINDS]
        every = base.union(added).groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("items"), *sums)
        joined = self.rows.select("row", "id").join(every, "row", "left")
        listed = lambda items: F.array_join(F.transform(items, lambda x: x["as"]), ",")
        fixed = listed(F.filter("items", lambda x: x["fixed"]))
        return joined.select(
            "id",
            *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
            F.sha2(F.coalesce(fixed, F.lit("")), 256).alias("base_sha256"),
            F.coalesce(listed(F.col("items")), F.lit("")).alias("spans"),
        )


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return PersonalData(documents(spark, folder)).listed().withColumnRenamed("id", "doc_id")


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
