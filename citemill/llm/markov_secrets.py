"""Secret scans: patterns for known forms, character Markov models for the rest.

Two first-order models give the probability of a character after another: one for
random strings, trained on what the patterns caught, one for ordinary identifiers,
trained on words of a bounded sample of documents and on words joined to longer names.
Both are mixed with equal chances, by a share that does not depend on the counts, so
they behave alike at every size. A candidate is a run of at least 20 token characters;
it is a secret where the mean log-likelihood ratio of its transitions exceeds a
threshold, which is fitted on labelled strings that the models compared for it have
not seen. UUIDs, which name things, are none. A secret that holds a known form is a
span of its own; only one that lies within a known form adds nothing.

Only column functions. Spans are in code points, end exclusive. Each pattern splits
the text; the lengths of the pieces and of the matches add up to places. Sums run
in blocks, so a text with very many matches costs little more than its length.

Null text counts as empty and has no spans. Repeated rows give repeated results.
On an empty table the models say nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.catalog import register
from citemill.llm.common import staged, table, texts

# The patterns of the known forms, in the order of their kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
ASSIGN_VALUE_MIN = 12
KINDS = ("assign", "access", "hex", "markov")

# The look-behind keeps a failed run from being tried again at each of its characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
# Documents, in expectation, whose words train the identifier model.
TRAIN_DOCUMENTS = 1000
# Share of equal chances in each model, and the threshold's place: the least at which so few
# identifiers are called random, moved by a part of the way to where random strings begin.
RANDOM_MIX = 0.5
IDENTIFIER_MIX = 0.005
FALSE_SHARE = 0.001
MISSED_SHARE = 0.01
MARGIN = 0.5
SCORE_STEPS = 20
THRESHOLD = 1.0  # without labelled strings of both kinds
# Fixed value: the form of a UUID.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
SUM_BLOCK = 512


def running_sums(values: Column) -> Column:
    """Sums of all values before each place."""

    def add(total: Column, x: Column) -> Column:
        return total + x

    def append(sums: Column, x: Column) -> Column:
        return F.array_append(sums, F.element_at(sums, -1) + x)

    zero = F.lit(0)
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(SUM_BLOCK))
    blocks = F.transform(starts, lambda i: F.slice(values, i, SUM_BLOCK))
    block_sums = F.transform(blocks, lambda block: F.aggregate(block, zero, add))
    before = F.aggregate(block_sums, F.array(zero), append)
    return F.flatten(
        F.zip_with(
            blocks,
            F.slice(before, F.lit(1), F.size(blocks)),
            lambda block, base: F.slice(
                F.aggregate(block, F.array(base), append), F.lit(1), F.size(block)
            ),
        )
    )


def matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Array of (start, end, value) of a pattern's matches, leftmost first."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    # One-element arrays bind what the inner functions use more than once.
    parts = F.struct(found.alias("found"), gaps.alias("gaps"), value.alias("value"), steps.alias("steps"))

    def placed(p: Column) -> Column:
        return F.transform(
            F.arrays_zip(
                running_sums(p["steps"]).alias("before"),
                F.slice(p["gaps"], F.lit(1), F.size(p["found"])).alias("gap"),
                p["found"].alias("match"),
                p["value"].alias("value"),
            ),
            lambda m: F.struct(
                (m["before"] + F.length(m["gap"])).alias("start"),
                (m["before"] + F.length(m["gap"]) + F.length(m["match"])).alias("end"),
                m["value"].alias("value"),
            ),
        )

    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), F.flatten(F.transform(F.array(parts), placed))).otherwise(empty)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the text ``t``, and the arrays assign, access and hex of its spans."""
    rows = docs.select("doc_id", texts(F.col("text")).alias("t"))
    t = F.col("t")
    return rows.select(
        "doc_id",
        "t",
        F.filter(
            matches(t, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_VALUE_MIN
        ).alias("assign"),
        matches(t, ACCESS).alias("access"),
        matches(t, HEX).alias("hex"),
    )


def _code(character: Column) -> Column:
    """A character's place in the alphabet, from 1; 0 for none."""
    return F.instr(F.lit(ALPHABET), character)


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each transition, row by row of the alphabet, and the threshold of their mean."""

    ratios: list[float]
    threshold: float


def labelled_strings(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """random, s, fold (0 or 1): strings known to be random or ordinary.

    Values that the patterns caught, in all documents, are random. Words of a hashed
    sample of about ``documents`` documents are ordinary, and so are runs of four words
    there, put together as names are: with marks between them, in capitals, with dates.
    Equal strings are in one fold.
    """
    rows = docs.select("doc_id", texts(F.col("text")).alias("text"))
    share = min(1.0, documents / max(1, rows.count()))
    chosen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))
    labelled = rows.where(
        chosen | F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX)
    )
    spans = base_spans(labelled)
    caught = F.concat("assign", "access", "hex")
    no_secrets = F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = F.regexp_extract_all(no_secrets, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))

    def names(w: Column) -> Column:
        starts = F.when(F.size(w) >= 4, F.sequence(F.lit(1), F.size(w) - 3, F.lit(4))).otherwise(F.array().cast("array<int>"))

        def name(i: Column) -> Column:
            parts = F.slice(w, i, F.lit(4))
            day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.pmod(F.xxhash64(F.get(w, i)), F.lit(9999)).cast("int")), "yyyy-MM-dd")
            forms = (
                F.array_join(parts, "_"),
                F.array_join(parts, "-"),
                F.array_join(parts, "/"),
                F.array_join(F.transform(parts, F.initcap), ""),
                F.upper(F.array_join(parts, "_")),
                F.concat_ws("-", day, parts),
                F.concat_ws("_", parts, F.replace(day, F.lit("-"))),
            )
            kind, chosen_form = F.pmod(F.floor(i / 4), F.lit(len(forms))), None
            for number, form in enumerate(forms):
                chosen_form = F.when(kind == number, form) if chosen_form is None else chosen_form.when(kind == number, form)
            return chosen_form

        return F.transform(starts, name)

    ordinary = F.when(chosen, words).otherwise(F.array().cast("array<string>"))
    both = F.transform(F.array(ordinary), lambda w: F.concat(w, names(w)))[0]
    strings = spans.select(
        F.explode(
            F.concat(
                F.transform(caught, lambda m: F.struct(F.lit(True).alias("random"), m["value"].alias("s"))),
                F.transform(both, lambda w: F.struct(F.lit(False).alias("random"), w.alias("s"))),
            )
        ).alias("x")
    ).select("x.*").where(F.length("s") > 1)
    return strings.withColumn("fold", F.pmod(F.xxhash64("s", F.lit("fold")), F.lit(2)).cast("int"))


def ratios_of(counts: dict[tuple[bool, str], int]) -> list[float]:
    """Log-likelihood ratios from the transitions counted in random and ordinary strings."""
    size, found = len(ALPHABET), []
    for a in ALPHABET:
        logs = []
        for random, mix in ((True, RANDOM_MIX), (False, IDENTIFIER_MIX)):
            row = [counts.get((random, a + b), 0) for b in ALPHABET]
            total = sum(row)
            logs.append([math.log(mix / size + (1 - mix) * (n / total if total else 1 / size)) for n in row])
        found += [r - i for r, i in zip(*logs)]
    return found


def fitted_threshold(scores: dict[tuple[bool, int], int]) -> float:
    """The threshold from counts of scores, in steps, of random and ordinary strings."""
    steps = sorted({step for _, step in scores})
    total = {random: sum(n for (r, _), n in scores.items() if r is random) for random in (True, False)}
    if not all(total.values()):
        return THRESHOLD

    def share(random: bool, step: int, above: bool) -> float:
        return sum(n for (r, s), n in scores.items() if r is random and (s >= step) is above) / total[random]

    tried = range(steps[0], steps[-1] + 2)
    low = next(t for t in tried if share(False, t, True) <= FALSE_SHARE)
    high = max((t for t in tried if share(True, t, False) <= MISSED_SHARE), default=low)
    return (low + MARGIN * max(0, high - low)) / SCORE_STEPS


def train(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Model:
    """The models of the labelled strings, and the threshold fitted on strings held out of them.

    What reaches the driver are counts: at most four per pair of alphabet characters,
    and two per step of the score.
    """
    strings = staged(labelled_strings(docs, documents), "labelled-strings")
    pairs = strings.select(
        "random", "fold",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, 2))).alias("pair"),
    )
    counted = pairs.groupBy("random", "fold", "pair").agg(F.count("*").alias("n")).where(
        (_code(F.substring("pair", 1, 1)) > 0) & (_code(F.substring("pair", 2, 1)) > 0)
    )
    first: dict[tuple[bool, str], int] = {}
    every: dict[tuple[bool, str], int] = {}
    for r in counted.collect():
        every[r.random, r.pair] = every.get((r.random, r.pair), 0) + r.n
        if r.fold == 0:
            first[r.random, r.pair] = r.n
    held_out = strings.where((F.col("fold") == 1) & F.col("s").rlike(f"^{CANDIDATE}$"))
    step = F.floor(likelihood_ratio(F.col("s"), ratios_of(first)) * SCORE_STEPS).cast("int")
    scores = {(r.random, r.step): r.n for r in held_out.groupBy("random", step.alias("step")).agg(F.count("*").alias("n")).collect()}
    return Model(ratios_of(every), fitted_threshold(scores))


def likelihood_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions, random over identifier."""
    model = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    size = len(ALPHABET)

    def step(total: Column, i: Column) -> Column:
        cell = (_code(F.substring(token, i, F.lit(1))) - 1) * size + _code(F.substring(token, i + 1, F.lit(1))) - 1
        return total + F.get(model, cell)

    places = F.sequence(F.lit(1), F.length(token) - 1)
    return F.aggregate(places, F.lit(0.0), step) / (F.length(token) - 1)


def is_random(token: Column, model: Model) -> Column:
    """Whether the models call a candidate random."""
    return ~token.rlike(f"^{UUID}$") & (likelihood_ratio(token, model.ratios) > model.threshold)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text ``t`` and the arrays assign, access, hex and markov of (start, end, value)."""

    def adds(m: Column) -> Column:
        """Not within a span that is there already."""
        return ~F.exists(
            F.concat("assign", "access", "hex"), lambda a: (a["start"] <= m["start"]) & (m["end"] <= a["end"])
        )

    spans = base_spans(docs).withColumn(
        "likely", F.filter(matches(F.col("t"), CANDIDATE), lambda m: is_random(m["value"], model))
    )
    return spans.withColumn("markov", F.filter("likely", adds)).drop("likely")


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of these kinds, by start and kind, comma-joined."""
    def numbered(kind: str) -> Column:
        return F.transform(
            kind,
            lambda m: F.struct(
                m["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("k"),
                m["end"].alias("end"),
                F.lit(kind).alias("kind"),
            ),
        )

    return F.array_join(
        F.transform(
            F.sort_array(F.concat(*map(numbered, kinds))),
            lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string")),
        ),
        ",",
    )


def redact(docs: DataFrame, model: Model, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every secret replaced; clean texts stay as they are.

    Assignments go first, then whole candidates that the models call random, so that
    nothing of a secret around a known form is left, then the other patterns.
    ``n_chars`` follows where the text changed.
    """

    def replaced(text: Column, pattern: str, group: int, is_secret) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        pieces = F.arrays_zip(
            F.split(text, pattern, -1).alias("gap"), found.alias("match"), value.alias("value")
        )
        written = F.transform(
            pieces,
            lambda p: F.concat(
                p["gap"],
                F.when(p["match"].isNull(), "").when(is_secret(p["value"]), mark).otherwise(p["match"]),
            ),
        )
        return F.when(text.rlike(pattern), F.array_join(written, "")).otherwise(text)

    t = F.col("t")
    steps = (
        docs.select(F.struct("*").alias("row"), F.col("text").alias("t"))
        .withColumn("t", replaced(t, ASSIGN, 2, lambda v: F.length(v) >= ASSIGN_VALUE_MIN))
        .withColumn("t", replaced(t, CANDIDATE, 0, lambda v: is_random(v, model)))
        .withColumn("t", F.regexp_replace(t, f"{ACCESS}|{HEX}", F.lit(mark)))
    )
    changed = {
        "text": t,
        "n_chars": F.when(t.eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(
            F.length(t).cast("long")
        )
        if "n_chars" in docs.columns
        else None,
    }
    return steps.select(
        *(
            (changed[name] if name in changed else F.col("row")[name]).alias(name)
            for name in docs.columns
        )
    )


@register("op3_markov_secrets")
def op3_markov_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = scan(docs, train(docs))
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
    )
