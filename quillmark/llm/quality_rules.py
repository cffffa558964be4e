"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule names the columns it needs and when it rejects. A bounded sample gives, in one job, which rules reject
which rows and how many characters, words and lines there are; a rule's cost is the work that its columns take at
these amounts. The next rule is always the one that rejects most of the rows still left per cost of the columns
that no rule before has computed. A column is only computed for rows that no earlier rule has rejected. The order
doesn't change any verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS

#: Rows that the sample, on which costs and rejections are measured, has on average (all rows of a smaller table).
SAMPLE_ROWS = 1000
MIN_WORDS, MAX_REPEATED = 50, 0.5
MAX_SYMBOLS, MAX_DUP_LINES, MAX_CAPITALS, MAX_SHOUTS = 0.1, 0.5, 0.4, 0.5
MEAN_WORD = (2.5, 12.0)


def _t() -> Column:
    return F.coalesce(F.col("_text"), F.lit(""))


def _n(name: str, value: Column) -> tuple[str, Callable[[], Column]]:
    return name, lambda: value


#: How each column follows from ``_text`` and the columns before it. Windows of three words are
#: compared by 64-bit digests. Words of repeated windows are counted from the windows' sorted starts.
FEATURES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "_words": ((), lambda: F.filter(F.split(_t(), SPACE_CLASS + "+"), lambda w: w != "")),
    "n_words": (("_words",), lambda: F.size("_words").cast("long")),
    "word_chars": (("_words",), lambda: F.length(F.array_join("_words", "")).cast("long")),
    "n_symbols": ((), lambda: F.length(F.regexp_replace(_t(), r"[^#*$%&|<>]+", "")).cast("long")),
    "_lines": ((), lambda: F.filter(F.split(_t(), "\n"), lambda x: x.rlike(WORD_CLASS))),
    "n_dup_lines": (("_lines",), lambda: (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")),
    "_n_lines": (("_lines",), lambda: F.size("_lines").cast("long")),
    "_capitals": ((), lambda: F.length(F.regexp_replace(_t(), "[^A-Z]+", "")).cast("long")),
    "_shouts": ((), lambda: F.length(F.regexp_replace(_t(), "[^!]+", "")).cast("long")),
    "_windows": (("_words", "n_words"), lambda: F.when(F.col("n_words") >= 3, F.transform(
        F.slice("_words", F.lit(1), (F.col("n_words") - 2).cast("int")),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))))),
    "_sorted": (("_windows",), lambda: F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))),
    "_starts": (("_sorted",), lambda: F.sort_array(F.transform(
        F.filter("_sorted", lambda s, k: (s["x"] == F.get("_sorted", k + 1)["x"]) | ((k > 0) & (s["x"] == F.get("_sorted", F.greatest(k - 1, F.lit(0)))["x"]))),
        lambda s: s["i"]))),
    "n_repeat_words": (("_starts",), lambda: F.coalesce(F.aggregate(
        F.transform("_starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - p, F.lit(3)))),
        F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")),
}


#: What a column costs for each character, word or line of a text, in the time that looking at a character takes.
#: Values of one measurement; only their ratios matter, and only for the order.
COSTS: dict[str, tuple[str, float]] = {
    "_words": ("chars", 3.0), "n_words": ("rows", 1.0), "word_chars": ("chars", 1.0), "n_symbols": ("chars", 2.0), "_lines": ("chars", 2.0),
    "n_dup_lines": ("lines", 20.0), "_n_lines": ("rows", 1.0), "_capitals": ("chars", 2.0), "_shouts": ("chars", 2.0), "_windows": ("words", 20.0),
    "_sorted": ("words", 60.0), "_starts": ("words", 10.0), "n_repeat_words": ("words", 5.0),
}


@dataclass(frozen=True)
class Rule:
    """``needs``: names in :data:`FEATURES`; ``rejects``: when a row with these columns goes."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[], Column]


RULES = (
    Rule("too_short", ("n_words",), lambda: F.col("n_words") < MIN_WORDS),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda: 100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words")),
    Rule("symbols", ("n_words", "n_symbols"), lambda: F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words")),
    Rule("same_lines", ("n_dup_lines", "_n_lines"), lambda: F.col("n_dup_lines") > MAX_DUP_LINES * F.col("_n_lines")),
    Rule("word_length", ("n_words", "word_chars"), lambda: (F.col("word_chars") < MEAN_WORD[0] * F.col("n_words")) | (F.col("word_chars") > MEAN_WORD[1] * F.col("n_words"))),
    Rule("capitals", ("word_chars", "_capitals"), lambda: F.col("_capitals") > MAX_CAPITALS * F.col("word_chars")),
    Rule("shouts", ("n_words", "_shouts"), lambda: F.col("_shouts") > MAX_SHOUTS * F.col("n_words")),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _needed(names) -> list[str]:
    """The features named and all that they follow from, in an order of computing."""
    out: list[str] = []
    for name in names:
        out += [x for x in [*_needed(FEATURES[name][0]), name] if x not in out]
    return out


def _with(df: DataFrame, names, guard: Column | None) -> DataFrame:
    """Add features and what they need; under ``guard`` other rows get null, at no cost."""
    for name in _needed(names):
        if name not in df.columns:
            value = FEATURES[name][1]()
            df = df.withColumn(name, F.when(guard, value) if guard is not None else value)
    return df


def greedy_order(rules, rejected: dict[int, int], amounts: dict[str, float], given=()) -> list[Rule]:
    """Rules by rows rejected per cost, each counted on the rows and columns that the rules before leave.

    ``rejected``: number of rows by the set of rules that reject them (bit k: rule k). ``given``: columns there anyway.
    """
    left, have, order = dict(enumerate(rules)), set(_needed(given)), []
    while left:
        def worth(k: int) -> tuple[float, int]:
            cost = sum(COSTS[x][1] * amounts[COSTS[x][0]] for x in _needed(left[k].needs) if x not in have)
            return -sum(n for mask, n in rejected.items() if mask >> k & 1) / (cost + amounts["rows"] + 1), k

        k = min(left, key=worth)
        rule = left.pop(k)
        order.append(rule)
        have.update(_needed(rule.needs))
        rejected = {mask: n for mask, n in rejected.items() if not mask >> k & 1}
    return order


def rule_order(texts: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, given=()) -> list[Rule]:
    """The order of the rules by a sample of ``texts`` (_text); as given on an empty sample."""
    sample = texts.sample(min(1.0, sample_rows / max(1, texts.count())), seed=7)
    sample = _with(sample, [x for r in rules for x in r.needs] + ["_n_lines", "n_words"], None)
    mask = sum((F.coalesce(r.rejects(), F.lit(False)).cast("long") * (1 << k) for k, r in enumerate(rules)), F.lit(0).cast("long"))
    amounts = (F.count(F.lit(1)).alias("rows"), F.sum(F.length(_t())).alias("chars"), F.sum("n_words").alias("words"), F.sum("_n_lines").alias("lines"))
    found = sample.groupBy(mask.alias("mask")).agg(*amounts).collect()  # a row for each set of rules that occurs: sample_rows at most
    total = {x: float(sum(r[x] or 0 for r in found)) for x in ("rows", "chars", "words", "lines")}
    return greedy_order(rules, {r["mask"]: r["rows"] for r in found}, total, given)


def quality_cascade(docs: DataFrame, rules=RULES, text: str = "text", report: bool = False, order: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``kept``: false if a rule rejects the text.

    ``report``: also the base counts, for every row (so the cascade saves only what they don't need). A null or
    empty text has no words and is rejected as too short. Equal texts get equal verdicts; repeated rows stay
    repeated; a text of any length is read as a whole; a table without rows gives none. Nothing else of a row is
    read, and columns of any name pass through, but for those named as an output column, which it replaces.
    """
    outputs = (*(BASE if report else ()), "kept")
    df = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in outputs]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    order = order or rule_order(df.select("_text"), rules, given=BASE if report else ())
    if report:
        df = _with(df, BASE, None)
    df = df.withColumn("_alive", F.lit(True))
    for rule in order:
        df = _with(df, rule.needs, F.col("_alive"))
        alive = F.col("_alive") & ~F.coalesce(rule.rejects(), F.lit(False))
        df = df.withColumn("_alive", alive)
    return df.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in outputs], *outputs[:-1], F.col("_alive").alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = quality_cascade(docs, report=True)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *BASE, failed.alias("base_failed"), "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the cascade keeps, under all their columns; null and empty texts go.

    A filter pushed into the cascade would repeat each rule's expression inside all later ones; the
    row number, which the filter also reads, holds it above.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    judged = quality_cascade(whole).withColumn("_n", F.monotonically_increasing_id())
    return judged.where("kept and _n >= 0").select("row.*")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w
), g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), c AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g
), r AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM c, (SELECT unnest(range(3)) AS o) WHERE n >= 2 GROUP BY doc_id
), f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS capitals, length(regexp_replace(t, '[^!]+', '', 'g')) AS shouts
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.1::DOUBLE * n_words
    OR n_dup_lines > 0.5::DOUBLE * n_lines OR word_chars < 2.5::DOUBLE * n_words OR word_chars > 12.0::DOUBLE * n_words
    OR capitals > 0.4::DOUBLE * word_chars OR shouts > 0.5::DOUBLE * n_words) AS kept
FROM f
"""
