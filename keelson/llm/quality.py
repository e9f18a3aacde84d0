"""Quality rules as weak supervision.

Each rule looks at a few counts of a document and votes good (+1), bad (-1) or abstains (0).
A document thus has a vote pattern; with R rules there are at most 3^R patterns, whatever the
corpus holds, so the pattern counts are the only thing the driver sees.  Expectation-maximisation
over these counts estimates how good documents are split (the prior) and, for each rule and each
true class, how often its votes are right.  A document's posterior probability of being good
is then a sum of log-odds over its votes, evaluated inside Spark's expressions.  It replaces the
usual "all rules must pass": a rule that fires on good documents too has little weight.

Defined results for odd input: a null or empty text has no words, fails the base test and is
rejected; texts of any length are counted whole; equal rows get equal verdicts, each row its own; ids are not looked at and may be null; an
empty table gives an empty result (the model is then the prior); columns of the input are kept, and a computed column whose name is taken (ignoring case)
gets a numbered name, see ``added_columns``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fresh_name, utf8_values

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
#: Bytes of ASCII letters and of all code points beyond ASCII.
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
WITH_SYMBOL = re.compile(b"[" + re.escape(SYMBOLS) + b"]")
MIN_WORDS = 50
#: A base failure as well: more than this share (in hundredths) of the words lies in repeated 3-word windows.
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct", "n_symbol_words", "n_letters", "n_other")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in ``words``, first occurrences included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    starts = [i for i, w in enumerate(windows) if seen[w] > 1]
    return 3 + sum(min(3, b - a) for a, b in pairwise(starts))


def text_counts(text: bytes | None, n_chars: int) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text; ``n_chars`` is its number of code points."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    return (
        len(words),
        n_chars - (len(text) - len(text.translate(None, WHITE))),
        n_symbols,
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, UPPER)),
        text.count(b"!") + text.count(b"?"),
        len(set(words)),
        sum(1 for w in words if WITH_SYMBOL.search(w)) if n_symbols else 0,
        len(text) - len(text.translate(None, LETTERS)),
        len(text.translate(None, LETTERS + WHITE)),
    )


def added_columns(columns: list[str]) -> dict[str, str]:
    """For each computed column its name beside ``columns``."""
    out: dict[str, str] = {}
    for c in (*COUNTS, "base_failed", "posterior", "kept"):
        out[c] = fresh_name(c, [*columns, *out.values()])
    return out


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``COUNTS`` (long) appended."""
    names = added_columns(docs.columns)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[c], T.LongType()) for c in COUNTS)])
    where = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            column = b.column(where)
            sizes = pc.utf8_length(column).to_pylist()
            rows = np.array([text_counts(t, n) for t, n in zip(utf8_values(column), sizes, strict=True)], dtype=np.int64).reshape(-1, len(COUNTS))
            arrays = [*b.columns, *(pa.array(rows[:, i]) for i in range(len(COUNTS)))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names, *(names[c] for c in COUNTS)])

    return arrow_map(docs, run, schema)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rule_votes(names: dict[str, str]) -> dict[str, Column]:
    """Rule name -> vote expression over the count columns.

    Each kind of junk is seen by two or three rules from different sides: a rule that nothing else backs
    is what the model takes for noise.
    """
    n = {c: F.col(f"`{names[c]}`").cast("double") for c in COUNTS}
    words, chars, lines = (F.greatest(n[c], F.lit(1.0)) for c in ("n_words", "word_chars", "n_lines"))
    enough, letters = n["n_words"] >= 20, n["n_letters"] / F.greatest(n["n_letters"] + n["n_other"], F.lit(1.0))
    return {
        "length": _vote(n["n_words"] < 10, n["n_words"] >= 100),
        "repeats": _vote(n["n_repeat_words"] > 0.30 * words, enough & (n["n_repeat_words"] < 0.10 * words)),
        "symbols": _vote(n["n_symbols"] > 0.25 * words, n["n_symbols"] < 0.02 * words),
        "symbol_words": _vote(n["n_symbol_words"] > 0.15 * words, n["n_symbol_words"] < 0.02 * words),
        "letters": _vote(letters < 0.85, letters > 0.93),
        "capitals": _vote(n["n_upper"] > 0.40 * chars, n["n_upper"] < 0.10 * chars),
        "lines": _vote((n["n_dup_lines"] > 0.30 * lines) & (n["n_dup_lines"] >= 2), (n["n_dup_lines"] == 0) & (n["n_lines"] >= 2)),
        "word_length": _vote((chars < 2.5 * words) | (chars > 14.0 * words), (chars > 3.0 * words) & (chars < 9.0 * words)),
        "marks": _vote(n["n_marks"] > 0.20 * words, n["n_marks"] < 0.03 * words),
        "variety": _vote(enough & (n["n_distinct"] < 0.15 * words), enough & (n["n_distinct"] > 0.30 * words)),
    }


@dataclass(frozen=True)
class LabelModel:
    """Class prior and, for each rule, log-odds that a good or a bad vote adds."""

    prior_good: float
    right_if_good: tuple[float, ...]
    right_if_bad: tuple[float, ...]

    def log_odds(self, rule: int) -> tuple[float, float]:
        """What a good vote and a bad vote of ``rule`` add to the log-odds of good."""
        g, b = self.right_if_good[rule], self.right_if_bad[rule]
        return float(np.log(g / (1 - b))), float(np.log((1 - g) / b))


#: Votes that the priors of a rule's accuracies are worth, whatever the corpus holds, and their means for good and for bad documents.
PSEUDO_VOTES, GOOD_MEAN, BAD_MEAN = 4.0, 0.95, 0.5
#: Documents that the prior of the share of good ones is worth, and its mean.
PSEUDO_DOCS, SHARE_MEAN = 10.0, 0.8
#: Where the estimation starts: chance of good without a bad vote, with one, with more.
START = (0.95, 0.3, 0.02)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation over vote patterns.

    ``patterns`` is (P, R) of -1, 0, 1 and ``counts`` how many documents have each.  Given the class,
    rules are taken as independent, and abstaining says nothing.  Each round weighs every pattern by its chance of being good, then
    estimates the share of good documents and, for each rule and class, the share of right ones among its votes.
    Beta priors of a few votes keep shares inside (0, 1); they don't grow with the corpus, so data outweigh them.  The
    start (two bad votes: very probably bad) ties the classes to the votes' meaning, so they can't swap.
    """
    plus, minus = (patterns == 1).astype(float), (patterns == -1).astype(float)
    weight, bad_votes = counts.astype(float), minus.sum(1)
    good = np.select([bad_votes > 1, bad_votes > 0], [START[2], START[1]], START[0])
    last = np.inf
    for _ in range(rounds):
        g, b = weight * good, weight * (1 - good)
        prior = (g.sum() + PSEUDO_DOCS * SHARE_MEAN) / (weight.sum() + PSEUDO_DOCS)
        if_good = (g @ plus + PSEUDO_VOTES * GOOD_MEAN) / (g @ (plus + minus) + PSEUDO_VOTES)
        if_bad = (b @ minus + PSEUDO_VOTES * BAD_MEAN) / (b @ (plus + minus) + PSEUDO_VOTES)
        logit = np.log(prior / (1 - prior)) + plus @ np.log(if_good / (1 - if_bad)) + minus @ np.log((1 - if_good) / if_bad)
        good = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
        change, last = abs(prior - last), prior
        if change < tolerance:
            break
    return LabelModel(float(prior), tuple(map(float, if_good)), tuple(map(float, if_bad)))


def learn(counted: DataFrame, names: dict[str, str]) -> LabelModel:
    """Fit the model to all rows of a table with ``COUNTS`` columns; at most 3^rules rows reach the driver."""
    votes = rule_votes(names)
    cols = [v.alias(f"v{i}") for i, v in enumerate(votes.values())]
    found = counted.select(*cols).groupBy(*(f"v{i}" for i in range(len(cols)))).count().collect()
    grid = np.array([[r[i] for i in range(len(cols))] for r in found], dtype=np.int64).reshape(-1, len(cols))
    return fit_label_model(grid, np.array([r["count"] for r in found], dtype=np.int64))


def judge(counted: DataFrame, model: LabelModel, names: dict[str, str]) -> DataFrame:
    """Append base_failed, posterior and kept to a table with ``COUNTS`` columns."""
    n = {c: F.col(f"`{names[c]}`") for c in COUNTS}
    logit = F.lit(float(np.log(model.prior_good / (1 - model.prior_good))))
    for i, vote in enumerate(rule_votes(names).values()):
        yes, no = model.log_odds(i)
        logit = logit + F.when(vote == 1, F.lit(yes)).when(vote == -1, F.lit(no)).otherwise(F.lit(0.0))
    failed = (n["n_words"] < MIN_WORDS) | (100 * n["n_repeat_words"] > MAX_REPEAT_PERCENT * n["n_words"])
    posterior = 1 / (1 + F.exp(-logit))
    return (
        counted.withColumn(names["base_failed"], failed)
        .withColumn(names["posterior"], posterior)
        .withColumn(names["kept"], ~F.col(f"`{names['base_failed']}`") & (F.col(f"`{names['posterior']}`") >= 0.5))
    )
