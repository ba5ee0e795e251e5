"""Quality rules: a decision list learned by sequential covering from labelled text statistics.

Spark computes the statistics of every whole text (Arrow batches, numpy). From a bounded sample
of labelled documents, rules are grown one condition (statistic <= or >= threshold) at a time by
information gain, pruned on held-back rows, and kept while they are precise; the rows that a rule
covers leave the sample before the next. The list becomes one ordered Spark conditional expression.

Cases: null text counts as empty; empty texts have all statistics 0 and fail the base rule
(fewer than 50 words); repeated rows are each judged alike; without labels of both kinds the list is
empty and only the base rule rejects; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .storage import as_rows
from .textbatch import Words, mix, pieces, range_hash

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_doubles")
SAMPLE_ROWS = 20_000
_is = {name: np.isin(np.arange(256), np.frombuffer(chars.encode(), np.uint8)) for name, chars in
       (("symbol", SYMBOLS), ("mark", "!?.,;:"), ("digit", "0123456789"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", "abcdefghijklmnopqrstuvwxyz"))}


def _per(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _dup_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text; n_repeat_words by 64-bit hashes of three-word windows within a text."""
    w = Words(column)
    hashes, b = w.hashes(), w.bytes
    first = w.windows(3)
    window = range_hash(hashes, first, first + 3)
    owner = w.owners()
    keys = mix(window + owner[first].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(w), dtype=bool)
    for k in range(3):
        covered[first[twice] + k] = True
    upper = np.zeros(len(b) + 1, dtype=np.int64)
    np.cumsum(_is["upper"][b], out=upper[1:])
    lower = np.zeros(len(b) + 1, dtype=np.int64)
    np.cumsum(_is["lower"][b], out=lower[1:])
    in_word = np.zeros(len(b) + 1, dtype=np.int8)
    np.add.at(in_word, w.starts, 1)
    np.add.at(in_word, w.ends, -1)
    points = ((b & 0xC0) != 0x80) & (np.cumsum(in_word[:-1]) > 0)
    shouted = (upper[w.ends] - upper[w.starts] > 1) & (lower[w.ends] == lower[w.starts])
    doubled = np.zeros(len(w), dtype=bool)
    doubled[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    return {
        "n_words": w.counts.astype(np.int64), "word_chars": _per(points, w.offsets), "n_symbols": _per(_is["symbol"][b], w.offsets),
        "n_dup_lines": np.array([_dup_lines(x) for x in column.to_pylist()], dtype=np.int64), "n_repeat_words": _per(covered, w.docs),
        "n_upper_words": _per(shouted, w.docs), "n_upper": upper[w.offsets[1:]] - upper[w.offsets[:-1]], "n_digits": _per(_is["digit"][b], w.offsets),
        "n_marks": _per(_is["mark"][b], w.offsets), "n_lines": _per(b == 10, w.offsets) + 1, "n_doubles": _per(doubled, w.docs),
    }


def with_counts(documents: DataFrame) -> DataFrame:
    """documents with a struct column _counts; all other columns pass through whatever their names."""
    own = as_rows(documents)

    def with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field("text").cast(pa.string())], names=["row", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(map(with_text, batches)):
            counts = text_counts(piece.column(1))
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(counts[c]) for c in COUNTS)], names=["row", *COUNTS])

    schema = own.select("row").schema  # a copy: add() changes it
    for c in COUNTS:
        schema = schema.add(c, "long")
    return own.mapInArrow(run, schema)


def statistics() -> dict[str, Column]:
    """What rules test: counts made independent of length."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words") * 1.0, "word_length": F.col("word_chars") / words, "symbols": F.col("n_symbols") / words, "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words, "shouted": F.col("n_upper_words") / words, "upper": F.col("n_upper") / chars, "digits": F.col("n_digits") / chars,
        "marks": F.col("n_marks") / words, "doubles": F.col("n_doubles") / words,
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.statistic)]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self, stats: dict[str, Column]) -> Column:
        return stats[self.statistic] >= self.threshold if self.above else stats[self.statistic] <= self.threshold


def _covered(rule: list[Condition], x: np.ndarray, names: list[str]) -> np.ndarray:
    held = np.ones(len(x), dtype=bool)
    for c in rule:
        held &= c.holds(x, names)
    return held


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], longest: int, cuts: int) -> list[Condition]:
    rule: list[Condition] = []
    held = np.ones(len(x), dtype=bool)
    while len(rule) < longest and (held & ~bad).any():
        p, n = (held & bad).sum(), (held & ~bad).sum()
        base, best = np.log2(p / (p + n)) if p else 0.0, (1e-9, None)
        for name in names:
            v = x[:, names.index(name)]
            levels = np.unique(np.quantile(v[held], np.linspace(0, 1, cuts)))
            levels = np.unique(np.concatenate((levels, (levels[1:] + levels[:-1]) / 2)))
            for above in (True, False):
                for t in levels.tolist():
                    c = Condition(name, above, t)
                    now = held & (v >= t if above else v <= t)
                    pos = (now & bad).sum()
                    if pos and (gain := pos * (np.log2(pos / now.sum()) - base)) > best[0]:
                        best = (gain, c)
        if best[1] is None:
            break
        rule.append(best[1])
        held &= best[1].holds(x, names)
    return rule


def _worth(rule: list[Condition], x: np.ndarray, bad: np.ndarray, names: list[str]) -> float:
    held = _covered(rule, x, names)
    p, n = (held & bad).sum(), (held & ~bad).sum()
    return float((p - n) / (p + n)) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.9, least: int = 5, most_rules: int = 12, longest: int = 3, cuts: int = 24) -> list[list[Condition]]:
    """Ordered rules whose conditions all hold for (nearly only) bad rows. Every third row is held back for pruning."""
    rules: list[list[Condition]] = []
    back = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    while len(rules) < most_rules and (left & bad & ~back).sum() >= least and (left & ~bad).any():
        grown = _grow(x[left & ~back], bad[left & ~back], names, longest, cuts)
        if not grown:
            break
        held_x, held_bad = x[left & back], bad[left & back]
        best = max((grown[:k] for k in range(len(grown), 0, -1)), key=lambda r: _worth(r, held_x, held_bad, names))
        hit = _covered(best, x, names) & left
        if (hit & bad).sum() < max(least, precision * hit.sum()) or _worth(best, held_x, held_bad, names) < 2 * precision - 1:
            break
        rules.append(best)
        left &= ~hit
    return rules


def fit_rules(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """Rules from at most sample_rows labelled documents (the documented bound of what reaches the driver)."""
    stats = statistics()
    sample = with_counts(labelled_sample(documents, labels, sample_rows)).select("row.doc_id", "row.quality", *(c.alias(name) for name, c in stats.items())).toPandas()
    sample = sample.sort_values("doc_id", kind="stable")
    if sample["quality"].nunique() < 2:
        return []
    return learn(sample[list(stats)].to_numpy(dtype=float), sample["quality"].to_numpy() == 0, list(stats))


def rule_column(rules: list[list[Condition]]) -> Column:
    """Number (from 1) of the first rule that rejects a row with COUNTS; null where none does."""
    stats, chosen = statistics(), F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        condition = F.lit(True)
        for c in rules[k - 1]:
            condition = condition & c.column(stats)
        chosen = F.when(condition, F.lit(k)).otherwise(chosen)
    return chosen


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """row (struct of the input's columns), COUNTS, base_failed, rule and kept."""
    rules = fit_rules(documents, labels, sample_rows)
    judged = with_counts(documents).withColumns({"base_failed": base_failed(), "rule": rule_column(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_documents(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of documents that the base rule and the learned list keep."""
    return judge(documents, labels, sample_rows).filter("kept").select("row.*")
