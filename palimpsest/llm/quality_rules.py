"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides.

Base figures of a text (words are runs of bytes other than space and \\x09-\\x0D): n_words; word_chars, the code points in
words; n_symbols, the characters #*$%&|<>; n_dup_lines, the \\n-split lines with a word that equal an earlier line;
n_repeat_words, the words in a window of three consecutive words that occurs at least twice in the text, the first included.
base_failed is n_words < 50 or 100 * n_repeat_words > 50 * n_words; such documents are never kept.

Method. Each rule below votes 1 (good), 0 (bad) or abstains, by limits on those figures. Rules come in families: those of one
family look for the same defect in different ways, so that they overlap and may disagree. Texts are good or bad by one of
the defects: a latent class a family, besides the good one. Expectation-maximisation on the counts of vote patterns
estimates the share of each class and how often each rule votes for and against in it, abstentions left out. The
probability of the good class is the posterior; kept is posterior >= 0.5 and not base_failed. So no vote decides by itself:
a vote against that other rules of its family contradict is outvoted if EM finds that rule to raise false alarms, and
counts if it finds it reliable.

Scale. One pass makes figures and votes; the pattern counts (at most 3 ** 11 rows, whatever the corpus) go to the driver,
where EM runs over weighted patterns; the posteriors go back as a broadcast lookup of that bounded size. What the pass makes
is written to the shared folder, so that texts are read and worked on once; they are never shuffled.

Defined results. Null text: as empty (figures 0, base_failed). Empty table: no rows. Repeated rows count and are judged
each. Null ids are carried. Very long texts are worked on whole. Columns of the input stay; the added ones replace columns of
the same name. A text on which all rules abstain has the share of good texts for its posterior.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import core, weak

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_symbol_words", "n_capital_words", "n_digit_words", "n_distinct")
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: Each rule: family, name, condition of a bad vote, condition of a good vote; neither: it abstains. Figures as above;
#: n_upper counts ASCII capitals, n_digits ASCII digits; n_symbol_words, n_capital_words and n_digit_words the words with a
#: symbol, with two capitals or more and no small letter, and with a digit; n_distinct the different words.
RULES = (
    ("symbols", "symbols_by_word", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("symbols", "words_with_symbols", "8 * n_symbol_words > n_words", "50 * n_symbol_words <= n_words"),
    ("symbols", "symbols_by_character", "25 * n_symbols > word_chars", "250 * n_symbols <= word_chars"),
    ("copies", "repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    ("copies", "lines", "10 * n_dup_lines > 3 * n_lines and n_dup_lines > 2", "10 * n_dup_lines <= n_lines"),
    ("copies", "vocabulary", "n_distinct * n_distinct < 4 * n_words", "n_distinct * n_distinct >= 20 * n_words"),
    ("capitals", "capitals_by_character", "10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    ("capitals", "words_in_capitals", "4 * n_capital_words > n_words", "10 * n_capital_words <= n_words"),
    ("form", "digits", "4 * n_digits > word_chars", "20 * n_digits <= word_chars"),
    ("form", "words_with_digits", "3 * n_digit_words > n_words", "10 * n_digit_words <= n_words"),
    ("form", "word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words", "word_chars >= 3 * n_words and word_chars <= 9 * n_words"),
)
FAMILIES = tuple(dict.fromkeys(r[0] for r in RULES))
#: Where EM starts: in good texts a rule votes for in 8 of 10 votes; in texts with a defect the rules of its family vote
#: against as often, the others for and against alike; 7 texts of 10 are good.
RIGHT, GOOD = 0.8, 0.7


def figures(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The figures of each row of a chunk."""
    rows = len(offs) - 1
    s, e = core.runs(buf, offs, core.IS_WORD)
    at = core.row_spans(s, offs)
    words = np.diff(at)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offs[1:]] - total[offs[:-1]]

    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    starts = core.IS_WORD[buf] & ((buf & 0xC0) != 0x80)  # code points, not continuation bytes
    upper, digit = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57)

    def in_words(flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each word holds."""
        total = np.append(0, np.cumsum(flags))
        return total[e] - total[s]

    def per_row(words_: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(words_))
        return total[at[1:]] - total[at[:-1]]

    shout = (in_words(upper) > 1) & (in_words((buf >= 97) & (buf <= 122)) == 0)
    ls, le, n_lines = core.line_spans(buf, offs)
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(core.IS_WORD[buf], out=total[1:])
    on = total[le] > total[ls]
    line_rows = np.repeat(np.arange(rows), n_lines)[on]
    dup = np.bincount(line_rows[_again(core.hash_spans(buf, ls[on], le[on]), line_rows)], minlength=rows)

    h = core.hash_spans(buf, s, e)
    word_rows = np.repeat(np.arange(rows), words)
    distinct = words - np.bincount(word_rows[_again(h, word_rows)], minlength=rows)
    g = core.windows(h, 3)
    n = np.maximum(words - 2, 0)
    idx = core.ranges(at[:-1], n)
    twice = _shared(g[idx], np.repeat(np.arange(rows), n))
    mark = np.zeros(len(s) + 1, np.int64)
    first = idx[twice]
    np.add.at(mark, first, 1)
    np.add.at(mark, first + 3, -1)
    covered = np.append(0, np.cumsum(np.cumsum(mark[:-1]) > 0))
    return {
        "n_words": words,
        "word_chars": count(starts),
        "n_symbols": count(symbol[buf]),
        "n_dup_lines": dup,
        "n_repeat_words": covered[at[1:]] - covered[at[:-1]],
        "n_lines": np.bincount(line_rows, minlength=rows),
        "n_upper": count(upper),
        "n_digits": count(digit),
        "n_symbol_words": per_row(in_words(symbol[buf]) > 0),
        "n_capital_words": per_row(shout),
        "n_digit_words": per_row(in_words(digit) > 0),
        "n_distinct": distinct,
    }


def _again(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Flags of the items whose value occurred earlier in the same row."""
    order = np.lexsort((h, rows))
    s, r = h[order], rows[order]
    out = np.zeros(len(h), bool)
    out[order[1:][(s[1:] == s[:-1]) & (r[1:] == r[:-1])]] = True
    return out


def _shared(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Flags of the items whose value occurs twice or more in the same row."""
    order = np.lexsort((h, rows))
    s, r = h[order], rows[order]
    same = (s[1:] == s[:-1]) & (r[1:] == r[:-1])
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _figures(keep_text: bool = False) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _with_figures(batch, keep_text)

    return run


def _with_figures(batch: pa.RecordBatch, keep_text: bool) -> pa.RecordBatch:
    parts = [figures(buf, offs) for _, _, buf, offs in core.chunks(batch.column("text"))]
    return core.batch_of(**{c: batch.column(c) for c in batch.schema.names if c != "text" or keep_text}, **{k: pa.array(np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]).astype(np.int64)) for k in FIGURES})


def votes() -> Column:
    """The vote pattern: a character a rule, 1 good, 0 bad, ? abstains."""
    return F.concat(*[F.expr(f"case when {bad} then '0' when {good} then '1' else '?' end") for _, _, bad, good in RULES])


def begin() -> tuple[np.ndarray, np.ndarray]:
    """Starting table [class, rule, vote] and shares: a class for each family, the good one last."""
    against = np.array([[RIGHT if r[0] == f else 0.5 for r in RULES] for f in FAMILIES] + [[1 - RIGHT] * len(RULES)])
    table = np.stack([np.full(against.shape, 1e-3), against, 1 - against], 2)
    return table, np.array([(1 - GOOD) / len(FAMILIES)] * len(FAMILIES) + [GOOD])


def _posteriors(made: DataFrame) -> DataFrame:
    """(votes, posterior): a table of at most 3 ** len(RULES) rows, whatever the corpus."""
    patterns = {r["votes"]: r["n"] for r in made.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    return made.sparkSession.createDataFrame(list(weak.fit(patterns, *begin())[2].items()), "votes string, posterior double")


FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _judged(made: DataFrame) -> DataFrame:
    return made.join(F.broadcast(_posteriors(made)), "votes").withColumn("kept", (F.col("posterior") >= 0.5) & ~F.col("base_failed"))


def quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without ``text``, with the figures, base_failed, posterior and kept."""
    keyed = core.wrap(docs, *ADDED)
    figured = keyed.mapInArrow(_figures(), core.out_schema(keyed, "row", "key", **{c: "bigint" for c in FIGURES}))
    made = core.cut(figured.select("row", *FIGURES[:5], F.expr(FAILED).alias("base_failed"), votes().alias("votes")))
    return core.unwrap(_judged(made), docs, *ADDED, text=False)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Texts that fail the base test are not written again."""
    keyed = core.wrap(docs)
    figured = keyed.mapInArrow(_figures(keep_text=True), core.out_schema(keyed, *keyed.columns, **{c: "bigint" for c in FIGURES}))
    failed = F.expr(FAILED)
    made = core.cut(figured.select("row", F.when(~failed, F.col("text")).alias("text"), failed.alias("base_failed"), votes().alias("votes")))
    return core.unwrap(_judged(made).where("kept"), docs)
