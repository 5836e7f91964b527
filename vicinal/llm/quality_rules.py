"""Quality rules as one threshold table compiled into Spark projections; no user function runs.

Every rule is a ratio of counts with a lowest and a highest accepted value. Counts come from built-in array functions over
the words and lines of one row, so nothing is shuffled. Repeated windows are found by 64-bit hashes of three words; only texts in which some
hash repeats are sorted, and windows with equal hashes count as a repeat only if their words are equal too.

Nulls: a null text has no words and so fails the base rules; a null doc_id stays null. An empty text is as a null one, an empty table gives an empty
result. Texts are read whole, however long. Repeated rows have a result each. A value at a threshold passes. Columns named as the
counts, base_failed, kept or _quality are replaced.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und den von zu das mit sich des für auf ist im dem nicht ein eine als "
    "de la le et les en un du une que est pour qui dans par sur au pas avec "
    "el y los se del las por con no una su para es al lo"
).split()
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    value: str
    low: float
    high: float

    def sql(self) -> str:
        return f"({self.value}) between {self.low}D and {self.high}D"


#: The threshold table. Values are SQL over the counts; they are only asked of texts that pass the base rules.
RULES = (
    Rule("words", "n_words", LEAST_WORDS, 1e12),
    Rule("mean_word_length", "word_chars / n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols / n_words", 0.0, 0.2),
    Rule("stop_word_share", "n_stop_words / n_words", 0.02, 1.0),
    Rule("duplicate_line_share", "n_dup_lines / n_lines", 0.0, 0.5),
)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def let(name: str, value: str, body: str) -> str:
    """SQL for body with name bound to value. A lambda binds it, so that it is worked out once per row wherever Spark moves the expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


def verdict_sql(text: str = "text") -> str:
    """One SQL expression: a struct of the counts, base_failed and kept."""
    stop = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
    # Neighbours in the order of hashes; where hashes are equal, the words decide.
    same = " and ".join(f"q_words[{{0}}.i{d}] = q_words[q_sorted[k].i{d}]" for d in ("", " + 1", " + 2"))
    beside = " or ".join(f"coalesce({x}.h = q_sorted[k].h and {same.format(x)}, false)" for x in ("get(q_sorted, k - 1)", "get(q_sorted, k + 1)"))
    covered = f"size(array_distinct(flatten(transform(filter(sequence(0, size(q_sorted) - 1), k -> {beside}), k -> array(q_sorted[k].i, q_sorted[k].i + 1, q_sorted[k].i + 2)))))"
    values = {
        "n_words": "size(q_words)",
        "word_chars": "length(array_join(q_words, ''))",
        "n_symbols": f"length(q_text) - length(translate(q_text, '{SYMBOLS}', ''))",
        "n_dup_lines": "size(q_lines) - size(array_distinct(q_lines))",
        "n_repeat_words": f"case when q_sorted is null then 0 else {covered} end",
        "n_lines": "size(q_lines)",
        "n_stop_words": f"size(filter(q_words, w -> lower(w) in ({stop})))",
    }
    failed = f"q_n.n_words < {LEAST_WORDS} or 100 * q_n.n_repeat_words > {MOST_REPEATED_PERCENT} * q_n.n_words"
    rules = re.sub(rf"\b({'|'.join(COUNTS)})\b", r"q_n.\1", " and ".join(rule.sql() for rule in RULES))
    out = "named_struct(" + ", ".join(f"'{n}', q_n.{n}" for n in COUNTS) + f", 'base_failed', {failed}, 'kept', case when {failed} then false else {rules} end)"
    out = let("q_n", "named_struct(" + ", ".join(f"'{n}', cast({v} as long)" for n, v in values.items()) + ")", out)
    out = let("q_sorted", "case when size(array_distinct(q_hashes)) < size(q_hashes) then sort_array(transform(q_hashes, (h, i) -> struct(h as h, i as i))) end", out)
    out = let("q_hashes", "case when size(q_words) >= 3 then transform(sequence(0, size(q_words) - 3), i -> xxhash64(q_words[i], q_words[i + 1], q_words[i + 2])) else array() end", out)
    out = let("q_lines", f"filter(split(q_text, '\\n'), x -> x rlike r'{WORD}')", out)
    out = let("q_words", r"array_remove(split(q_text, r'[\x20\x09-\x0D]+'), '')", out)
    return let("q_text", f"coalesce({text}, '')", out)


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs (with a column text) with the counts, base_failed and kept. Own columns of these names are replaced."""
    plain = docs.drop(*COUNTS, "base_failed", "kept", "_quality")
    return plain.withColumn("_quality", F.expr(verdict_sql())).select(*plain.columns, "_quality.*")
