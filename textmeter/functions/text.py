"""Scalar text operators: every function maps columns to a column.

All of it is built-in expressions, so a cleaning step is a projection: no
shuffle, no Python worker. Null text counts as the empty string.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from textmeter import resources as R

# What counts as white space. Java's \s is ASCII only, so the
# remaining Unicode blanks are listed.
BLANK = r"\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
BLANKS = f"[{BLANK}]+"

# Patterns of the cleaning chain.
HTML_TAG = r"<[^>]+>"
URL = rf"http[^{BLANK}]+|www\.[^{BLANK}]+"
SPECIAL = rf"[^a-zA-Z0-9{BLANK}]"
SPECIAL_KEEP_LETTERS = rf"[^\p{{L}}\p{{M}}0-9{BLANK}]"
VECTOR_TOKEN = r"(?U)\w\w+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip_html(text: Column) -> Column:
    """Each markup tag becomes one blank; tags may span lines."""
    return F.regexp_replace(text, HTML_TAG, " ")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def _contraction_rules(fold_case: bool) -> list[tuple[str, str]]:
    """(pattern, replacement) pairs that together apply the contraction table.

    Forms that differ only in the word before the shared ending, such as
    ``isn't`` and ``hadn't``, share one pattern, so a text is scanned a handful
    of times rather than once per table row. No expansion contains another
    form, so the order of the rules is immaterial. A capitalised form whose
    expansion is lower case ("Don't" -> "do not") can share a pattern only when
    the caller lower-cases afterwards (``fold_case``).
    """
    stems: dict[tuple[str, str], list[str]] = defaultdict(list)
    whole: dict[str, list[str]] = defaultdict(list)
    for form, expansion in R.CONTRACTIONS.items():
        if form == expansion:
            continue
        head, _, tail = expansion.partition(" ")
        stem, ending = form[: len(head)], form[len(head):]
        same = stem.lower() == head.lower() if fold_case else stem == head
        if tail and same:
            stems[ending, tail].append(stem)
        else:
            whole[expansion].append(form)
    rules = [(rf"\b({'|'.join(s)}){re.escape(end)}\b", f"$1 {tail}") for (end, tail), s in stems.items()]
    rules += [(rf"\b(?:{'|'.join(map(re.escape, f))})\b", e) for e, f in whole.items()]
    return rules


def expand_contractions(text: Column, fold_case: bool = False) -> Column:
    """``don't`` -> ``do not`` and so on; texts without an apostrophe pass untouched."""

    def expand(x: Column) -> Column:
        expanded = x
        for pattern, replacement in _contraction_rules(fold_case):
            expanded = F.regexp_replace(expanded, "(?U)" + pattern, replacement)
        return F.when(F.contains(x, F.lit("'")), expanded).otherwise(x)

    # The lambda binds the text once; written inline, its steps would run per mention.
    return F.get(F.transform(F.array(text), expand), F.lit(0))


def lowercase(text: Column) -> Column:
    return F.lower(text)


def strip_special(text: Column, keep_letters: bool = False) -> Column:
    """Anything but ASCII letters, digits and blanks becomes a blank.

    ``keep_letters`` keeps the letters of every script instead.
    """
    return F.regexp_replace(text, SPECIAL_KEEP_LETTERS if keep_letters else SPECIAL, " ")


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def tokenize(text: Column) -> Column:
    """Tokens of already normalised text; a few fused words are split in two."""
    pattern = "|".join(rf"{a}(?={b}\b)" for a, b in R.TOKEN_SPLITS.values())
    return F.array_remove(F.split(F.regexp_replace(text, rf"\b({pattern})", "$1 "), " "), "")


def remove_stop_words(tokens: Column, stop_words: Iterable[str] = R.STOP_WORDS) -> Column:
    stop_words = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(stop_words)) if stop_words else tokens


def min_token_length(tokens: Column, length: int = 2) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= length)


def clean_tokens(
    text: Column,
    stop_words: Iterable[str] = R.STOP_WORDS,
    min_length: int = 2,
    keep_letters: bool = False,
) -> Column:
    """The cleaning chain up to, not including, lemmas.

    Same tokens as chaining the single steps, in fewer passes: contractions are
    expanded just before lower-casing, and one extraction stands for blanking
    out special characters, collapsing blanks and tokenising.
    """
    stop_words = list(stop_words)
    kept = r"[\p{L}\p{M}0-9]" if keep_letters else "[a-zA-Z0-9]"
    fused = "|".join(rf"{a}(?={b}(?!{kept}))" for a, b in R.TOKEN_SPLITS.values())
    x = strip_urls(strip_html(text_or_empty(text)))
    x = F.lower(expand_contractions(x, fold_case=True))
    tokens = F.regexp_extract_all(x, F.lit(f"{fused}|{kept}+"), F.lit(0))

    def keep(t: Column) -> Column:
        long_enough = F.length(t) >= min_length
        return long_enough & ~t.isin(stop_words) if stop_words else long_enough

    return F.filter(tokens, keep)


def array_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def split_words(text: Column) -> Column:
    """Words between blanks, no empty ones."""
    return F.array_remove(F.split(text_or_empty(text), BLANKS), "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text)).cast("bigint")


def negation_count(text: Column, words: Iterable[str] = R.NEGATION_WORDS) -> Column:
    """Words that negate, compared with their punctuation on (``not,`` is no hit)."""
    words = list(words)
    return F.size(F.filter(split_words(F.lower(text)), lambda t: t.isin(words))).cast("bigint")


def label_name(label: Column) -> Column:
    return F.when(label == 0, "Negative").when(label == 1, "Positive")


def text_preview(text: Column, length: int = 200) -> Column:
    """The first characters on one line: cut first, then blank out line breaks."""
    return F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" "))


def vector_tokens(text: Column) -> Column:
    """The vectoriser's own tokens: lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(VECTOR_TOKEN), F.lit(0))


def ngrams_1_2(tokens: Column) -> Column:
    """Unigrams, then bigrams of neighbouring tokens."""
    shorter = F.greatest(F.size(tokens) - 1, F.lit(0))
    bigrams = F.zip_with(
        F.slice(tokens, F.lit(1), shorter),
        F.slice(tokens, F.lit(2), shorter),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(tokens, bigrams)


def argmax(scores: Column) -> Column:
    """Index of the largest score; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
