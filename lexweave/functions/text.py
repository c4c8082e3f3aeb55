"""Text functions as Column expressions: they stay in the JVM and inside whole-stage code."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.config import CHEMICAL, CHEMICAL_TUIS, DISORDER, DISORDER_TUIS

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside lambdas a repeated expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_punctuation(text: Column) -> Column:
    """Each punctuation mark and line break becomes one space, so offsets stay."""
    return F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))


def is_english(word: Column) -> Column:
    """Holds a Latin letter."""
    return word.rlike("[A-Za-z]")


def english_text(text: Column) -> Column:
    """The Latin words of more than two characters, lower case."""
    return F.array_join(F.transform(F.filter(F.split(text, " "), lambda w: (F.length(w) > 2) & is_english(w)), F.lower), " ")


def usable(words: Column) -> Column:
    """Words of two characters or more, and numbers."""
    return F.filter(words, lambda w: (F.length(w) >= 2) | w.rlike(r"^\d+$"))


def usable_tokens(text: Column) -> Column:
    """Full stops are spaces; split at single spaces; only usable words."""
    return usable(F.split(F.translate(text, ".", " "), " "))


def cleaned(text: Column) -> Column:
    """Only Hebrew and Latin letters and ``.,!?``; anything else, digits too, is one space."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, "\n\r", "  "), r"[^א-ת\s.,!?a-zA-Z]", " "), "  +", " ")


def parser_input(text: Column) -> Column:
    """Line breaks, full stops and commas are spaces."""
    return F.translate(text, "\n.,", "   ")


def squeezed_spaces(text: Column) -> Column:
    """Trimmed, runs of spaces as one."""
    return F.trim(F.regexp_replace(text, " +", " "))


def display_words(text: Column) -> Column:
    """Words of a text, the Latin ones in lower case."""
    return F.transform(F.split(text, " "), lambda w: F.when(is_english(w), F.lower(w)).otherwise(w))


def long_term(term: Column, least: int = 3) -> Column:
    """More than ``least`` characters without punctuation and spaces."""
    return F.length(F.regexp_replace(blank_punctuation(term), " ", "")) > least


def io_tag(tag: Column) -> Column:
    """B-D and I-D as D; O stays."""
    return F.when(tag == "O", "O").otherwise(F.substring_index(tag, "-", -1))


def percent(share: Column) -> Column:
    """A share as a percentage, cut to whole numbers."""
    return F.concat((share * 100).cast("int").cast("string"), F.lit("%"))


def span_end(start: Column, term: Column) -> Column:
    return start + F.length(term)


def semantic_type(tui: Column) -> Column:
    """The group of a type code; null for others."""
    return F.when(tui.isin(*DISORDER_TUIS), DISORDER).when(tui.isin(*CHEMICAL_TUIS), CHEMICAL)


def prefix_words(text: Column, offset: Column, compat: bool = False) -> Column:
    """Non-empty words before a match. At offset 0 there are none; ``compat`` takes all but the last character there."""
    before = F.substring(text, 1, F.greatest(offset - 1, F.lit(0)))
    if compat:
        before = F.when(offset == 0, F.substring(text, 1, F.length(text) - 1)).otherwise(before)
    return F.filter(F.split(before, " "), lambda w: w != "")


def last_words(words: Column, k: int) -> Column:
    """The last k words as text; all of them when there are fewer."""
    return F.array_join(F.slice(words, F.greatest(F.size(words) - k + 1, F.lit(1)), k), " ")


def gram_starts(words: Column) -> Column:
    """Each word with the two that follow it, PAD past the end: ``w1, w2, w3`` in reading order."""

    def body(w: Column) -> Column:
        after = lambda i, k: F.coalesce(F.get(w, i + k), F.lit("PAD"))
        return F.transform(w, lambda x, i: F.struct(x.alias("w1"), after(i, 1).alias("w2"), after(i, 2).alias("w3")))

    return let(words, body)


def literal_offsets(text: Column, part: Column) -> Column:
    """Start offsets of all non-overlapping occurrences of a literal part, from the left; none for an empty part."""
    quoted = F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), none.alias("o"))
    # a running end of the pieces; every piece but the last is followed by the part
    step = lambda acc, n: F.struct((acc.at + n + F.length(part)).cast("int").alias("at"), F.concat(acc.o, F.array((acc.at + n).cast("int"))).alias("o"))
    lengths = F.transform(F.split(text, quoted, -1), F.length)
    offsets = let(lengths, lambda l: F.aggregate(F.slice(l, F.lit(1), F.greatest(F.size(l) - 1, F.lit(0))), start, step, lambda acc: acc.o))
    return F.when(F.length(part) > 0, offsets).otherwise(F.when(text.isNotNull() & part.isNotNull(), none))


# ---- rule tokenizer ---------------------------------------------------------------------------------------------------

_POINTS = "ְ-ׄ"
#: Classes in order of priority (fixed patterns): a space ends a token, junk is anything else.
TOKEN_CLASSES = (
    ("URL", r"[a-z]+://\S+"),
    ("HEB", rf"[א-ת{_POINTS}](?:[.'`\"\-/\\]?['`]?[א-ת{_POINTS}0-9'`])*"),
    ("ENG", r"[a-zA-Z][a-zA-Z0-9'.]*"),
    ("NUM", r"[+-]?(?:[0-9][0-9.,/\-:]*)?[0-9]%?"),
    ("PUNCT", r"[\[('`\"{]|[\])'`\"}]|[!?.]+|[,;:\-&]"),
    ("JUNK", rf"[^א-ת{_POINTS}a-zA-Z0-9!?.,:;\-()\[\]{{}}]+"),
)


def classed_tokens(text: Column) -> Column:
    """Tokens with their class, spaces left out. White space is the first choice, or junk would swallow it."""
    pattern = r"\s+|" + "|".join(p for _, p in TOKEN_CLASSES)
    tokens = F.filter(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda t: ~t.rlike(r"^\s+$"))

    def kind(t: Column) -> Column:
        out = F.lit("JUNK")
        for name, p in reversed(TOKEN_CLASSES[:-1]):
            out = F.when(t.rlike(f"^(?:{p})$"), name).otherwise(out)
        return out

    return F.transform(tokens, lambda t: F.struct(kind(t).alias("class"), t.alias("token")))


@cache
def digraphs() -> dict[str, str]:
    """By rule: Hebrew characters that stand for two letters, with these: the digraphs by their names, ligatures by their decomposition."""
    out = {}
    for c in map(chr, range(0x05F0, 0x05F3)):
        first, second = unicodedata.name(c).split(" YIDDISH ")[1].split(" ")
        out[c] = "".join(unicodedata.lookup(f"HEBREW LETTER {x}") for x in ([second, second] if first == "DOUBLE" else [first, second]))
    for c in map(chr, range(0xFB1D, 0xFB50)):
        letters = unicodedata.normalize("NFKC", c)
        if "LIGATURE" in unicodedata.name(c, "") and sum(x.isalpha() for x in letters) > 1:
            out[c] = letters
    return out


def one_spelling(text: Column) -> Column:
    """Hebrew digraphs and ligatures as letters, without joiners."""
    for a, b in digraphs().items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.replace(text, F.lit("\u200d"), F.lit(""))


def sentences(text: Column, most: int = 150, chunk: int = 140) -> Column:
    """Sentences of a tokenised text: a sentence ends with a run of tokens that begin with one of ``!|.?``.

    A sentence of more than ``most`` words is cut into chunks of ``chunk``; what follows the last stop is one sentence.
    """
    stop = lambda w: w.rlike(r"^[!|.?]")

    def body(words: Column) -> Column:
        size = F.size(words)
        last_of_run = F.filter(F.sequence(F.lit(1), size), lambda i: stop(F.get(words, i - 1)) & ((i == size) | ~F.coalesce(stop(F.get(words, i)), F.lit(False))))
        return let(F.when(size > 0, last_of_run).otherwise(F.array().cast("array<int>")), lambda ends: cut_at(words, ends))

    def cut_at(words: Column, ends: Column) -> Column:
        size = F.size(words)
        spans = F.transform(F.concat(F.array(F.lit(0)), ends), lambda b, k: F.struct(b.alias("b"), F.coalesce(F.get(ends, k), size).alias("e"), (k < F.size(ends)).alias("stopped")))
        return F.flatten(F.transform(F.filter(spans, lambda s: s.e > s.b), lambda s: chunks(words, s)))

    def chunks(words: Column, s: Column) -> Column:
        n = s.e - s.b
        # chunks are cut while more than `most` words are left
        many = F.when(s.stopped & (n > most), F.ceil((n - most) / chunk).cast("int") + 1).otherwise(F.lit(1))
        return F.transform(F.sequence(F.lit(1), many), lambda k: F.array_join(F.slice(words, (s.b + (k - 1) * chunk + 1).cast("int"), F.when(k == many, s.e - s.b - (k - 1) * chunk).otherwise(F.lit(chunk)).cast("int")), " "))

    return let(F.filter(F.split(text, r"\s+"), lambda w: w != ""), body)
