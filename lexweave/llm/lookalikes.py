r"""Problem 3: text that looks the same, brought to the same characters.

DuckDB runs inside the Arrow partitions: one SQL statement per batch with ``nfc_normalize``, ``translate`` and regular
expressions drops what shows as nothing, turns odd spaces into the ordinary one, composes accents, maps compatibility
forms of letters and digits, and replaces look-alike letters inside words of another alphabet.

Defined results: null stays null and is no case; empty and plain texts come back as they are; tabs and line breaks are
plain; composed accented letters, words wholly of one alphabet and a Hebrew prefix before Latin letters are plain; a word
that mixes alphabets and cannot be brought to one keeps its letters and still counts as a case; extra columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that show as nothing: soft hyphen, joiners, direction marks, variation selectors and fillers.
INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
#: Spaces other than the ordinary one.
SPACES = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
#: Look-alikes of Latin letters (fixed values: Greek, Cyrillic, Armenian and special Latin letters beside what they show as).
LATIN_LIKE = (
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝѵ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧινορυχα" "օսոհցԼՕՏ" "ıɑɡɩʟɪ",
    "ABESIJKMHOPCTYXaesijopcyxhdqwv" "ABEZHIKMNOPTYXivopuxa" "ouuhgLOS" "iagiLI",
)
#: Latin letters inside words that are otherwise Cyrillic.
CYRILLIC_LIKE = ("ABEKMHOPCTYXaeopcyxisjkmtubnr", "АВЕКМНОРСТУХаеорсухіѕјкмтивпг")
#: Hebrew letters beside symbols and ligatures whose compatibility form Unicode leaves out or spells with several letters.
SEVERAL = {"װ": "וו", "ױ": "וי", "ײ": "יי", "ﭏ": "אל", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž"}


@cache
def compatibility_forms() -> tuple[str, str]:
    """By rule: every character whose compatibility form is one other letter or digit, and every half- or full-width form."""
    odd, plain = [], []
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if 0xD800 <= i < 0xE000 or unicodedata.category(c) in ("Cn", "Co") or unicodedata.normalize("NFC", c) != c:
            continue
        k = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", c))
        if k != c and len(k) == 1 and (k.isalnum() or 0xFF00 <= i <= 0xFFEF):
            odd.append(c)
            plain.append(k)
    return "".join(odd), "".join(plain)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def statement() -> str:
    """The SQL over a batch ``b(k, x)``: ``k, y, odd``.

    Few texts hold anything odd, so the long map runs only on texts with a character beyond the plain blocks.
    """
    odd, plain = compatibility_forms()
    several = "y2"
    for a, b in SEVERAL.items():
        several = f"replace({several}, {_quoted(a)}, {_quoted(b)})"
    other = r"[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Hebrew}ıɑɡɩʟɪ]"
    mixed = r"[\p{Latin}][\p{Greek}\p{Cyrillic}\p{Armenian}\p{Hebrew}]|[\p{Greek}\p{Cyrillic}\p{Armenian}]\p{Latin}|[\p{Greek}\p{Cyrillic}\p{Armenian}]\p{Hebrew}|\p{Hebrew}[\p{Greek}\p{Cyrillic}\p{Armenian}]|\p{Greek}\p{Cyrillic}|\p{Cyrillic}\p{Greek}|[ıɑɡɩʟɪ]"
    latin = f"translate(w, {_quoted(LATIN_LIKE[0])}, {_quoted(LATIN_LIKE[1])})"
    cyrillic = f"translate(w, {_quoted(CYRILLIC_LIKE[0])}, {_quoted(CYRILLIC_LIKE[1])})"
    fix = rf"CASE WHEN NOT regexp_matches(w, '{mixed}') THEN w WHEN NOT regexp_matches({latin}, '{other}') THEN {latin} WHEN NOT regexp_matches({cyrillic}, '\p{{Latin}}') THEN {cyrillic} ELSE w END"
    return rf"""
WITH a AS (SELECT k, x, coalesce(regexp_matches(x, '[^\x{{01}}-\x{{7F}}א-תА-яЁё]|{mixed}'), false) AS look FROM b),
s AS (SELECT k, x, regexp_replace(regexp_replace(x, '{INVISIBLE}', '', 'g'), '{SPACES}', ' ', 'g') AS y1 FROM a WHERE look),
n AS (SELECT k, x, nfc_normalize(y1) AS y2 FROM s),
c AS (SELECT k, x, CASE WHEN regexp_matches(y2, '[^\x{{01}}-\x{{17F}}א-ת\x{{0391}}-\x{{03C9}}\x{{0400}}-\x{{052F}}\x{{0621}}-\x{{064A}}\x{{2010}}-\x{{201F}}]|[ªºĲĳĿŀſ²³¹]')
  THEN nfc_normalize(translate({several}, {_quoted(odd)}, {_quoted(plain)})) ELSE y2 END AS y3 FROM n),
m AS (SELECT k, x, CASE WHEN regexp_matches(y3, '{mixed}')
  THEN array_to_string(list_transform(regexp_extract_all(y3, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+'), lambda w: {fix}), '') ELSE y3 END AS y FROM c)
SELECT k, y, y <> x OR regexp_matches(y, '{mixed}|[\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}][\x{{300}}-\x{{36F}}]') AS odd FROM m
UNION ALL SELECT k, x AS y, false AS odd FROM a WHERE NOT look"""


def one_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """``row_id, text, odd``: every row with its text in one form; ``odd`` where the text held anything else. Nothing is shuffled."""
    sql = statement()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        schema = pa.schema([("row_id", pa.int64()), ("text", pa.string()), ("odd", pa.bool_())])
        for batch in batches:
            b = pa.Table.from_batches([batch], schema=pa.schema([("k", pa.int64()), ("x", pa.string())]))
            con.register("b", b)
            out = con.sql(sql).to_arrow_table()
            yield from out.rename_columns(["row_id", "text", "odd"]).cast(schema).to_batches()
            con.unregister("b")

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("x")).mapInArrow(run, "row_id long, text string, odd boolean")


def found(posts: DataFrame, instances: DataFrame) -> DataFrame:
    """``field_name, row_id`` of the posts and of the mentions that hold anything but the plain characters, each id once.

    An instance delivered twice gives one row: its ids are made distinct over the few that were found.
    """
    p = one_form(posts, "post_id", "post_txt").where("odd").select(F.lit("post_txt").alias("field_name"), "row_id")
    i = one_form(instances, "inst_id", "cand_match").where("odd").select(F.lit("cand_match").alias("field_name"), "row_id")
    return p.unionByName(i).distinct()
