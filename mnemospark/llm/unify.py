"""One consistent form for texts that look the same in different characters (problem 9).

DuckDB runs inside the Arrow partitions: each batch is a relation, and embedded SQL maps full-width
letters and digits, look-alike letters of other scripts, blanks, hyphens and Han radicals with
``translate``, drops invisible characters with a regular expression and composes accents and Han
compatibility forms with ``nfc_normalize``.  Texts then agree exactly where their forms do; they meet
by a 128-bit digest of the form, so a shuffle carries 32 bytes a text and not the text.

Kept apart, since they show something different: letter case, the presence of an accent, raised digits,
full-width punctuation, the number of blanks, word order and every other character.

Defined results: a null text has a null form and takes part in no pair; an empty text is equal to another
empty one; texts are processed whole; extra columns of the input are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.staging import Staging

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    "Տ": "S", "Օ": "O", "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "զ": "q",
    "ı": "i", "ɡ": "g", "ɑ": "a",
}

# Characters without appearance.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"
INVISIBLE_RANGES = [(0xFE00, 0xFE0F), (0xE0000, 0xE007F), (0xE0100, 0xE01EF)]

# Blanks of other widths, and hyphens.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u2800"
HYPHENS = "\u2010\u2011\ufe63\uff0d"

# Han radicals of the supplement block that have one unified form of the same look.
RADICALS = {"⺟": "母", "⻳": "龟", "⺼": "肉", "⻁": "虎", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻓": "长", "⻔": "门", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻲": "龟"}


def character_map() -> dict[str, str]:
    """One character to one character: the table that ``translate`` applies."""
    out = dict(LOOKALIKES) | dict(RADICALS)
    out |= {c: " " for c in BLANKS} | {c: "-" for c in HYPHENS}
    for code in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]:  # full-width digits and letters
        out[chr(code)] = chr(code - 0xFEE0)
    for code in range(0x2F00, 0x2FD6):  # radicals, each with its compatibility form
        out[chr(code)] = unicodedata.normalize("NFKC", chr(code))
    for code in range(0x3038, 0x303B):  # Hangzhou tens
        out[chr(code)] = unicodedata.normalize("NFKC", chr(code))
    for code in [*range(0x0370, 0x0530), *range(0x1F00, 0x2000)]:  # a look-alike with accents in one character
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in LOOKALIKES:
            form = unicodedata.normalize("NFC", LOOKALIKES[parts[0]] + parts[1:])
            if len(form) == 1:
                out[chr(code)] = form
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """DuckDB expression for the consistent form of a text column."""
    table = character_map()
    unseen = "[" + INVISIBLE + "".join(f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE_RANGES) + "]+"
    mapped = f"translate(regexp_replace({column}, {_quoted(unseen)}, '', 'g'), {_quoted(''.join(table))}, {_quoted(''.join(table.values()))})"
    # composing first brings accents of either order and Han compatibility forms into one form
    return f"CASE WHEN regexp_matches({column}, '[^\\x00-\\x7F]') THEN nfc_normalize({mapped.replace(column, f'nfc_normalize({column})', 1)}) ELSE {column} END"


def _forms(keep_text: bool):
    columns = "key, md5(f) AS digest, f AS form" if keep_text else "key, md5(f) AS digest"
    query = f"SELECT {columns} FROM (SELECT key, {form_sql('body')} AS f FROM batch)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect()
        con.execute("SET threads = 1")
        con.execute("SET memory_limit = '400MB'")
        for record in batches:
            con.register("batch", pa.Table.from_batches([record]))
            found = con.sql(query).to_arrow_table()
            con.unregister("batch")
            yield from found.to_batches()
        con.close()

    return run


def consistent_forms(rows: DataFrame) -> DataFrame:
    """(key, form, digest) of ``rows(key, body)``: the consistent form of each text."""
    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "body").mapInArrow(_forms(True), f"key {kind}, digest string, form string")


def _staged_digests(rows: DataFrame) -> DataFrame:
    """(key, digest) of the texts, each normalized once and staged, since classes and pairs read it twice."""
    kind = rows.schema["key"].dataType.simpleString()
    forms = rows.select("key", "body").filter("key IS NOT NULL AND body IS NOT NULL").mapInArrow(_forms(False), f"key {kind}, digest string")
    return Staging(rows.sparkSession, "forms").cut(forms)


def look_classes(rows: DataFrame) -> DataFrame:
    """(key, class_id, n_same): one row per text; class_id is the smallest key that looks the same.

    The compact result: a text copied into a third of all rows is as many rows and no pairs.
    """
    forms = _staged_digests(rows)
    size = forms.groupBy("digest").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("n_same"))
    return forms.join(size, "digest").select("key", "class_id", "n_same")


def same_look_pairs(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: keys of texts that look the same, all pairs of a class; ``look_classes`` says the same in one row a text."""
    forms = _staged_digests(rows)
    shared = forms.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    kept = forms.join(shared, "digest", "left_semi")  # most texts look like no other and go no further
    left, right = kept.select("digest", F.col("key").alias("a")), kept.select("digest", F.col("key").alias("b"))
    return left.join(right, "digest").filter("a < b").select("a", "b").distinct()
