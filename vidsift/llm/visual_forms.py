"""One consistent form for texts that look the same: DuckDB expressions inside Arrow partitions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidsift.session import cut, spread

# Characters by what a reader sees of them.
#: Code points without a visible form of their own: soft hyphen, joiners, direction marks, variation selectors.
INVISIBLE_RANGES = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE01EF),
]
#: Spaces on one line; line breaks and tabs stay what they are.
SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
#: Hyphens of the usual length; en and em dashes look different.
HYPHENS = "‐‑−˗﹣⁃"
#: Letters that look like a Latin letter, script by script, in pairs.
LOOKALIKES = {
    "cyrillic": ("аеорсухіѕјһӏԁԛԝѵүАВЕКМНОРСТУХІЅЈҮѴԚԜӀ", "aeopcyxisjhldqwvyABEKMHOPCTYXISJYVQWI"),
    "cyrillic with marks": ("ѐёїЀЁЇ", "èëïÈËÏ"),
    "greek": ("αονρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "aovpcjABEZHIKMNOPTYXC"),
    "greek with marks": ("άόΌΆΈΊΎ", "áóÓÁÉÍÝ"),
    "armenian": ("ոսօհՕՍ", "nuohOU"),
    "cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    "latin": ("ɑɡƉÐ", "agĐĐ"),
}
#: Letters of another script that no Latin letter looks like: a word with one of them belongs to that script throughout.
ONLY = {
    "cyrillic": "бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯєґђѓљњћќўџЄҐЂЃЉЊЋЌЎЏ",
    "greek": "βγδεζηθικλμξπςστυφχψωΓΔΘΛΞΠΣΦΨΩέήίύώϊϋΐΰ",
}
#: Twins within such a word, Latin and its own.
WITHIN = {
    "cyrillic": ("aeopcyxëABEKMHOPCTYXË", "аеорсухёАВЕКМНОРСТУХЁ"),
    "greek": ("aovpABEZHIKMNOPTYXáóÓÁÉÍÝ", "αονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧάόΌΆΈΊΎ"),
}
#: Kinds of compatibility decomposition that change width, style or joining of a letter, not what it is. The others (superscripts,
#: fractions, circles, squares) look different.
SAME_LOOK = ("<wide>", "<narrow>", "<small>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")

#: Documents of a spelling, and spellings of a look, that one task pairs; larger ones are split.
BLOCK_ROWS = 1_000
SALTS = 16
#: Only those beyond a LARGE_SHARE-th of all rows are split, so at most LARGE_SHARE are.
LARGE_SHARE = 20_000


@lru_cache(maxsize=1)
def mappings() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Characters and what they look like: frequent single ones, further single ones, and those that look like several.

    The first are spaces, hyphens, look-alikes and full-width ASCII; the others follow from the Unicode data: forms of another
    width, style or joining, ligatures and digraphs (letters that decompose into letters), Roman numerals.
    """
    near = {chr(c): " " for c in SPACES} | {c: "-" for c in HYPHENS}
    for own, latin in LOOKALIKES.values():
        near |= dict(zip(own, latin, strict=True))
    near |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}  # full-width forms lie at a fixed distance from ASCII
    hidden = {chr(c) for a, b in INVISIBLE_RANGES for c in range(a, b + 1)}
    single: dict[str, str] = {}
    several: dict[str, str] = {}

    def plain(c: str) -> str:
        tag, *points = unicodedata.decomposition(c).split() or [""]
        return "".join(plain(chr(int(p, 16))) for p in points) if tag in SAME_LOOK or c == "ſ" else near.get(c, c)

    for c in map(chr, range(0x80, 0x110000)):
        tag, *points = unicodedata.decomposition(c).split() or [""]
        parts = [chr(int(p, 16)) for p in points]
        letters = all(unicodedata.category(p) in ("Lu", "Ll", "Lt", "Lo") for p in parts)
        kind = unicodedata.category(c)
        joined = tag == "<compat>" and letters and (len(parts) > 1 and kind[0] == "L" or kind == "Nl")
        if c in near or c in hidden or not (tag in SAME_LOOK and " " not in parts or joined):
            continue
        look = "".join(map(plain, parts))
        if len(look) == 1:
            single[c] = look
        else:
            several[c] = look
    return near, single, several


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(points: Iterable[int]) -> str:
    """The inside of a character class: ranges of code points."""
    out, at = [], None
    for p in [*sorted(points), None]:
        if at is not None and p == at[1] + 1:
            at = (at[0], p)
            continue
        if at is not None:
            out.append(f"\\x{{{at[0]:X}}}-\\x{{{at[1]:X}}}" if at[0] < at[1] else f"\\x{{{at[0]:X}}}")
        at = None if p is None else (p, p)
    return "".join(out)


def invisible_class() -> str:
    return "[" + _class(c for a, b in INVISIBLE_RANGES for c in range(a, b + 1)) + "]"


@lru_cache(maxsize=1)
def _plain_class() -> str:
    """Characters whose form is what they are: ASCII and, of Latin letters and common signs, those that nothing changes."""
    changed = set().union(*mappings()) | {chr(c) for a, b in INVISIBLE_RANGES for c in range(a, b + 1)}
    wide = [*range(0xA1, 0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2028), 0x20AB, 0x20AC]
    kept = [c for c in wide if chr(c) not in changed and unicodedata.normalize("NFC", chr(c)) == chr(c) and unicodedata.category(chr(c))[0] != "M"]
    return _class([*range(0x80), *kept])


def form_sql(column: str, other_scripts: bool = True) -> str:
    """DuckDB expression of the consistent form of a text column.

    Invisible characters go first, since they keep accents from being composed; then translate() for width, style, spaces,
    hyphens and look-alikes, ligatures by a map, and NFC. With `other_scripts`, the look-alikes of a word that holds a
    purely Cyrillic or Greek letter become letters of that script again (in either spelling of the word, so that the
    form still depends on the looks only). A text of plain characters only is its own form, and rare characters are
    looked up only in texts that hold one.
    """
    near, single, several = mappings()
    has = lambda v, chars: f"regexp_matches({v}, '[{_class(map(ord, chars))}]')"
    e = f"regexp_replace({column}, {_quote(invisible_class())}, '', 'g')"
    e = f"translate({e}, {_quote(''.join(near))}, {_quote(''.join(near.values()))})"
    more = f"translate(v, {_quote(''.join(single))}, {_quote(''.join(single.values()))})"
    e = f"list_transform([{e}], lambda v: CASE WHEN {has('v', single)} THEN {more} ELSE v END)[1]"
    table = "MAP {" + ", ".join(f"{_quote(a)}: {_quote(b)}" for a, b in several.items()) + "}"
    split = f"array_to_string(list_transform(string_split(v, ''), lambda c: coalesce(map_extract({table}, c)[1], c)), '')"
    e = f"nfc_normalize(list_transform([{e}], lambda v: CASE WHEN {has('v', several)} THEN {split} ELSE v END)[1])"
    if other_scripts:
        words = "regexp_extract_all(v, '[\\p{L}\\p{M}]+|[^\\p{L}\\p{M}]+')"
        for script, only in ONLY.items():
            latin, own = WITHIN[script]
            back = f"array_to_string(list_transform({words}, lambda w: CASE WHEN {has('w', only)} THEN translate(w, {_quote(latin)}, {_quote(own)}) ELSE w END), '')"
            e = f"list_transform([{e}], lambda v: CASE WHEN {has('v', only)} THEN {back} ELSE v END)[1]"
    return f"CASE WHEN regexp_matches({column}, '[^{_plain_class()}]') THEN {e} ELSE {column} END"


def normalized_sql(form: str) -> str:
    """Lower case, letters and digits only, single spaces."""
    return f"trim(regexp_replace(lower({form}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"


def folded_sql(form: str) -> str:
    """The same without accents; đ counts as d."""
    return f"trim(regexp_replace(translate(strip_accents(lower({form})), 'đ', 'd'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def connect():
    """An in-memory DuckDB of one thread that never writes to the worker's disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def duckdb_map(df: DataFrame, select: str, ddl: str, names: list[str]) -> DataFrame:
    """Each Arrow batch of df as the view `b` of an in-memory DuckDB with one thread; `select` keeps each row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for batch in batches:
            con.register("b", pa.Table.from_batches([batch]))
            got = con.sql(select).to_arrow_table()
            con.unregister("b")
            yield from got.select(names).to_batches()

    return df.mapInArrow(run, ddl)


def consistent_texts(df: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, text_normalized, text_folded: the consistent form of each row's text and the two columns made from it.

    text_normalized: lower case, letters and digits, single spaces; text_folded: the same without accents.
    Both are made anew from the cleaned text, as stored ones were made from the uncleaned. A null text gives nulls;
    empty and blank texts give an empty text_normalized. Repeated rows give a row each. Other columns are ignored.
    Texts are processed whole, in a narrow map without a shuffle.
    """
    key = df.schema[doc_id].dataType.simpleString()
    slim = spread(df.select(F.col(doc_id).alias("k"), F.col(text).alias("t")))
    select = f"SELECT k, f AS text, {normalized_sql('f')} AS text_normalized, {folded_sql('f')} AS text_folded FROM (SELECT k, {form_sql('t')} AS f FROM b)"
    names = ["k", "text", "text_normalized", "text_folded"]
    return duckdb_map(slim, select, f"k {key}, text string, text_normalized string, text_folded string", names).withColumnRenamed("k", doc_id)


def classes(df: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """k (doc_id), form_id, text_id: 128-bit ids of each text's look and of its characters; null and blank texts are left out."""
    key = df.schema[doc_id].dataType.simpleString()
    slim = spread(df.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).filter(F.col("t").rlike(r"(?U)\S")))
    select = f"SELECT k, unhex(md5(f)) AS form_id, unhex(md5(t)) AS text_id FROM (SELECT k, t, {form_sql('t')} AS f FROM b) WHERE regexp_matches(f, '[^\\s]')"
    return duckdb_map(slim, select, f"k {key}, form_id binary, text_id binary", ["k", "form_id", "text_id"])


def _members(df: DataFrame, doc_id: str, text: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Looks with more than one spelling. Their spellings: form_id, text_id, part, n (documents of the spelling), spellings and documents
    (of the look); and their documents, once each: k, text_id, part. A spelling of many documents is dealt over parts by document."""
    rows = cut(classes(df, doc_id=doc_id, text=text).distinct())
    least = max(block, rows.count() // LARGE_SHARE + 1)
    counts = rows.groupBy("form_id", "text_id").agg(F.count(F.lit(1)).alias("n"))
    looks = counts.groupBy("form_id").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("documents")).filter("spellings > 1")
    # a look of many spellings isn't gathered in one task
    salted = looks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = cut(counts.withColumn("salt", F.pmod(F.xxhash64("text_id"), F.lit(SALTS)).cast("int")).join(salted, ["form_id", "salt"]).drop("salt"))
    hot = F.broadcast(found.filter(F.col("n") >= least).select("text_id", ((F.col("n") / block).cast("int") + 1).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    spellings = found.join(hot, "text_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    docs = rows.select("k", "text_id").join(hot, "text_id", "left").withColumn("part", F.pmod(F.xxhash64("k"), parts).cast("int")).drop("parts")
    return spellings, docs.join(spellings.select("text_id", "part"), ["text_id", "part"], "left_semi")


def lookalike_classes(df: DataFrame, *, doc_id: str, text: str, block: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, class_id (the look, 32 hex digits), spellings, links (long): one row for each document that looks like one of
    other characters, with the number of these; copies aren't expanded into pairs.

    Null and blank texts have no class; repeated rows count once. Work follows the number of rows, however many look the same.
    """
    spellings, docs = _members(df, doc_id, text, block)
    return docs.join(spellings, ["text_id", "part"]).select(F.col("k").alias(doc_id), F.lower(F.hex("form_id")).alias("class_id"), "spellings", (F.col("documents") - F.col("n")).alias("links"))


def lookalike_pairs(df: DataFrame, *, doc_id: str, text: str, block: int = BLOCK_ROWS) -> DataFrame:
    """doc_id_a, doc_id_b (a < b): documents whose texts look the same but differ in characters; each pair once.

    Null and blank texts and texts equal character by character make no pair; repeated rows make a pair once.
    Rows are reduced to two 128-bit ids before any shuffle. Only looks with more than one spelling go on; spellings
    of a look are paired with each other (never rows with rows), and then each side is joined with its documents,
    so the work follows the size of the result, also where a third of all rows look the same: a spelling of many
    documents and a look of many spellings are dealt over parts, so that no task pairs more than block by block.
    """
    spellings, docs = _members(df, doc_id, text, block)
    s = spellings.select("form_id", "text_id", "part", "spellings")
    shares = (F.col("spellings") / block).cast("int") + 1
    a = s.withColumn("share", F.pmod(F.xxhash64("text_id"), shares).cast("int")).select("form_id", "share", F.col("text_id").alias("text_a"), F.col("part").alias("part_a"))
    b = s.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).select("form_id", "share", F.col("text_id").alias("text_b"), F.col("part").alias("part_b"))
    pairs = a.join(b, ["form_id", "share"]).filter("text_a < text_b").select("text_a", "part_a", "text_b", "part_b")
    left = pairs.join(docs.toDF("text_a", "part_a", "x"), ["text_a", "part_a"]).select("x", "text_b", "part_b")
    both = left.join(docs.toDF("text_b", "part_b", "y"), ["text_b", "part_b"])
    return both.filter("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
