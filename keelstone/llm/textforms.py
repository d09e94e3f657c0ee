"""Text that looks the same in one form.

Two forms are computed.  The *comparison form* is compatibility normalisation, composed, with full case folding, mapped
white space and default-ignorable characters removed.  The *page form* undoes only what a reader cannot see: encodings
of accents, full-width and joined letters, invisible characters, kinds of blanks, and letters of another script with
the same shape; case, raised digits and fraction signs stay.  Texts of equal page form have equal comparison forms, so
the comparison form finds candidates among all texts, and the page form is made of the candidates only and checks them.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.operators.skew import heavy_keys, replicate_for_salt, salt_of
from keelstone.session import materialize

# --- fixed values ---
#: Default-ignorable code points (Unicode, derived core property), as inclusive ranges.
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
#: Cyrillic, Greek, phonetic and Armenian letters, each followed by the Latin letter of the same shape.
CYRILLIC_SHAPES = (
    "\u0410A \u0412B \u0415E \u0405S \u0406I \u0408J \u041aK \u041cM \u041dH \u041eO \u0420P \u0421C \u0422T \u0425X "
    "\u050cG \u051aQ \u051cW \u04aeY \u0430a \u0435e \u0456i \u0458j \u043eo \u0440p \u0441c \u0443y \u0445x \u0455s "
    "\u0501d \u04bbh \u04cfl \u051bq \u051dw"
)
GREEK_SHAPES = (
    "\u0391A \u0392B \u0395E \u0396Z \u0397H \u0399I \u039aK \u039cM \u039dN \u039fO \u03a1P \u03a4T \u03a5Y \u03a7X "
    "\u03bfo \u03f3j \u03f2c \u03f9C"
)
OTHER_SHAPES = "\u04c0I \u0261g \u0585o \u0555O \u0570h \u0578n \u057du \u054dU \u054fS \u0581g"
#: White space drawn as a blank; separators drawn as a line break.
BLANKS = [0x09, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
BREAKS = [0x85, 0x2028, 0x2029]
#: Letters joined into one sign by a typesetter: f-ligatures, and the digraphs of Dutch and Croatian.
JOINED = [*range(0xFB00, 0xFB07), 0x0132, 0x0133, *range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4)]
# --- end of fixed values ---


def _page_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in range(0xFF01, 0xFFEF):  # full-width and half-width forms
        form = chr(code)
        if unicodedata.decomposition(form).startswith(("<wide>", "<narrow>")):
            table[code] = unicodedata.normalize("NFKD", form)
    for code in JOINED:
        table[code] = unicodedata.normalize("NFKD", chr(code))
    table.update({ord(pair[0]): pair[1] for pair in f"{CYRILLIC_SHAPES} {GREEK_SHAPES} {OTHER_SHAPES}".split(" ")})
    table.update(dict.fromkeys(BLANKS, " "))
    table.update(dict.fromkeys(BREAKS, "\n"))
    for low, high in IGNORABLE:
        table.update(dict.fromkeys(range(low, high + 1)))
    return table


_PAGE_TABLE = _page_table()
_RETURNS = re.compile("\r\n?")
#: Characters met so far, and whether the page table changes a part of them.
_CHANGED: dict[str, bool] = {}


def _is_changed(sign: str) -> bool:
    if sign not in _CHANGED:
        _CHANGED[sign] = any(ord(part) in _PAGE_TABLE for part in unicodedata.normalize("NFD", sign))
    return _CHANGED[sign]


def _mapped(text: str) -> str:
    """Canonically decomposed where the page table has something to change, then changed by it; otherwise as it was.

    Most texts hold no such sign; their different characters tell.
    """
    if any(map(_is_changed, set(text))):
        return unicodedata.normalize("NFD", text).translate(_PAGE_TABLE)
    return text


def page_form(text: str) -> str:
    """The text as a reader sees it; line breaks, case, accents and raised signs are kept."""
    if "\r" in text:
        text = _RETURNS.sub("\n", text)
    if text.isascii():
        return text.replace("\t", " ") if "\t" in text else text
    return unicodedata.normalize("NFC", _mapped(text))


def fold(page: str) -> str:
    """The comparison form of a text that is in page form."""
    if page.isascii():
        return page.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", page).casefold())


def comparison_form(text: str) -> str:
    """Compatibility normalised, composed, fully case-folded, blanks mapped, ignorable characters removed.

    It is ``fold(page_form(text))``; the composition between the two steps would be undone and is left out.
    """
    if "\r" in text:
        text = _RETURNS.sub("\n", text)
    if text.isascii():
        return (text.replace("\t", " ") if "\t" in text else text).lower()
    return fold(_mapped(text))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def unify_text(df: DataFrame, column: str, form: str = "comparison") -> DataFrame:
    """``df`` with ``column`` in one form (``comparison`` or ``page``); all other columns and all rows are kept.

    Each distinct value of a batch is normalised once.  Null stays null, the empty text stays empty, repeated rows are
    repeated; texts of any length are taken whole.
    """
    change = {"comparison": comparison_form, "page": page_form}[form]
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(at).dictionary_encode()
            values = pa.array([None if v is None else change(v) for v in coded.dictionary.to_pylist()], batch.schema.types[at])
            columns = list(batch.columns)
            columns[at] = values.take(coded.indices)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)


#: Distinct texts whose digests a task remembers.
REMEMBERED = 100_000
#: Candidate ids up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rows of a class, or copies of a text, that one task pairs; larger ones are spread over several.
PAIRED_ROWS = 4096


def digests_of(df: DataFrame, form: Callable[[str], str], name: str) -> DataFrame:
    """``id, as_written, <name>``: digests of the text and of one of its forms. Each distinct text is formed once a task."""
    kind = df.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            written, formed = [], []
            for text in coded.dictionary.to_pylist():
                own = _digest(text)
                if own not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[own] = _digest(form(text))
                written.append(own)
                formed.append(known[own])
            columns = [pa.array(d, pa.binary()).take(coded.indices) for d in (written, formed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "as_written", name])

    return df.mapInArrow(run, f"id {kind.simpleString()}, as_written binary, {name} binary")


def text_digests(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """``id, as_written, as_seen``: digests of each text that may read like a different one, and of its page form.

    The comparison forms of all texts are compared first: only where different texts share one are they candidates, and
    only the candidates, each distinct text once, are brought to page form.  Rows with a null text or id are left out:
    they have nothing to compare; so are texts whose comparison form is their own.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(column).alias("text")).where("id is not null and text is not null")
    compared = materialize(digests_of(rows, comparison_form, "compared"), "compared")
    texts = compared.groupBy("compared", "as_written").agg(F.min("id").alias("id"))
    shared = texts.groupBy("compared").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("compared")
    candidates = materialize(texts.join(shared, "compared", "left_semi").select("id", "as_written"), "candidates")
    ids = candidates.select("id").distinct()  # an id may come twice
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    pages = digests_of(rows.join(ids, "id", "left_semi"), page_form, "as_seen").select("as_written", "as_seen").distinct()
    pages = pages.join(candidates.select("as_written"), "as_written", "left_semi")
    heavy = heavy_keys(compared.select("as_written"), ["as_written"])
    members = compared.select("id", "as_written").withColumn("_salt", salt_of([F.col("as_written")], [F.col("id")], heavy))
    return members.join(replicate_for_salt(pages, ["as_written"], heavy), ["as_written", "_salt"]).select("id", "as_written", "as_seen")


def look_alikes(digests: DataFrame) -> DataFrame:
    """``as_seen, as_written, copies, id``: the different texts of each class that reads the same, with the smallest id of each.

    Only classes of several texts are listed.  With the ids in ``digests`` (the membership), this says as much as all pairs.
    """
    texts = digests.groupBy("as_seen", "as_written").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"))
    several = texts.groupBy("as_seen").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("as_seen")
    return texts.join(several, "as_seen", "left_semi")


def same_on_the_page(digests: DataFrame) -> DataFrame:
    """``id_a, id_b`` (a < b): all pairs of rows with different texts that read the same.

    The texts of a class are paired, not its rows, so copies of one text cost nothing; each pair of texts is expanded to
    its rows, so what is expanded is exactly the result.  Large classes and texts of many copies are cut into parts of
    about ``PAIRED_ROWS`` that go to different tasks.
    """
    texts = materialize(look_alikes(digests).select("as_seen", "as_written", "copies"), "look-alikes")
    sizes = texts.groupBy("as_seen").agg(F.ceil(F.count(F.lit(1)) / PAIRED_ROWS).cast("int").alias("parts"))
    sized = texts.join(sizes, "as_seen")
    part = F.pmod(F.xxhash64("as_written"), F.col("parts")).cast("int")
    a = sized.select("as_seen", part.alias("part"), F.col("as_written").alias("text_a"), F.col("copies").alias("copies_a"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    b = sized.select("as_seen", every.alias("part"), F.col("as_written").alias("text_b"), F.col("copies").alias("copies_b"))
    pairs = a.join(b, ["as_seen", "part"]).where("text_a < text_b").drop("as_seen", "part")
    members = digests.join(texts.select("as_written", "copies"), "as_written").select("id", "as_written", "copies")
    found = pairs
    for side in ("a", "b"):
        parts = F.ceil(F.col(f"copies_{side}") / PAIRED_ROWS).cast("int")
        spread = found.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        own = members.select(
            F.col("as_written").alias(f"text_{side}"), F.col("id").alias(f"_{side}"),
            F.pmod(F.xxhash64("id"), F.ceil(F.col("copies") / PAIRED_ROWS)).cast("int").alias("part"),
        )
        found = spread.join(own, [f"text_{side}", "part"]).drop("part")
    found = found.where("_a <> _b")
    return found.select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"))
