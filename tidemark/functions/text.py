"""Text functions: normal forms for search, caption clean-up, moras, JSON pointers, digests, stamps."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def search_form(texts: pd.Series) -> pd.Series:
    """NFKC and case folding, which the built-in functions lack; meant for ingest, with the result stored."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """HTML character references to characters."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def plain_caption(c: Column) -> Column:
    r"""Override blocks in braces go; \N and \n become line breaks and \h a space."""
    c = F.regexp_replace(c, r"\{[^}]*\}", "")
    c = F.regexp_replace(c, r"\\[Nn]", "\n")
    return F.trim(F.regexp_replace(c, r"\\h", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


#: Brackets of both widths, the marks that may stand before a speaker's name, kana of a reading.
_OPEN, _CLOSE, _DASH, _READING = "[（(]", "[）)]", "[-－]?", "[ぁ-んァ-ヶー]+"


def caption_parts(c: Column) -> Column:
    """struct(text, speaker, kind, flags): readings after ideographs go first, then names in brackets at line
    starts, then music marks. The one distinct name is the speaker; several are flagged and name nobody."""
    inner = "[^）)]+"
    text = F.regexp_replace(F.trim(c), f"(?<=[一-龯々]){_OPEN}{_READING}{_CLOSE}", "")
    lead = rf"(?:^|\n)\s*{_DASH}\s*{_OPEN}({inner}){_CLOSE}"
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(lead), F.lit(1)))
    alone = text.rlike(f"^{_OPEN}{inner}{_CLOSE}$")
    body = F.regexp_replace(F.regexp_replace(text, lead, " "), "[♪♫]", "")
    body = F.trim(F.regexp_replace(body, r"\s+", " "))
    mute = ~body.rlike(r"[\p{L}\p{N}]")
    none = F.lit(None).cast("string")
    flag = F.when(~alone & mute, F.lit("punctuation_or_music_only")).when(~alone & (F.size(names) > 1), F.lit("multiple_caption_speakers"))
    return F.struct(
        F.when(alone | mute, "").otherwise(body).alias("text"),
        F.when(alone | mute | (F.size(names) != 1), none).otherwise(F.get(names, F.lit(0))).alias("speaker"),
        F.when(alone | mute, "non_speech_caption").otherwise("speech_candidate").alias("kind"),
        F.array_compact(F.array(flag)).alias("flags"),
    )


def moras(c: Column) -> Column:
    """Number of kana that count as a mora; null if there is anything but kana."""
    counted = F.char_length(F.regexp_replace(c, "[ゃゅょぁぃぅぇぉゎャュョァィゥェォヮ]", ""))
    return F.when(c.rlike("^[぀-ゟ゠-ヿ]+$"), counted)


def finite_numbers(raw: Column) -> Column:
    """Whether every number of a JSON text is finite as a double. Strings are passed over, so that digits in them
    count for nothing; the patterns don't backtrack, so texts may be long."""
    bare = F.regexp_replace(raw, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', '""')
    numbers = F.regexp_extract_all(bare, F.lit(r"(-?\d++(?:\.\d++)?(?:[eE][+-]?\d++)?)"), F.lit(1))
    return ~F.exists(numbers, lambda n: F.abs(n.try_cast("double")) == float("inf"))


def strict_json(raw: Column) -> Column:
    """The variant of a JSON text; null where it isn't JSON, keys repeat or a number isn't finite."""
    return F.when(finite_numbers(raw), F.try_parse_json(raw))


def json_path(pointer: str) -> str:
    """JSON pointer to a path of the variant functions."""
    if pointer in ("", "/"):
        return "$"
    if not pointer.startswith("/"):
        raise ValueError("a JSON pointer starts with /")
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")]
    return "$" + "".join(f"[{p}]" if p.isdigit() else "['" + p.replace("'", "\\'") + "']" for p in parts)


def json_get(doc: Column, pointer: str, to: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(doc), json_path(pointer), to)


def digest(*columns: Column, prefix: str = "", size: int = 16) -> Column:
    """Prefix and truncated SHA-256 of the columns' JSON; the order of the columns is part of the identity."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, size))


def unordered_key(a: Column, b: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.array(a, b)), "|"), 256)


def vtt_stamp(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def timecode(c: Column) -> Column:
    """Seconds of SS, MM:SS or HH:MM:SS; null for anything else."""
    parts = F.split(c, ":")
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p.try_cast("double"))
    return F.when(c.rlike(r"^(\d+:){0,2}\d+(\.\d+)?$"), total)
