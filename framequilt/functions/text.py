"""Text functions as Column expressions; they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.strip`` sees it.
_WS = r"[\s\x1c-\x1f\x85\p{Z}]"
MEDIA_TAGS = ("<video>", "<image>")
ASKING = ("human", "user")
ANSWERING = ("gpt", "assistant")


def strip_ws(c: Column) -> Column:
    """White space at both ends removed, Unicode blanks included; null stays null."""
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")


def clean_str(c: Column) -> Column:
    """Null becomes '', otherwise the stripped text."""
    return F.coalesce(strip_ws(c.cast("string")), F.lit(""))


def clean_text(c: Column) -> Column:
    """Runs of white space become one blank, ends stripped; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{_WS}+", " "))


def blank_to_null(c: Column) -> Column:
    """Stripped text; null where nothing is left."""
    return F.nullif(strip_ws(c), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Lower case, everything but ASCII letters, digits and blanks to a blank, blanks collapsed."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9]", " "), " +", " "))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is part of the stem."""
    name = file_name(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def video_key(youtube_id: Column, video: Column) -> Column:
    """Stripped youtube_id, or else the first 11 characters of the file name; null where both are missing."""
    return F.coalesce(blank_to_null(youtube_id), F.nullif(F.substring(file_name(strip_ws(video)), 1, 11), F.lit("")))


def first_turn(conversations: Column, roles: tuple[str, ...]) -> Column:
    """Text of the first turn whose speaker (case and blanks ignored) is in ``roles``, even where that text is null or blank."""
    said = F.filter(conversations, lambda t: F.lower(strip_ws(t["from"])).isin(*roles))
    return F.get(said, F.lit(0))["value"]


def strip_media(c: Column) -> Column:
    for tag in MEDIA_TAGS:
        c = F.replace(c, F.lit(tag), F.lit(""))
    return c
