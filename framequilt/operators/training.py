"""Training items: mixtures of data sets, placeholders, lengths, padding, offsets, label masks."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequilt.functions.text import strip_ws
from framequilt.functions.values import seeded
from framequilt.operators.blocks import sums_before, with_position
from framequilt.operators.selection import sample_fraction

# Names of the data sets, each with the beginning and the end of its file's name; a view stands between the two. One bears the name of its project.
DATASETS = {
    "surg_segment_captions": ("captions", "_train"),
    "surg_step_descriptions": ("steps", "_train"),
    "surg_ocr_phases": ("ocr_phases", "_train"),
    "surg_video_summaries": ("summaries", ""),
    "surg_title_descriptions": ("metadata", ""),
    "{project}_qa": ("train_vqa", ""),
    "ocr_phases_vqa": ("ocr_phases_vqa", "_train"),
}
VIEWS = ("", "_open", "_mis")
# Tokens that open and close an answer in the chat template, and the label that is ignored.
ANSWER_TOKEN = 77091
END_TOKEN = 151645
IGNORED = -100


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    percent: int = 100


def registry(root: str, project: str = "project") -> dict[str, Dataset]:
    """Data sets by name: every one in every view. ``project`` is the name that the question-answer set begins with."""
    named = {name.format(project=project): parts for name, parts in DATASETS.items()}
    return {f"{name}{view}": Dataset(f"{name}{view}", f"{root}/{begin}{view}{end}.jsonl") for view in VIEWS for name, (begin, end) in named.items()}


def parse_mixture(spec: str, known: dict[str, Dataset]) -> list[Dataset]:
    """Comma-separated names, each with an optional ``%NN``. An unknown name is an error."""
    out = []
    for entry in filter(None, (e.strip() for e in spec.split(","))):
        m = re.fullmatch(r"(.*?)(?:%(\d+))?", entry)
        if m[1] not in known:
            raise ValueError(f"unknown data set {m[1]!r}")
        out.append(Dataset(m[1], known[m[1]].path, int(m[2]) if m[2] else 100))
    return out


def mixture(parts: list[tuple[Dataset, DataFrame]], row_key: str, seed: int) -> DataFrame:
    """Data sets in order, tagged with dataset and dataset_no, each with its exact share of rows."""
    tagged = [sample_fraction(df, row_key, d.percent, seed).withColumns({"dataset": F.lit(d.name), "dataset_no": F.lit(i)}) for i, (d, df) in enumerate(parts)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def as_list(c: Column, is_array: bool) -> Column:
    """One value, many or none as an array."""
    return F.coalesce(c, F.array().cast("array<string>")) if is_array else F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))


def count_tag(conversations: Column, tag: str) -> Column:
    """Placeholders of a kind in the human turns."""
    text = F.array_join(F.transform(F.filter(conversations, lambda t: t["from"] == "human"), lambda t: F.coalesce(t["value"], F.lit(""))), "\n")
    return F.size(F.split(text, tag)) - 1


def placeholder_defect(conversations: Column, images: Column, videos: Column) -> Column:
    """Null where every placeholder has its file and every file its placeholder; else what is wrong."""
    out = F.lit(None).cast("string")
    for kind, files in (("video", videos), ("image", images)):
        n, have = count_tag(conversations, f"<{kind}>"), F.size(files)
        out = F.when(n > have, F.lit(f"more <{kind}> placeholders than files")).when(n < have, F.lit(f"{kind} files remain unused")).otherwise(out)
    return out


def content_parts(text: Column) -> Column:
    """A human turn as parts in order: placeholders, and the stripped text between them."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), "(<image>|<video>)", "\u0001$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: strip_ws(s)), lambda s: s != "")


def turn_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


_PARTS = "array<struct<type:string,text:string,path:string>>"


def messages(conversations: Column, images: Column, videos: Column, base: str = "") -> Column:
    """The turns as messages: array of struct role, content; content is an array of struct type (image, video, text), text, path.

    Placeholders of human turns take the files in their order, over all turns; each file is put below ``base`` unless its
    path is absolute. Other turns are one text. Where placeholders and files don't match, it is an error when it is read:
    look at ``placeholder_defect`` first to set such items aside.
    """

    def part(kind: str, text: Column | None = None, path: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("type"), (none if text is None else text).alias("text"), (none if path is None else path).alias("path"))

    def placed(path: Column) -> Column:
        return F.when(path.startswith("/") | F.lit(base == ""), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))

    def turn(done: Column, t: Column) -> Column:
        text = turn_text(t["value"])

        def step(acc: Column, s: Column) -> Column:
            image, video = s == "<image>", s == "<video>"
            at_image, at_video = acc["n_image"] + image.cast("int"), acc["n_video"] + video.cast("int")
            item = F.when(image, part("image", path=placed(F.get(images, at_image - 1)))).when(video, part("video", path=placed(F.get(videos, at_video - 1)))).otherwise(part("text", text=s))
            return F.struct(F.concat(acc["content"], F.array(item)).alias("content"), at_image.alias("n_image"), at_video.alias("n_video"))

        empty = F.struct(F.array().cast(_PARTS).alias("content"), done["n_image"].alias("n_image"), done["n_video"].alias("n_video"))
        read = F.aggregate(content_parts(text), empty, step)
        human = t["from"] == "human"
        content = F.when(human, read["content"]).otherwise(F.array(part("text", text=text)))
        message = F.struct(F.when(human, "user").otherwise("assistant").alias("role"), content.alias("content"))
        n_image, n_video = (F.when(human, read[n]).otherwise(done[n]).alias(n) for n in ("n_image", "n_video"))
        return F.struct(F.concat(done["messages"], F.array(message)).alias("messages"), n_image, n_video)

    zero = F.struct(F.array().cast(f"array<struct<role:string,content:{_PARTS}>>").alias("messages"), F.lit(0).alias("n_image"), F.lit(0).alias("n_video"))
    read = F.aggregate(conversations, zero, turn)
    defect = placeholder_defect(conversations, images, videos)
    return F.when(defect.isNull(), read["messages"]).otherwise(F.raise_error(defect).cast(f"array<struct<role:string,content:{_PARTS}>>"))


def known_lengths(items: DataFrame, name: str = "num_tokens") -> Column:
    """Token lengths that the items bring with them; 1 for each where they have no such field."""
    return F.col(name).cast("bigint") if name in items.columns else F.lit(1).cast("bigint")


def word_length(conversations: Column) -> Column:
    """White-space words of all turns."""
    n = lambda v: F.size(F.filter(F.split(F.coalesce(v, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.aggregate(conversations, F.lit(0), lambda acc, t: acc + n(t["value"]))


def item_length(conversations: Column, has_image: Column) -> Column:
    return word_length(conversations) + F.when(has_image, 128).otherwise(0)


def modality_length(conversations: Column, has_media: Column) -> Column:
    """Length, negative for items of text alone."""
    n = word_length(conversations)
    return F.when(has_media, n).otherwise(-n)


def pad_right(ids: Column, width: Column, value: int, most: int) -> Column:
    """Array filled up to ``width`` and cut to ``most``."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(value), F.greatest(width - F.size(ids), F.lit(0)))), 1, most)


def sequence_offsets(df: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """``offset``: where each sequence starts when those of a group stand end to end. ``order`` is unique within a group; groups may be of any size."""
    return sums_before(df, [group], [order], {"offset": length})


def replacements(items: DataFrame, row_key: str, failed: str, seed: int) -> DataFrame:
    """For each item that failed, another one that didn't, drawn by the seeded hash of its key: the key and ``replacement`` (null where no item is sound). ``row_key`` is unique.

    Draws are independent, as a retry draws again from all items; the same rows give the same draws.
    """
    sound = with_position(items.filter(~F.coalesce(F.col(failed), F.lit(True))).select(F.col(row_key).alias("replacement")), ["replacement"], "__place")
    n = sound.count()
    bad = items.filter(F.coalesce(F.col(failed), F.lit(True))).select(row_key)
    draw = F.conv(F.substring(seeded(seed, F.col(row_key)), 1, 15), 16, 10).cast("bigint")
    if not n:
        return bad.withColumn("replacement", F.lit(None).cast(dict(items.dtypes)[row_key]))
    return bad.withColumn("__place", F.pmod(draw, F.lit(n))).join(sound, "__place", "left").select(row_key, "replacement")


def mask_labels(ids: list[int]) -> list[int]:
    """Labels of one sequence: answers from two after ANSWER_TOKEN through one after the next END_TOKEN, IGNORED elsewhere. An answer that never ends has none."""
    out = [IGNORED] * len(ids)
    ends = [i for i, t in enumerate(ids) if t == END_TOKEN]
    free = 0
    for i in (i for i, t in enumerate(ids) if t == ANSWER_TOKEN):
        if i < free:
            continue  # inside an answer
        at = bisect_left(ends, i + 2)
        if at < len(ends):
            out[i + 2 : ends[at] + 2] = ids[i + 2 : ends[at] + 2]
            free = ends[at] + 1
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def label_mask(ids: pd.Series) -> pd.Series:
    """``mask_labels`` of every sequence; null stays null."""
    return ids.map(lambda x: None if x is None else mask_labels([int(t) for t in x]))
