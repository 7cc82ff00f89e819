"""Timed transcripts: chunks joined to one time axis, sentences, cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequilt.functions.text import strip_ws
from framequilt.functions.values import safe_folder_name, timestamp
from framequilt.operators.blocks import sums_before, with_position

# Fixed value: seconds of a chunk that has no times.
FALLBACK_SECONDS = 600.0
#: Lines that one part of a text holds.
PART_ROWS = 10_000


def chunk_seconds(transcript: Column, failed: Column) -> Column:
    """Length of a chunk: the end of its last segment, else of its last word; 600 where it failed or has no times."""
    last = F.coalesce(F.when(F.size(transcript["segments"]) > 0, F.element_at(transcript["segments"], -1)["end"]), F.when(F.size(transcript["words"]) > 0, F.element_at(transcript["words"], -1)["end"]))
    return F.when(~failed & (last > 0), last).otherwise(F.lit(FALLBACK_SECONDS))


def with_offsets(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """Chunks with their text, ``failed``, ``chunk_number`` (from 1) and ``offset_sec``: the lengths of all earlier chunks of the video. A failed chunk (null transcript or stated error) has a marked text and no segments or words.

    ``order`` is unique within a video. Only lengths are laid out in order; the transcripts are joined to their offsets by (video, order), so that one long video doesn't pile its texts up in one task.
    """
    failed = F.col("transcript").isNull() | (F.coalesce(strip_ws(F.col("error")), F.lit("")) != "")
    rows = chunks.drop("chunk_number", "chunk_text", "offset_sec").withColumn("failed", failed).withColumn("chunk_sec", chunk_seconds(F.col("transcript"), F.col("failed")))
    narrow = rows.select(F.col(key).alias("__key"), F.col(order).alias("__order"), F.col("chunk_sec").alias("__sec"), F.lit(1).alias("__one"))
    placed = sums_before(narrow, ["__key"], ["__order"], {"offset_sec": "__sec", "__before": "__one"})
    placed = placed.select("__key", "__order", F.col("offset_sec").cast("double").alias("offset_sec"), (F.col("__before") + 1).alias("chunk_number"))
    joined = rows.join(placed, F.col(key).eqNullSafe(F.col("__key")) & (F.col(order) == F.col("__order")))
    # Fixed value: the text of a chunk that failed.
    text = F.when(F.col("failed"), F.format_string("[ERROR: Failed to transcribe chunk %d]", "chunk_number")).otherwise(F.coalesce(F.col("transcript.text"), F.lit("")))
    return joined.withColumn("chunk_text", text).drop("__key", "__order")


def _shifted(field: str, text: str) -> Column:
    items = F.when(~F.col("failed"), F.col(f"transcript.{field}"))
    return F.transform(F.coalesce(items, F.array()), lambda s: F.struct((s["start"] + F.col("offset_sec")).alias("start"), (s["end"] + F.col("offset_sec")).alias("end"), s[text].alias("text")))


def timed_rows(offsets: DataFrame, key: str, order: str, field: str) -> DataFrame:
    """Segments or words on the video's time axis: key, order, position, start, end, text. One-to-many inside a chunk: no shuffle."""
    text = "word" if field == "words" else "text"
    return offsets.select(key, order, F.posexplode(_shifted(field, text)).alias("position", "s")).select(key, order, "position", "s.start", "s.end", "s.text")


def in_parts(rows: DataFrame, key: str, number: str, text: Column, separator: str) -> DataFrame:
    """Texts of a key joined in the order of ``number`` (unique within the key, without great gaps), PART_ROWS numbers to a part: key, part, content.

    A part is as much as one task puts together. Write parts where a key may hold more text than one value should.
    """
    one = F.struct(F.col(number).alias("at"), text.alias("t"))
    lines = F.sort_array(F.collect_list(one))
    return rows.groupBy(key, F.floor(F.col(number) / PART_ROWS).alias("part")).agg(F.array_join(F.transform(lines, lambda r: r["t"]), separator).alias("content"))


def joined_parts(parts: DataFrame, key: str, separator: str) -> DataFrame:
    """One text per key from its parts, in their order: what a whole file of a key is."""
    rows = F.sort_array(F.collect_list(F.struct("part", "content")))
    return parts.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["content"]), separator).alias("content"))


def merged_text(offsets: DataFrame, key: str, order: str = "chunk_number") -> DataFrame:
    """Whole text of each video, chunks in the order of their number, with the number of chunks and of those transcribed. ``order`` is what the offsets were made with; the chunk number follows it."""
    said = offsets.select(key, "chunk_number", strip_ws(F.col("chunk_text")).alias("__t")).filter("__t <> ''")
    text = joined_parts(in_parts(said, key, "chunk_number", F.col("__t"), " "), key, " ").select(F.col(key).alias("__key"), F.col("content").alias("__text"))
    counts = offsets.groupBy(key).agg(F.count("*").alias("chunk_count"), F.count_if(~F.col("failed")).alias("chunks_transcribed"))
    return counts.join(text, counts[key].eqNullSafe(text["__key"]), "left").select(key, F.coalesce("__text", F.lit("")).alias("text"), "chunk_count", "chunks_transcribed")


def join_words(words: Column) -> Column:
    """Words joined by blanks, none before closing signs and none after opening brackets."""

    def step(text: Column, w: Column) -> Column:
        tight = w.isin(".", ",", "!", "?", ";", ":", "%", ")", "]", "}") | F.substring(text, -1, 1).isin("(", "[", "{")
        return F.when(text == "", w).when(tight, F.concat(text, w)).otherwise(F.concat(text, F.lit(" "), w))

    return strip_ws(F.aggregate(words, F.lit(""), step))


def sentences(words: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Sentences of timed words: key, sentence_no, start, end, text. A sentence ends with a word that ends in . ! or ?; what remains is the last one. Blank words are dropped. ``order`` is unique within a key; keys may be of any size."""
    closes = strip_ws(F.col("text")).rlike(r"[.!?]$").cast("int")
    spoken = words.filter(strip_ws(F.col("text")) != "").withColumns({"__closes": closes, "__one": F.lit(1)})
    numbered = sums_before(spoken, [key], order, {"closed": "__closes", "at": "__one"})
    rows = F.sort_array(F.collect_list(F.struct("at", "text")))
    return numbered.groupBy(key, (F.col("closed") + 1).alias("sentence_no")).agg(
        F.min_by("start", "at").alias("start"), F.max_by("end", "at").alias("end"), join_words(F.transform(rows, lambda r: r["text"])).alias("text")
    )


def line(start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit("["), timestamp(start), F.lit(" --> "), timestamp(end), F.lit("] "), strip_ws(text))


def text_lines(rows: DataFrame, key: str, order: list[str], parts: bool = False) -> DataFrame:
    """One text of ``[start --> end] text`` lines per video that has any: key, content. With ``parts``, its parts in order: key, part, content."""
    numbered = with_position(rows, order, "__n", [key])
    pieces = in_parts(numbered, key, "__n", line(F.col("start"), F.col("end"), F.col("text")), "\n")
    return pieces if parts else joined_parts(pieces, key, "\n")


def vtt(segments: DataFrame, key: str, order: list[str], parts: bool = False) -> DataFrame:
    """One WebVTT text per video that has segments, cues numbered from 1: key, content. With ``parts``, its parts in order, the first with the header: key, part, content."""
    numbered = with_position(segments, order, "__n", [key])
    cue = F.concat((F.col("__n") + 1).cast("string"), F.lit("\n"), timestamp(F.col("start")), F.lit(" --> "), timestamp(F.col("end")), F.lit("\n"), strip_ws(F.col("text")), F.lit("\n"))
    pieces = in_parts(numbered, key, "__n", cue, "\n").withColumn("content", F.concat(F.when(F.col("part") == 0, "WEBVTT\n\n").otherwise(""), "content"))
    return pieces if parts else joined_parts(pieces, key, "\n")


def _without_place(name: str):
    return lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r[name].alias(name))


def detailed_json(offsets: DataFrame, key: str, order: str) -> DataFrame:
    """The transcript of each video as one JSON text: text, segments and words on the video's time axis; chunk_count and chunks_transcribed where it has more than one chunk.

    One value holds all of a video's words, as the file of a video does; use ``timed_rows`` where that is too much.
    """
    whole = merged_text(offsets, key)
    out = whole
    for field, name in (("segments", "text"), ("words", "word")):
        rows = timed_rows(offsets, key, order, field)
        item = F.struct(F.col(order), F.col("position"), F.col("start"), F.col("end"), F.col("text").alias(name))
        lists = rows.groupBy(F.col(key).alias("__key")).agg(F.transform(F.sort_array(F.collect_list(item)), _without_place(name)).alias(field))
        out = out.join(lists, out[key].eqNullSafe(lists["__key"]), "left").drop("__key")
    several = F.col("chunk_count") > 1
    fields = [F.col("text"), *[F.coalesce(F.col(f), F.array().cast(dict(out.dtypes)[f])).alias(f) for f in ("segments", "words")]]
    fields += [F.when(several, F.col(c)).alias(c) for c in ("chunk_count", "chunks_transcribed")]
    return out.select(key, F.to_json(F.struct(*fields), {"pretty": "true"}).alias("content"))


def timing_json(rows: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """How long each stage took, and all of them, as one JSON text per video: key, content. Stages that weren't timed are left out."""
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages), start=F.lit(0.0))
    return rows.select(key, F.to_json(F.struct(*[F.col(s) for s in stages], total.alias("total_time")), {"pretty": "true"}).alias("content"))


def transcription_batch(selected: DataFrame, catalogue: DataFrame, done: DataFrame) -> DataFrame:
    """Status of every selected title: skipped_missing (blank title or no such video), skipped_done, or to_run; with its video and the folder of its output.

    selected: title; catalogue: stem, path; done: folder of each transcript that exists. Titles name the stem of a video,
    case and all. A title selected twice has two rows: the second run finds the first one's output.
    """
    title = F.coalesce(strip_ws(F.col("title").cast("string")), F.lit(""))
    rows = selected.withColumn("title", title).join(catalogue.withColumnRenamed("stem", "title"), "title", "left")
    rows = rows.withColumn("folder", safe_folder_name(F.col("title"))).join(done.select("folder", F.lit(True).alias("__done")).distinct(), "folder", "left")
    status = F.when((F.col("title") == "") | F.col("path").isNull(), "skipped_missing").when(F.col("__done"), "skipped_done").otherwise("to_run")
    return rows.withColumn("status", status).drop("__done")
