"""Media tools and model clients behind injectable functions.

Each class is built on the driver and called once per partition; it gives a function for ``models.ask``. What touches a
disk, a process or the network comes in as an argument, so tests replay it.
"""

from __future__ import annotations

import base64
import json
import subprocess
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequilt.functions import frames as maps
from framequilt.functions.values import component_score, expand_box, implausible_box, restrict_window
from framequilt.models import Model, ask
from framequilt.options import CropOptions

Tool = Callable[[Sequence[str], float | None], bytes]
#: Fixed value: seconds that audio tools may take.
AUDIO_TIMEOUT = 300.0


def run_tool(command: Sequence[str], timeout: float | None = None) -> bytes:
    """Output of a program; its complaint is the error's text where it fails."""
    done = subprocess.run(list(command), capture_output=True, timeout=timeout, check=False)
    if done.returncode:
        raise RuntimeError(f"{command[0]} failed: {done.stderr.decode('utf-8', 'replace').strip()[-2000:]}")
    return done.stdout


# Options of the programs.
def probe_command(path: str) -> list[str]:
    return ["ffprobe", "-v", "error", "-select_streams", "v:0", "-show_entries", "stream=width,height,duration,avg_frame_rate:format=duration", "-of", "json", path]


def frame_command(path: str, seconds: float, quality: int = 3) -> list[str]:
    return ["ffmpeg", "-v", "error", "-ss", f"{seconds:.3f}", "-i", path, "-frames:v", "1", "-q:v", str(quality), "-f", "image2pipe", "-c:v", "mjpeg", "-"]


def audio_command(path: str, start: float, end: float | None, kind: str = "mp3") -> list[str]:
    length = [] if end is None else ["-t", f"{end - start:.3f}"]
    return ["ffmpeg", "-v", "error", "-ss", f"{start:.3f}", "-i", path, *length, "-vn", "-f", kind, "-"]


def crop_command(path: str, out: str, x: int, y: int, w: int, h: int) -> list[str]:
    return ["ffmpeg", "-y", "-i", path, "-vf", f"crop={w}:{h}:{x}:{y}", "-c:v", "libx264", "-crf", "18", "-preset", "medium", "-c:a", "copy", out]


def video_info(reply: Column) -> Column:
    """What a probe says: struct width, height, duration, error. The stream's duration comes before the file's; 'N/A' is none."""
    r = F.from_json(reply, "struct<streams array<struct<width int, height int, duration string>>, format struct<duration string>>")
    first = F.get(r["streams"], F.lit(0))
    seconds = F.coalesce(first["duration"].try_cast("double"), r["format"]["duration"].try_cast("double"))
    error = F.when(first.isNull(), "no video stream").when(first["width"].isNull() | first["height"].isNull(), "no size").when(seconds.isNull(), "no duration")
    return F.struct(first["width"].alias("width"), first["height"].alias("height"), seconds.alias("duration"), error.alias("error"))


@dataclass(frozen=True)
class Probe:
    """Requests are paths, replies what ffprobe prints."""

    tool: Tool = run_tool

    def __call__(self) -> Model:
        return lambda requests: [self.tool(probe_command(p), None).decode() for p in requests]


def probed(df: DataFrame, path: str, make: Callable[[], Model] = Probe()) -> DataFrame:
    """Adds width, height, duration and probe_error of each video."""
    told = ask(df, path, "__reply", make, attempts=1).withColumn("__info", video_info(F.col("__reply")))
    columns = {"width": F.col("__info.width"), "height": F.col("__info.height"), "duration": F.col("__info.duration"), "probe_error": F.coalesce("__reply_error", "__info.error")}
    return told.withColumns(columns).drop("__reply", "__reply_error", "__info")


@dataclass(frozen=True)
class Crop:
    """Requests are JSON objects path, out, x, y, w, h; replies the path that was written."""

    tool: Tool = run_tool

    def __call__(self) -> Model:
        def one(request: str) -> str:
            r = json.loads(request)
            self.tool(crop_command(r["path"], r["out"], r["x"], r["y"], r["w"], r["h"]), None)
            return r["out"]

        return lambda requests: [one(r) for r in requests]


def cropped(to_crop: DataFrame, make: Callable[[], Model] = Crop()) -> DataFrame:
    """Crops the videos with the status to_crop (path, out, x, y, w, h): status becomes cropped or failed, with error_message. Other rows stay as they are."""
    request = F.when(F.col("status") == "to_crop", F.to_json(F.struct("path", "out", "x", "y", "w", "h")))
    told = ask(to_crop.filter("status = 'to_crop'").withColumn("request", request), "request", "written", make, attempts=1)
    done = told.withColumns({"status": F.when(F.col("written_error").isNull(), "cropped").otherwise("failed"), "error_message": F.col("written_error")}).drop("request", "written", "written_error")
    return done.unionByName(to_crop.filter("status <> 'to_crop' OR status IS NULL").withColumn("error_message", F.lit(None).cast("string")))


def data_url(picture: bytes) -> str:
    return "data:image/jpeg;base64," + base64.b64encode(picture).decode()


def frames_at(path: str, seconds: float, n: int, tool: Tool = run_tool, quality: int = 3) -> list[bytes]:
    """Pictures at the middles of ``n`` equal parts, empty ones skipped. No length, no number or no picture is an error."""
    if n <= 0 or seconds <= 0:
        raise ValueError("duration and number of frames must be above 0")
    got = [p for i in range(n) if (p := tool(frame_command(path, (i + 0.5) * seconds / n, quality), None))]
    if not got:
        raise RuntimeError(f"no frames from {path}")
    return got


@dataclass(frozen=True)
class Vision:
    """Requests are those of ``programs.vision_request``. ``call`` takes the prompt, the frames as data URLs and the most tokens of the reply."""

    call: Callable[[str, list[str], int], str]
    seconds: Callable[[str], float]
    tool: Tool = run_tool

    def __call__(self) -> Model:
        def one(request: str) -> str:
            r = json.loads(request)
            pictures = frames_at(r["video"], self.seconds(r["video"]), r["num_frames"], self.tool)
            return self.call(r["prompt"], [data_url(p) for p in pictures], r["max_output_tokens"]).strip()

        return lambda requests: [one(r) for r in requests]


@dataclass(frozen=True)
class Whisper:
    """Requests are those of ``programs.transcribe``. ``hear`` takes the sound of a chunk and gives text, segments and words; the backend api times words only. Words without times are dropped."""

    hear: Callable[[bytes, str], dict]
    tool: Tool = run_tool

    def __call__(self) -> Model:
        def one(request: str) -> str:
            r = json.loads(request)
            told = self.hear(self.tool(audio_command(r["path"], r["start_sec"], r.get("end_sec")), AUDIO_TIMEOUT), r["backend"])
            words = [w for w in told.get("words") or [] if w.get("start") is not None and w.get("end") is not None]
            segments = [] if r["backend"] == "api" else told.get("segments") or []
            return json.dumps({"text": told.get("text") or "", "segments": segments, "words": words}, ensure_ascii=False)

        return lambda requests: [one(r) for r in requests]


def plain_json(x, depth: int = 8):
    """A reply's object as JSON can hold it: fields of objects, text of bytes, and the name of what is nothing of these."""
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if depth == 0:
        return repr(x)[:200]
    if isinstance(x, (bytes, bytearray)):
        return f"{len(x)} bytes"
    if isinstance(x, dict):
        return {str(k): plain_json(v, depth - 1) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain_json(v, depth - 1) for v in x]
    fields = getattr(x, "__dict__", None)
    return {k: plain_json(v, depth - 1) for k, v in fields.items() if not k.startswith("_")} if fields else repr(x)[:200]


def _salient_boxes(options: CropOptions) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def analyse(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("frame_no")
        pictures = [np.frombuffer(p, dtype=np.uint8).reshape(h, w, 3) for p, h, w in zip(rows["pixels"], rows["height"], rows["width"], strict=True)]
        mean, scale = maps.saliency(pictures, options.max_analysis_dim)
        h, w = mean.shape
        least = maps.least_area(h, w)
        found = [c for c in maps.components(maps.salient_mask(mean, options.saliency_quantile)) if c[4] >= least]
        bright = [maps.bright_box(p, options.black_threshold) for p in pictures]
        inner = [min(b[0] for b in bright), min(b[1] for b in bright), max(b[2] for b in bright), max(b[3] for b in bright)]
        n = max(1, len(found))
        base = pd.DataFrame({"path": [rows["path"].iloc[0]] * n, "video_w": int(rows["width"].iloc[0]), "video_h": int(rows["height"].iloc[0]), "map_w": w, "map_h": h, "scale": scale})
        boxes = pd.DataFrame(found or [(None,) * 5], columns=["bx", "by", "bw", "bh", "area"], dtype="Int64")
        return pd.concat([base, boxes, pd.DataFrame([inner] * n, columns=["in_left", "in_top", "in_right", "in_bottom"])], axis=1)

    return analyse


def procedure_windows(frames: DataFrame, options: CropOptions = CropOptions()) -> DataFrame:
    """The window of each video that shows the procedure: path, video_w, video_h, x, y, w, h, reason.

    frames: path, frame_no, height, width, pixels (rows of blue, green, red bytes); a video has a few sampled frames, and
    unreadable ones are absent. Pictures become boxes in one task per video; what is decided about boxes is Spark's. No
    salient component, or an implausible one, gives the whole frame, with the reason.
    """
    schema = "path string, video_w bigint, video_h bigint, map_w bigint, map_h bigint, scale double, bx bigint, by bigint, bw bigint, bh bigint, area bigint, in_left bigint, in_top bigint, in_right bigint, in_bottom bigint"
    boxes = frames.select("path", "frame_no", "height", "width", "pixels").groupBy("path").applyInPandas(_salient_boxes(options), schema)
    c = F.col
    score = component_score(c("bx"), c("by"), c("bw"), c("bh"), c("area"), c("map_w"), c("map_h"))
    # of equal scores the first component, from top to bottom
    best = boxes.groupBy("path").agg(F.max_by(F.struct(*boxes.columns[1:]), F.struct(score, -c("by"), -c("bx"))).alias("b"), F.first(F.struct(*boxes.columns[1:])).alias("any"))
    rows = best.select("path", F.coalesce("b", "any").alias("b")).select("path", "b.*")
    odd = implausible_box(c("bw"), c("bh"), c("map_w"), c("map_h"))
    reason = F.when(c("bx").isNull(), "no_salient_component").when(odd, "implausible_bbox")
    big = [F.rint(c(n) / c("scale")).cast("bigint") for n in ("bx", "by", "bw", "bh")]
    rows = rows.withColumn("reason", reason).withColumn("e", expand_box(*big, c("video_w"), c("video_h"), options.padding))
    inner = F.struct(c("in_left").alias("left"), c("in_top").alias("top"), c("in_right").alias("right"), c("in_bottom").alias("bottom"))
    rows = rows.withColumn("r", restrict_window(c("e.x"), c("e.y"), c("e.w"), c("e.h"), inner, c("video_w"), c("video_h")))
    whole = {"x": F.lit(0).cast("bigint"), "y": F.lit(0).cast("bigint"), "w": c("video_w"), "h": c("video_h")}
    return rows.select("path", "video_w", "video_h", *[F.when(c("reason").isNotNull(), whole[n]).otherwise(c(f"r.{n}")).alias(n) for n in ("x", "y", "w", "h")], "reason")


def read_frames(df: DataFrame, path: str, times: str, grab: Callable[[str, float], np.ndarray | None]) -> DataFrame:
    """Frames of each video at the times of an array column: path, frame_no, height, width, pixels. ``grab`` gives a picture or none; a video without any has no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, ts in zip(pdf["path"], pdf["times"], strict=True):
                got = [(i, f) for i, t in enumerate(ts) if (f := grab(p, float(t))) is not None]
                if got:
                    yield pd.DataFrame([(p, i, f.shape[0], f.shape[1], np.ascontiguousarray(f, dtype=np.uint8).tobytes()) for i, f in got], columns=["path", "frame_no", "height", "width", "pixels"])

    return df.select(F.col(path).alias("path"), F.col(times).alias("times")).mapInPandas(run, "path string, frame_no int, height int, width int, pixels binary")
