import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequilt import media
from framequilt.functions import frames as maps
from framequilt.models import ask
from framequilt.options import CropOptions, InferenceOptions, TranscribeOptions
from framequilt.plans.programs import vision_request


def test_components_equal_a_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < 0.45
        seen, want = np.zeros(mask.shape, dtype=bool), []
        for y, x in np.argwhere(mask):
            if seen[y, x]:
                continue
            todo, cells = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                cells.append((a, b))
                for i in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for j in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                        if mask[i, j] and not seen[i, j]:
                            seen[i, j] = True
                            todo.append((i, j))
            c = np.array(cells)
            low, high = c.min(axis=0), c.max(axis=0)
            want.append((low[1], low[0], high[1] - low[1] + 1, high[0] - low[0] + 1, len(c)))
        assert sorted(maps.components(mask)) == sorted(want)


def test_squares_and_blurs():
    mask = np.zeros((9, 9), dtype=bool)
    mask[4, 4] = True
    assert maps.dilated(mask, 3).sum() == 9 and maps.eroded(maps.dilated(mask, 3), 3).sum() == 1 and not maps.dilated(maps.eroded(mask, 3), 3).any()
    assert maps.eroded(np.ones((4, 5), dtype=bool), 3).all()
    flat = np.full((20, 30), 0.7)
    assert np.allclose(maps.blurred(flat, 3.0), 0.7) and maps.blurred(np.eye(31), 2.0).sum() == pytest.approx(31, rel=0.02)
    assert maps.resized(np.full((40, 60, 3), 7, dtype=np.uint8), 10, 15).shape == (10, 15, 3) and (maps.resized(np.full((41, 63, 3), 7, dtype=np.uint8), 10, 15) == 7).all()


def test_colours_and_motion():
    frame = np.zeros((1, 4, 3), dtype=np.uint8)
    frame[0, 0], frame[0, 1], frame[0, 2] = (0, 0, 255), (255, 0, 0), (0, 255, 0)
    h, s, v = maps.hue_saturation_value(frame)
    assert h[0].tolist() == [0, 120, 60, 0] and s[0].tolist() == [1, 1, 1, 0] and v[0].tolist() == [1, 1, 1, 0]
    assert not maps.motion_map(np.ones((5, 5)), None).any() and maps.motion_map(np.eye(9), np.zeros((9, 9))).max() == 1
    assert maps.bright_box(np.zeros((3, 4, 3), dtype=np.uint8), 10) == (0, 0, 4, 3)


def _picture(shift=0):
    """A red square on dark grey within a black border."""
    p = np.zeros((180, 320, 3), dtype=np.uint8)
    p[10:170, 40:280] = 40
    p[50:130, 110 + shift : 210 + shift] = (30, 30, 220)
    return p


def test_windows_of_videos(spark):
    rows = [("/a.mp4", i, 180, 320, bytearray(_picture(i).tobytes())) for i in range(3)] + [("/b.mp4", 0, 90, 90, bytearray(np.zeros((90, 90, 3), dtype=np.uint8).tobytes()))]
    got = {r["path"]: r for r in media.procedure_windows(spark.createDataFrame(rows, "path string, frame_no int, height int, width int, pixels binary")).collect()}
    a = got["/a.mp4"]
    assert a["reason"] is None and 40 <= a["x"] <= 110 and a["x"] + a["w"] >= 205 and a["y"] <= 50 and a["y"] + a["h"] >= 125 and a["x"] % 2 == a["w"] % 2 == 0
    assert a["x"] >= 40 and a["y"] >= 10 and a["x"] + a["w"] <= 280 and a["y"] + a["h"] <= 170 and (a["video_w"], a["video_h"]) == (320, 180)
    b = got["/b.mp4"]
    # all black: every pixel is as salient as any other, so the whole frame is one component, and even numbers begin at 2
    assert (b["x"], b["y"], b["w"], b["h"]) == (2, 2, 88, 88)
    times = spark.createDataFrame([("/a.mp4", [0.0, 1.0, 9.0]), ("/gone.mp4", [0.0])], "path string, times array<double>")
    picture = _picture()
    read = media.read_frames(times, "path", "times", lambda p, t: picture if p == "/a.mp4" and t < 5 else None).collect()
    assert [(r["path"], r["frame_no"], r["height"]) for r in read] == [("/a.mp4", 0, 180), ("/a.mp4", 1, 180)]


def test_probe_and_crop(spark):
    replies = {"/a": {"streams": [{"width": 4, "height": 2, "duration": "N/A"}], "format": {"duration": "12.5"}}, "/b": {"streams": []}, "/c": {"streams": [{"width": 4, "height": 2}]}}

    def tool(command, timeout):
        if command[0] == "ffprobe" and command[-1] in replies:
            return json.dumps(replies[command[-1]]).encode()
        raise OSError("broken")

    df = spark.createDataFrame([(p,) for p in ("/a", "/b", "/c", "/d")], "path string")
    got = {r["path"]: r for r in media.probed(df, "path", media.Probe(tool)).collect()}
    assert (got["/a"]["width"], got["/a"]["duration"], got["/a"]["probe_error"]) == (4, 12.5, None)
    assert got["/b"]["probe_error"] == "no video stream" and got["/c"]["probe_error"] == "no duration" and "broken" in got["/d"]["probe_error"]
    said = []

    def cut(command, timeout):
        said.append(command)
        if command[3] == "/bad":
            raise OSError("full")
        return b""

    todo = spark.createDataFrame([("/a", "/o/a", 2, 4, 6, 8, "to_crop"), ("/bad", "/o/b", 0, 0, 2, 2, "to_crop"), ("/c", None, None, None, None, None, "missing_video")], "path string, out string, x int, y int, w int, h int, status string")
    rows = {r["path"]: (r["status"], r["error_message"]) for r in media.cropped(todo, media.Crop(cut)).collect()}
    assert rows["/a"] == ("cropped", None) and rows["/bad"][0] == "failed" and "full" in rows["/bad"][1] and rows["/c"] == ("missing_video", None)
    assert "crop=6:8:2:4" in media.crop_command("/a", "/o", 2, 4, 6, 8)


def test_vision_and_whisper(spark):
    rows = spark.createDataFrame([("v.mp4", "<video>\nwhat is it", ["a", "b"]), ("none.mp4", "what", None)], "video string, question string, choices array<string>")
    asked = rows.withColumn("request", vision_request(rows, InferenceOptions(num_frames=2)))
    first = json.loads(asked.first()["request"])
    assert "- a\n- b" in first["prompt"] and "<video>" not in first["prompt"] and first["num_frames"] == 2

    def tool(command, timeout):
        return b"" if "none.mp4" in command else b"jpeg"

    make = media.Vision(lambda prompt, parts, most: f" {len(parts)} {parts[0][:22]} {most} ", lambda path: 10.0, tool)
    got = {r["video"]: (r["reply"], r["reply_error"]) for r in ask(asked, "request", "reply", make, attempts=1).collect()}
    assert got["v.mp4"] == ("2 data:image/jpeg;base64 128", None) and "no frames" in got["none.mp4"][1]
    with pytest.raises(ValueError):
        media.frames_at("v", 0.0, 4, tool)
    hear = media.Whisper(lambda sound, backend: {"text": "t", "segments": [{"start": 0, "end": 1, "text": "t"}], "words": [{"word": "t", "start": 0, "end": 1}, {"word": "x", "start": None, "end": 1}]}, lambda c, t: b"sound")()
    api, local = (json.loads(hear([json.dumps({"path": "p", "start_sec": 0.0, "end_sec": 5.0, "backend": b})])[0]) for b in ("api", "local"))
    assert api["segments"] == [] and len(local["segments"]) == 1 and len(api["words"]) == 1
    assert "-t" in media.audio_command("p", 1.0, 3.0) and "-t" not in media.audio_command("p", 0.0, None)


def test_tools_options_and_plain_json():
    assert media.run_tool(["echo", "x"]) == b"x\n"
    with pytest.raises(RuntimeError, match="failed"):
        media.run_tool(["ls", "/nowhere at all"])

    class Reply:
        def __init__(self):
            self.text, self.raw, self._hidden = "t", b"abc", 1

    assert media.plain_json({"a": [Reply(), None, 1.5]}) == {"a": [{"text": "t", "raw": "3 bytes"}, None, 1.5]}
    told = TranscribeOptions.from_env({"WHISPER_BACKEND": " Local ", "MAX_FILE_SIZE_MB": " 10 ", "WHISPER_LANGUAGE": " "})
    assert (told.backend, told.max_file_mb, told.language, told.output_dir) == ("local", 10.0, None, "./outputs")
    for env in ({}, {"WHISPER_BACKEND": "other"}):
        with pytest.raises(ValueError):
            TranscribeOptions.from_env(env)
    with pytest.raises(ValueError):
        CropOptions(saliency_quantile=1.5)
    with pytest.raises(ValueError):
        InferenceOptions(rank=2, world=2)
