"""Options of the programs, with their defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from framequilt.operators.metrics import GROUPS


@dataclass(frozen=True)
class GenerateOptions:
    max_videos: int = 0
    segments_per_video: int = 7
    min_caption_len: int = 12
    max_categories: int = 3
    question_style: str = "mixed"
    min_score: int = 4
    segment_radius: int = 1
    seed: int = 42
    include_rationale: bool = False
    skip_validator: bool = False
    procedures: tuple[str, ...] = ()
    specialties: tuple[str, ...] = ()
    surgery_types: tuple[str, ...] = ()
    type_source: str = "json"

    def __post_init__(self) -> None:
        if self.type_source not in ("json", "excel"):
            raise ValueError("type_source is json or excel")
        if self.question_style not in ("open", "mcq", "mixed"):
            raise ValueError("question_style is open, mcq or mixed")
        if not 1 <= self.min_score <= 5:
            raise ValueError("min_score is 1 to 5")


@dataclass(frozen=True)
class MetricsOptions:
    group_by: tuple[str, ...] = GROUPS
    llm_judge: bool = False
    judge_model: str = ""
    judge_sleep: float = 0.0
    judge_max_output_tokens: int = 256


@dataclass(frozen=True)
class InferenceOptions:
    model: str = ""
    num_frames: int = 4
    max_output_tokens: int = 128
    jpg_quality: int = 3
    temperature: float = 0.0
    thinking_budget: int = 0
    sleep: float = 0.0
    limit: int = 0
    overwrite: bool = False
    rank: int = 0
    world: int = 1
    merge_ranks_at_end: bool = False

    def __post_init__(self) -> None:
        if self.num_frames < 1 or self.max_output_tokens < 1 or self.limit < 0 or self.sleep < 0:
            raise ValueError("num_frames and max_output_tokens from 1, limit and sleep from 0")
        if not 0 <= self.rank < self.world:
            raise ValueError("rank lies within the world")


@dataclass(frozen=True)
class TranscribeOptions:
    backend: str = "api"
    model_name: str = "base"
    language: str | None = None
    api_key: str | None = field(default=None, repr=False)
    audio_format: str = "mp3"
    max_file_mb: float = 25.0
    output_dir: str = "./outputs"
    temp_dir: str = "./temp"

    def __post_init__(self) -> None:
        if self.backend not in ("api", "local"):
            raise ValueError("backend is api or local")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> TranscribeOptions:
        """Options from the environment, blanks at the ends removed; the backend api needs a key."""
        # Names of the variables.
        names = {"backend": "WHISPER_BACKEND", "model_name": "WHISPER_MODEL_NAME", "language": "WHISPER_LANGUAGE", "api_key": "OPENAI_API_KEY", "audio_format": "AUDIO_FORMAT", "max_file_mb": "MAX_FILE_SIZE_MB", "output_dir": "OUTPUT_DIR", "temp_dir": "TEMP_DIR"}
        told: dict = {k: env[v].strip() for k, v in names.items() if v in env}
        for k in ("language", "api_key"):
            told[k] = told.get(k) or None
        if "backend" in told:
            told["backend"] = told["backend"].lower()
        if "max_file_mb" in told:
            told["max_file_mb"] = float(int(told["max_file_mb"]))
        options = cls(**told)
        if options.backend == "api" and not options.api_key:
            raise ValueError("the backend api needs OPENAI_API_KEY")
        return options


@dataclass(frozen=True)
class CropOptions:
    samples: int = 24
    padding: float = 0.04
    max_analysis_dim: int = 640
    saliency_quantile: float = 0.78
    black_threshold: float = 18.0
    print_filter: bool = False
    min_border_px: int = 16
    min_border_pct: float = 0.025
    dry_run: bool = False

    def __post_init__(self) -> None:
        if self.max_analysis_dim < 1 or not 0 < self.saliency_quantile < 1 or not 0 <= self.black_threshold <= 255:
            raise ValueError("max_analysis_dim from 1, saliency_quantile between 0 and 1, black_threshold within 0 to 255")
        if self.samples < 1 or not 0 <= self.padding <= 1 or self.min_border_px < 0 or not 0 <= self.min_border_pct <= 1:
            raise ValueError("samples from 1, padding and min_border_pct within 0 to 1, min_border_px from 0")
