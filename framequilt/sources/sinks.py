"""Sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequilt.functions.text import file_name, file_stem
from framequilt.operators.blocks import with_position
from framequilt.session import exists, write_file
from framequilt.sources.readers import numbered_lines


def append_jsonl(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; null fields are kept. The job commits as a whole, so no buffer is flushed by hand."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def summary(metrics: DataFrame, grouped: DataFrame, **notes) -> dict:
    """A row of overall metrics, and the metrics of each group by field and value; both are as small as the groups are few."""
    out: dict = {"overall": metrics.first().asDict(), "grouped": {}}
    for r in grouped.orderBy("field", F.desc("n_success"), "value").collect():
        row = r.asDict()
        out["grouped"].setdefault(row.pop("field"), {})[row.pop("value")] = row
    return out | notes


def write_summary(metrics: DataFrame, grouped: DataFrame, path: str, **notes) -> dict:
    """One pretty JSON of ``summary``, on whatever store the path names."""
    told = summary(metrics, grouped, **notes)
    write_file(metrics.sparkSession, path, json.dumps(told, indent=2, ensure_ascii=False))
    return told


def _shown(x) -> str:
    return "N/A" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def summary_report(told: dict) -> str:
    """A summary as readers see it on the console: a block for all rows, then one for each field with its values."""

    def block(of: dict, names: Sequence[str]) -> list[str]:
        return [f"  {n}: {_shown(of.get(n))}" for n in names]

    everything = list(told["overall"])
    scores = [n for n in ("n_success", "exact_match", "token_f1", "rouge_l", "llm_judge_n", "llm_judge_accuracy") if n in told["overall"]]
    lines = ["All rows", *block(told["overall"], everything)]
    for field, groups in told["grouped"].items():
        lines += ["", f"By {field}"]
        for value, of in groups.items():
            lines += [f"[{field} = {value}]", *block(of, scores)]
    return "\n".join(lines)


def distribution_report(counts: DataFrame, title: str) -> str:
    """A distribution (columns, n, percent) as lines, most frequent first; as long as there are categories."""
    named = [c for c in counts.columns if c not in ("n", "percent")]
    return "\n".join([title, *(f"  {' / '.join(str(r[c]) for c in named)}: {r['n']} ({r['percent']:.2f}%)" for r in counts.collect())])


def write_csv(df: DataFrame, path: str) -> None:
    """A run's summary, one row per selected item, in one file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_ranks(df: DataFrame, path: str, world: int, order: str = "line_no") -> None:
    """Rows of each rank in a folder of its own: rank=N. Every ``world``-th row in the order given belongs to a rank, whatever numbers ``order`` holds."""
    with_position(df, [order], "__place").withColumn("rank", F.pmod(F.col("__place"), F.lit(world)).cast("int")).drop("__place").write.mode("overwrite").partitionBy("rank").json(path)


def merge_ranks(spark: SparkSession, path: str, world: int, schema: str) -> DataFrame:
    """Rows of all ranks with rank; a rank without folder is an error. Order by rank and the rows' own number for the merged order, or read the folders with ``merged_lines``."""
    missing = [r for r in range(world) if not exists(spark, f"{path}/rank={r}")]
    if missing:
        raise FileNotFoundError(f"no output of ranks {missing} in {path}")
    return spark.read.schema(f"{schema}, rank int").json(path)


def write_texts(df: DataFrame, key: str, content: str, folder: str, suffix: str) -> None:
    """One text file per row in ``folder``, which all machines must reach. Written by the tasks; a repeated task writes the same file again."""
    from pyarrow import fs

    def save(rows) -> None:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{base}/{r[0]}{suffix}") as f:
                f.write(r[1].encode("utf-8"))

    df.filter(F.col(content).isNotNull()).select(key, content).foreachPartition(save)


def existing_outputs(spark: SparkSession, folder: str, suffixes: Sequence[str]) -> DataFrame:
    """Stems of the non-empty outputs that a folder holds."""
    glob = "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.filter("length > 0").select(file_stem(F.col("path")).alias("stem")).distinct()


def output_path(path: Column, out: str, root: str | None = None) -> Column:
    """``{stem}_cropped{suffix}`` below ``out``; with ``root``, in the same sub-folders as below it."""
    suffix = F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)
    name = F.concat(file_stem(path), F.lit("_cropped"), suffix)
    if root is None:
        return F.concat(F.lit(out.rstrip("/") + "/"), name)
    inner = F.regexp_extract(F.replace(path, F.lit(root.rstrip("/") + "/"), F.lit("")), r"^(.*/)?[^/]*$", 1)
    return F.concat(F.lit(out.rstrip("/") + "/"), inner, name)


def merged_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines of several files in the order given: file_no, line_no, value."""
    if absent := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(f"missing: {absent}")
    out: DataFrame | None = None
    for i, p in enumerate(paths):
        df = numbered_lines(spark, p).select(F.lit(i).alias("file_no"), "line_no", "value")
        out = df if out is None else out.unionByName(df)
    return out
