"""Sources in files: raw filings, submission indexes, golden questions, reports, settings."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.html import decoded_text

SUBMISSIONS = """cik bigint, name string, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>,
  filingDate: array<string>, reportDate: array<string>, primaryDocument: array<string>>>"""
GOLDEN = """id string, type string, question string, refuse boolean, verified boolean, require string,
  expected array<struct<company: string, form_type: string, accession: string, section_prefix: string, must_contain: string>>"""
TYPES = ("single_fact", "cross_company", "temporal", "out_of_corpus")


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Submission indexes, one JSON document in each file."""
    return spark.read.schema(SUBMISSIONS).json(path, multiLine=True)


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """``(raw_path, text, content_hash, size_bytes)``: UTF-8 or else Windows-1252, hash and size of the bytes."""
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return blobs.select(
        F.col("path").alias("raw_path"), decoded_text(F.col("content")).alias("text"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes")
    )


def present(spark: SparkSession, folder: str) -> DataFrame:
    """``raw_path`` of the files below a folder; only names are listed. A folder that isn't there has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "raw_path string")
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return names.select(plain_path(F.col("path")).alias("raw_path"))


def plain_path(path: Column) -> Column:
    """Local paths without their scheme, others as they are."""
    return F.regexp_replace(path, "^file:/*", "/")


def write_file(spark: SparkSession, to: str, body: bytes) -> None:
    """Writes a file of any file system that Spark knows; it's there whole or not at all."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    target, staged = path(to), path(f"{to}._part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(staged, True)
    stream.write(bytearray(body))
    stream.close()
    fs.delete(target, False)
    if not fs.rename(staged, target):
        raise OSError(f"{to} couldn't be written")


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from YAML, checked: ids unique, types known, and specifications just where one is to answer."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = checked_golden(yaml.safe_load(f) or [])
    return spark.createDataFrame(rows, GOLDEN)


def checked_golden(items: list[dict]) -> list[tuple]:
    items = items.get("questions", []) if isinstance(items, dict) else items
    seen: set[str] = set()
    rows = []
    for x in items:
        key, kind, require = x.get("id"), x.get("type"), x.get("require", "all")
        refuse, expected = bool(x.get("refuse", False)), x.get("expected") or []
        if not key or key in seen:
            raise ValueError(f"golden question without an id of its own: {key!r}")
        if kind not in TYPES:
            raise ValueError(f"{key}: unknown type {kind!r}")
        if require not in ("all", "any"):
            raise ValueError(f"{key}: require must be all or any")
        if refuse == bool(expected):
            raise ValueError(f"{key}: specifications are for questions to answer, and only for those")
        seen.add(key)
        names = ("company", "form_type", "accession", "section_prefix", "must_contain")
        rows.append((key, kind, x["question"], refuse, bool(x.get("verified", False)), require, [tuple(e.get(n) for n in names) for e in expected]))
    return rows


def golden_specs(questions: DataFrame) -> DataFrame:
    """A row for each specification, with an id within the set."""
    each = questions.select(F.col("id").alias("question_id"), F.posexplode("expected").alias("nth", "e"))
    return each.select("question_id", F.concat_ws("#", "question_id", F.col("nth").cast("string")).alias("spec_id"), "e.*")


def latest_report(spark: SparkSession, folder: str, most: int = 50_000) -> DataFrame:
    """The newest Markdown report's path and first characters; no row if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    newest = files.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1)
    return newest.select("path", F.substring(decoded_text(F.col("content")), 1, most).alias("report"))


@dataclass(frozen=True)
class Settings:
    """Settings from the environment; each is checked when read, and all that is wrong is named at once."""

    data_dir: str = "data"
    user_agent: str = ""
    max_rps: float = 8.0
    refusal_threshold: float = 0.68
    refusal_threshold_no_entity: float = 0.75
    tokenizer_path: str = ""

    @classmethod
    def read(cls, env: dict[str, str] | None = None, prefix: str = "LEDGERLOOM_") -> Settings:
        env = dict(os.environ) if env is None else env
        values, wrong = {}, []
        for f in fields(cls):
            text = env.get(prefix + f.name.upper())
            if text is None:
                continue
            try:
                values[f.name] = float(text) if isinstance(f.default, float) else text
            except ValueError:
                wrong.append(f"{prefix}{f.name.upper()} isn't a number: {text!r}")
        made = cls(**values)
        if made.user_agent and not re.fullmatch(r".+\s+[^@\s]+@[^@\s]+\.[^@\s]+", made.user_agent):
            wrong.append(f"{prefix}USER_AGENT needs a name and an address for mail")
        if not 0 < made.max_rps <= 10:
            wrong.append(f"{prefix}MAX_RPS must be above 0 and at most 10")
        if wrong:
            raise ValueError("; ".join(wrong))
        return made
