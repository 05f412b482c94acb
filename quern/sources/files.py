"""Sources and sinks (§2.1): text trees, JSONL, artifacts, prepared datasets, summaries, configuration."""

from __future__ import annotations

import csv
import hashlib
import importlib.metadata
import io
import json
import os
import re
import shutil
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T

VERSION = 1


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC1, SRC2: (doc_id, text, source_path) of the text and Markdown files below a folder, or of one file whatever its suffix."""
    where = Path(path)
    if not where.exists():
        raise FileNotFoundError(path)
    one = where.is_file()
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path).select(F.col("value").alias("text"), F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")).alias("source_path"))
    rows = rows.withColumn("source_path", F.regexp_replace("source_path", "^file:/*", "/"))
    if one:
        return rows.withColumn("doc_id", F.lit(where.stem)).select("doc_id", "text", "source_path")
    rows = rows.where(F.lower("source_path").rlike(r"\.(txt|md|markdown)$"))
    if rows.limit(1).isEmpty():
        raise ValueError(f"no text files below {path}")
    root = str(where.resolve()).rstrip("/") + "/"
    return rows.withColumn("doc_id", F.regexp_replace(F.expr(f"substring(source_path, {len(root) + 1})"), r"\.[^./]*$", "")).select("doc_id", "text", "source_path")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC6."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(path: str | Path) -> Any:
    """SRC5."""
    return json.loads(Path(path).read_text("utf-8"))


def write_json(path: str | Path, value: Any) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", "utf-8")


def fingerprint(value: Any) -> str:
    """SCL2."""
    return "sha256:" + hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def source_fingerprint(docs: DataFrame) -> str:
    """MT2: a hash of all (doc_id, text), whatever their order."""
    h = F.xxhash64("doc_id", "text")
    n, low, total = docs.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return fingerprint([n, low, str(total)])


def build_manifest(pipeline: str, config: dict[str, Any], docs: DataFrame | None = None, embedding_model: str | None = None, level: str = "unspecified", **extra: Any) -> dict[str, Any]:
    """MT2: who made an artifact, from what and how."""
    versions = {}
    for name in ("pyspark", "pyarrow", "numpy"):
        versions[name] = importlib.metadata.version(name)
    return {
        "pipeline": {"id": pipeline, "implementation_level": level, "config": config, "config_fingerprint": fingerprint({"id": pipeline, "config": config})},
        "embedding": {"model": embedding_model},
        "corpus": {"fingerprint": None if docs is None else source_fingerprint(docs), "documents": None if docs is None else docs.select("doc_id").distinct().count()},
        "runtime": {"created_at": datetime.now(UTC).isoformat(), "versions": versions},
        "extra": extra,
    }


def check_manifest(m: dict[str, Any], pipeline: str | None = None) -> None:
    """MT2: an error unless a manifest has all its parts, its configuration is what its fingerprint says, and it is of the pipeline asked for."""
    if missing := sorted({"pipeline", "embedding", "corpus", "runtime"} - set(m)):
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    own = m["pipeline"]
    if not own.get("id"):
        raise ValueError("the manifest lacks pipeline.id")
    if pipeline is not None and own["id"] != pipeline:
        raise ValueError(f"the artifact is of {own['id']}, not {pipeline}")
    if own.get("config_fingerprint") != fingerprint({"id": own["id"], "config": own.get("config")}):
        raise ValueError("the configuration's fingerprint is wrong")


def stale(m: dict[str, Any], docs: DataFrame | None = None) -> list[str]:
    """MT2: what has changed since an artifact was made: its sources, the versions it was made with."""
    out = []
    if docs is not None and m["corpus"].get("fingerprint") != source_fingerprint(docs):
        out.append("sources")
    return out + [n for n, v in m["runtime"].get("versions", {}).items() if importlib.metadata.version(n) != v]


def save_artifact(nodes: DataFrame, path: str, manifest: dict[str, Any]) -> dict[str, Any]:
    """SRC8, SRC10: nodes with their embeddings as one Parquet table, then a manifest with its files' hash; a reader never sees one without the other's rows. What an earlier artifact left is deleted last."""
    spark = nodes.sparkSession
    if "pipeline" in manifest:
        check_manifest(manifest)
    data = f"{path}/nodes-{uuid.uuid4().hex}"
    nodes.write.parquet(data)
    whole = spark.read.parquet(data)
    has = "embedding" in whole.columns
    widths, lacking = [], 0
    if has:
        widths = [r[0] for r in whole.where("embedding is not null").select(F.size("embedding")).distinct().limit(2).collect()]
        lacking = whole.where("embedding is null").count() if widths else 0
    if len(widths) > 1 or lacking:
        shutil.rmtree(data, ignore_errors=True)
        raise ValueError("embeddings are missing or differ in width")  # AGG14
    full = manifest | {"version": VERSION, "nodes": whole.count(), "data": os.path.basename(data), "dimensions": widths[0] if widths else None, "files_fingerprint": files_fingerprint(spark, data)[2]}
    write_json(f"{path}/manifest.json", full)
    for old in Path(path).glob("nodes-*"):
        if old.name != full["data"]:
            shutil.rmtree(old, ignore_errors=True)
    return full


def files_fingerprint(spark: SparkSession, path: str) -> tuple[int, int, str]:
    """AGG19: (files, bytes, hash over each file's name and sha256) below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select("length", F.xxhash64(F.regexp_extract("path", r"([^/]+)$", 1), F.sha2("content", 256)).alias("h"))
    n, size, low, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return n, size, fingerprint([n, low, str(total)])


def load_artifact(spark: SparkSession, path: str, pipeline: str | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """SRC9: nodes and manifest, checked against each other before any model is called."""
    m = read_json(f"{path}/manifest.json")
    if m.get("version") != VERSION:
        raise ValueError(f"artifact version {m.get('version')} isn't {VERSION}")
    if "pipeline" in m or pipeline is not None:
        check_manifest(m, pipeline)
    nodes = spark.read.parquet(f"{path}/{m['data']}")
    if (n := nodes.count()) != m["nodes"]:
        raise ValueError(f"the manifest counts {m['nodes']} nodes, the table has {n}")
    if files_fingerprint(spark, f"{path}/{m['data']}")[2] != m["files_fingerprint"]:
        raise ValueError("the artifact's files have changed")
    return nodes, m


def inspect_artifact(spark: SparkSession, path: str) -> dict[str, Any]:
    """SRC11, AGG19."""
    nodes, m = load_artifact(spark, path)
    files, size, _ = files_fingerprint(spark, f"{path}/{m['data']}")
    return {"manifest": m, "nodes": m["nodes"], "has_embeddings": m["dimensions"] is not None, "files": files, "bytes": size}


def embed_cached(texts: DataFrame, cache: str, model: str, embed: Callable[[DataFrame], DataFrame], text: str = "text", use: bool = True) -> DataFrame:
    """SRC12, EMB1: ``texts`` with their embeddings and ``embedding_model``; only texts whose key the Parquet cache lacks are embedded, each once, and appended.

    The cache is one folder for each model, of keys' first hex digit, so a lookup reads what it may need. ``use`` False embeds all, and neither reads nor writes it.
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("_key", T.cache_key(model, F.col(text)))
    need = keyed.groupBy("_key").agg(F.min(text).alias("text"))
    tag = lambda df: keyed.join(df, "_key").drop("_key").withColumn("embedding_model", F.lit(model))
    if not use:
        return tag(embed(need).select("_key", F.col("embedding").cast("array<float>").alias("embedding")))
    path = f"{cache}/model={hashlib.sha256(model.encode()).hexdigest()[:16]}"
    if Path(path).exists():
        need = need.join(spark.read.parquet(path).select("_key"), "_key", "left_anti")
    new = embed(need).select("_key", F.col("embedding").cast("array<float>").alias("embedding"), F.substring("_key", 1, 1).alias("_part"))
    new.write.mode("append").partitionBy("_part").parquet(path)
    return tag(spark.read.schema("_key string, embedding array<float>, _part string").parquet(path).drop("_part"))


def summary_csv(rows: list[dict[str, Any]]) -> str:
    """SRC15."""
    out = io.StringIO()
    w = csv.DictWriter(out, sorted({k for r in rows for k in r}), lineterminator="\n")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue()


def summary_markdown(rows: list[dict[str, Any]], columns: list[str]) -> str:
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(columns), line("---" for _ in columns), *(line(r.get(c, "") for c in columns) for r in rows)]) + "\n"


def substitute(value: Any, env: dict[str, str] | None = None) -> Any:
    """SRC7: ${NAME} and ${NAME:-default}, throughout."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1]) or (m[2] or ""), value)
    return value


def _scalar(s: str) -> Any:
    s = s.strip()
    if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1]
    if s in ("", "null", "~"):
        return None
    if s.lower() in ("true", "false"):
        return s.lower() == "true"
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def _yaml(lines: list[tuple[int, str]], at: int, depth: int) -> tuple[Any, int]:
    if lines[at][1].startswith("- "):
        items: list[Any] = []
        while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("- "):
            body = lines[at][1][2:].strip()
            if re.match(r"[\w.-]+:(\s|$)", body):
                inner = depth + len(lines[at][1]) - len(lines[at][1][2:].lstrip())
                lines[at] = (inner, body)
                value, at = _yaml(lines, at, inner)
            else:
                value, at = _scalar(body), at + 1
            items.append(value)
        return items, at
    out: dict[str, Any] = {}
    while at < len(lines) and lines[at][0] == depth:
        key, _, rest = lines[at][1].partition(":")
        at += 1
        if rest.strip():
            out[key.strip()] = _scalar(rest)
        elif at < len(lines) and (lines[at][0] > depth or (lines[at][0] == depth and lines[at][1].startswith("- "))):
            out[key.strip()], at = _yaml(lines, at, lines[at][0])
        else:
            out[key.strip()] = None
    return out, at


def load_config(path: str | Path, env: dict[str, str] | None = None) -> Any:
    """SRC7: JSON, or YAML of nested maps, lists and scalars."""
    raw = Path(path).read_text("utf-8")
    try:
        return substitute(json.loads(raw), env)
    except json.JSONDecodeError:
        lines = [(len(x) - len(x.lstrip()), y) for x in raw.splitlines() if (y := _uncommented(x))]
        return substitute(_yaml(lines, 0, lines[0][0])[0] if lines else {}, env)


def _uncommented(line: str) -> str:
    """A line up to a ``#`` that begins it or follows a blank, outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (not line[:i].strip() or line[:i].rstrip()[-1:] in ":-[,"):
            quote = c
        elif c == "#" and not line[:i][-1:].strip():
            return line[:i].strip()
    return line.strip()


def load_env(path: str | Path) -> dict[str, str]:
    """SRC16: NAME=value lines."""
    pairs = (x.split("=", 1) for x in Path(path).read_text("utf-8").splitlines() if "=" in x and not x.lstrip().startswith("#"))
    return {k.strip().removeprefix("export ").strip(): v.strip().strip("\"'") for k, v in pairs}


def env_value(name: str, default: Any = None, kind: type = str, env: dict[str, str] | None = None) -> Any:
    """SRC16: a variable as a str, int, float or bool; the default where it is unset or blank; an error if it isn't one."""
    raw = (dict(os.environ) if env is None else env).get(name, "").strip()
    if not raw:
        return default
    if kind is bool:
        return raw.lower() in ("1", "true", "yes", "on")
    try:
        return kind(raw)
    except ValueError:
        raise RuntimeError(f"{name} must be {kind.__name__}, not {raw!r}") from None
