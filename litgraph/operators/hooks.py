"""Places for models, with defaults by rule. Each hook works on Arrow batches, and loads its model once for each Python worker."""

from __future__ import annotations

import shlex
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cased_tokens, entity_spans, tokens

_LOADED: dict[str, object] = {}


def once_per_worker(name: str, build: Callable[[], object]) -> object:
    """The worker's own instance of a model; `build` runs at the first call."""
    if name not in _LOADED:
        _LOADED[name] = build()
    return _LOADED[name]


def analyse(rows: DataFrame, text: str, model: Callable[[pd.Series], pd.Series] | None = None, schema: str = "array<struct<lemma:string,pos:string,stop:boolean>>") -> DataFrame:
    """Adds tokens: by rule, or by a model that maps a batch of texts to lists of tokens."""
    if model is None:
        return rows.withColumn("tokens", tokens(F.col(text)))
    return rows.withColumn("tokens", F.pandas_udf(model, schema)(F.col(text)))


def with_entities(rows: DataFrame, text: str) -> DataFrame:
    """Adds tokens (with capitals marked) and entities, both by rule."""
    return rows.withColumn("tokens", cased_tokens(F.col(text))).withColumn("entities", entity_spans(F.col("tokens")))


def locate(root: str, wanted: dict[str, str]) -> dict[str, str]:
    """Files of a local installation by glob patterns under root; each pattern must name exactly one."""
    out = {}
    for name, pattern in wanted.items():
        found = sorted(str(p) for p in Path(root).glob(pattern))
        if len(found) != 1:
            raise FileNotFoundError(f"{name}: {pattern} matches {len(found)} files under {root}: {', '.join(found[:5])}")
        out[name] = found[0]
    return out


def embed(rows: DataFrame, key: str, words: str, dimensions: int = 64, model: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """key and embedding: hashed word counts, or a model's vectors. A row's vector depends on that row alone."""
    if model is not None:
        return rows.select(key, F.pandas_udf(model, "array<float>")(F.col(words)).alias("embedding"))
    counted = HashingTF(numFeatures=dimensions, inputCol=words, outputCol="_v").transform(rows)
    return counted.select(key, vector_to_array("_v", "float32").alias("embedding"))


def score_pairs(pairs: DataFrame, model: Callable[[pd.DataFrame], pd.Series], columns: list[str]) -> DataFrame:
    """Adds score by a model over a batch of the named columns."""
    return pairs.withColumn("score", F.pandas_udf(model, "double")(F.struct(*columns)))


def pipe_lines(lines: DataFrame, command: str, column: str = "value", seconds: int = 600) -> DataFrame:
    """line, output and error of an external program that reads lines. A batch that fails is run line by line, so a bad line spoils no
    other; its error is a column."""
    args = shlex.split(command)

    def call(text: str) -> str:
        return subprocess.run(args, input=text, capture_output=True, text=True, timeout=seconds, check=True).stdout

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            given = b[column].tolist()
            try:
                out = call("".join(f"{x}\n" for x in given)).splitlines()
                done = [(x, y, None) for x, y in zip(given, out, strict=True)]
            except (subprocess.SubprocessError, ValueError):
                done = []
                for x in given:
                    try:
                        done.append((x, call(f"{x}\n").rstrip("\n"), None))
                    except subprocess.SubprocessError as e:
                        done.append((x, None, str(e)))
            yield pd.DataFrame(done, columns=["line", "output", "error"])

    return lines.select(column).mapInPandas(run, "line string, output string, error string")
