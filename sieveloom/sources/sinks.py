"""Writers: tables, reports, manifests."""

from __future__ import annotations

import base64
import csv
import hashlib
import html
import io
import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def csv_table(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One folder of CSV; columns in the given order, or sorted; others are left out."""
    df.select(*(columns or sorted(df.columns))).write.mode("overwrite").options(header=True, escape='"').csv(path)


def csv_rows(rows: Iterable[dict], path: str, columns: list[str] | None = None) -> None:
    """A small gold table as one file; without columns the sorted union of all keys."""
    rows = list(rows)
    columns = columns or sorted({k for r in rows for k in r})
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, columns, extrasaction="ignore", restval="")
        w.writeheader()
        w.writerows(rows)


def tables(named: dict[str, DataFrame], folder: str) -> dict[str, str]:
    out = {}
    for name, df in named.items():
        csv_table(df, f"{folder}/{name}", df.columns)
        out[name] = f"{folder}/{name}"
    return out


def topic_export(review: DataFrame, terms: DataFrame, metadata: dict, folder: str) -> dict[str, str]:
    """The review table, the terms of each topic and the run's metadata below one folder."""
    out = tables({"review": review, "terms": terms}, folder)
    one = review.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True, ensure_ascii=False),)], "value string")
    one.coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")
    return out | {"metadata": f"{folder}/metadata"}


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])


def markdown_report(title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    """A report of gold tables; each shows at most `most` rows, as reports do."""
    parts = [f"# {title}"]
    for name, df in sections.items():
        parts += [f"## {name}", markdown_table([r.asDict() for r in df.limit(most).collect()], df.columns)]
    return "\n\n".join(parts) + "\n"


def refreshed(text: str, values: dict[str, object]) -> tuple[str, list[str]]:
    """Text with the numbers between <!--n:key--> and <!--/n--> replaced; and the keys without a value, sorted, each once."""
    parts = re.split(r"(<!--n:[\w.]+-->)(.*?)(<!--/n-->)", text, flags=re.S)  # plain, opening, number, closing, plain, …
    keys = [x[len("<!--n:") : -len("-->")] for x in parts[1::4]]
    parts[2::4] = [str(values[k]) if k in values else old for k, old in zip(keys, parts[2::4], strict=True)]
    return "".join(parts), sorted(set(keys) - set(values))


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files at a path, read by Spark."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(inputs: Iterable[str], outputs: Iterable[str], parameters: dict, counts: dict, path: str) -> dict:
    """Provenance as JSON: names, sizes and digests, no absolute paths, not its own digest."""
    import pyspark

    one = lambda p: {"file": Path(p).name, "bytes": os.path.getsize(p), "sha256": sha256_file(p)}
    out = {"inputs": [one(p) for p in inputs], "outputs": [one(p) for p in outputs if Path(p) != Path(path)], "parameters": parameters, "counts": counts, "versions": {"pyspark": pyspark.__version__}}
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    return out


def verified(manifest_: dict, path: str) -> None:
    """ValueError unless the file has the digest that the manifest says."""
    name = Path(path).name
    known = [x["sha256"] for x in manifest_["outputs"] if x["file"] == name]
    if not known or known[0] != sha256_file(path):
        raise ValueError(f"{name} is not the file of the manifest")


def mirrored(source: str, target: str) -> None:
    """An atomic copy: a temporary file beside the target, then a rename."""
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(target) or ".")
    os.close(fd)
    try:
        shutil.copyfile(source, tmp)
        os.replace(tmp, target)
    finally:
        if os.path.exists(tmp):
            os.unlink(tmp)


def inside(root: str, path: str) -> Path:
    """A path below root; ValueError for one that leaves it."""
    full = (Path(root) / path).resolve()
    if not full.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} leaves {root}")
    return full


def html_table(rows: list[dict], columns: list[str], name: str = "table.csv") -> str:
    """An HTML table with its CSV as a download."""
    sheet = io.StringIO()
    csv.writer(sheet, lineterminator="\n").writerows([columns, *([r.get(c, "") for c in columns] for r in rows)])
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(c, '')))}</td>" for c in columns) + "</tr>" for r in rows)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    data = base64.b64encode(sheet.getvalue().encode()).decode()
    return f'<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table><a download="{html.escape(name)}" href="data:text/csv;base64,{data}">CSV</a>'
