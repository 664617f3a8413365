"""Repository sources: markdown, decisions, owners, manifests, schemas, CI, symbols; and the framework that runs sources together."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.text import DOCUMENT_RULES, SECRET_RULES, first_rule
from loomstone.session import ship


@dataclass
class Source:
    """A named reader of items, with a check that its rows must pass."""

    name: str
    version: str
    read: Callable[[SparkSession, str], DataFrame]
    check: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)


class Ingestion:
    """Registered sources, run one after another; what fails is reported and the others stay."""

    def __init__(self) -> None:
        self.sources: dict[str, Source] = {}

    def register(self, source: Source) -> None:
        if source.name in self.sources:
            raise ValueError(f"{source.name} is registered")
        self.sources[source.name] = source

    def run(self, spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
        out, errors = {}, {}
        for name in names or list(self.sources):
            s = self.sources[name]
            try:
                out[name] = s.check(s.read(spark, path))
                _ = out[name].schema
            except Exception as e:  # noqa: BLE001  a source's failure is a result
                errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
        return out, errors


def markdown_parts(texts: DataFrame) -> DataFrame:
    """(path, title, headings, links, code_blocks, kind) of markdown in column text."""
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6}\s+(.+)$"), 1)
    links = F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)\s]+)"), 1)
    code = F.regexp_extract_all("text", F.lit(r"(?s)```(\w*)\n.*?```"), 1)
    return texts.select("path", F.try_element_at(heads, F.lit(1)).alias("title"), heads.alias("headings"), links.alias("links"), F.size(code).alias("code_blocks"), first_rule(F.lower("path"), DOCUMENT_RULES, "other").alias("kind"))


def decisions(texts: DataFrame) -> DataFrame:
    """(path, title, status, context, decision, consequences) of architecture decision records."""
    multi = lambda name: F.regexp_replace(F.regexp_extract("text", rf"(?ims)^##\s*{name}\s*$\n(.*?)(?=^##\s|\z)", 1), r"^\s+|\s+$", "")
    return texts.select("path", F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1).alias("title"), *[multi(n).alias(n) for n in ("status", "context", "decision", "consequences")])


def codeowners(texts: DataFrame) -> DataFrame:
    """(pattern, owner, place) of CODEOWNERS lines; later places win."""
    lines = texts.select(F.posexplode(F.split("text", "\n")).alias("place", "l")).withColumn("l", F.trim(F.regexp_replace("l", r"(^|\s)#.*$", ""))).where("l <> ''")
    parts = F.split("l", r"\s+")
    return lines.select(parts[0].alias("pattern"), F.explode(F.slice(parts, 2, 1000)).alias("owner"), "place")


def sql_tables(texts: DataFrame) -> DataFrame:
    """(path, table, column, type) of CREATE TABLE statements."""
    p = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?([\w.]+)[`\"\]]?\s*\((.*?)\)\s*;"
    names, bodies = F.regexp_extract_all("text", F.lit(p), 1), F.regexp_extract_all("text", F.lit(p), 2)
    each = texts.select("path", F.explode(F.arrays_zip(names.alias("t"), bodies.alias("b"))).alias("z"))
    cols = each.select("path", F.col("z.t").alias("table"), F.explode(F.split("z.b", r",(?![^(]*\))")).alias("c")).withColumn("c", F.trim("c"))
    return cols.where(~F.col("c").rlike(r"(?i)^(primary|foreign|unique|constraint|check)\b")).select("path", "table", F.regexp_extract("c", r"^[`\"\[]?(\w+)", 1).alias("column"), F.lower(F.regexp_extract("c", r"^\S+\s+(\w+)", 1)).alias("type"))


def manifest_dependencies(texts: DataFrame) -> DataFrame:
    """(path, name, version, scope) of package.json texts and requirements lines."""
    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    j = texts.where(F.col("path").endswith("package.json")).withColumn("j", F.from_json("text", schema))
    run = j.select("path", F.explode("j.dependencies").alias("name", "version"), F.lit("runtime").alias("scope"))
    dev = j.select("path", F.explode("j.devDependencies").alias("name", "version"), F.lit("development").alias("scope"))
    req = texts.where(F.col("path").rlike(r"requirements[^/]*\.txt$")).select("path", F.explode(F.split("text", "\n")).alias("l")).where(F.trim("l").rlike("^[A-Za-z]"))
    p = r"^\s*([A-Za-z0-9_.-]+)\s*(.*)$"
    return run.union(dev).union(req.select("path", F.regexp_extract("l", p, 1).alias("name"), F.trim(F.regexp_extract("l", p, 2)).alias("version"), F.lit("runtime").alias("scope")))


def ci_jobs(texts: DataFrame) -> DataFrame:
    """(path, job) of the jobs of CI workflow files: keys two spaces deep under jobs."""
    body = F.regexp_extract("text", r"(?ms)^jobs:\s*\n(.*?)(?=^\S|\z)", 1)
    return texts.select("path", F.explode(F.regexp_extract_all(body, F.lit(r"(?m)^  ([\w-]+):\s*$"), 1)).alias("job"))


def endpoints(texts: DataFrame) -> DataFrame:
    """(path, method, route) of router calls such as app.get('/x', ...)."""
    p = r"""\b(?:app|router|server)\.(get|post|put|patch|delete)\(\s*['"`]([^'"`]+)"""
    z = F.arrays_zip(F.regexp_extract_all("text", F.lit(p), 1).alias("m"), F.regexp_extract_all("text", F.lit(p), 2).alias("r"))
    return texts.select("path", F.explode(z).alias("z")).select("path", F.upper("z.m").alias("method"), F.col("z.r").alias("route"))


def config_keys(texts: DataFrame) -> DataFrame:
    """(path, key) of the environment variables that code reads."""
    p = r"""process\.env\.([A-Z][A-Z0-9_]*)|os\.environ(?:\.get)?[\[(]['"]([A-Z][A-Z0-9_]*)"""
    both = F.transform(F.arrays_zip(F.regexp_extract_all("text", F.lit(p), 1).alias("a"), F.regexp_extract_all("text", F.lit(p), 2).alias("b")), lambda z: F.when(F.coalesce(z["a"], F.lit("")) != "", z["a"]).otherwise(z["b"]))
    return texts.select("path", F.explode(F.array_distinct(both)).alias("key"))


def security_findings(texts: DataFrame) -> DataFrame:
    """(path, line, rule) of lines that look like secrets."""
    lines = texts.select("path", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return lines.select("path", (F.col("line") + 1).alias("line"), first_rule("l", SECRET_RULES, "none").alias("rule")).where("rule <> 'none'")


def tests_for(paths: DataFrame) -> DataFrame:
    """(test, source, confidence): a test path to the source path it names, .9 in the same place, .8 by base name alone."""
    p = paths.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"[._](test|spec)(?=\.)|^test_", "").alias("base"), F.regexp_replace(F.regexp_replace("path", r"(^|/)(__tests__|tests?)/", "$1"), r"[._](test|spec)(?=\.)|(?<=/)test_", "").alias("home"), F.col("path").rlike(r"[._](test|spec)\.|(^|/)(__tests__|tests?)/|(^|/)test_").alias("is_test"))
    t, s = p.where("is_test"), p.where("not is_test")
    near = t.alias("t").join(s.alias("s"), F.col("t.home") == F.col("s.path")).select(F.col("t.path").alias("test"), F.col("s.path").alias("source"), F.lit(0.9).alias("confidence"))
    far = t.alias("t").join(s.alias("s"), F.col("t.base") == F.col("s.base")).select(F.col("t.path").alias("test"), F.col("s.path").alias("source"), F.lit(0.8).alias("confidence"))
    return near.union(far).groupBy("test", "source").agg(F.max("confidence").alias("confidence"))


def read_symbols(path: str, text: str) -> Iterator[tuple]:
    """(name, kind, line, end_line, exported, signature) of a Python file by its syntax tree, of other files by pattern."""
    if path.endswith(".py"):
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                yield node.name, kind, node.lineno, node.end_lineno, not node.name.startswith("_"), "" if kind == "class" else f"{node.name}({ast.unparse(node.args)})"
        return
    p = re.compile(r"^(export\s+)?(?:default\s+)?(?:async\s+)?(function|class|interface|type|enum|const|func|fn|struct)\s+(\w+)([^\n{=]*)", re.M)
    for m in p.finditer(text):
        line = text.count("\n", 0, m.start()) + 1
        yield m[3], {"func": "function", "fn": "function", "struct": "class"}.get(m[2], m[2]), line, line, bool(m[1]), (m[3] + m[4]).strip()


def symbols(texts: DataFrame) -> DataFrame:
    """(file, name, kind, line, end_line, exported, signature) of source files (path, text)."""
    ship(texts.sparkSession)

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *r) for p, t in zip(f["path"], f["text"], strict=True) for r in read_symbols(p, t or "")]
            yield pd.DataFrame(rows, columns=["file", "name", "kind", "line", "end_line", "exported", "signature"])

    return texts.select("path", "text").mapInPandas(kernel, "file string, name string, kind string, line long, end_line long, exported boolean, signature string")


def prometheus(metrics: DataFrame, prefix: str) -> DataFrame:
    """Rows (name, labels: map<string,string>, value) as lines of the text exposition format."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return metrics.select(F.concat(F.lit(prefix + "_"), "name", F.lit("{"), labels, F.lit("} "), F.col("value").cast("string")).alias("value"))


def provenance(ledger: DataFrame) -> DataFrame:
    """Ledger rows (id, kind, ts, agent, used: array<string>) as W3C PROV documents in JSON, one a row."""
    doc = F.struct(F.map_from_arrays(F.array("id"), F.array(F.struct(F.col("kind").alias("prov:type")))).alias("entity"), F.map_from_arrays(F.array(F.concat(F.lit("act:"), "id")), F.array(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("prov:startTime")))).alias("activity"), F.map_from_arrays(F.array("agent"), F.array(F.struct(F.lit("prov:SoftwareAgent").alias("prov:type")))).alias("agent"), F.transform("used", lambda u: F.struct(F.concat(F.lit("act:"), F.col("id")).alias("prov:activity"), u.alias("prov:entity"))).alias("used"))
    return ledger.select("id", F.to_json(doc).alias("document"))
