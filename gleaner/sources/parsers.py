"""Parsers of model files: MPS, notebooks, reStructuredText and Pyomo code, one file per row."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mps(text: str | None) -> dict:
    """Counts of a fixed or free MPS file: variables, constraints by sense, integer and binary variables (bounds of kind BV only)."""
    section, integer = "", False
    rows: dict[str, str] = {}
    variables: dict[str, bool] = {}
    binary: set[str] = set()
    name = None
    for line in (text or "").splitlines():
        if not line.strip() or line.startswith("*"):
            continue
        parts = line.split()
        if not line[0].isspace():
            section = parts[0].upper()
            if section == "NAME" and len(parts) > 1:
                name = parts[1]
            if section == "ENDATA":
                break
            continue
        if section == "ROWS" and len(parts) >= 2:
            rows[parts[1]] = parts[0].upper()
        elif section == "COLUMNS":
            if "'MARKER'" in parts:
                integer = "'INTORG'" in parts
            else:
                variables.setdefault(parts[0], integer)
        elif section == "BOUNDS" and len(parts) >= 3 and parts[2] in variables:
            kind = parts[0].upper()
            if kind == "BV":
                binary.add(parts[2])
            elif kind in ("LI", "UI"):
                variables[parts[2]] = True
    count = lambda s: sum(1 for v in rows.values() if v == s)
    return {"name": name, "n_variables": len(variables), "n_constraints": sum(1 for v in rows.values() if v != "N"), "n_integer": sum(1 for v, i in variables.items() if i and v not in binary), "n_binary": len(binary), "n_less": count("L"), "n_greater": count("G"), "n_equal": count("E")}


MPS = "name string, n_variables int, n_constraints int, n_integer int, n_binary int, n_less int, n_greater int, n_equal int"

_MATH = re.compile(r"\$\$(.+?)\$\$|\\begin\{(align\*?|equation\*?)\}(.+?)\\end\{\2\}", re.S)


def notebook(text: str | None) -> dict:
    """Markdown and code of a notebook, its display formulas and its paragraphs of more than 40 characters."""
    try:
        cells = json.loads(text or "{}").get("cells", [])
    except (ValueError, AttributeError):
        cells = []
    body = {"markdown": [], "code": []}
    for c in cells:
        source = c.get("source", "")
        body.get(c.get("cell_type"), []).append("".join(source) if isinstance(source, list) else source)
    markdown = "\n\n".join(body["markdown"])
    plain = _MATH.sub("", markdown)
    return {
        "n_code": len(body["code"]),
        "formulas": [(m[1] or m[3]).strip() for m in _MATH.finditer(markdown)],
        "paragraphs": [p.strip() for p in re.split(r"\n\s*\n", plain) if len(p.strip()) > 40 and not p.lstrip().startswith("#")],
    }


NOTEBOOK = "n_code int, formulas array<string>, paragraphs array<string>"


def rst(text: str | None) -> dict:
    """Title, first paragraph and math blocks of a reStructuredText page."""
    t = text or ""
    title = re.search(r"^(?P<t>\S.*)\n(?P<u>[=\-~^\"#*])(?P=u){2,}\s*$", t, re.M)
    rest = t[title.end() :] if title else t
    first = next((p.strip() for p in re.split(r"\n\s*\n", rest) if p.strip() and not p.lstrip().startswith("..")), None)
    math = [re.sub(r"^\s+", "", m[1], flags=re.M).strip() for m in re.finditer(r"^\.\. math::[^\n]*\n((?:[ \t]+[^\n]*\n?|\n)+)", t, re.M)]
    return {"title": title["t"].strip() if title else None, "description": " ".join(first.split()) if first else None, "math": math}


RST = "title string, description string, math array<string>"


def pyomo_components(code) -> dict:
    """Columns with the names of a Pyomo model's components, natively."""
    return {k: F.regexp_extract_all(code, F.lit(rf"(?m)^\s*\w+\.(\w+)\s*=\s*(?:\w+\.)?{k}\("), F.lit(1)) for k in ("Set", "Param", "Var", "Objective", "Constraint")}


_KINDS = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def parsed(files: DataFrame, parser, schema: str) -> DataFrame:
    """path and the parser's fields for files (path, text)."""
    fields = [tuple(f.strip().split(" ", 1)) for f in schema.split(",")]

    def run(batches):
        for batch in batches:
            got = [parser(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array([g[n] for g in got], _KINDS[k]) for n, k in fields]], names=["path", *[n for n, _ in fields]])

    return files.select("path", "text").mapInArrow(run, f"path string, {schema}")
