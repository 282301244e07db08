"""Study files of fixed or nested formats: PQMethod, Ken-Q (JSON, workbook, keyed export), KADE archives, workbooks.

Files are read by Spark as binary rows, so a folder of thousands of studies is
parsed by all tasks; one file, a few kilobytes, is parsed by one small function
into the common long form.
"""

from __future__ import annotations

import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.study import grid_values
from .kenq import deck_from_multipliers, project_workbook
from .xlsx import read_workbook

SCHEMA = "study_id string, participant string, p_idx int, stmt_num int, value double, statement string, source string"
Parsed = tuple[list[str], list[list[float | None]], list[str | None], str]


def _number(v) -> float | None:
    try:
        return float(str(v).replace("+", "").strip())
    except ValueError:
        return None


def parse_pqmethod(text: str) -> Parsed:
    """A .DAT file: a header of either kind, then an id and two-character values in each line."""
    lines = [x.rstrip("\r\n") for x in text.splitlines() if x.strip()]
    if len(lines) < 3:
        raise ValueError("PQMethod file has no sorts")
    first = [int(x) for x in re.findall(r"-?\d+", lines[0])[:2]]
    second = [int(x) for x in re.findall(r"-?\d+", lines[1])]
    if len(second) > 3 and 1 <= sum(second[2:]) <= 200:  # respondents, statements, title / least, greatest, counts
        statements = sum(second[2:])
    else:
        statements = second[0] if second else 0
    if not 1 <= statements <= 200 and len(first) == 2:
        statements = first[1]
    if not 1 <= statements <= 200:
        raise ValueError("PQMethod header names no number of statements")
    body = [x for x in lines[2:] if x.strip()]
    width = len(body[0]) - 2 * statements
    width = width if 4 <= width <= 20 else 10
    people, values = [], []
    for line in body:
        cells = [_number(line[width + 2 * k : width + 2 * k + 2]) for k in range(statements)]
        if any(c is None for c in cells):
            parts = line.split()
            tail = [_number(x) for x in parts[-statements:]]
            if len(parts) > statements and None not in tail:
                people.append(" ".join(parts[:-statements]))
                values.append(tail)
                continue
        people.append(line[:width].strip())
        values.append(cells)
    return people, values, [None] * statements, "pqmethod"


def parse_kenq_json(text: str) -> Parsed:
    """A project export (qSorts, respondentData) or a keyed object of pipe-delimited sorts."""
    data = json.loads(text)
    statements = data.get("statementText") or data.get("statements") or [] if isinstance(data, dict) else []
    if isinstance(statements, str):
        statements = statements.splitlines()
    if isinstance(data, dict) and ("qSorts" in data or "respondentData" in data):
        rows = data.get("qSorts") or data["respondentData"]
        names = data.get("participantNames") or []
        people, values = [], []
        for k, r in enumerate(rows):
            v = (r.get("sort") or r.get("rawSort") or r.get("values") or []) if isinstance(r, dict) else r
            name = (r.get("name") or r.get("id")) if isinstance(r, dict) else None
            people.append(str(names[k] if k < len(names) else name or f"P{k + 1}"))
            values.append([_number(x) for x in v])
        source = "kenq_json"
    else:
        items = data.items() if isinstance(data, dict) else enumerate(data)
        people, values = [], []
        for key, r in items:
            if isinstance(r, dict) and isinstance(r.get("sort"), str):
                people.append(str(r.get("name") or r.get("email") or str(key)[-10:]))
                values.append([_number(x) for x in r["sort"].split("|") if x.strip()])
        source = "firebase"
    n = max((len(v) for v in values), default=0)
    return people, [v + [None] * (n - len(v)) for v in values], [*map(str, statements), *[None] * n][:n], source


def parse_kade(data: bytes) -> Parsed:
    """An archive of sorts, names, statements and pattern files."""
    z = zipfile.ZipFile(io.BytesIO(data))
    found: dict[str, str] = {}
    for name in z.namelist():
        base = name.split("/")[-1].lower()
        for key in ("sorts", "name", "statement", "pattern"):
            if base.startswith(key):
                found.setdefault(key, z.read(name).decode("utf-8-sig", "replace"))
    if "sorts" not in found:
        raise ValueError("archive has no sorts file")
    table = lambda t: [[c.strip().strip('"') for c in line.split(";" if t.count(";") > t.count(",") else ",")] for line in t.splitlines() if line.strip()]
    rows = table(found["sorts"])
    if rows and sum(_number(c) is not None for c in rows[0][1:]) == 0:
        rows = rows[1:]
    with_id = any(_number(r[0]) is None for r in rows)
    names = [r[0] for r in table(found["name"])] if "name" in found else []
    people = [r[0] if with_id else names[k] if k < len(names) else f"P{k + 1}" for k, r in enumerate(rows)]
    values = [[_number(c) for c in (r[1:] if with_id else r)] for r in rows]
    n = max(map(len, values), default=0)
    texts = [line.strip() for line in found.get("statement", "").splitlines() if line.strip()]
    return people, [v + [None] * (n - len(v)) for v in values], [*texts, *[None] * n][:n], "kade"


def _statements_sheet(rows: list[list]) -> list[str]:
    """Texts of the column with the longest text, ordered by the first column of distinct numbers."""
    body = [r for r in rows if any(c not in (None, "") for c in r)]
    width = max(map(len, body), default=0)
    cell = lambda r, k: r[k] if k < len(r) else None
    size = lambda k: sum(len(c) for r in body if isinstance(c := cell(r, k), str)) / max(1, len(body))
    if not width:
        return []
    best = max(range(width), key=size)
    rows_in = [r for r in body if isinstance(cell(r, best), str) and cell(r, best).strip() not in ("", ".")]
    for k in range(width):
        numbers = [_number(cell(r, k)) for r in rows_in]
        if k != best and sum(n is not None for n in numbers) >= len(rows_in) - 1 and len(rows_in) > 1:
            kept = [(n, cell(r, best)) for n, r in zip(numbers, rows_in, strict=True) if n is not None]
            if len({n for n, _ in kept}) == len(kept):
                return [t.strip() for _, t in sorted(kept)]
    return [cell(r, best).strip() for r in rows_in]


def parse_workbook(data: bytes) -> Parsed:
    """Transposed (statements down, people across), a sorts sheet of a project workbook, or people down."""
    sheets = {k.lower(): v for k, v in read_workbook(data).items()}
    texts = next((_statements_sheet(v) for k, v in sheets.items() if k.startswith("statement")), [])
    if "type" in sheets or "pattern" in sheets or any(k.startswith("example - ") for k in sheets):
        people, values, own, _, name = project_workbook(sheets)
        return people, values, own, f"kenq_{name}"
    rows = next((v for k, v in sheets.items() if k in ("sorts", "qsorts", "q-sorts", "q sorts")), None) or next(v for k, v in sheets.items() if not k.startswith("statement"))
    rows = [r for r in rows if any(c not in (None, "") for c in r)]
    header, body = [str(c or "") for c in rows[0]], rows[1:]
    get = lambda r, k: r[k] if k < len(r) else None
    if re.match(r"(?i)^(statement|stmt|item)", header[0]):
        people = [h for h in header[1:] if h]
        keyed = sorted(enumerate(body), key=lambda x: (_number(get(x[1], 0)) is None, _number(get(x[1], 0)) or 0, x[0]))
        values = [[_number(get(r, k + 1)) for _, r in keyed] for k in range(len(people))]
        own = [get(r, 0) for _, r in keyed]
        texts = texts if len(texts) == len(body) else [t if isinstance(t, str) else None for t in own]
        return people, values, texts, "xlsx_transposed"
    with_id = any(_number(get(r, 0)) is None for r in body)
    people = [str(get(r, 0)) if with_id else f"P{k + 1}" for k, r in enumerate(body)]
    columns = [k for k in range(1 if with_id else 0, len(header)) if all(_number(get(r, k)) is not None or get(r, k) in (None, "") for r in body)]
    values = [[_number(get(r, k)) for k in columns] for r in body]
    return people, values, texts if len(texts) == len(columns) else [header[k] or None for k in columns], "xlsx_wide"


def parse(name: str, data: bytes) -> Parsed:
    """By extension; .sta files hold statements, not sorts."""
    low = name.lower()
    if low.endswith(".dat"):
        return parse_pqmethod(data.decode("latin-1"))
    if low.endswith(".json"):
        return parse_kenq_json(data.decode("utf-8-sig"))
    if low.endswith(".zip"):
        return parse_kade(data)
    if low.endswith((".xlsx", ".xlsm")):
        return parse_workbook(data)
    raise ValueError(f"{name}: not a format of sorts" + (" (a .sta file holds statements)" if low.endswith(".sta") else ""))


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(n if not k else f"{n}_{k}")
    return out


def read_studies(spark: SparkSession, path: str) -> DataFrame:
    """Long sorts with statement texts of all files at ``path``; ``study_id`` is the file's name without extension."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts):
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                base = row.path.rstrip("/").split("/")[-1]
                people, values, texts, source = parse(base, bytes(row.content))
                study = re.sub(r"\.[^.]*$", "", base)
                people = _unique([p or f"P{k + 1}" for k, p in enumerate(people)])
                yield pd.DataFrame([(study, p, i, j, v, texts[j - 1] if j <= len(texts) else None, source) for i, (p, vs) in enumerate(zip(people, values, strict=True), 1) for j, v in enumerate(vs, 1)], columns=["study_id", "participant", "p_idx", "stmt_num", "value", "statement", "source"])

    return files.mapInPandas(run, SCHEMA)


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Sorts of a file of any known kind."""
    if path.lower().endswith((".csv", ".txt", ".tsv")):
        from .delimited import read_sorts

        return read_sorts(spark, path, sep="\t" if path.lower().endswith(".tsv") else ",", **options)
    return read_studies(spark, path).select("study_id", "participant", "p_idx", "stmt_num", F.col("value"))


__all__ = ["deck_from_multipliers", "grid_values", "parse", "read_any", "read_studies"]
