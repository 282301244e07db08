"""Ken-Q layouts, as DataFrame steps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def statements_by_value_to_sorts(cards: DataFrame, statements: int) -> DataFrame:
    """Turns (participant, value, card) into sorts: the card names the statement that lies on the value.

    Cards that aren't whole numbers from 1 to ``statements`` are left out; of several values for one statement the last in order of ``at``
    (the row of the layout; without it, of value) stays.
    """
    n = F.regexp_extract("card", r"^\s*([0-9]+)\s*$", 1).try_cast("int")
    kept = cards.withColumn("stmt_num", n).where(F.col("stmt_num").between(1, statements))
    order = "at" if "at" in cards.columns else "value"
    return kept.groupBy("study_id", "participant", "stmt_num").agg(F.max_by("value", order).cast("double").alias("value"))


def deck_from_multipliers(numbers: list[int]) -> list[int]:
    """The span from the first to the last non-zero column, zeros inside it kept."""
    on = [i for i, n in enumerate(numbers) if n]
    return numbers[on[0] : on[-1] + 1] if on else []


# --- grids of a project workbook --------------------------------------------------------------------

_NUMBER = re.compile(r"-?\d+\.?\d*")
_PATTERN = re.compile(r"(?i)sort\s*pattern")
_HEADING = re.compile(r"(?i)respondent|sort\s*value|name")


def _text(cell) -> str:
    return "" if cell is None else str(cell).strip()


def _float(cell) -> float | None:
    try:
        return float(_text(cell))
    except ValueError:
        return None


def _is_name(cell) -> bool:
    return bool(_text(cell)) and not _NUMBER.fullmatch(_text(cell))


def grid_layout(rows: list[list], kind: int | None = None) -> tuple[str, int]:
    """How a grid is laid out, and the row of its names or of its pattern.

    ``by_value``: a row of names, then rows of a sort value and the number of
    the statement that each person put there; ``by_value_old``: the same under a
    block of some 22 heading rows. ``by_person_old``: a row that starts with a
    sort pattern, then a person a row; ``by_person``: a person a row. ``kind`` is
    what a sheet named "type" says: 1 by value, 2 by person.
    """
    cell = lambda i, k: rows[i][k] if i < len(rows) and k < len(rows[i]) else None
    pattern = next((i for i in range(min(5, len(rows))) for k in range(5) if _PATTERN.search(_text(cell(i, k)))), None)
    if kind == 1:
        return "by_value", 0
    if pattern is not None:
        return "by_person_old", pattern
    if kind == 2:
        return "by_person", 0
    first = _text(cell(0, 0))
    if (not first or _HEADING.search(first)) and cell(0, 1) is not None and not _NUMBER.fullmatch(_text(cell(0, 1))):
        return "by_value", 0
    if len(rows) > 25 and _is_name(cell(1, 1)) and len(_text(cell(1, 1))) > 2 and all(not _text(cell(i, 0)) or _float(cell(i, 0)) is not None for i in range(2, 22)):
        names = next((i for i in range(19, min(28, len(rows))) if _is_name(cell(i, 1))), None)
        if names is None:
            raise ValueError("no row of participants under the heading")
        return "by_value_old", names
    if _is_name(first) and sum(_float(c) is not None for c in rows[0][1:]) > (len(rows[0]) - 1) / 2 and len(rows[0]) > 2:
        return "by_person", 0
    raise ValueError("neither a grid of statement numbers by sort value nor one of scores by participant")


def grid_sorts(rows: list[list], statements: int | None = None, kind: int | None = None) -> tuple[list[str], list[list[float | None]], list[int] | None, str]:
    """(participants, their values by statement, quotas if the grid tells them, layout) of a grid of any layout."""
    name, at = grid_layout(rows, kind)
    if name.startswith("by_value"):
        people = [_text(c) for c in rows[at][1:] if _is_name(c)]
        body = [(v, [None if (x := _float(c)) is None else round(x) for c in (r[1:] + [None] * len(people))[: len(people)]]) for r in rows[at + 1 :] if r and (v := _float(r[0])) is not None]
        n = statements or max((c for _, cards in body for c in cards if c is not None), default=0)
        values: list[list[float | None]] = [[None] * n for _ in people]
        for value, cards in body:
            for p, card in enumerate(cards):
                if card is not None and 1 <= card <= n:
                    values[p][card - 1] = value  # the last to name a statement stays
        return people, values, quotas([v for v, _ in body]), name
    deck = None
    if name == "by_person_old":
        deck = quotas([x for c in rows[at] if (x := _float(c)) is not None])
        at = next((i for i in range(at + 1, len(rows)) if rows[i] and _is_name(rows[i][0])), len(rows))
        if at == len(rows):
            raise ValueError("no participants under the sort pattern")
    body = [r for r in rows[at:] if r and _text(r[0])]
    width = max(map(len, body))
    scores = [[_float(c) for c in (r[1:] + [None] * width)[: width - 1]] for r in body]
    kept = [k for k in range(width - 1) if any(s[k] is not None for s in scores)]
    return [_text(r[0]) for r in body], [[s[k] for k in kept] for s in scores], deck, name


def quotas(values: list[float]) -> list[int] | None:
    """How often each whole value from the least to the greatest comes."""
    if not values:
        return None
    return [sum(v == k for v in values) for k in range(round(min(values)), round(max(values)) + 1)]


def pattern_deck(rows: list[list]) -> list[int] | None:
    """Quotas of a pattern sheet: its second, first or third row with five numbers or more, padded to 20 columns, then the used span."""
    for k in (1, 0, 2):
        numbers = [int(x) for c in (rows[k] if k < len(rows) else []) if (x := _float(c)) is not None]
        if len(numbers) >= 5:
            return deck_from_multipliers((numbers + [0] * 20)[: max(20, len(numbers))])
    return None


def project_sheets(sheets: dict[str, list[list]]) -> dict[str, list[list]]:
    """The sheets of a project by what they hold; an "Example - " sheet stands in for one that is missing or blank."""
    low = {k.strip().lower(): v for k, v in sheets.items()}
    filled = lambda v: v and any(_text(c) for r in v for c in r)
    out = {}
    for name, keys in {"sorts": ("sorts", "qsorts", "q-sorts", "q sorts"), "statements": ("statements",), "pattern": ("pattern",), "name": ("name",), "type": ("type",), "version": ("version",)}.items():
        found = next((low[p + k] for p in ("", "example - ") for k in keys if filled(low.get(p + k))), None)
        if found is not None:
            out[name] = found
    return out


def project_workbook(sheets: dict[str, list[list]]) -> tuple[list[str], list[list[float | None]], list[str], list[int] | None, str]:
    """(participants, values, statement texts, quotas, layout) of a project workbook."""
    found = project_sheets(sheets)
    texts = [t for r in found.get("statements", []) if (t := next((_text(c) for c in r if _is_name(c) and _text(c) != "."), None))]
    kind = next((int(x) for r in found.get("type", []) for c in r if (x := _float(c)) in (1.0, 2.0)), None)
    people, values, deck, name = grid_sorts(found["sorts"], len(texts) or None, kind)
    return people, values, texts, pattern_deck(found["pattern"]) if "pattern" in found and pattern_deck(found["pattern"]) else deck, name
