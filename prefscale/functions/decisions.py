"""Decision codes. Each operator reads raw codes by its own dialect; inside the engine they are Text1, Text2 or Tie."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes by dialect for item 1, item 2 and a tie. Whole numbers may also be written with ".0".
DIALECTS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "score": (("Text1", "0"), ("Text2", "1"), ("Tie", "tie", "2", "0.5")),
    "alt_test": (("Text1", "0"), ("Text2", "1"), ("Tie", "0.5")),
    "dawid_skene": (("Text1", "0"), ("Text2", "1"), ("Tie", "0.5")),
    "irr": (("Text1", "0"), ("Text2", "1"), ("Tie", "tie", "2")),
    "icc": (("Text1", "0"), ("Text2", "1"), ("Tie", "tie", "2")),
    "transitivity": (("Text1", "1"), ("Text2", "0"), ("Tie",)),
    "network": (("Text1", "0"), ("Text2", "1"), ()),
    "append": (("Text1", "0"), ("Text2", "1"), ()),
    "reward": (("Text1", "1"), ("Text2", "2"), ()),
}


def _codes(codes: tuple[str, ...]) -> list[str]:
    return [*codes, *(f"{c}.0" for c in codes if c.isdigit())]


def normalize(col: Column | str, dialect: str) -> Column:
    """Text1, Text2 or Tie; null for a code that the dialect doesn't know. "append" passes such codes on."""
    one, two, tie = DIALECTS[dialect]
    raw = (F.col(col) if isinstance(col, str) else col).cast("string")
    out = F.when(raw.isin(_codes(one)), "Text1").when(raw.isin(_codes(two)), "Text2")
    if tie:
        out = out.when(raw.isin(_codes(tie)), "Tie")
    return out.otherwise(raw) if dialect == "append" else out


def value(decision: Column, tie: float = 0.5) -> Column:
    """0 where item 1 wins, 1 where item 2 does, ``tie`` between."""
    return F.when(decision == "Text1", 0.0).when(decision == "Text2", 1.0).when(decision == "Tie", float(tie))


def swapped(decision: Column) -> Column:
    return F.when(decision == "Text1", "Text2").when(decision == "Text2", "Text1").otherwise(decision)


def label_of(name: str) -> str:
    return name.removeprefix("decision_") if name != "decision" else name


def score_column(decision_col: str = "decision", split: str | None = None, model: str = "Bradley_Terry") -> str:
    """Name of a score column; the default decision column has no suffix."""
    suffix = "" if decision_col == "decision" else f"_{decision_col.removeprefix('decision_')}"
    return f"{model}_Score{f'_{split}' if split else ''}{suffix}"


def pick_score_column(columns: list[str]) -> str:
    full = [c for c in columns if "_Score_full" in c]
    some = full or [c for c in columns if c.endswith("_Score") or "_Score_" in c]
    if not some:
        raise ValueError("no score column")
    return some[0]


# ---------------------------------------------------------------- answers of judges

_LABEL = r"(Description 1|Description 2|Tie)"


def extract_answer(response: Column, allow_ties: bool = False, fallback: bool = False) -> Column:
    """The decision in a judge's answer: after FINAL ANSWER, else at the end; in a fallback answer, else anywhere. The
    first pattern that matches decides; a tie that isn't allowed is no decision."""
    patterns = [rf"(?is)FINAL\s+ANSWER.*?{_LABEL}", rf"(?i){_LABEL}[^a-zA-Z0-9]*\z", *([rf"(?is){_LABEL}"] if fallback else [])]
    found = F.lower(F.coalesce(*(F.nullif(F.regexp_extract(response, p, 1), F.lit("")) for p in patterns)))
    out = F.when(found == "description 1", "Text1").when(found == "description 2", "Text2")
    return out.when((found == "tie") & F.lit(allow_ties), "Tie")


# ---------------------------------------------------------------- text and bands


def token_estimate(text: Column) -> Column:
    """Tokens of a text as 1.33 of its words, rounded down; 0 for null."""
    trimmed = F.regexp_replace(text, r"^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$", "")
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t\n\r\x0B\f]+")))
    return F.coalesce(F.floor(words * F.lit(1.33)).cast("long"), F.lit(0).cast("long"))


def band(score: Column, cuts: tuple[tuple[float, str], ...], lowest: str) -> Column:
    out = F.when(score.isNull() | F.isnan(score), F.lit(None).cast("string"))
    for least, name in sorted(cuts, reverse=True):
        out = out.when(score >= least, name)
    return out.otherwise(lowest)


KAPPA_BANDS = ((0.8, "almost perfect"), (0.6, "substantial"), (0.4, "moderate"), (0.2, "fair"), (0.0, "slight"))
ICC_BANDS = ((0.9, "excellent"), (0.75, "good"), (0.5, "moderate"))
