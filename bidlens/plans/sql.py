"""SQL text fragments used by the oracles (the independent statement of each query)."""

from __future__ import annotations

from bidlens.functions import fixed_values as fv
from bidlens.functions.text import BLANK, LINE_BREAK, NUMBER, TOKEN, WS, alias_key


def s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def slist(values) -> str:
    values = list(values)
    return "[" + ", ".join(s(v) for v in values) + "]" if values else "[]::VARCHAR[]"


def clean(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def compact(x: str) -> str:
    return rf"lower(regexp_replace(coalesce({x}, ''), '[^\p{{L}}\p{{N}}]', '', 'g'))"


def space_compact(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{WS}+', '', 'g')"


def raw_tokens(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{TOKEN}')"


def tokens(x: str) -> str:
    return f"list_transform({raw_tokens(x)}, lambda z: lower(z))"


def numbers(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{NUMBER}')"


def _base(x: str) -> str:
    x = f"replace(coalesce({x}, ''), chr(0), '')"
    x = f"regexp_replace({x}, '{LINE_BREAK}', chr(10), 'g')"
    return rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"


def basis_normalize(x: str) -> str:
    x = rf"regexp_replace({_base(x)}, '{BLANK}*\n{BLANK}*', chr(10), 'g')"
    return clean(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def evidence_normalize(x: str) -> str:
    return clean(rf"regexp_replace({_base(x)}, '{BLANK}*\n{WS}*', chr(10), 'g')")


def reference_normalize(x: str) -> str:
    return evidence_normalize(f"replace(coalesce({x}, ''), chr(8228), '.')")


def lines(x: str) -> str:
    return f"list_transform(regexp_split_to_array(coalesce({x}, ''), '{LINE_BREAK}'), lambda y: {clean('y')})"


def filled_lines(x: str) -> str:
    return f"list_filter({lines(x)}, lambda y: y <> '')"


def distinct_ordered(x: str) -> str:
    """Order-preserving distinct of a list (first occurrence kept)."""
    return f"list_filter({x}, lambda ov, oi: list_position({x}, ov) = oi)"


def clean_value(x: str) -> str:
    x = rf"regexp_replace(coalesce({x}, ''), '^[ :：\t\n]+|[ :：\t\n]+$', '', 'g')"
    x = f"regexp_replace({x}, '{WS}+', ' ', 'g')"
    return clean(rf"regexp_replace({x}, ' +([),.])', '\1', 'g')")


def digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def labels(compact_sql: str, aliases: dict, shadowed: dict | None = None) -> str:
    shadowed = fv.SHADOWED_ALIASES if shadowed is None else shadowed

    def has(alias):
        key = alias_key(alias)
        hay = f"replace({compact_sql}, {s(shadowed[key])}, '')" if key in shadowed else compact_sql
        return f"contains({hay}, {s(key)})"

    cases = [
        f"CASE WHEN {' OR '.join(has(a) for a in names)} THEN {s(label)} END" for label, names in aliases.items()
    ]
    return f"list_filter([{', '.join(cases)}], lambda y: y IS NOT NULL)"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {s(w)})" for w in words) + ")"


def basis_documents() -> str:
    """CTE body: documents as rule documents; toxic ones count as failed."""
    return """SELECT d.doc_id, d.text, d.lang AS category, d.source AS document_version,
      CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'completed' END AS processing_status,
      CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'completed' END AS index_status,
      l.quality
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
