"""Column expressions over text.  Everything here is a Spark expression: no Python UDF."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.functions import fixed_values as fv

# white space as Unicode understands it (plain trim() strips U+0020 only)
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# the same without the line feed
BLANK = r"[\t\x{0b}-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
TOKEN = "[0-9A-Za-z가-힣]{2,}"
NO_TOKEN = "[^0-9A-Za-z가-힣]+"  # what lies between them
NUMBER = r"[0-9][0-9.,:/-]*"


def any_of(conds) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, list(conds))


def contains_any(text: Column, words) -> Column:
    """True if any of a fixed, short list of words occurs in the text."""
    return any_of(text.contains(w) for w in words)


def str_array(values) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def present(c: Column) -> Column:
    """Null for blank text, so that coalesce() picks the first non-blank value."""
    return F.nullif(clean_text(c), F.lit(""))


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[present(c) for c in cols], F.lit(""))


def clean_text(c: Column) -> Column:
    return F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(WS_CHARS))


def let(value: Column, body) -> Column:
    """``body(value)`` where a costly value is used more than once: it is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compact_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))


def space_compact(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", "")


def tokenize(c: Column) -> Column:
    return F.transform(raw_tokens(c), F.lower)


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))


def numeric_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0))


RARE_BREAK = r"[\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
RARE_BLANK = r"[\x{1f}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
RARE = r"[\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{1f}\x{85}\x{a0}\x{1680}-\x{3000}]"  # all of these and others: sooner tested


def _stripped_lines(c: Column, gap: str, after: str) -> Column:
    """Unified line feeds, single blanks, stripped lines; ``gap`` says what follows a line feed and is dropped.

    Most texts need few of the steps.  Plain byte searches decide whether a pattern has to run at all.
    """
    text = F.replace(F.coalesce(c, F.lit("")), F.lit("\0"), F.lit(""))
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    ragged = (" \n", "\n ", after)

    def single_blanks(c):
        return let(c, lambda t: F.when(t.contains("  ") | t.contains("\t"), F.regexp_replace(t, r"[ \t]{2,}|\t", " ")).otherwise(t))

    def stripped(c, odd):
        def needed(t):
            return contains_any(t, ragged) | t.rlike(RARE_BLANK) if odd else contains_any(t, ragged)

        return let(single_blanks(c), lambda t: F.when(needed(t), F.regexp_replace(t, f"{BLANK}*\n{gap}*", "\n")).otherwise(t))

    def unified(t):
        return F.when(t.rlike(RARE_BREAK), F.regexp_replace(t, RARE_BREAK, "\n")).otherwise(t)

    return let(text, lambda t: F.when(t.rlike(RARE), stripped(unified(t), True)).otherwise(stripped(t, False)))


def basis_normalize(c: Column) -> Column:
    """Stripped lines, at most one blank line in a row, none at the ends."""
    text = let(
        _stripped_lines(c, BLANK, "\n "),
        lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t),
    )
    return clean_text(text)


def evidence_normalize(c: Column) -> Column:
    """Stripped lines without any blank line."""
    return clean_text(_stripped_lines(c, WS, "\n\n"))


def reference_normalize(c: Column) -> Column:
    return evidence_normalize(F.replace(c, F.lit("․"), F.lit(".")))


def procurement_boundary_restore(c: Column) -> Column:
    """Give back the line breaks lost in front of numbered items, dates and sentence ends."""
    text = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("․"), F.lit(".")), r"[ \t]{2,}|\t", " ")
    for pattern in (
        rf"(?<!\n)(?=[0-9]+\.{WS}*[가-힣A-Za-z])",
        rf"(?<!\n)(?=[가-힣]\.{WS}*[가-힣A-Za-z])",
        rf"(?<=[가-힣)])(?=[0-9]{{4}}\.{WS}*[0-9]{{1,2}}\.{WS}*[0-9]{{1,2}})",
        rf"(?<=다)(?={WS}*[-가-힣])",
    ):
        text = F.regexp_replace(text, pattern, "\n")
    return basis_normalize(text)


def lines(c: Column) -> Column:
    """Lines of a text, each stripped; blank ones stay (their place may matter)."""
    def cut(t):
        return F.when(t.contains("\r") | t.rlike(RARE_BREAK), F.split(t, LINE_BREAK)).otherwise(F.split(t, "\n"))

    return F.transform(let(F.coalesce(c, F.lit("")), cut), clean_text)


def filled_lines(c: Column) -> Column:
    return F.filter(lines(c), lambda x: x != "")


def ordered_distinct(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, clean_text), lambda x: x != ""))


def clean_value(c: Column) -> Column:
    """Strip blanks and colons, one space between words, none before ``) , .``"""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[ :：\t\n]+|[ :：\t\n]+$", "")
    text = F.regexp_replace(text, f"{WS}+", " ")
    return clean_text(F.regexp_replace(text, r" +([),.])", "$1"))


def won_format(c: Column) -> Column:
    text = clean_text(c)
    bare = F.regexp_replace(F.regexp_replace(text, "[, ]", ""), "원$", "")
    amount = F.regexp_extract(bare, r"^([0-9]+)(?:\.0+)?$", 1)
    return F.when(
        amount != "", F.concat(F.format_number(amount.cast("decimal(38,0)"), 0), F.lit("원"))
    ).otherwise(text)


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def registration_number(c: Column) -> Column:
    d = digits(c)
    return (
        F.when(F.length(d) == 10, F.regexp_replace(d, "^(.{3})(.{2})(.{5})$", "$1-$2-$3"))
        .when(F.length(d) == 13, F.regexp_replace(d, "^(.{6})(.{7})$", "$1-$2"))
        .otherwise(clean_value(c))
    )


def date_normalize(c: Column) -> Column:
    text = clean_value(c)
    spelled = rf"([0-9]{{4}}){WS}*년{WS}*([0-9]{{1,2}}){WS}*월{WS}*([0-9]{{1,2}}){WS}*일"
    marked = rf"([0-9]{{4}})[.\-/]{WS}*([0-9]{{1,2}})[.\-/]{WS}*([0-9]{{1,2}})"

    def iso(pattern):
        part = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
        return F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0"))

    return F.when(text.rlike(spelled), iso(spelled)).when(text.rlike(marked), iso(marked)).otherwise(text)


def region_derive(c: Column) -> Column:
    words = F.split(clean_value(c), " ")
    return F.when(
        (F.size(words) >= 2) & F.get(words, F.lit(0)).rlike("(도|시)$"), F.array_join(F.slice(words, 1, 2), " ")
    ).otherwise(F.get(words, F.lit(0)))


def json_list(c: Column) -> Column:
    """JSON list, or comma text, as distinct cleaned items in order."""
    text = clean_text(c)
    parsed = F.from_json(text, "array<string>")
    items = F.when(text.startswith("[") & parsed.isNotNull(), parsed).otherwise(F.split(text, ","))
    return ordered_distinct(items)


def first_items(c: Column, n: int | None) -> Column:
    """The first ``n`` items of an array; all without ``n``."""
    return c if n is None else F.slice(c, 1, n)


def first_chars(c: Column, n: int | None) -> Column:
    return c if n is None else F.substring(c, 1, n)


def json_list_merge(existing: Column, incoming: Column) -> Column:
    return F.array_distinct(F.concat(json_list(existing), json_list(incoming)))


def pii_mask(c: Column, max_chars: int | None = None) -> Column:
    """Mask credentials, resident ids and business ids; with ``max_chars`` (a log line's), cut longer values.

    A value with a query part is first taken as a URL, whose sensitive keys lose their values.
    """
    head, tail = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    text = F.regexp_replace(url_redact(c), rf"(?i){head}(Bearer|Basic){WS}+[A-Za-z0-9._~+/=-]+", "$1 " + fv.REDACTED)
    text = F.regexp_replace(text, rf"{head}[0-9]{{6}}-[0-9]{{7}}{tail}", fv.REDACTED_RRN)
    text = F.regexp_replace(text, rf"{head}([0-9]{{3}})-?[0-9]{{2}}-?[0-9]{{5}}{tail}", r"$1-**-*****")
    if max_chars is None:
        return text
    return F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("...[truncated]"))).otherwise(text)


def is_sensitive_key(c: Column) -> Column:
    return c.rlike(fv.SENSITIVE_KEY)


def url_redact(c: Column) -> Column:
    """Values of sensitive query keys are masked; other pairs keep their order."""
    url = F.coalesce(c, F.lit(""))
    bare, fragment = F.regexp_extract(url, r"^([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    path, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)

    def plain(part):
        return F.try_url_decode(part)

    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    keys = F.transform(pairs, lambda p: plain(F.regexp_extract(p, "^([^=]*)", 1)))
    masked = F.transform(
        pairs,
        lambda p: F.concat(
            F.url_encode(plain(F.regexp_extract(p, "^([^=]*)", 1))),
            F.lit("="),
            F.when(is_sensitive_key(plain(F.regexp_extract(p, "^([^=]*)", 1))), F.url_encode(F.lit(fv.REDACTED))).otherwise(
                F.url_encode(plain(F.regexp_extract(p, "=(.*)$", 1)))
            ),
        ),
    )
    return F.when(
        F.exists(keys, is_sensitive_key), F.concat(path, F.lit("?"), F.array_join(masked, "&"), fragment)
    ).otherwise(url)


def sensitive_keys_mask(c: Column, kind: T.DataType | None = None) -> Column:
    """Mask values of a map (of strings, or of type ``kind``): sensitive keys whole, other strings by pattern.

    Maps, arrays and structs inside are masked alike; under a sensitive key every string is hidden.
    """
    return _masked(c, kind or T.MapType(T.StringType(), T.StringType()), F.lit(False))


def _masked(c: Column, kind: T.DataType, hidden: Column) -> Column:
    if isinstance(kind, T.StringType):
        return F.when(c.isNull(), c).when(hidden, F.lit(fv.REDACTED)).otherwise(pii_mask(c))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: _masked(v, kind.valueType, hidden | is_sensitive_key(k)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: _masked(v, kind.elementType, hidden))
    if isinstance(kind, T.StructType):
        secret = re.compile(fv.SENSITIVE_KEY)
        fields = [_masked(c[f.name], f.dataType, F.lit(True) if secret.search(f.name) else hidden).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def source_hash(c: Column) -> Column:
    key = compact_key(c)
    return F.when(key == "", F.lit("")).otherwise(F.substring(F.sha2(key, 256), 1, 16))


def display_copy(c: Column) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), fv.DISPLAY_REPLACEMENTS, clean_text(c))


def secret_mask(c: Column) -> Column:
    text, n = F.coalesce(c, F.lit("")), F.length(c)

    def ends(keep):
        return F.concat(
            F.substring(text, 1, keep), F.repeat(F.lit("*"), F.greatest(n - 2 * keep, F.lit(0))), F.right(text, F.lit(keep))
        )

    return F.when(text == "", F.lit("")).when(n <= 12, ends(2)).otherwise(ends(4))


def found_labels(compact: Column, aliases: dict, shadowed: dict | None = None) -> Column:
    """Canonical labels whose alias occurs in a compact text, in dictionary order."""
    shadowed = fv.SHADOWED_ALIASES if shadowed is None else shadowed

    def has(alias):
        key = alias_key(alias)
        if not key:
            return F.lit(False)
        longer = shadowed.get(key)
        return (F.replace(compact, F.lit(longer), F.lit("")) if longer else compact).contains(key)

    return F.array_compact(
        F.array(*[F.when(any_of(has(a) for a in names), F.lit(label)) for label, names in aliases.items()])
    )


def alias_key(alias: str) -> str:
    return "".join(ch.lower() for ch in alias if ch.isalnum())


def heading(c: Column) -> Column:
    """First short line that looks like a heading, else the first line cut to 80 characters."""
    def pick(rows):
        candidates = F.filter(
            rows, lambda x: (F.length(x).between(1, 80)) & x.rlike(rf"^(제{WS}*[0-9]+{WS}*[장조절관항]|[0-9]+[.)]|[가-힣]\.)")
        )
        return F.coalesce(F.get(candidates, F.lit(0)), F.substring(F.get(rows, F.lit(0)), 1, 80))

    return let(lines(c), pick)


def extractive_summary(c: Column) -> Column:
    filled = filled_lines(c)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("문서에서 추출 가능한 텍스트가 부족합니다.")).otherwise(
        F.substring(F.array_join(F.slice(filled, 1, 4), " "), 1, 500)
    )


def extractive_requirements(c: Column) -> Column:
    return F.slice(filled_lines(c), 5, 6)


def money_decimal(c: Column) -> Column:
    """Number inside an amount text, null when there is none."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9.-]", "").try_cast("double")
