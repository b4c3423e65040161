"""The word lists a mining job runs with.  Operators take one as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

from bidlens.functions import fixed_values as fv


@dataclass(frozen=True)
class Dictionaries:
    regions: dict = field(default_factory=lambda: fv.REGION_ALIASES)
    licenses: dict = field(default_factory=lambda: fv.LICENSE_ALIASES)
    companies: dict = field(default_factory=lambda: fv.COMPANY_ALIASES)
    documents: dict = field(default_factory=lambda: fv.DOCUMENT_ALIASES)
    shadowed: dict = field(default_factory=lambda: fv.SHADOWED_ALIASES)
    company_evidence: tuple = tuple((tuple(words), name) for words, name in fv.COMPANY_EVIDENCE)
    region_word: str = fv.REGION_WORD
    region_false: tuple = tuple(fv.REGION_FALSE_WORDS)
    rule_keywords: tuple = tuple(fv.RULE_LINE_KEYWORDS)
    requirement_keywords: tuple = tuple(fv.REQUIREMENT_LINE_KEYWORDS)
    lower_tokens: dict = field(default_factory=lambda: fv.RULE_LOWER_TOKENS)
    modal: tuple = tuple(fv.RULE_MODAL_TOKENS)
    modal_lower: tuple = tuple(fv.RULE_MODAL_LOWER_TOKENS)
    table_terms: tuple = tuple(fv.TABLE_TERMS)
    required_terms: tuple = tuple(fv.REQUIRED_TERMS)
    forbidden_terms: tuple = tuple(fv.FORBIDDEN_TERMS)


KOREAN = Dictionaries()

# words of the invented prose in the test tables
DEMO = Dictionaries(
    regions={
        "Northland": ["thanedble", "than-dble"], "Eastmark": ["lichung", "Enheit"], "Southdale": ["eauou"], "Westmoor": ["asado"],
    },
    licenses={
        "MIT": ["MIT License"], "Apache": ["Apache License"], "GPL": ["General Public License"], "Builder": ["ertion", "oution"],
    },
    companies={"Large": ["reining"], "Small": ["ining"], "Artisan": ["queque"]},
    documents={"Certificate A": ["attion"], "Certificate B": ["nicht"], "Certificate C": ["mente"]},
    shadowed={"ining": "reining"},
    company_evidence=((("Small", "Large"), "Size confirmation"), (("Artisan",), "Artisan confirmation")),
    region_word="Th[a-z]{2,10}tion",
    region_false=("Thhation", "Thonention"),
    rule_keywords=("license", "thing", "token", "Einst", "eauch", "ering"),
    requirement_keywords=("attion", "nicht", "License", "queque", "ering"),
    lower_tokens={"company_type": ["small business", "heing"], "license": ["license"], "required_document": ["estion"]},
    modal=("Thing", "Ering"),
    modal_lower=("must", "intion"),
    table_terms=("attion", "nicht", "eauou"),
    required_terms=("thing", "License", "nicht", "eauou", "asado", "token", "mail"),
    forbidden_terms=("ertionth", "license"),
)
