"""Protocol over words that occur in the ``documents`` table."""

from citemill.config import Protocol, Term


def _term(slot: str, word: str, category: str, *patterns: str, generic: bool = False) -> Term:
    return Term(
        slot=slot, entity_id=word, label_es=f"{word}_es", label_en=f"{word}_en", category=category,
        generic=generic, patterns=patterns or (rf"\b{word}\b",),
    )


PROTOCOL = Protocol(
    name="documents", name_a="Sustancias", name_b="Efectos",
    terms=(
        _term("a", "thing", "nouns", r"\bthing\b", r"\bthble\b"),
        _term("a", "ering", "gerunds"),
        _term("a", "oning", "gerunds"),
        _term("a", "eding", "gerunds"),
        _term("a", "der", "articles", generic=True),
        _term("b", "ertion", "nouns"),
        _term("b", "ontion", "nouns"),
        _term("b", "antion", "abstract nouns"),
        _term("b", "retion", "abstract nouns"),
        _term("b", "ention", "abstract nouns"),
        _term("b", "nicht", "particles", generic=True),
    ),
    cues={
        "exposure": [r"\bfor\b", r"\bfrom\b"],
        "dose": [r"\bon\b"],
        "association": [r"\bwith\b"],
        "strong_association": [r"\bby\b"],
        "speculative": [r"\bthis\b"],
        "negation": [r"\bno\b"],
        "review": [r"\blicensed\b", r"\blorem\b"],
        "human": [r"\bpersons?\b", r"\bnot\b"],
        "in_vivo": [r"\bund\b"],
        "in_vitro": [r"\bles\b"],
    },
    headers={
        "title": [],
        "abstract": [r"(?im)^\s*(the|la)\b"],
        "introduction": [r"(?im)^\s*(of|der)\b"],
        "methods": [r"(?im)^\s*(and|de)\b"],
        "results": [r"(?im)^\s*(in)\b"],
        "discussion": [r"(?im)^\s*(to)\b"],
        "conclusion": [r"(?im)^\s*(was)\b"],
        "references": [r"(?im)^\s*(that|licensed)\b"],
        "other": [],
    },
)
