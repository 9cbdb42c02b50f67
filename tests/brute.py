"""Slow, direct restatements of the rules, used as the expected results."""

import itertools
import re

from citemill import fixed

BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÜÑ0-9])")


def squash(text):
    return " ".join(text.split())


def term_spans(patterns, text):
    """Try every position: take the longest pattern match there, then continue behind it."""
    starts = {}
    for p in patterns:
        for m in re.finditer(p, text, re.I):
            if m.end() > m.start():
                starts[m.start()] = max(m.end(), starts.get(m.start(), 0))
    out, i = [], 0
    while i < len(text):
        if i in starts:
            out.append((i, starts[i]))
            i = starts[i]
        else:
            i += 1
    return out


def sentence(text, start, end):
    left, right = max(0, start - 900), min(len(text), end + 900)
    piece, at = text[left:right], start - left
    cuts = [(0, 0), *[m.span() for m in BREAK.finditer(piece)], (len(piece), len(piece))]
    for (_, b), (e, _) in zip(cuts, cuts[1:]):
        if e > b and at < e:
            found = squash(piece[b:e])
            if found:
                return found
            break
    return squash(text[max(0, start - 180) : end + 180])


def section_spans(text, headers):
    """All header matches as records; rules as filters on them; neighbours as spans."""
    records = []
    for name, patterns in headers.items():
        for m in (m for p in patterns for m in re.finditer(p, text, re.I)):
            at = m.end() - len(m.group().lstrip())
            begin = text.rfind("\n", 0, at) + 1
            records.append({
                "name": name, "begin": begin, "word": m.group().strip(), "lead": text[begin:at], "next": text[m.end() : m.end() + 1],
                "line": text[begin:].partition("\n")[0].strip()})
    rules = (
        lambda r: bool(r["line"]), lambda r: not r["lead"].strip(), lambda r: r["word"][:1].isupper() or r["line"].casefold() == r["word"].casefold(),
        lambda r: len(r["line"]) <= 60 or (r["next"] and r["next"] in ".:—–-"))
    marks = sorted({(0, 0, "title")} | {(r["begin"], 1, r["name"]) for r in records if all(rule(r) for rule in rules)})
    closing = [m for m in marks if m[2] == "references"][-1:]
    marks = [m for m in marks if m in closing or m[2] != "references" and all(m < c for c in closing)]
    edges = [m[0] for m in marks] + [len(text)]
    return [(m[2], edges[i], edges[i + 1]) for i, m in enumerate(marks) if edges[i] < edges[i + 1]]


def best_relations(text, mentions, protocol):
    """Every A-B product with a quotation, best score first; the first of a pair stays."""
    def quotation(a, b):
        forms = {squash(a["matched_text"]), squash(b["matched_text"])}
        ends = [m[k] for m in (a, b) for k in ("start", "end")]
        choices = [a["sentence"]] if a["sentence"] == b["sentence"] else []
        choices += [squash(text[min(ends) : max(ends)])] if max(ends) - min(ends) <= protocol.relation_distance else []
        return next((c for c in choices if c and all(f in c for f in forms)), None)

    def score(a, b, quote):
        fired = (v for k, v in fixed.EVIDENCE_POINTS.items() if any(re.search(p, quote, re.I) for p in protocol.cues.get(k, ())))
        return a["score"] + b["score"] + sum(fired)

    sides = [[m for m in mentions if m["entity_type"] == slot] for slot in "ab"]
    quoted = [(a, b, q) for a, b in itertools.product(*sides) if (q := quotation(a, b)) is not None]
    best = {}
    for a, b, q in sorted(quoted, key=lambda r: -score(*r)):
        best.setdefault((a["entity_id"], b["entity_id"]), (score(a, b, q), min((m["start"], m["section"]) for m in (a, b))[1], q))
    return best


def summary(kind, items):
    """(role, confidence, score) of one entity from (section, set of cues) items."""
    inner = [(s, c) for s, c in items if s != fixed.TERMINAL_SECTION]
    points = sum(fixed.SECTION_WEIGHTS[s] + sum(fixed.CUE_POINTS[x] for x in c) for s, c in inner)
    central = any(s in fixed.CENTRAL_SECTIONS for s, _ in items)
    direct, linked = (any(c & cues for _, c in inner) for cues in ({"exposure", "dose"}, {"association"}))
    rungs = {
        "role_review_mention": kind == "review_or_synthesis", "role_bibliographic_only": not inner, "role_primary_focus": central and points >= 16 and direct,
        "role_probable_focus": central and (direct or linked), "role_secondary_variable": central and points >= 8,
        "role_intro_discussion_only": any(s in fixed.PERIPHERAL_SECTIONS for s, _ in items), "role_unclear": True}
    level = sum((central and points >= 8, central and points >= 18 and (direct or linked)))
    return next(r for r, holds in rungs.items() if holds), ("Baja", "Media", "Alta")[level], points


def association(flags, central):
    """Label of a quotation from the cue families that fire in it."""
    grade = max(("strong_association" in flags and "speculative" not in flags) * (3 if central else 2), ("association" in flags) * 2, ("speculative" in flags) * 1)
    labels = (fixed.NO_EVIDENCE, "mencion_especulativa", "asociacion_debil", "asociacion_fuerte")
    return labels[0 if "negation" in flags else grade]


def quotas(sizes, n):
    """Deal rows out one by one, round after round, larger strata first."""
    left, out, n = list(sizes), [0] * len(sizes), min(n, sum(sizes))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    while n:
        for i in order:
            if n and left[i]:
                out[i] += 1
                left[i] -= 1
                n -= 1
    return out
