"""Findings and edits of one text, in both layers; the per-row work of ``textloom.operators.audit``.

A scan asks first which rules a text can match at all: a rule names the words that must stand in the text whole, and the
text's distinct words are met with those in one pass. Only the rules left run their pattern.

Kept on purpose: straight apostrophes in policy phrases don't match curly ones; repeated spaces are reported, never
edited; dash rules mind neither disabled rules nor categories; a paired dash's edit leaves the blanks around it; a base
finding in quotes stays out even where quotes are checked, other protected ones then come in.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from textloom.functions import registry as R
from textloom.functions.facts import CITATION, DOI, EMAIL, FOOTNOTE, NUMBER, URL, Facts
from textloom.operators import structure
from textloom.sources.configs import PolicyConfig, StyleConfig

# Contextual tests, author preferences, warnings.
TEXTILE = re.compile("textile|weaving|woven|fabric|loom|thread|embroidery|carpet")
SENTENCE_OPENERS = frozenset(["participial_framing", "discourse_signposting", "generic_example", "generic_audience"])
CONTRACTION = re.compile(r"(?i)\b(?:I[’'](?:m|ve|ll|d)|you[’'](?:re|ve|ll|d)|we[’'](?:re|ve|ll|d)|they[’'](?:re|ve|ll|d)|he[’'](?:s|ll|d)|she[’'](?:s|ll|d)|it[’'](?:s|ll|d)|that[’']s|there[’']s|what[’']s|who[’']s|[A-Za-z]+n[’']t)\b")
PHRASE_LISTS = [("discouraged", 3.0, "medium"), ("forbidden", 5.0, "low")]
RANGES = [
    ("PROFILE_SENTENCE_WORD_RANGE", "Sentence lengths diverge from the explicit author-profile range.", "{n} of {of} sentences fall outside {low}-{high} words", "Revise only where useful toward the configured {low}-{high}-word range.", 4, 0.40),
    ("PROFILE_PARAGRAPH_SENTENCE_RANGE", "Paragraph sentence counts diverge from the explicit author-profile range.", "{n} of {of} paragraphs fall outside {low}-{high} sentences", "Adjust paragraph boundaries only where the argument supports the configured {low}-{high}-sentence range.", 3, 0.50),
]
CONTRACTED = ("PROFILE_CONTRACTION_DISALLOWED", "The active author profile disallows contractions.", "Expand the contraction after confirming the intended auxiliary and modality.", 2.5)
TRIMMED = " \t\r\n.,;:!?()[]{}\"'“”‘’"
IN_ORDER = "Replace 'in order to' with 'to'."
NOT_IDEMPOTENT = "Idempotency check failed: a second auto pass would make additional edits"
INVARIANTS = [("Numeric tokens changed", [NUMBER]), ("URLs changed", [URL]), ("Email addresses changed", [EMAIL]), ("Citation tokens changed", [DOI, CITATION, FOOTNOTE])]
# End of fixed values.

#: Their pattern looks past the match, so a match taken alone doesn't fit it again and no edit follows.
NEVER_EDITED = "MECH_REPEATED_SPACES"


@dataclass(slots=True)
class Finding:
    rule: R.Rule
    start: int
    end: int
    matched: str
    candidates: tuple[str, ...]
    explanation: str
    confidence: str
    weight: float = 0.0
    severity: str = ""
    suggestion: str = ""
    protected: str | None = None
    edit: tuple[int, int, str] | None = None
    text: Facts | None = field(default=None, repr=False)

    def row(self, nth: int) -> dict:
        """As it stands in tables; ``nth``: which finding of its rule in the text this is."""
        line, column = self.text.place(self.start)
        r = self.rule
        return {
            "source": r.layer, "rule_id": r.rule_id, "category": r.category, "severity": self.severity, "start": self.start, "end": self.end, "line": line, "column": column, "matched_text": self.matched, "explanation": self.explanation, "suggestion": self.suggestion, "candidates": list(self.candidates),
            "weight": self.weight, "evidence_class": r.evidence, "false_positive_risk": r.risk, "confidence": self.confidence, "protected": self.protected is not None, "protected_kind": self.protected, "nth": nth,
        }


@dataclass(frozen=True)
class Edit:
    source: str
    rule_id: str
    start: int
    end: int
    original: str
    replacement: str
    rationale: str


class Matcher:
    """Compiled rules, findable by a word that each needs."""

    def __init__(self, rules: Sequence[R.Rule]) -> None:
        self.any: list[tuple[int, R.Rule, re.Pattern[str]]] = []
        self.by_word: dict[str, list[tuple[frozenset[str], int, R.Rule, re.Pattern[str], re.Pattern[str] | None]]] = {}
        for i, r in enumerate(rules):
            pattern, gate = re.compile(r.pattern, re.I), re.compile(R.GATES[r.rule_id], re.I) if r.rule_id in R.GATES else None
            if not r.needs:
                self.any.append((i, r, pattern))
            for words in r.needs:
                self.by_word.setdefault(max(words, key=lambda w: (len(w), w)), []).append((words, i, r, pattern, gate))

    def rules_for(self, text: str, vocabulary: set[str]) -> Iterator[tuple[R.Rule, re.Pattern[str]]]:
        found = {i: (r, p) for i, r, p in self.any if self._may(r, text)}
        for word in vocabulary & self.by_word.keys():
            found |= {i: (r, p) for words, i, r, p, gate in self.by_word[word] if words <= vocabulary and (gate is None or gate.search(text))}
        yield from (found[i] for i in sorted(found))

    @staticmethod
    def _may(r: R.Rule, text: str) -> bool:
        if r.category == "unicode_sanitation":
            return not text.isascii() and (len(r.pattern) > 1 or r.pattern in text)
        return {"!": "!!", "?": "??"}.get(r.suggestions[0], "") in text


@functools.lru_cache(16)
def _matcher(config: StyleConfig | PolicyConfig) -> Matcher:
    if isinstance(config, StyleConfig):
        return Matcher([r for r in R.style_rules() if r.pattern and config.uses(r) and R.LEVEL[r.confidence] >= R.LEVEL[config.min_confidence]])
    return Matcher([r for r in R.policy_rules() if r.pattern and r.rule_id not in config.disabled_rules])


def rewritten(rule: R.Rule, m: re.Match[str]) -> tuple[str, ...]:
    """What may stand in place of a match."""
    if rule.rewrite == "capital":
        return (m["next"].upper(),)
    form = R.REWRITES.get(rule.rewrite)
    if not form:
        return rule.suggestions
    parts = {k: (m.groupdict().get(k) or "").strip().rstrip(".;:!?").strip() for k in "xyz"}
    used = {k for k in "xyz" if "{" + k + "}" in form.lower()}
    return (form.format(**parts, **{k.upper(): structure.capital(v) for k, v in parts.items()}),) if all(parts[k] for k in used) else ()


def explained(f: Facts, rule: R.Rule, m: re.Match[str]) -> bool:
    """Whether the surroundings of a match speak against it."""
    said = m[0].lower()
    if rule.category == "research_lexicon" and "tapestry" in said:
        return bool(TEXTILE.search(f.text[max(0, m.start() - 100) : m.end() + 100].lower()))
    if rule.category == "unsupported_sourcing":
        return f.sourced(*m.span())
    opens = rule.category in SENTENCE_OPENERS or (rule.category == "assistant_residue" and said.strip() in ("certainly", "absolutely"))
    return opens and not f.opens_sentence(m.start())


def _lexical(f: Facts, c: StyleConfig) -> Iterator[Finding]:
    preferred = {x.strip().casefold() for x in c.author.preferred_transitions} if c.author else set()
    for rule, pattern in _matcher(c).rules_for(f.text, f.vocabulary):
        kept = [m for m in pattern.finditer(f.text) if f.spans.at(*m.span(), "analysis") is None and not explained(f, rule, m)]
        if preferred and rule.category == "discourse_signposting":
            kept = [m for m in kept if m[0].strip().casefold() not in preferred]
        if len(kept) >= rule.min_occurrences:
            yield from (Finding(rule, *m.span(), m[0], rewritten(rule, m), rule.description, rule.confidence) for m in kept)


def _own_rule(rule_id: str, description: str, weight: float, risk: str) -> R.Rule:
    return R.Rule(rule_id, R.STYLE, "author_profile", description, None, weight, "light", risk, "high", "house-style-heuristic")


def _author(f: Facts, c: StyleConfig) -> Iterator[Finding]:
    """Findings that an author profile asks for: listed phrases, lengths outside the ranges, contractions."""
    a, clean = c.author, f.clean
    if a is None:
        return
    for (label, weight, risk), phrases in zip(PHRASE_LISTS, (a.discouraged_phrases, a.forbidden_phrases), strict=True):
        for i, phrase in enumerate(phrases, 1):
            rule = _own_rule(f"PROFILE_{label.upper()}_{i:03d}", f"Phrase is {label} by the active author profile: {phrase!r}.", weight, risk)
            yield from (Finding(rule, *m.span(), m[0], (), rule.description, "high") for m in re.finditer(R.literal(phrase), f.text, re.I) if f.spans.at(*m.span(), "analysis") is None)
    some = clean.paragraph_sentences > 0
    measured = ((clean.sentences, clean.sentence_words, a.preferred_sentence_words), (clean.paragraphs[some], clean.paragraph_sentences[some], a.preferred_paragraph_sentences))
    for (rule_id, description, shown, advice, few, share), (spans, sizes, (low, high)) in zip(RANGES, measured, strict=True):
        out = spans[(sizes < low) | (sizes > high)]
        if len(spans) >= few and len(out) >= 2 and len(out) / len(spans) >= share:
            rule, values = _own_rule(rule_id, description, 3.0, "medium"), {"n": len(out), "of": len(spans), "low": low, "high": high}
            yield Finding(rule, *structure.reach(out), shown.format(**values), (advice.format(**values),), description, "high")
    if not a.allow_contractions:
        rule_id, description, advice, weight = CONTRACTED
        rule = _own_rule(rule_id, description, weight, "medium")
        yield from (Finding(rule, *m.span(), f.text[m.start() : m.end()], (advice,), description, "high") for m in CONTRACTION.finditer(clean.text) if f.spans.at(*m.span(), "analysis") is None)


_SHOWN = {name: shown for name, *_, shown in R.STRUCT}


def _shapes(f: Facts, c: StyleConfig) -> Iterator[Finding]:
    for name, start, end, values in structure.structural(f):
        rule = R.by_id()[f"STRUCT_{name}"]
        if c.uses(rule) and R.LEVEL[rule.confidence] >= R.LEVEL[c.min_confidence]:
            explanation = R.STRUCT_EXPLAINED.get(name, "").format(**values) or rule.description
            yield Finding(rule, start, end, _SHOWN[name].format(**values), rule.suggestions, explanation, rule.confidence)


def _dashes(f: Facts, c: StyleConfig) -> Iterator[Finding]:
    for name, start, end, more in structure.dashes(f) if c.dashes != "preserve" else ():
        rule = R.by_id()[f"EMDASH_{name}"]
        if name == "PAIRED_PARENTHETICAL" or R.LEVEL[rule.confidence] >= R.LEVEL[c.min_confidence]:
            yield Finding(rule, start, end, f.text[start:end], more["candidates"], more.get("explanation", rule.description), rule.confidence, edit=more.get("edit"))


def style_findings(f: Facts, c: StyleConfig) -> tuple[list[Finding], list[Finding]]:
    """Findings of the scored layer, of equal spans the heaviest (of equal weights the smallest id), in order; and all
    dash findings, as those that give way still edit."""
    dashed = list(_dashes(f, c))
    best: dict[tuple[int, int], Finding] = {}
    for x in [*_lexical(f, c), *_author(f, c), *_shapes(f, c), *dashed]:
        x.weight = c.weight(x.rule.category, x.rule.weight)
        have = best.get((x.start, x.end))
        if have is None or (-x.weight, x.rule.rule_id) < (-have.weight, have.rule.rule_id):
            best[x.start, x.end] = x
    for x in best.values():
        x.text, x.protected, x.severity = f, f.spans.at(x.start, x.end, "edit"), R.base_severity(x.rule.rule_id, x.rule.category)
        x.suggestion = x.candidates[0] if x.candidates else R.DEFAULT_SUGGESTION
    return sorted(best.values(), key=lambda x: (x.start, x.end, x.rule.rule_id)), dashed


@functools.lru_cache(16)
def _allowance(c: PolicyConfig) -> tuple[frozenset[str], list[re.Pattern[str]]]:
    return frozenset(t.casefold().strip() for t in c.allowed_terms), [re.compile(p, re.I) for p in c.allowed_patterns]


def allowed(f: Facts, start: int, end: int, c: PolicyConfig) -> bool:
    """Whether a policy lets a match stand: by its words, or by a pattern around it."""
    terms, patterns = _allowance(c)
    if f.text[start:end].casefold().strip(TRIMMED) in terms:
        return True
    around = f.text[max(0, start - 120) : end + 120] if patterns else ""
    return any(p.search(around) for p in patterns)


def _graded(f: Facts, c: PolicyConfig) -> Iterator[Finding]:
    for rule, pattern in _matcher(c).rules_for(f.masked, f.clean.vocabulary):
        for a, b in (m.span() for m in pattern.finditer(f.masked)):
            if f.spans.at(a, b, c.way) is None and not allowed(f, a, b, c):
                yield Finding(rule, a, b, f.text[a:b], (), rule.description, rule.confidence, suggestion=rule.suggestions[0])
    for name, a, b, more in structure.procedural(f, c.way):
        rule = R.by_id()[name]
        if name not in c.disabled_rules and not (name == "VD_EM_DASH" and allowed(f, a, b, c)):
            yield Finding(rule, a, b, more["shown"], (), rule.description, rule.confidence, suggestion=rule.suggestions[0].format(**more))


def _converted(f: Facts, c: PolicyConfig) -> Iterator[Finding]:
    """Findings of the scored layer that the graded one takes over."""
    for x in style_findings(f, c.style())[0]:
        quoted = x.protected and any(q in x.protected for q in ("quoted_text", "markdown_blockquote"))
        if x.rule.rule_id not in c.disabled_rules and not (x.protected and (quoted or not c.check_quotes)) and not allowed(f, x.start, x.end, c):
            yield x


def across_layers(found: list[Finding], back: int = 12) -> list[Finding]:
    """Findings in order, without those that repeat one of the last ``back`` kept: the same rule, or a scored one under a
    graded one of the same or a higher grade, that share four fifths of the shorter span."""
    kept: list[Finding] = []
    for x in sorted(found, key=lambda x: (x.start, x.start - x.end, -R.SEVERITY[x.severity], x.rule.layer != R.POLICY, x.rule.rule_id)):
        for p in kept[-back:]:
            shared = min(p.end, x.end) - max(p.start, x.start)
            shorter = min(max(1, p.end - p.start), max(1, x.end - x.start))
            over = p.rule.layer == R.POLICY and x.rule.layer == R.STYLE and R.SEVERITY[p.severity] >= R.SEVERITY[x.severity]
            if max(0, shared) / shorter >= 0.8 and (over or p.rule.rule_id == x.rule.rule_id):
                break
        else:
            kept.append(x)
    return sorted(kept, key=lambda x: (x.start, x.end, x.rule.rule_id))


def policy_findings(f: Facts, c: PolicyConfig) -> list[Finding]:
    """Findings of both layers as one stream, graded."""
    grades = dict(c.severity_overrides)
    found = [*_graded(f, c), *_converted(f, c)]
    for x in found:
        x.text, x.severity = f, grades.get(x.rule.rule_id, x.severity or x.rule.severity)
    return across_layers(found)


def numbered(found: list[Finding]) -> list[dict]:
    """Findings as rows, each with its number among those of its rule."""
    seen: Counter[str] = Counter()
    out = []
    for x in found:
        seen[x.rule.rule_id] += 1
        out.append(x.row(seen[x.rule.rule_id]))
    return out


def greedy(edits: list[tuple[tuple, Edit]]) -> list[Edit]:
    """Edits by their order keys, without those that overlap an earlier one."""
    kept: list[Edit] = []
    for _, e in sorted(edits, key=lambda x: x[0]):
        if not kept or e.start >= kept[-1].end:
            kept.append(e)
    return kept


def applied(text: str, edits: list[Edit]) -> str:
    """``text`` with sorted edits made."""
    out, at = [], 0
    for e in edits:
        out += [text[at : e.start], e.replacement]
        at = e.end
    return "".join(out) + text[at:]


def _dash_edited(name: str, c: StyleConfig, n: int) -> bool:
    return name == "EMDASH_NUMERIC_RANGE" or c.dashes == "eliminate" or (c.dashes == "reduce" and (n >= 2 or name in ("EMDASH_PAIRED_PARENTHETICAL", "EMDASH_LIST_INTRODUCTION")))


def _chosen(f: Facts, found: list[Finding], dashed: list[Finding], c: StyleConfig) -> list[Edit]:
    """Edits that may be made unasked: safe rules first, then dashes, longer and heavier ones first at one place."""
    n, out = f.text.count("—"), []
    for x, (a, b, to) in [*((x, (x.start, x.end, x.candidates[0])) for x in found if x.rule.action == "safe_replace" and x.candidates and x.rule.rule_id != NEVER_EDITED), *((x, x.edit) for x in dashed if x.edit and _dash_edited(x.rule.rule_id, c, n))]:
        safe = x.rule.action == "safe_replace"
        if R.LEVEL[x.rule.risk] <= R.LEVEL[c.max_auto_risk] and R.LEVEL[x.confidence] >= R.LEVEL[c.min_confidence] and f.spans.at(a, b, "edit") is None:
            why = x.rule.description if safe else structure.DASH_EDITS[x.rule.rule_id.removeprefix("EMDASH_")][1]
            out.append(((a, -3 if safe else -2, a - b, -x.rule.weight, x.rule.rule_id), Edit(R.STYLE, x.rule.rule_id, a, b, f.text[a:b], to, why)))
    return greedy(out)


def broken(before: str, after: str) -> list[str]:
    """What an edit must not change and did."""
    out = ["Final-newline state changed"] if before.endswith(("\n", "\r")) != after.endswith(("\n", "\r")) else []
    return out + [label for label, patterns in INVARIANTS if any(p.findall(before) != p.findall(after) for p in patterns)]


def facts(text: str, name: str | None, c: StyleConfig) -> Facts:
    return Facts(text, c.format, name, c.author.protected_patterns if c.author else (), c.edit_quotes)


@dataclass
class Refined:
    facts: Facts
    found: list[Finding]
    text: str
    edits: list[Edit]
    warnings: list[str]
    idempotent: bool = True


def style_refine(text: str, name: str | None, c: StyleConfig, again: bool = True) -> Refined:
    """Findings and, in auto mode, the edited text; edits that break an invariant are all taken back."""
    f = facts(text, name, c)
    found, dashed = style_findings(f, c)
    edits = _chosen(f, found, dashed, c) if c.mode == "auto" else []
    out = Refined(f, found, applied(text, edits), edits, [])
    wrong = broken(text, out.text) if edits else []
    if wrong:
        out.text, out.edits, out.warnings = text, [], [f"Automatic edits reverted: {w}" for w in wrong]
    if c.mode == "auto" and again and out.edits:
        out.idempotent = style_refine(out.text, name, c, False).text == out.text
        out.warnings += [] if out.idempotent else [NOT_IDEMPOTENT]
    return out


def case_of(word: str, model: str) -> str:
    """``word`` in the case of ``model``: all upper, first upper, or as it is."""
    return word.upper() if model.isupper() else word[:1].upper() + word[1:] if model[:1].isupper() else word


def _auto_pass(text: str, name: str | None, c: PolicyConfig) -> tuple[str, list[Edit], list[str]]:
    """The scored layer's edits, then the graded layer's on what they give."""
    first = style_refine(text, name, c.style("auto"))
    rule = R.by_id()["VD_IN_ORDER_TO"]
    edits: list[Edit] = []
    if rule.rule_id not in c.disabled_rules and "order" in first.text.lower():
        f = facts(first.text, name, c.style())
        places = (m for m in re.finditer(rule.pattern, f.text, re.I) if f.spans.at(*m.span(), c.way) is None)
        edits = greedy([((m.start(), m.start() - m.end()), Edit(R.POLICY, rule.rule_id, *m.span(), m[0], case_of("to", m[0]), IN_ORDER)) for m in places])
    return applied(first.text, edits), first.edits + edits, first.warnings


def policy_refine(text: str, name: str | None, c: PolicyConfig) -> tuple[Refined, list[Finding]]:
    """The result of a run, with the findings that remain, and the findings before any edit."""
    f = facts(text, name, c.style())
    found = policy_findings(f, c)
    if c.mode != "auto":
        return Refined(f, found, text, [], []), found
    refined, edits, warnings = _auto_pass(text, name, c)
    after = facts(refined, name, c.style()) if refined != text else f
    out = Refined(after, policy_findings(after, c) if edits else found, refined, edits, warnings)
    out.idempotent = not edits or _auto_pass(refined, name, c)[0] == refined
    out.warnings += [] if out.idempotent else [NOT_IDEMPOTENT.replace("additional", "more") + "."]
    return out, found
