"""Settings of the two layers, and profile and policy files in JSON: closed schemas, checked before any plan is built."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from textloom.functions import registry as R

# Allowed settings, and the defaults of profile and policy files.
MODES, FORMATS, DASH_POLICIES = ("audit", "suggest", "auto"), ("auto", "plain", "markdown", "html", "latex"), ("preserve", "reduce", "eliminate")
FAIL_LEVELS, AUTO_RISKS, CONFIDENCES, SEVERITIES = ("hard", "strong", "any", "none"), ("low", "medium"), ("low", "medium", "high"), ("light", "strong", "hard")
PATTERN_LENGTH = 512
NESTED_REPEAT = re.compile(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)[+*{]")
# End of fixed values.


@dataclass(frozen=True)
class AuthorProfile:
    """House style of one author."""

    name: str = "Unnamed profile"
    version: str = "1.0"
    preferred_sentence_words: tuple[int, int] = (8, 28)
    preferred_paragraph_sentences: tuple[int, int] = (1, 5)
    em_dash_policy: str = "reduce"
    allow_contractions: bool = True
    preferred_transitions: tuple[str, ...] = ()
    discouraged_phrases: tuple[str, ...] = ()
    forbidden_phrases: tuple[str, ...] = ()
    protected_patterns: tuple[str, ...] = ()
    category_weights: tuple[tuple[str, float], ...] = ()
    disabled_rules: tuple[str, ...] = ()
    enabled_rules: tuple[str, ...] = ()
    notes: str = ""


@dataclass(frozen=True)
class StyleConfig:
    """How the scored layer runs. ``em_dash_policy``: the author's if None, else the built-in profile's."""

    mode: str = "audit"
    profile: str = "plain"
    em_dash_policy: str | None = None
    format: str = "auto"
    min_confidence: str = "low"
    max_auto_risk: str = "low"
    author: AuthorProfile | None = None
    edit_quotes: bool = False

    def __post_init__(self) -> None:
        for name, allowed in (("mode", MODES), ("format", FORMATS), ("min_confidence", CONFIDENCES), ("max_auto_risk", AUTO_RISKS), ("profile", tuple(R.PROFILES))):
            _one_of(allowed)(name, getattr(self, name))
        if self.em_dash_policy is not None:
            _one_of(DASH_POLICIES)("em_dash_policy", self.em_dash_policy)

    @property
    def dashes(self) -> str:
        return self.em_dash_policy or (self.author.em_dash_policy if self.author else R.PROFILES[self.profile][0])

    def weight(self, category: str, signal: float) -> float:
        own = dict(self.author.category_weights).get(category, 1.0) if self.author else 1.0
        return round(signal * R.PROFILES[self.profile][1].get(category, 1.0) * own, 4)

    def uses(self, rule: R.Rule) -> bool:
        """Named on, else named off by the author, else by the profile's categories."""
        if self.author and rule.rule_id in self.author.enabled_rules:
            return True
        return not (self.author and rule.rule_id in self.author.disabled_rules) and rule.category not in R.PROFILES[self.profile][2]


@dataclass(frozen=True)
class PolicyConfig:
    """How the graded layer runs, over the scored one with every dash class."""

    mode: str = "audit"
    format: str = "auto"
    base_profile: str = "markdown"
    fail_on: str = "hard"
    max_auto_risk: str = "low"
    check_quotes: bool = False
    allowed_terms: tuple[str, ...] = ()
    allowed_patterns: tuple[str, ...] = ()
    disabled_rules: tuple[str, ...] = ()
    severity_overrides: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        for name, allowed in (("mode", MODES), ("format", FORMATS), ("fail_on", FAIL_LEVELS), ("max_auto_risk", AUTO_RISKS), ("base_profile", tuple(R.PROFILES))):
            _one_of(allowed)(name, getattr(self, name))

    def style(self, mode: str = "audit") -> StyleConfig:
        return StyleConfig(mode=mode, profile=self.base_profile, em_dash_policy="eliminate", format=self.format, max_auto_risk=self.max_auto_risk)

    @property
    def way(self) -> str:
        """The spans that findings keep out of."""
        return "analysis" if self.check_quotes else "analysis or quoted"


Check = Callable[[str, object], object]


def _one_of(allowed) -> Check:
    def check(name: str, value: object) -> object:
        if value not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(sorted(allowed))}; got {value!r}")
        return value

    return check


def _kind(kind: type, label: str) -> Check:
    def check(name: str, value: object) -> object:
        if not isinstance(value, kind):
            raise ValueError(f"{name} must be {label}")
        return value

    return check


def _strings(name: str, value: object) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ValueError(f"{name} must be an array of strings")
    return tuple(value)


def _range(name: str, value: object) -> tuple[int, int]:
    if not isinstance(value, list) or [type(x) for x in value] != [int, int] or not 0 <= value[0] <= value[1]:
        raise ValueError(f"{name} must be two integers, 0 <= minimum <= maximum")
    return value[0], value[1]


def _patterns(guarded: bool) -> Check:
    def check(name: str, value: object) -> tuple[str, ...]:
        for p in _strings(name, value):
            if len(p) > PATTERN_LENGTH:
                raise ValueError(f"{name} entries must be at most {PATTERN_LENGTH} characters")
            if guarded and NESTED_REPEAT.search(p):
                raise ValueError(f"{name}: {p!r} repeats a repetition, which can take for ever")
            try:
                re.compile(p)
            except re.error as e:
                raise ValueError(f"{name}: {p!r} is no pattern: {e}") from e
        return tuple(value)

    return check


def _rule_ids(layers: tuple[str, ...]) -> Check:
    def check(name: str, value: object) -> tuple[str, ...]:
        unknown = sorted(x for x in _strings(name, value) if x not in R.by_id() or R.by_id()[x].layer not in layers)
        if unknown:
            raise ValueError(f"{name}: unknown rules {', '.join(unknown)}")
        return tuple(value)

    return check


def _weights(name: str, value: object) -> tuple[tuple[str, float], ...]:
    known = {r.category for r in R.style_rules()}
    for key, x in _kind(dict, "an object")(name, value).items():
        if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x < 0:
            raise ValueError(f"{name} values must be finite numbers, not negative")
        if key not in known:
            raise ValueError(f"{name}: unknown category {key}")
    return tuple(sorted((k, float(x)) for k, x in value.items()))


def _overrides(name: str, value: object) -> tuple[tuple[str, str], ...]:
    for rule, severity in _kind(dict, "an object")(name, value).items():
        _rule_ids((R.STYLE, R.POLICY))(name, [rule])
        _one_of(SEVERITIES)(f"{name}.{rule}", severity)
    return tuple(sorted(value.items()))


_TEXT, _FLAG = _kind(str, "a string"), _kind(bool, "true or false")
PROFILE_FIELDS: dict[str, Check] = {
    "name": _TEXT, "version": _TEXT, "preferred_sentence_words": _range, "preferred_paragraph_sentences": _range, "em_dash_policy": _one_of(DASH_POLICIES), "allow_contractions": _FLAG, "preferred_transitions": _strings, "discouraged_phrases": _strings,
    "forbidden_phrases": _strings, "protected_patterns": _patterns(True), "category_weights": _weights, "disabled_rules": _rule_ids((R.STYLE,)), "enabled_rules": _rule_ids((R.STYLE,)), "notes": _TEXT,
}
POLICY_FIELDS: dict[str, Check] = {
    "format": _one_of(FORMATS), "base_profile": _one_of(tuple(R.PROFILES)), "fail_on": _one_of(FAIL_LEVELS), "max_auto_risk": _one_of(AUTO_RISKS), "check_quotes": _FLAG, "allowed_terms": _strings, "allowed_patterns": _patterns(False), "disabled_rules": _rule_ids((R.STYLE, R.POLICY)), "severity_overrides": _overrides,
    "notes": _TEXT,
}


def _read(path: str, fields: dict[str, Check]) -> dict[str, object]:
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except (OSError, ValueError) as e:
        raise ValueError(f"cannot read {path}: {e}") from e
    if not isinstance(raw, dict):
        raise ValueError(f"{path} must hold an object")
    unknown = sorted(raw.keys() - fields.keys())
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    return {name: fields[name](name, value) for name, value in raw.items()}


def load_author_profile(path: str) -> AuthorProfile:
    profile = AuthorProfile(**_read(path, PROFILE_FIELDS))
    both = sorted(set(profile.disabled_rules) & set(profile.enabled_rules))
    if both:
        raise ValueError(f"rules both enabled and disabled: {', '.join(both)}")
    return profile


def load_policy(path: str) -> PolicyConfig:
    found = _read(path, POLICY_FIELDS)
    found.pop("notes", None)
    return PolicyConfig(**found)


def merged(config: PolicyConfig, allowed_terms: tuple[str, ...] = (), allowed_patterns: tuple[str, ...] = (), **given: object) -> PolicyConfig:
    """A policy with what a caller gives on top: settings that are set win, lists are joined without repeats."""
    join = lambda a, b: tuple(dict.fromkeys((*a, *b)))
    lists = {"allowed_terms": join(config.allowed_terms, allowed_terms), "allowed_patterns": join(config.allowed_patterns, allowed_patterns)}
    return replace(config, **lists, **{k: v for k, v in given.items() if v})
