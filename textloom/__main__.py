"""Command line over one text: ``python -m textloom [policy|style] FILE|- ...``.

Exit codes: 0 done, 1 findings that ``--check`` looks for, 2 wrong usage, 3 a file or setting that can't be read or
written, or an edit that a second pass would go on with.
"""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from textloom.functions import registry as R
from textloom.operators import findings as K
from textloom.operators import reports
from textloom.operators.audit import _result
from textloom.sources import configs as C
from textloom.sources.files import read_input, write_whole

OK, FINDINGS, USAGE, IO = 0, 1, 2, 3


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("textloom", description="Audit one text and make safe edits.")
    p.add_argument("layer", choices=("policy", "style"))
    p.add_argument("input", nargs="?", help="a UTF-8 file, or - for standard input")
    p.add_argument("--mode", choices=C.MODES, default="audit")
    for flag in ("check", "apply", "diff", "quiet", "list-rules", "check-quotes", "edit-quotes"):
        p.add_argument(f"--{flag}", action="store_true")
    for name in ("output", "report-json", "report-markdown", "config", "author-profile"):
        p.add_argument(f"--{name}")
    for name, allowed in (("format", C.FORMATS), ("fail-on", C.FAIL_LEVELS), ("profile", tuple(R.PROFILES)), ("max-auto-risk", C.AUTO_RISKS), ("min-confidence", C.CONFIDENCES), ("em-dash-policy", C.DASH_POLICIES)):
        p.add_argument(f"--{name}", choices=allowed)
    for name in ("allow-term", "allow-pattern"):
        p.add_argument(f"--{name}", action="append", default=[])
    return p


def conflict(a: argparse.Namespace) -> str | None:
    """What doesn't go together, if anything."""
    if a.list_rules:
        return "--list-rules takes no input" if a.input else None
    same = a.output and a.input and a.input != "-" and os.path.abspath(a.output) == os.path.abspath(a.input)
    tests = {
        "an input is needed": a.input is None, "--check writes nothing": a.check and (a.apply or a.output), "--apply or --output, not both": a.apply and a.output, "--apply and --output need --mode auto": (a.apply or a.output) and a.mode != "auto",
        "--apply needs a file": a.apply and a.input == "-", "--output is the input": same, "--diff of auto output needs --output or --apply": a.layer == "style" and a.mode == "auto" and a.diff and not (a.output or a.apply),
    }
    return next((what for what, wrong in tests.items() if wrong), None)


def settings(a: argparse.Namespace) -> C.PolicyConfig | C.StyleConfig:
    mode = "audit" if a.check else a.mode
    if a.layer == "style":
        author = C.load_author_profile(a.author_profile) if a.author_profile else None
        given = {"profile": a.profile, "em_dash_policy": a.em_dash_policy, "format": a.format, "min_confidence": a.min_confidence, "max_auto_risk": a.max_auto_risk}
        return replace(C.StyleConfig(mode=mode, author=author, edit_quotes=a.edit_quotes), **{k: v for k, v in given.items() if v})
    base = C.load_policy(a.config) if a.config else C.PolicyConfig()
    return C.merged(base, tuple(a.allow_term), tuple(a.allow_pattern), mode=mode, format=a.format, base_profile=a.profile, fail_on=a.fail_on, max_auto_risk=a.max_auto_risk, check_quotes=a.check_quotes)


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    wrong = conflict(a)
    if wrong:
        p.error(wrong)
    if a.list_rules:
        sys.stdout.write(reports.catalogue(R.STYLE if a.layer == "style" else None))
        return OK
    source = "stdin" if a.input == "-" else a.input
    try:
        text, config = read_input(a.input), settings(a)
        if a.layer == "style":
            r = K.style_refine(text, source, config)
            payload, shown = reports.style_payload(_result(r, r.found) | {"word_count": r.facts.word_count}, text, source, config), reports.style_text
        else:
            r, initial = K.policy_refine(text, source, config)
            payload, shown = reports.policy_payload(_result(r, initial), text, source, config), reports.policy_text
        if a.report_json:
            write_whole(a.report_json, reports.as_json(payload))
        if a.report_markdown and a.layer == "policy":
            write_whole(a.report_markdown, reports.markdown(payload))
        if a.apply or a.output:
            if not r.idempotent:
                raise ValueError("a second pass would make more edits; nothing is written")
            write_whole(a.input if a.apply else a.output, r.text, a.input if a.apply else None)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return IO
    if a.diff:
        sys.stdout.write(reports.diff(text, r.text, source))
    to_stdout = config.mode == "auto" and not (a.apply or a.output)
    if to_stdout:
        sys.stdout.write(r.text)
    if not a.quiet:
        (sys.stderr if to_stdout else sys.stdout).write(shown(payload))
    failed = payload["findings"] if a.layer == "style" else payload["metrics"]["failure_count"]
    return FINDINGS if a.check and failed else OK


if __name__ == "__main__":
    sys.exit(main())
