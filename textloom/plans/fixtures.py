"""A small corpus of texts that fire rules, with what they should give, worked out by hand from the rules' definitions.

The synthetic tables hold next to none of the phrases and shapes that rules look for, so these texts stand for them. SQL
finds the offsets of the expected pieces by itself.
"""

from __future__ import annotations

#: Text, and the pieces that the graded run (default policy) should report: rule, piece, which occurrence of the piece.
FINDINGS: list[tuple[str, list[tuple[str, str, int]]]] = [
    ("This robust framework will unlock value.", [("VD_WORD_047_robust", "robust", 1), ("CORP_012_robust_framework", "robust framework", 1), ("VD_WORD_004_unlock", "unlock", 1), ("CORP_024_unlock_value", "unlock value", 1)]),
    ("It's not about prompts. It's about context.", [("VD_NEG_NOT_PERIOD", "It's not about prompts. It's about context", 1)]),
    ("She wrote, “This robust tool will unlock value.”", []),
    ("## Global Context and Critical Mineral Demand\n\nText.", [("VD_TITLE_CASE_HEADING", "Global Context and Critical Mineral Demand", 1)]),
    ("The tool unlocks value and streamlines work.", [("VD_WORD_VARIANT_003_unlock", "unlocks", 1), ("VD_WORD_VARIANT_020_streamline", "streamlines", 1)]),
    ("We wanted speed, clarity, and innovation.", [("VD_RULE_OF_THREE", "We wanted speed, clarity, and innovation", 1)]),
    ("Studies have shown that the method works. Research indicates that it scales.", [("SOURCE_003_studies_have_shown", "Studies have shown", 1), ("SOURCE_001_research_indicates", "Research indicates", 1)]),
    ("Studies have shown that the method works [1].", []),
    ("The museum conserves a woven tapestry made on a loom.", [("VD_WORD_005_tapestry", "tapestry", 1)]),
    ("The platform creates a rich tapestry of problems.", [("META_001_rich_tapestry", "rich tapestry", 1), ("VD_WORD_005_tapestry", "tapestry", 1)]),
    ("In order to test it, we ran 5 interviews.", [("VD_IN_ORDER_TO", "In order to", 1)]),
    ("First line.\nWe have three things.\nWe do not stop!!", [("VD_NUMBER_WORD", "three", 1), ("VD_UNCONTRACTED_FORM", "do not", 1), ("MECH_REPEATED_EXCLAMATION", "!!", 1)]),
    ("The trial—which lasted six weeks—produced no effect.", [("EMDASH_PAIRED_PARENTHETICAL", "—which lasted six weeks—", 1), ("VD_EM_DASH", "—", 1), ("VD_EM_DASH", "—", 2), ("VD_NUMBER_WORD", "six", 1)]),
    ("The study ran from 2019—2024.", [("VD_EM_DASH", "—", 1)]),
    ("This improves speed. This improves clarity. This improves safety.", [("STRUCT_REPEATED_SENTENCE_OPENING", "This improves speed.", 1)]),
    ("A: b. C: d. E: f. G: h.", [("STRUCT_COLON_DENSITY", ":", 1)]),
    ("One. Two. Red. Blue.\n\nOk here.", [("VD_LONG_PARAGRAPH", "One. Two. Red. Blue.", 1), ("VD_NUMBER_WORD", "Two", 1)]),
    ("**a** and **b** plus **c** or **d**\n\n- x", [("VD_BOLD_DENSITY", "**c** or **d**", 1)]),
    ("Here's why it ran.\n\nHere's how it ran.\n\nHere's what matters now.", [("STRUCT_CONTROLLED_REVELATION", "Here's why it ran.\n\nHere's how it ran.\n\nHere's what matters", 1), ("STRUCT_DRAMATIC_PIVOT_PARAGRAPHS", "Here's why it ran.\n\nHere's how it ran.\n\nHere's what matters now.", 1)]),
    ("imagine a world where birds sing.", [("EX_001_imagine_a_world_where", "imagine a world where", 1), ("STRUCT_GENERIC_EXAMPLE_WITHOUT_DETAIL", "imagine a world where birds sing.", 1)]),
    ("Many people agree that it rains.", [("STRUCT_UNSUPPORTED_CONSENSUS", "Many people agree", 1)]),
    ("Picture this. It may potentially rain.", [("EX_002_picture_this", "Picture this", 1), ("SAFE_REDUNDANT_MODAL_MAY", "may potentially", 1)]),
    ("Not only speed but also care.\n\nYou can add more than that.", [("VD_NEG_NOT_ONLY", "Not only speed but also care", 1), ("VD_NEG_BARE_NOT", "Not only speed but also care.\n\nYou can add more than that", 1)]),
    ("This shows a rise.\n\nUltimately, it fell.\n\nThis suggests rain.", [("STRUCT_PARAGRAPH_ENDING_FORMULA", "This shows a rise.\n\nUltimately, it fell.\n\nThis suggests rain.", 1), ("DISC_005_ultimately", "Ultimately", 1)]),
    ("And it ran. But it sat. So it hid. It ate. It ran. It sat. It hid. It won.", [("VD_LONG_PARAGRAPH", "And it ran. But it sat. So it hid. It ate. It ran. It sat. It hid. It won.", 1)]),
]

#: Text, and what it becomes in auto mode with all dashes edited and medium risks taken.
EDITS: list[tuple[str, str]] = [
    ("It is important to note that the sample was small.", "The sample was small."),
    ("It is worth noting that the result is stable.\n", "The result is stable.\n"),
    ("Alpha﻿beta.", "Alphabeta."),
    ("The trial—which lasted six weeks—produced no measurable effect.", "The trial, which lasted six weeks, produced no measurable effect."),
    ("I thought the result would—actually, never mind.", "I thought the result would—actually, never mind."),
    ("The study ran from 2019—2024.", "The study ran from 2019–2024."),
    ("The sample was small—the effect was clear.", "The sample was small; the effect was clear."),
    ("Only one explanation remained—measurement error.", "Only one explanation remained: measurement error."),
    ("The system includes parts—input, processing, and output.", "The system includes parts: input, processing, and output."),
    ("See `in order to!!` at https://x.example/a!!b\n\n# Title\n\nStop!! Go.", "See `in order to!!` at https://x.example/a!!b\n\n# Title\n\nStop! Go."),
    ("<html><p>Stop!!</p><code>It is important to note that x!!</code></html>", "<html><p>Stop!</p><code>It is important to note that x!!</code></html>"),
    ("She wrote, “It is important to note that the sample was small.”", "She wrote, “It is important to note that the sample was small.”"),
    ("They may potentially go??  Now.", "They may go?  Now."),
]


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def findings_sql() -> str:
    """Expected findings as SQL: cases and pieces as VALUES, offsets found by counting characters up to the piece."""
    rows = ", ".join(f"({i}, {literal(t)}, '{rule}', {literal(piece)}, {n})" for i, (t, found) in enumerate(FINDINGS) for rule, piece, n in found)
    before = "list_reduce(list_transform(string_split(text, piece)[1:n], lambda x: length(x)), lambda a, b: a + b) + (n - 1) * length(piece)"
    return f"SELECT case_id::BIGINT AS case_id, rule_id, ({before})::BIGINT AS start, ({before} + length(piece))::BIGINT AS \"end\" FROM (VALUES {rows}) t(case_id, text, rule_id, piece, n)"


def edits_sql() -> str:
    return "SELECT case_id::BIGINT AS case_id, refined FROM (VALUES " + ", ".join(f"({i}, {literal(after)})" for i, (_, after) in enumerate(EDITS)) + ") t(case_id, refined)"
