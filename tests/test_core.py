import json
import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from textloom.__main__ import main
from textloom.functions import registry as R
from textloom.functions.facts import Facts, Segments
from textloom.operators import audit, reports
from textloom.operators import findings as K
from textloom.plans import fixtures, queries
from textloom.sources.configs import PolicyConfig, StyleConfig, load_author_profile, load_policy, merged
from textloom.sources.files import read_texts, write_whole
from textloom.streaming import gate_stream, read_folder

GOLDEN = """# A Revolutionary Framework for Better Writing

In today's dynamic landscape, this robust system doesn't just streamline your workflow. It unlocks a seamless, data-driven future.

It's not about sounding polished. It's about sounding human.

In order to make this work, we use three things: speed, clarity, and innovation.
"""
GOLDEN_AT = """VD_TITLE_CASE_HEADING 2 46, VD_TODAYS 48 76, VD_WORD_069_dynamic 59 66, VD_WORD_009_landscape 67 76, VD_WORD_047_robust 83 89, VD_NEG_DOESNT_JUST_PERIOD 97 177, VD_WORD_050_streamline 110 120,
VD_WORD_VARIANT_003_unlock 139 146, VD_WORD_044_seamless 149 157, VD_WORD_055_data_driven 159 170, VD_NEG_NOT_PERIOD 180 239, VD_IN_ORDER_TO 242 253, VD_NUMBER_WORD 277 282, VD_RULE_OF_THREE 291 321"""


def table(spark, *texts, extra=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def style(text, **settings):
    return K.style_refine(text, None, StyleConfig(**settings))


def rule_ids(found):
    return {x.rule.rule_id for x in found}


def test_registry():
    assert (len(R.style_rules()), len(R.policy_rules()), len(R.by_id())) == (385, 204, 589)
    assert sum(r.pattern is None for r in R.style_rules()) == 28 and sum(r.pattern is None for r in R.policy_rules()) == 9
    assert R.by_id()["STRUCT_EM_DASH_DENSITY"].risk == "high" and R.by_id()["STRUCT_PARTICIPIAL_OPENINGS"].evidence == "research-supported"
    assert R.by_id()["DISC_018_this_leads_to"].suggestions == ("This causes", "This supports")
    lines = reports.catalogue().splitlines()
    assert len(lines) == 590 and reports.catalogue(R.STYLE).startswith("rule_id\tcategory\tevidence_class\tweight\t")


def test_golden_sample(spark):
    row = reports.plain(audit.policy_audit(spark.createDataFrame([(GOLDEN, "before.md")], "text string, source string"), source="source").first())["audit"]
    assert ", ".join(f"{x['rule_id']} {x['start']} {x['end']}" for x in row["findings"]) == GOLDEN_AT.replace("\n", " ")
    payload = reports.policy_payload(row, GOLDEN, "before.md", PolicyConfig())
    m = payload["metrics"]
    assert (m["failure_count"], m["severity_counts"], m["status"], m["format"], m["word_count"], m["source_counts"]) == (11, {"hard": 11, "strong": 3}, "fail", "markdown", 47, {R.POLICY: 14})
    assert m["texture"] == {"sentence_word_mean": 7.83, "sentence_word_min": 4, "sentence_word_max": 14, "sentence_length_cv": 0.48, "paragraph_sentence_counts": [1, 2, 2, 1], "contraction_count": 4, "direct_address_count": 2, "number_count": 0, "parenthetical_count": 0}
    assert (payload["findings"][2]["line"], payload["findings"][2]["column"]) == (3, 12)
    assert json.loads(reports.as_json(payload)) == json.loads(json.dumps(payload))
    assert "### HARD: `VD_TODAYS` at L3:C1\n\nMatched: `In today's dynamic landscape`\n\nGeneric 'In today's...' opening.\n\n**Edit:** Open with the actual subject.\n" in reports.markdown(payload)
    assert "Status: FAIL (fail on hard)" in reports.policy_text(payload)
    auto = K.policy_refine(GOLDEN, "before.md", PolicyConfig(mode="auto"))[0]
    assert auto.text == GOLDEN.replace("In order to", "To") and auto.idempotent and len(auto.edits) == 1


def test_fixture_corpus(spark):
    for i, (text, wanted) in enumerate(fixtures.FINDINGS):
        at = lambda piece, n, t=text: [m.start() for m in re.finditer(re.escape(piece), t)][n - 1]
        got = sorted((x.rule.rule_id, x.start, x.end) for x in K.policy_refine(text, None, PolicyConfig())[0].found)
        assert got == sorted((r, at(p, n), at(p, n) + len(p)) for r, p, n in wanted), (i, text)
    for text, wanted in fixtures.EDITS:
        done = style(text, mode="auto", em_dash_policy="eliminate", max_auto_risk="medium")
        assert done.text == wanted and done.idempotent, text
    assert style("“It is important to note that x.”", mode="auto", edit_quotes=True).text == "“X.”"
    assert style(fixtures.EDITS[0][0]).text == fixtures.EDITS[0][0]  # an audit never edits


def test_scan_equals_every_pattern_on_every_text():
    phrases = [*R.VD_WORD, *(r + "s" for r in R.VD_ROOTS), *R.VD_COPULA, *R.VD_PHRASE, *(queries._first(x) for spec in R.FAMILIES for x in spec[2])]
    texts = [f"Here {p} ends. Then {p.upper()} ends. {p} starts.".replace("'", "’" if k % 2 else "'") for k, p in enumerate(phrases)]
    texts += ["It is not just speed, but also care. It marks a change. It isn't merely fun, it is work.", "The issue is not cost. The issue is time. No fuss. No noise. Just work.", "from speed to care, highlighting its importance. Really? No. We go.", "not only x, but also y; less about a and more about b. Forget it. This is new.", "Not this. That one.  Let's dive in!! What?? 10x your work​ in today’s world"]
    texts += [t for t, _ in fixtures.FINDINGS] + [t for t, _ in fixtures.EDITS]
    for rules in (R.style_rules(), R.policy_rules()):
        patterned = [r for r in rules if r.pattern]
        matcher = K.Matcher(patterned)
        for t in texts:
            wanted = {r.rule_id for r in patterned if re.search(r.pattern, t, re.I)}
            met = {r.rule_id for r, p in matcher.rules_for(t, Segments(t).vocabulary) if p.search(t)}
            assert met == wanted, t


def test_findings_by_context():
    assert "SOURCE_003_studies_have_shown" not in rule_ids(style("Studies have shown that it works [1].").found)
    assert not any(x.rule.category == "research_lexicon" for x in style("A woven tapestry made on a loom.").found)
    assert len(style("At its core, art. So at its core, bread. At its core, cold.").found) == 2  # signposts count at a sentence start only
    assert not style("This highlights art.").found and len(style("This highlights art. This highlights bread.").found) >= 2  # at least two
    two = style("It is not speed; it is reliability. Not just output, but evidence.").found
    assert [x.candidates for x in two] == [("Reliability rather than speed.",), ("Output and evidence.",)]
    assert {x.rule.rule_id for x in style("Deeply, deeply, deeply so.").found} >= {"INT_001_deeply"}
    assert not style("It is important to note that x.", min_confidence="high").found == [] and style("The end", profile="minimal").found == []


def test_classes_of_dashes():
    kinds = {
        "The trial—which lasted six weeks—produced no effect.": "PAIRED_PARENTHETICAL", "From 2019—2024.": "NUMERIC_RANGE", "Said well.\n— Jane Doe": "ATTRIBUTION", "It would—actually, never mind.": "INTERRUPTION",
        "The sample was small—the effect was clear.": "INDEPENDENT_CLAUSES", "It has parts—input, and output.": "LIST_INTRODUCTION", "One explanation remained—measurement error.": "APPOSITIONAL", "He left—quickly.": "AMBIGUOUS",
    }
    for text, kind in kinds.items():
        assert [x.rule.rule_id for x in style(text).found if x.rule.category == "punctuation"] == [f"EMDASH_{kind}"], text
        assert not style(text, em_dash_policy="preserve").found
    reduced = style("He left—quickly. The sample was small—the effect was clear.", mode="auto", max_auto_risk="medium")
    assert reduced.text == "He left—quickly. The sample was small; the effect was clear."


def test_structure_rules():
    eight = " ".join(f"Word{i} one two three four five six seven eight." for i in range(8))
    para = "\n\n".join(f"P{i} " + "w " * 20 + "end." for i in range(5))
    cases = {
        "UNIFORM_SENTENCE_LENGTH": eight, "UNIFORM_PARAGRAPH_LENGTH": para, "REPEATED_SENTENCE_OPENING": "It ran on. It ran off. It ran.", "EXCESSIVE_HEADINGS": "# a\n# b\n# c\n# d\n", "THREE_ITEM_BLOCKS": "- a x\n- b\n- c d e\n\nT\n\n- d\n- e f g h\n- f\n\nText. More.", "BOLD_LABEL_BULLETS": "- **a:** x\n- **b:** y y\n- **c:** z z z\n- d",
        "HERES_REPETITION": "Here is art. Here's bread. Here is cold. End.", "INITIAL_CONJUNCTIONS": "And art. But bread. So cold. It ate. We ran. You sat. They hid. She won.", "PARTICIPIAL_OPENINGS": "Going out, we ate. Seeing it, you ran. Having it, they sat. She hid. He won. It fell.", "COLON_DENSITY": "a: b: c: d:", "EM_DASH_DENSITY": "a — b — c — d",
        "INTRO_CONCLUSION_OVERLAP": "\n\n".join([(x := " ".join(f"word{i}" for i in range(20)) + "."), " ".join(f"b{i}" for i in range(25)) + "!", " ".join(f"c{i}" for i in range(22)), x]), "GENERIC_EXAMPLE_WITHOUT_DETAIL": "picture this.", "UNSUPPORTED_CONSENSUS": "First.\nSecond.\nExperts agree so.",
        "QUESTION_FRAGMENTS": "The cost?\n\nOther text here.\n\nThe end?", "NOMINALIZATION_DENSITY": " ".join(R.NOM[:5]) + ".",
    }
    for name, text in cases.items():
        assert f"STRUCT_{name}" in rule_ids(style(text).found), name
    assert not [x for x in style("A plain line.\nAnother one.").found if x.rule.rule_id.startswith("STRUCT")]


def test_policy_settings():
    found = lambda text, **s: rule_ids(K.policy_refine(text, None, PolicyConfig(**s))[0].found)
    assert "VD_WORD_072_transparent" in found("The JSON is transparent.") and not found("The JSON is transparent.", allowed_terms=("Transparent",)) and not found("The JSON is transparent.", allowed_patterns=("json",))
    assert not found("He said “a robust tool”.") and "VD_WORD_047_robust" in found("He said “a robust tool”.", check_quotes=True)
    assert not found("A robust tool.", disabled_rules=("VD_WORD_047_robust",))
    graded = K.policy_refine("A robust tool.", None, PolicyConfig(severity_overrides=(("VD_WORD_047_robust", "light"),)))[0].found
    assert [x.severity for x in graded] == ["light"]
    assert K.policy_refine("IN ORDER TO go, in order to stay.", None, PolicyConfig(mode="auto"))[0].text == "TO go, to stay."
    assert merged(PolicyConfig(allowed_terms=("a",)), ("a", "b"), fail_on="any", format=None).allowed_terms == ("a", "b")
    with pytest.raises(ValueError):
        PolicyConfig(fail_on="never")


def test_author_profiles(tmp_path):
    def load(content, loader=load_author_profile):
        (tmp_path / "p.json").write_text(json.dumps(content))
        return loader(str(tmp_path / "p.json"))

    for bad in ({"em_dash_policy": "obliterate"}, {"disabled_rules": ["NOT_A_REAL_RULE"]}, {"category_weights": {"imaginary_category": 2}}, {"protected_patterns": ["(a+)+"]}, {"protected_patterns": ["("]}, {"x": 1}, {"preferred_sentence_words": [3, 1]}, {"allow_contractions": 1}, [], {"disabled_rules": ["UNICODE_BOM"], "enabled_rules": ["UNICODE_BOM"]}):
        with pytest.raises(ValueError):
            load(bad)
    for bad in ({"fail_on": "x"}, {"severity_overrides": {"VD_EM_DASH": "fatal"}}, {"disabled_rules": ["X"]}, {"allowed_patterns": ["a" * 513]}, {"check_quotes": "no"}):
        with pytest.raises(ValueError):
            load(bad, load_policy)
    assert load({"fail_on": "strong", "severity_overrides": {"VD_EM_DASH": "strong"}, "notes": "x"}, load_policy).severity_overrides == (("VD_EM_DASH", "strong"),)
    author = load({"name": "T", "discouraged_phrases": ["move the needle"], "protected_patterns": ["KEEP:.*"], "preferred_transitions": ["in essence"], "category_weights": {"corporate_abstraction": 2}})
    done = style("We should move the needle. KEEP: It is important to note that x.", mode="auto", author=author)
    assert "PROFILE_DISCOURAGED_001" in rule_ids(done.found) and "KEEP: It is important to note that x." in done.text
    assert not style("In essence, x.", author=author).found and style("A robust framework.", author=author).found[0].weight == 4.0
    strict = load({"allow_contractions": False, "preferred_sentence_words": [4, 6]})
    text = "It isn't ready. This compact sentence is acceptable. This deliberately overlong sentence exceeds the configured range by several unnecessary words. We won't ship."
    assert {"PROFILE_CONTRACTION_DISALLOWED", "PROFILE_SENTENCE_WORD_RANGE"} <= rule_ids(style(text, author=strict).found)


def test_protected_spans():
    kinds = lambda text, fmt: "+".join(Facts(text, fmt).spans.kind)
    text = 'Before.  \n```python\nprint("x")\n```\n    code = True\nAfter `a` and ``b`c`` [d](https://e.f/g) [h][i] [^1]\n> quote\n~~~\nopen'
    for kind in ("fenced_code", "indented_code", "inline_code", "link", "reference_link", "footnote", "blockquote"):
        assert f"markdown_{kind}" in kinds(text, "markdown"), kind
    assert "html_code" in kinds("<pre>a</pre> <b>", "html") and "html_markup" in kinds("<b>x</b><!-- c -->", "html") and "latex_verbatim" in kinds("\\begin{verbatim}x\\end{verbatim}", "latex")
    plain = 'https://a.b/c x@y.org 10.1234/ab.c <mailto:z@w.de> [1, 2] (Doe et al., 2020) “a” ‘b’ "cd"\n"key": "value"\n'
    for kind in ("url", "email", "doi", "autolink", "numeric_citation", "author_date_citation", "quoted_text", "json_string"):
        assert kind in kinds(plain, "plain"), kind
    f = Facts("a `b\nc` d", "markdown")
    assert f.masked == "a   \n   d" and f.spans.at(3, 4, "analysis") == "markdown_inline_code" and f.spans.at(0, 2, "edit") is None
    assert Facts("See “x https://a.b y” z", "plain").spans.kind == ["quoted_text+url"]
    assert [Facts(t, "auto", n).format for t, n in (("x", "a.MD"), ("x", "b.htm"), ("# h", None), ("<p>x", None), ("\\section{x}", None), ("x", "c.txt"))] == ["markdown", "html", "markdown", "html", "latex", "plain"]


def test_sentences_and_paragraphs():
    t = 'Dr. Smith paid 3.5 dollars. "Ok." (Yes!) no\n\nNew e.g. this. A. B. Foo.\r\nBar … — .'
    assert [t[a:b] for a, b in Segments(t).sentences] == ["Dr. Smith paid 3.5 dollars.", '"Ok."', "(Yes!)", "no", "New e.g. this.", "A. B. Foo.", "Bar … — ."]
    assert Segments("a\n \nb\r\n\r\n c ").paragraphs.tolist() == [[0, 1], [4, 5], [10, 11]] and Segments("").paragraphs.tolist() == []
    assert Segments("a\nbc").place(3) == (2, 2)


def test_long_runs_take_seconds(spark):
    for text in ("\n" * 300_000, '"abc" ' * 30_000, " \n" * 100_000, "“" * 100_000, "." * 300_000 + " x", '"' + "\\" * 100_001, "[a](" + "\\" * 50_000, "<" * 100_000, "`" * 99 + "`` ` " * 20_000, "a. " * 30_000, "—" * 20_000):
        began = time.time()
        f = Facts(text)
        assert len(f.clean.sentences) >= 0 and len(f.clean.paragraphs) >= 0 and time.time() - began < 5, text[:10]
    from textloom.functions import text as T

    assert table(spark, "a" + "\n" * 300_000 + "b").select(F.size(T.paragraphs(F.col("text")))).first()[0] == 2


def test_rows_of_any_kind(spark):
    d = spark.createDataFrame([(None, "A robust tool.", "x"), (None, "A robust tool.", "x"), (1, None, None), (1, "", "y")], "doc_id long, text string, audit string")
    out = audit.policy_audit(d)
    assert out.columns == ["doc_id", "text", "audit", "audit_1"] and audit.column_of(out) == "audit_1"
    rows = audit.gate(out, ["doc_id", "audit"]).collect()
    assert sorted((r.failure_count, r.status) for r in rows) == [(0, "pass"), (0, "pass"), (1, "fail"), (1, "fail")]
    empty = d.limit(0)
    assert audit.gate(audit.policy_audit(empty), ["doc_id"]).count() == audit.scores(audit.style_audit(empty), ["doc_id"]).count() == audit.openings(empty, ["doc_id"]).count() == 0


def test_scores_and_counts(spark):
    a = audit.style_audit(table(spark, "A robust framework. " * 5, "Plain words."), StyleConfig())
    scores = {(r.doc_id, r.dimension): r for r in audit.scores(a, ["doc_id"]).collect()}
    assert len(scores) == 22 and scores[0, "register_mismatch"].score == round((2.0 * (1 + 0.75 + 0.5 + 0.25 * 2)) * 1000 / 250, 2) and scores[1, "register_mismatch"].band == "low"
    counts = {r.doc_id: r for r in audit.counters(a, ["doc_id"]).collect()}
    assert counts[0].category_counts["corporate_abstraction"] == 5 and counts[1].category_counts == {}
    assert {r.category: (r.n, r.docs) for r in audit.corpus_counts(a, "category").collect()}["corporate_abstraction"] == (5, 1)
    m = audit.metrics(a, ["doc_id"]).where("doc_id = 0").first()
    assert (m.word_count, m.sentence_count, m.registry_rule_count, m.structural_analyzer_count, m.changed) == (15, 5, 385, 28, False)
    values = [2.675, 0.125, 0.375, 1234567.005, 11.525, 0.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(audit.rounded(F.col("v"), 2)).collect()
    assert [r[0] for r in got] == [round(v, 2) for v in values]


def test_files_reports_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_bytes("A robust tool.\r\nIn order to go.".encode())
    rows = read_texts(spark, f"{tmp_path}/in/*.md")
    assert rows.first().text == "A robust tool.\r\nIn order to go."
    report = reports.rendered(audit.policy_audit(rows, PolicyConfig(), source="source"), PolicyConfig()).first()
    assert json.loads(report.report)["metrics"]["failure_count"] == 2
    query = gate_stream(read_folder(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("gated").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("gated").first().failure_count == 2
    write_whole(f"{tmp_path}/new/x.txt", "é\r\n")
    assert (tmp_path / "new" / "x.txt").read_bytes() == "é\r\n".encode()
    (tmp_path / "in" / "bad.md").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception):  # noqa: B017
        read_texts(spark, f"{tmp_path}/in/bad.md").collect()


def test_command_line(tmp_path, capsys):
    path = tmp_path / "a.txt"
    path.write_text("It is important to note that the sample was small.")
    assert main(["style", str(path), "--check", "--quiet"]) == 1 and main(["policy", str(path), "--quiet"]) == 0
    assert main(["style", str(path), "--mode", "auto", "--quiet"]) == 0 and capsys.readouterr().out == "The sample was small."
    report = tmp_path / "r.json"
    assert main(["style", str(path), "--mode", "auto", "--apply", "--report-json", str(report), "--quiet"]) == 0
    assert path.read_text() == "The sample was small." and json.loads(report.read_text())["idempotent_check"]
    assert main(["style", str(tmp_path / "none.txt")]) == 3 and main(["policy", "--list-rules"]) == 0
    for wrong in (["style", str(path), "--apply"], ["style", str(path), "--check", "--output", "x"], ["policy"]):
        with pytest.raises(SystemExit) as e:
            main(wrong)
        assert e.value.code == 2
    assert reports.diff("a\n", "b\n", "n").startswith("--- n (original)\n+++ n (refined)\n") and reports.diff("a", "a") == ""


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_on_odd_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    ends = "Go on. " + " ".join(["e"] * 15) + ". " + " ".join(["f"] * 17) + ". "
    texts = [
        "An a.klsd is one word. It ends..a. So does it.", "St.ihgne ran. st.ihgne sat. ST.ihgne hid.", "To be. To be. To be- it.", "Bé lá x. ΑΣ ΒΣ. ΑΣ ΒΣ. ασ βσ. İx y.", "***\n\nA b.\n\nIt is you-me, I.", None, ends * 2, ends * 3,
        "from aa to " + "b" * 69 + " from cc to dd", "from aa to " + "b" * 60 + ", from cc to dd", "²from aa to bb",
    ]
    table(spark, *texts).withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("false_ranges", "texture", "repeated_openings"):
        found = queries.QUERIES[name](spark, str(tmp_path))
        columns = ", ".join(found.columns)
        assert sorted(map(tuple, found.collect())) == con.execute(f"SELECT {columns} FROM ({queries.SQL[name]}) ORDER BY ALL").fetchall(), name
