"""The audit as DataFrame operators: findings, edits, gates, counters, scores and texture of every row.

The per-text work (offsets of matches, protected spans, order-dependent choices) is one Arrow pass that adds a struct
column; rows aren't shuffled, collected or joined by an id for it, so ids may be null, repeated or missing. All that
follows reads the struct: filters, folds and groupings of built-in functions.

Defined cases: a null text counts as empty and gives no finding; rows with equal ids stay rows of their own; an empty
table gives an empty result; all columns of the input stay as they are, whatever their names, and the added column has
a name that none of them has (``column_of`` tells it). A text takes time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from textloom.functions import registry as R
from textloom.functions.facts import Facts, Segments
from textloom.operators import findings as K
from textloom.sources.configs import PolicyConfig, StyleConfig

FINDING = "struct<source:string,rule_id:string,category:string,severity:string,start:int,end:int,line:int,column:int,matched_text:string,explanation:string,suggestion:string,candidates:array<string>,weight:double,evidence_class:string,false_positive_risk:string,confidence:string,protected:boolean,protected_kind:string,nth:int>"
EDIT = "struct<source:string,rule_id:string,start:int,end:int,original:string,replacement:string,rationale:string>"
SPAN = "struct<start:int,end:int,kind:string,analysis:boolean,edit:boolean>"
AUDIT = f"struct<format:string,word_count:int,sentence_count:int,paragraph_count:int,spans:array<{SPAN}>,findings:array<{FINDING}>,initial_findings:array<{FINDING}>,refined:string,edits:array<{EDIT}>,warnings:array<string>,idempotent:boolean>"
SEGMENTS = "struct<words:int,sentences:array<struct<start:int,end:int,words:int,opening:string>>,paragraphs:array<struct<start:int,end:int,words:int,sentences:int>>>"
SPANS = f"struct<format:string,masked:string,spans:array<{SPAN}>>"
#: Rows of an Arrow batch, at most; texts may be long.
BATCH_ROWS = 1000


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that no column has."""
    taken = {c.lower() for c in docs.columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if x.lower() not in taken)


def column_of(result: DataFrame) -> str:
    """Name of the column that an operator of this module added: the last."""
    return result.columns[-1]


def add(docs: DataFrame, name: str, kind: str, make: Callable[[str, str | None], dict], text: str = "text", source: str | None = None) -> DataFrame:
    """``docs`` with one more column, a struct made of each row's text (and source name) by ``make``."""
    spark, result = docs.sparkSession, fresh(docs, name)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    added: DataType = _parse_datatype_string(kind)
    arrow, at, named = to_arrow_type(added), docs.columns.index(text), docs.columns.index(source) if source else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(named).to_pylist() if named is not None else [None] * batch.num_rows
            made = [make(t or "", n) for t, n in zip(batch.column(at).to_pylist(), names, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=[*batch.schema.names, result])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(result, added)]))


def _spans(f: Facts) -> list[dict]:
    s = f.spans
    return [{"start": a, "end": b, "kind": k, "analysis": x, "edit": e} for a, b, k, x, e in zip(s.start.tolist(), s.end.tolist(), s.kind, s.analysis.tolist(), s.edit.tolist(), strict=True)]


def _result(r: K.Refined, initial: list[K.Finding]) -> dict:
    found = K.numbered(r.found)
    return {
        "format": r.facts.format, "word_count": Segments(r.text).word_count if r.text != r.facts.text else r.facts.word_count, "sentence_count": len(r.facts.clean.sentences), "paragraph_count": len(r.facts.clean.paragraphs), "spans": _spans(r.facts), "findings": found,
        "initial_findings": found if initial is r.found else K.numbered(initial), "refined": r.text, "edits": [vars(e) for e in r.edits], "warnings": r.warnings, "idempotent": r.idempotent,
    }


def style_audit(docs: DataFrame, config: StyleConfig | None = None, text: str = "text", source: str | None = None) -> DataFrame:
    """``docs`` with column ``audit`` (see AUDIT): the scored layer, and its edits in auto mode."""
    config = config or StyleConfig()

    def make(t: str, name: str | None) -> dict:
        r = K.style_refine(t, name, config)
        out = _result(r, r.found)
        return out | {"word_count": r.facts.word_count}  # of the text as it came, as its scores are

    return add(docs, "audit", AUDIT, make, text, source)


def policy_audit(docs: DataFrame, config: PolicyConfig | None = None, text: str = "text", source: str | None = None) -> DataFrame:
    """``docs`` with column ``audit`` (see AUDIT): both layers as one graded stream, and their edits in auto mode."""
    config = config or PolicyConfig()
    return add(docs, "audit", AUDIT, lambda t, name: _result(*K.policy_refine(t, name, config)), text, source)


def segments(docs: DataFrame, text: str = "text", cut: Callable[[str], dict] | None = None) -> DataFrame:
    """``docs`` with column ``segments`` (see SEGMENTS): sentences and paragraphs of the raw text, or as ``cut`` gives them."""

    def make(t: str, _: str | None) -> dict:
        if cut:
            return cut(t)
        s = Segments(t)
        opening = lambda i, n: f"{s.token(i)} {s.token(i + 1)}" if n > 1 else None
        return {
            "words": s.word_count,
            "sentences": [{"start": a, "end": b, "words": n, "opening": opening(i, n)} for (a, b), n, i in zip(s.sentences.tolist(), s.sentence_words.tolist(), s.sentence_first.tolist(), strict=True)],
            "paragraphs": [{"start": a, "end": b, "words": n, "sentences": k} for (a, b), n, k in zip(s.paragraphs.tolist(), s.paragraph_words.tolist(), s.paragraph_sentences.tolist(), strict=True)],
        }

    return add(docs, "segments", SEGMENTS, make, text)


def protected(docs: DataFrame, text: str = "text", source: str | None = None, fmt: str = "auto", extra: tuple[str, ...] = (), edit_quotes: bool = False) -> DataFrame:
    """``docs`` with column ``protected`` (see SPANS): format, masked text and merged protected spans."""

    def make(t: str, name: str | None) -> dict:
        f = Facts(t, fmt, name, extra, edit_quotes)
        return {"format": f.format, "masked": f.masked, "spans": _spans(f)}

    return add(docs, "protected", SPANS, make, text, source)


def exploded(audited: DataFrame, keep: list[str], which: str = "findings") -> DataFrame:
    """One row a finding: the ``keep`` columns and the finding's fields."""
    one = audited.select(*[F.col(f"`{c}`") for c in keep], F.explode(f"{column_of(audited)}.{which}").alias("_x"))
    names = [f.name for f in _parse_datatype_string(FINDING).fields]
    return one.select(*keep, *[F.col(f"_x.`{n}`").alias(n) for n in names if n not in keep])


def fails(severity: Column, level: str) -> Column:
    """Whether a finding of that grade fails a gate: none, any, strong or hard."""
    return F.lit(False) if level == "none" else F.lit(True) if level == "any" else severity.isin("hard", "strong") if level == "strong" else severity == "hard"


def gate(audited: DataFrame, keep: list[str], level: str = "hard") -> DataFrame:
    """Rows (keep..., finding_count, failure_count, status), without a shuffle."""
    found = F.col(f"{column_of(audited)}.findings")
    n = F.size(F.filter(found, lambda x: fails(x.severity, level))).cast("long")
    return audited.select(*keep, F.size(found).cast("long").alias("finding_count"), n.alias("failure_count"), F.when(n > 0, "fail").otherwise("pass").alias("status"))


KEYS = ["source", "category", "severity", "false_positive_risk", "confidence", "evidence_class"]


def counters(audited: DataFrame, keep: list[str]) -> DataFrame:
    """Findings of each row by each of KEYS, as maps in columns ``<key>_counts``, without a shuffle."""
    found = F.col(f"{column_of(audited)}.findings")

    def of(key: str) -> Column:
        values = F.transform(found, lambda x: x[key])
        return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(v.alias("key"), F.size(F.filter(values, lambda x: x == v)).alias("value"))))

    return audited.select(*keep, *[of(k).alias(f"{k}_counts") for k in KEYS])


def corpus_counts(audited: DataFrame, key: str) -> DataFrame:
    """Rows (key, n, docs) over the whole table: findings, and rows that have one; counted in each row before a shuffle."""
    per = counters(audited, []).select(F.explode(f"{key}_counts").alias("key", "n"))
    return per.groupBy(F.col("key").alias(key)).agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def rounded(value: Column, digits: int) -> Column:
    """Half to even, on the exact binary value."""
    return F.regexp_replace(F.format_number(value, digits), ",", "").cast("double")


def band(score: Column) -> Column:
    return F.when(score < 5, "low").when(score < 12, "moderate").when(score < 25, "high").otherwise("very_high")


def weighed(found: Column) -> Column:
    """Sum of weights: a rule's first finding in full, the second by 3/4, the third by half, others by a quarter."""
    share = lambda n: F.when(n == 1, 1.0).when(n == 2, 0.75).when(n == 3, 0.5).otherwise(0.25)
    return F.aggregate(found, F.lit(0.0), lambda s, x: s + x.weight * share(x.nth))


def scores(audited: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep..., dimension, score, band, finding_count) for every dimension, marker density of all findings last."""
    audit = column_of(audited)
    found, words = F.col(f"{audit}.findings"), F.col(f"{audit}.word_count")
    of = lambda cs: F.filter(found, lambda x: x.category.isin(*cs))
    chosen = [(d, of(cs)) for d, cs in R.DIMENSIONS.items()] + [("marker_density", found)]
    score = lambda f: rounded(weighed(f) * 1000 / F.greatest(F.lit(250), words), 2)
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), score(f).alias("score"), F.size(f).cast("long").alias("finding_count")) for d, f in chosen])
    one = audited.select(*keep, F.explode(each).alias("_x"))
    return one.select(*keep, "_x.dimension", "_x.score", band(F.col("_x.score")).alias("band"), "_x.finding_count")


def metrics(audited: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Counts of the text, its protection and findings, one row each."""
    a, t = column_of(audited), F.coalesce(F.col(text), F.lit(""))
    kept = F.aggregate(F.col(f"{a}.spans"), F.lit(0), lambda s, x: s + F.when(x.edit, x.end - x.start).otherwise(0))
    found = F.col(f"{a}.findings")
    density = rounded(weighed(found) * 1000 / F.greatest(F.lit(250), F.col(f"{a}.word_count")), 2)
    return audited.select(
        *keep, f"{a}.format", f"{a}.word_count", f"{a}.sentence_count", f"{a}.paragraph_count", F.size(found).alias("finding_count"), F.size(f"{a}.edits").alias("applied_edit_count"), density.alias("marker_density_score"), band(density).alias("marker_density_band"),
        F.size(f"{a}.spans").alias("protected_span_count"), kept.alias("protected_character_count"), rounded(kept / F.greatest(F.lit(1), F.length(t)), 4).alias("protected_character_fraction"), (F.length(t) - F.length(F.replace(t, F.lit("—")))).alias("em_dash_count"),
        (F.length(t) - F.length(F.replace(t, F.lit(":")))).alias("colon_count"), (F.col(f"{a}.refined") != t).alias("changed"), f"{a}.idempotent", F.lit(len(R.style_rules())).alias("registry_rule_count"), F.lit(sum(r.pattern is None for r in R.style_rules())).alias("structural_analyzer_count"),
    )


def texture(docs: DataFrame, keep: list[str], text: str = "text", cut: Callable[[str], dict] | None = None) -> DataFrame:
    """Sentence and paragraph lengths, contractions, direct address, numbers and asides of every row."""
    from textloom.functions import text as T

    s = segments(docs, text, cut)
    made, t = column_of(s), F.coalesce(F.col(text), F.lit(""))
    lengths = F.col(f"{made}.sentences.words")
    mean = F.coalesce(F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(lengths), F.lit(0)), F.lit(0.0))
    # the running form, as SQL's stddev_pop takes it: a sum of squares by itself can fall on the other side of a half
    moved = lambda a, x: a["mean"] + (x - a["mean"]) / (a.n + 1)
    step = lambda a, x: F.struct((a.n + 1).alias("n"), moved(a, x).alias("mean"), (a.squares + (x - moved(a, x)) * (x - a["mean"])).alias("squares"))
    nothing = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    spread = F.aggregate(lengths, nothing, step, lambda a: F.sqrt(a.squares / F.nullif(a.n, F.lit(0.0))))
    d = s.withColumn("mean", mean)
    cv = F.when((F.col("mean") == 0) | (F.size(lengths) < 2), F.lit(0.0)).otherwise(spread / F.col("mean"))
    least = lambda f: F.coalesce(f(lengths), F.lit(0))
    return d.select(
        *keep, F.size(lengths).alias("sentences"), rounded(F.col("mean"), 2).alias("sentence_word_mean"), least(F.array_min).alias("sentence_word_min"), least(F.array_max).alias("sentence_word_max"), rounded(cv, 3).alias("sentence_length_cv"),
        F.col(f"{made}.paragraphs.sentences").alias("paragraph_sentence_counts"), T.count(t, T.CONTRACTION).alias("contraction_count"), T.count(t, T.ADDRESS).alias("direct_address_count"), T.count(t, T.NUMBER, "U").alias("number_count"), T.count(t, T.PARENTHETICAL).alias("parenthetical_count"),
    )


def openings(docs: DataFrame, keep: list[str], text: str = "text", least: int = 3, cut: Callable[[str], dict] | None = None) -> DataFrame:
    """Rows (keep..., opening, n): two lower-cased first words that ``least`` sentences of a row share."""
    s = segments(docs, text, cut)
    said = F.array_sort(F.filter(F.col(f"{column_of(s)}.sentences.opening"), lambda x: x.isNotNull()))
    nothing = F.expr("named_struct('last', cast(null as string), 'n', 0, 'found', cast(array() as array<struct<opening:string,n:int>>))")
    closed = lambda s: F.when(s.n >= least, F.concat(s.found, F.array(F.struct(s["last"].alias("opening"), s.n.alias("n"))))).otherwise(s.found)
    step = lambda s, x: F.when(x.eqNullSafe(s["last"]), F.struct(s["last"].alias("last"), (s.n + 1).alias("n"), s.found.alias("found"))).otherwise(F.struct(x.alias("last"), F.lit(1).alias("n"), closed(s).alias("found")))
    one = s.select(*keep, F.explode(F.aggregate(said, nothing, step, closed)).alias("_x"))
    return one.select(*keep, "_x.opening", F.col("_x.n").cast("long").alias("n"))
