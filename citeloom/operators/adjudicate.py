"""External judgments as a pluggable, cached step, off by default.

An adjudicator is a function from a list of prompts to a list of answers (JSON texts) that is shipped to the
workers.  Its failures and malformed answers become values in ``error``; only well-formed answers are worth
caching, by the hash of the prompt, the kind of question and the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a well-formed answer per kind of question, with the values they may take.
ANSWERS = {
    "can_correspond": {"answer": ["yes", "no"], "confidence": ["high", "medium", "low"]},
    "same_work": {"relation": ["same", "version", "part", "different"], "confidence": ["high", "medium", "low"]},
    "web_match": {"answer": ["yes", "no"], "confidence": ["high", "medium", "low"]},
    "field_check": {"kind": ["variant", "error", "uncertain"], "confidence": ["high", "medium", "low"]},
    "citation_alignment": {"status": ["supported", "contradicted", "not_in_abstract"], "confidence": ["high", "medium", "low"]},
}
TEXT_CAP = 4000
INSTRUCTION = {
    "can_correspond": "Does this record describe the cited work? Without evidence for it the answer is no.",
    "same_work": "How are these two records related? Without evidence for more they are different.",
    "web_match": "Is this page the cited work itself? Without evidence for it the answer is no.",
    "field_check": "Is the cited value a variant of the canonical one or an error? If in doubt it is uncertain.",
    "citation_alignment": "Does the abstract support the sentence? What it does not mention is not_in_abstract.",
}


def prompt(kind: str, **parts: Column) -> Column:
    """A question with its labelled parts, long texts cut at TEXT_CAP signs."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(F.left(v.cast("string"), F.lit(TEXT_CAP)), F.lit("(none)"))) for k, v in parts.items()]
    fields = "; ".join(f"{f} in {'/'.join(v)}" for f, v in ANSWERS[kind].items())
    return F.concat_ws("\n", F.lit(INSTRUCTION[kind]), F.lit(f"Answer in JSON: {fields}."), *lines)


def with_hash(questions: DataFrame) -> DataFrame:
    return questions.withColumn("prompt_hash", F.sha2("prompt", 256))


def parse(kind: str, raw: Column) -> Column:
    """The answer as a struct; null if it is not the JSON that was asked for."""
    schema = ", ".join(f"{f} string" for f in ANSWERS[kind])
    got = F.from_json(raw, schema)
    ok = F.lit(True)
    for f, allowed in ANSWERS[kind].items():
        ok = ok & got[f].isin(allowed)
    return F.when(F.coalesce(ok, F.lit(False)), got)


def ask(questions: DataFrame, kind: str, model: str, judge: Callable[[list[str]], list[str]] | None, cache: DataFrame | None = None) -> DataFrame:
    """``questions`` (with ``prompt``) with ``answer`` (struct) and ``error``.

    Cached answers (prompt_hash, kind, model, answer as JSON) are reused; without a judge the rest has the
    error "no adjudicator".
    """
    rows = with_hash(questions)
    if cache is not None:
        known = cache.filter((F.col("kind") == kind) & (F.col("model") == model)).select("prompt_hash", F.col("answer").alias("_known")).dropDuplicates(["prompt_hash"])
        rows = rows.join(known, "prompt_hash", "left")
    else:
        rows = rows.withColumn("_known", F.lit(None).cast("string"))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw, error = [None] * len(pdf), [None] * len(pdf)
            open_ = [i for i, k in enumerate(pdf["_known"]) if k is None]
            if open_ and judge is None:
                for i in open_:
                    error[i] = "no adjudicator"
            elif open_:
                try:
                    for i, a in zip(open_, judge([pdf["prompt"].iloc[i] for i in open_]), strict=True):
                        raw[i] = a
                except Exception as e:  # a failing judge is a value, not a failed job
                    for i in open_:
                        error[i] = f"{type(e).__name__}: {e}"[:200]
            yield pdf.assign(_raw=[k if k is not None else r for k, r in zip(pdf["_known"], raw, strict=True)], error=error)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _raw string, error string"
    out = rows.mapInPandas(call, schema).withColumn("answer", parse(kind, F.col("_raw")))
    bad = F.col("error").isNull() & F.col("answer").isNull()
    return out.withColumn("error", F.when(bad, "malformed answer").otherwise(F.col("error"))).drop("_raw", "_known")


def cacheable(answers: DataFrame, kind: str, model: str) -> DataFrame:
    """Rows to append to the cache: well-formed answers only."""
    return answers.filter("error is null").select("prompt_hash", F.lit(kind).alias("kind"), F.lit(model).alias("model"), F.to_json("answer").alias("answer")).distinct()


def candidate_questions(assessed: DataFrame) -> DataFrame:
    """One question per candidate left to adjudicate (rows with structs e and r)."""
    e, r = F.col("e"), F.col("r")
    p = prompt(
        "can_correspond", cited_title=e["title"], cited_authors=F.array_join(e["authors"], "; "), cited_year=e["year"], cited_venue=e["venue"],
        title=r["title"], authors=F.array_join(r["authors"], "; "), year=r["year"], venue=r["venue"],
    )
    return assessed.select("entry_id", "ord", p.alias("prompt"))


def relation_questions(ambiguous: DataFrame) -> DataFrame:
    """One question per ambiguous pair of accepted records: rows (entry_id, a, b, ra, rb) with record structs."""
    parts = {f"{k}_{s}": F.array_join(F.col(f"r{s}")[k], "; ") if k == "authors" else F.col(f"r{s}")[k] for s in ("a", "b") for k in ("title", "authors", "year", "venue", "pages")}
    return ambiguous.select("entry_id", "a", "b", prompt("same_work", **parts).alias("prompt"))


def page_questions(pages: DataFrame) -> DataFrame:
    """One question per cited page whose title does not settle it: rows (entry_id, title, authors, page_title, page_text)."""
    asked = prompt("web_match", cited_title=F.col("title"), cited_authors=F.array_join("authors", "; "), page_title=F.col("page_title"), page_text=F.col("page_text"))
    return pages.select("entry_id", asked.alias("prompt"))


def rulings(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Yes/no answers as (keys, answer boolean, confidence, error)."""
    return answers.select(*keys, (F.col("answer")["answer"] == "yes").alias("answer"), F.col("answer")["confidence"].alias("confidence"), "error")


def confirmed_pairs(answers: DataFrame) -> DataFrame:
    """``(entry, a, b)`` of the pairs ruled the same work or a version of it with confidence."""
    a = F.col("answer")
    return answers.filter(a["relation"].isin("same", "version") & a["confidence"].isin("high", "medium")).select(F.col("entry_id").alias("entry"), "a", "b")


def judgments(answers: DataFrame) -> DataFrame:
    """``(entry_id, field, kind, confidence)`` of the well-formed answers to field questions."""
    return answers.filter("answer is not null").select("entry_id", "field", F.col("answer")["kind"].alias("kind"), F.col("answer")["confidence"].alias("confidence"))


def statuses(answers: DataFrame) -> DataFrame:
    """``(entry_id, ordinal, status, error)`` of the answers to alignment questions."""
    return answers.select("entry_id", "ordinal", F.col("answer")["status"].alias("status"), "error")


def field_questions(findings: DataFrame) -> DataFrame:
    asked = findings.filter("status = 'needs_llm'")
    return asked.select("entry_id", "field", prompt("field_check", field=F.col("field"), cited=F.col("bib_value"), canonical=F.col("canonical_value")).alias("prompt"))


def alignment_questions(contexts: DataFrame) -> DataFrame:
    """Questions for citing sentences with an abstract: rows (entry_id, ordinal, text, abstract)."""
    rows = contexts.filter(F.trim(F.coalesce("abstract", F.lit(""))) != "")
    return rows.select("entry_id", "ordinal", prompt("citation_alignment", sentence=F.col("text"), abstract=F.col("abstract")).alias("prompt"))
