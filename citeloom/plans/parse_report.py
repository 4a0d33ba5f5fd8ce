"""The parse-only report: a bibliography and a manuscript from files, no look-ups."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import entries
from citeloom.runtime import ship
from citeloom.sources import bibtex, latex


def parse_report(spark: SparkSession, bib: str, tex: str | None = None) -> dict[str, DataFrame]:
    """Tables ``entries``, ``twins``, ``issues``, ``dangling``, ``uncited``, ``contexts``, ``missing`` and
    ``summary`` of a .bib file (or folder) and a root .tex file.  Files of one document are small, so their
    include closure is made on the driver; an empty bibliography is an error."""
    ship(spark)
    raw = bibtex.read(spark, bib).withColumn("entry_id", F.sha2(F.concat_ws("|", "bib_file", "key"), 256)).cache()
    if raw.filter("not is_commented").isEmpty():
        raise ValueError("the bibliography has no entries")
    body, missing = "", []
    if tex:
        folder = Path(tex).parent
        body, missing = latex.closure(Path(tex).name, {str(p.relative_to(folder)): p.read_text(encoding="utf-8", errors="replace") for p in folder.rglob("*.tex")})
    doc = spark.createDataFrame([(tex or "", body)], "tex_file string, text string")
    keys = latex.cited_keys(doc).select("key")
    star = tex is None or not keys.filter("key = '*'").isEmpty()
    keys = keys.filter("key <> '*'")
    live, twins = raw.filter("not is_commented"), raw.filter("is_commented")
    marked = entries.mark_cited(live, keys, ["key"], star).withColumn("cited", F.col("is_cited")).drop("is_cited")
    issues = entries.issues(marked)
    gone = entries.dangling(keys, live, ["key"])
    return {
        "entries": marked, "twins": twins, "issues": issues, "dangling": gone.orderBy("key"), "uncited": entries.uncited(live, keys, ["key"], star).select("key").orderBy("key"),
        "contexts": latex.contexts(doc), "missing": spark.createDataFrame([(m,) for m in missing], "name string"), "summary": entries.summary(marked.unionByName(twins.withColumn("cited", F.lit(False))), issues, gone),
    }


def text_report(report: dict[str, DataFrame]) -> str:
    """A short text for one document."""
    s = report["summary"].first()
    lines = [f"{s.entries} entries: {s.cited} cited, {s.uncited} uncited; {s.with_issues} with issues; {s.dangling} keys without an entry"]
    lines += [f"  {r.key}: {r.issue}" for r in report["issues"].join(report["entries"].select("entry_id", "key"), "entry_id").orderBy("key", "pos").collect()]
    lines += [f"  no entry for {r.key}" for r in report["dangling"].collect()] + [f"  not cited: {r.key}" for r in report["uncited"].collect()]
    lines += [f"  missing include: {r.name}" for r in report["missing"].collect()]
    return "\n".join(lines)
