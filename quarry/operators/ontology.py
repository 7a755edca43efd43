"""Alignment rows to RDF triples and Turtle text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.fixed import MANUAL_FIELDS, MATCH_PREDICATES, TURTLE_HEADER, VALIDATION_STATUSES, VARIABLE_EVIDENCE


def slug(text: Column) -> Column:
    """ASCII letters and digits only."""
    return F.regexp_replace(text, "[^A-Za-z0-9]", "")


def escaped(text: Column) -> Column:
    """``text`` inside a Turtle literal."""
    text = F.coalesce(text, F.lit(""))
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def enrich(rows: DataFrame, variables: DataFrame) -> DataFrame:
    """``rows`` (variable, ...) with evidence from the variables' table and the fields that people fill in.

    A variable that isn't declared shows question marks. A manual field that
    ``rows`` has already stays as it is, nulls included.
    """
    facts = variables.groupBy(F.col("name").alias("variable")).agg(*(F.max_by(c, "seq").alias(f"_{c}") if "seq" in variables.columns else F.max(c).alias(f"_{c}") for c in ("type", "example", "description")))
    joined = rows.drop("evidence").join(facts, "variable", "left")
    pieces, rest = [], VARIABLE_EVIDENCE
    for name in ("type", "example", "description"):
        head, rest = rest.split("{%s}" % name)
        pieces += [F.lit(head), F.coalesce(f"_{name}", F.lit("?"))]
    joined = joined.withColumn("evidence", F.concat(*pieces, F.lit(rest))).drop("_type", "_example", "_description")
    return joined.withColumns({k: F.lit(v) for k, v in MANUAL_FIELDS.items() if k not in rows.columns})


def related_terms(rows: DataFrame, subject: str = "concept", object: str = "target") -> DataFrame:
    """(term): the different terms that are subject or object of a relation; rows without an object relate nothing."""
    both = rows.filter(F.col(object).isNotNull() & (F.col(object) != "")).select(F.explode(F.array(subject, object)).alias("term"))
    return both.filter("term <> ''").distinct()


def status_histogram(rows: DataFrame) -> DataFrame:
    """(status, n): the known statuses, zero included, and any others that occur; null counts as Uncertain."""
    known = rows.sparkSession.createDataFrame([(s, 0) for s in VALIDATION_STATUSES], "status string, one int")
    own = rows.select(F.coalesce("validation_status", F.lit("Uncertain")).alias("status"), F.lit(1).alias("one"))
    return own.union(known).groupBy("status").agg(F.sum("one").cast("long").alias("n"))


def triples(rows: DataFrame, order: str = "seq") -> DataFrame:
    """(seq, place, block, s, p, o) of the rows validated as Correct: the true triples, in the order they are written.

    ``order`` names the rows' order. ``block`` numbers the blocks of Turtle text of a row.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    proj = lambda c: F.concat(F.lit("proj:"), slug(F.col(c)))
    text = lambda c: F.concat(F.lit('"'), escaped(F.col(c)), F.lit('"'))
    subject, uri = proj("normalized_concept"), F.concat(F.lit("<"), F.col("identifier_uri"), F.lit(">"))
    mapping = F.create_map(*(F.lit(x) for kv in MATCH_PREDICATES.items() for x in kv))
    mapped = F.element_at(mapping, F.coalesce("match", F.lit("")))
    aligned = mapped.isNotNull() & has("identifier_uri")
    triple = lambda block, s, p, o, when: F.when(when, F.struct(F.lit(block).alias("block"), s.alias("s"), p.alias("p"), o.alias("o")))
    every = F.array(
        triple(0, subject, F.lit("rdfs:subClassOf"), proj("semantic_category"), F.lit(True)),
        triple(0, subject, F.lit("rdfs:label"), text("normalized_concept"), F.lit(True)),
        triple(0, subject, F.lit("rdfs:comment"), text("evidence"), has("relation")),
        triple(0, subject, proj("relation"), proj("variable"), has("relation")),
        triple(1, subject, mapped, uri, aligned),
        triple(2, uri, F.lit("rdfs:label"), text("preferred_label"), aligned & has("preferred_label")),
    )
    own = rows.filter(F.col("validation_status") == "Correct")
    out = own.select(F.col(order).alias("seq"), F.posexplode(F.array_compact(every)).alias("place", "t"))
    return out.select("seq", "place", "t.block", "t.s", "t.p", "t.o")


def turtle_blocks(found: DataFrame) -> DataFrame:
    """(seq, block, text): a subject's triples as one statement."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "s", "p", "o"))), lambda x: x)
    grouped = found.groupBy("seq", "block").agg(parts.alias("t"))
    first = F.col("t")[0]
    rest = F.transform(F.slice("t", 2, 10), lambda x: F.concat(F.lit("    "), x["p"], F.lit(" "), x["o"]))
    lines = F.concat(F.array(F.concat_ws(" ", first["s"], first["p"], first["o"])), rest)
    return grouped.select("seq", "block", F.concat(F.array_join(lines, " ;\n"), F.lit(" .")).alias("text"))


def turtle(found: DataFrame) -> str | None:
    """The Turtle document of a fragment that one person validates; None without triples."""
    rows = turtle_blocks(found).orderBy("seq", "block").toLocalIterator()
    body = "\n\n".join(r.text for r in rows)
    return f"{TURTLE_HEADER}\n{body}\n" if body else None


def triple_counts(found: DataFrame) -> DataFrame:
    """(p, n): the number of triples by predicate."""
    return found.groupBy("p").agg(F.count("*").alias("n"))
