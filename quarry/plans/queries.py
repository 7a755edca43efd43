"""Queries that apply the engine's operators to the test tables, each over whole tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import junk, text
from quarry.operators import align, concepts, dedup, encoding, generation, lookup, ontology, profile, semfilter
from quarry.operators.memo import Memo
from quarry.plans import pipelines
from quarry.scale import shared_dir
from quarry.sources import readers, sinks

NEWLINES = " \r\n\r\n \r\n"
GAZETTEER = {"that": ("drug", 0.9), "with": ("disease", 0.05), "avec": ("symptom", 0.4), "und": ("biomarker", 0.2)}
NEAR = 0.3
SYSTEM, MODEL, OPTIONS = "Answer as JSON.", "stand-in", {"temperature": 0, "num_predict": 400}
#: Letters and how they look when their UTF-8 bytes are read as one-byte characters.
MOJIBAKE = {c: c.encode().decode("cp1252") for c in "éèêçñóüöäß"}
SHAPES = ["", " ", "___", "a___b", "12", "١٢", "é_!", "phq-9", "abc-12.", "ab-cd-3", " The ", "12.5", "a-5", "don't", "x\n", "12\n"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(spark, sf_dir):
    noisy = F.replace(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(NEWLINES))
    noisy = F.replace(noisy, F.lit("ation"), F.lit("a-\ntion"))
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(noisy, repair=False).alias("text"))


def clean_soft_hyphens(spark, sf_dir):
    """Texts with soft hyphens in their words, cleaned with all steps."""
    noisy = F.replace(F.replace("text", F.lit("a"), F.lit("a\u00ad")), F.lit(" "), F.lit(" \t"))
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(noisy).alias("text"))


def nfc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.compose(F.replace("text", F.lit("é"), F.lit("é"))).alias("text"))


def mojibake(spark, sf_dir):
    noisy = F.col("text")
    for good, bad in MOJIBAKE.items():
        noisy = F.replace(noisy, F.lit(good), F.lit(bad))
    return table(spark, sf_dir, "documents").select("doc_id", text.repair_mojibake(noisy).alias("text"))


def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", semfilter.count_words(F.col("text")).alias("n_words"), semfilter.count_words(F.col("text"), True).alias("n_content_words")
    )


def _scored(spark, sf_dir, config=semfilter.FilterConfig()):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return semfilter.scored(semfilter.tag_entities(docs, lambda: semfilter.GazetteerTagger(GAZETTEER)), config)


def semantic_filter(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.round("score", 9).alias("score"), F.round("density", 9).alias("density"), "keep")


def density_by_source(spark, sf_dir, config=semfilter.FilterConfig()):
    """Kept texts, and their mean density, by source and language."""
    kept = _scored(spark, sf_dir, config).filter("keep")
    return kept.groupBy("source", "lang").agg(F.count("*").alias("n_texts"), F.round(F.avg("density"), 6).alias("mean_density"))


def limit_then_filter(spark, sf_dir):
    """The long texts among the first rows of a stored corpus: rows are taken first, filtered then."""
    taken = readers.read_corpus(spark, f"{sf_dir}/documents.parquet", "text", order_by="doc_id", most=500)
    return taken.filter(semfilter.count_words(F.col("text")) > 100)


def _terms(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term"))
    return own.union(spark.createDataFrame([(s,) for s in SHAPES], "term string")).distinct()


def junk_flags(spark, sf_dir):
    return junk.junk_columns(_terms(spark, sf_dir), "term", blacklist=["of", "und"])


def truncate_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", concepts.evidence_words(F.col("text")).alias("evidence"), generation.fit_budget(F.col("text"), "one two", "three {txt}", 211).alias("fitted")
    )


def _answers(spark, sf_dir):
    """Model-like answers of eight kinds made of documents: plain, fenced, in prose, a list, broken, odd id, odd category, with a relation."""
    kind = (F.col("doc_id") % 8).alias("kind")
    words = text.tokens(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", kind, words.alias("w"))
    concept = F.concat_ws(", ", F.get("w", F.lit(0)), F.concat_ws("_", F.get("w", F.lit(1)), F.get("w", F.lit(2))), F.lit("12"))
    fields = F.struct(
        F.when(F.col("kind") != 5, F.concat(F.lit(" id"), F.col("doc_id").cast("string"))).otherwise("").alias("item_id"), concept.alias("concept_proposed"),
        F.when(F.col("kind") == 6, "observable entity").otherwise("Finding ").alias("category"), F.array_join(F.slice("w", 1, 30), " ").alias("evidence"),
        F.when(F.col("kind") == 7, F.struct(F.lit("is_a").alias("predicate"), F.get("w", F.lit(0)).alias("target_concept"))).alias("relation"),
        F.array(F.lit("Low_mood"), F.lit("the"), F.lit("low mood"), F.get("w", F.lit(3))).alias("synonyms"),
    )
    body = F.to_json(fields)
    raw = (
        F.when(F.col("kind") == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("kind") == 2, F.concat(F.lit("Here: "), body, F.lit(" done")))
        .when(F.col("kind") == 3, F.concat(F.lit("["), body, F.lit("]"))).when(F.col("kind") == 4, F.concat(body, F.lit("}"))).otherwise(body)
    )
    return docs.select("doc_id", raw.alias("raw"))


def concept_parse(spark, sf_dir):
    rows = concepts.parse_concepts(_answers(spark, sf_dir))
    return rows.select("doc_id", "place", "item_id", "concept", "category", F.coalesce("predicate", F.lit("")).alias("predicate"), F.coalesce("target", F.lit("")).alias("target"), "evidence", F.array_join("synonyms", "; ").alias("synonyms"))


def concept_csv(spark, sf_dir):
    return sinks.concept_csv_rows(concepts.parse_concepts(_answers(spark, sf_dir)))


def answers_without_concept(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sinks.missing_items(docs, concepts.parse_concepts(_answers(spark, sf_dir)), "doc_id")


def rejected_answers(spark, sf_dir):
    """How many answers there are and how many have no valid concept, observed while the concepts are written."""
    found, counts = concepts.counted_concepts(_answers(spark, sf_dir))
    found.write.parquet(_own_folder(spark))
    return concepts.counts_table(spark, counts, "documents")


def _prompts(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoding.encode_prompts(docs, encoding.file_tokenizer(str(public_tokenizers.path("byte_bpe_50k.json"))), SYSTEM, "Read: {txt}.", 700)


def token_budget(spark, sf_dir):
    """Texts cut by a tokenizer so that their prompts have 700 tokens at most."""
    return _prompts(spark, sf_dir).select("doc_id", "n_tokens", F.sha2("fitted", 256).alias("fitted_sha256"), F.size("input_ids").alias("n_ids"))


def padded_batches(spark, sf_dir):
    """Ids and padding of the prompts in batches of four rows of like lengths."""
    return encoding.padding_share(encoding.pad_batches(_prompts(spark, sf_dir).select("doc_id", "input_ids"))).select("n_rows", (F.col("n_padding") * 10 < F.col("n_ids")).alias("little_padding"))


class PlannedClient:
    """A terminology that answers by the length of a query, with failures of every kind."""

    def __call__(self, query: str, limit: float):
        kind = len(query) % 8
        if kind in (0, 1):
            raise lookup.LookupFailure((429, 404)[kind])
        if kind in (2, 3):
            raise (TimeoutError, ValueError)[kind - 2]
        return {"collection": [{"@id": f"http://example.org/{x}"} for x in {4: [], 5: ["abc", ""]}.get(kind, ["abc", "123"])]}


def lookup_statuses(spark, sf_dir):
    """Part names looked up by a client with planned failures, each different name once."""
    memo = Memo(spark, _own_folder(spark), "planned")
    own = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lookup.lookup(own, "p_name", PlannedClient, memo, lookup.LookupConfig(first_wait=0.0)).select("p_partkey", "found", "lookup_status")


def memo_answers(spark, sf_dir):
    """Answers to items from a store that a first run filled for a part of them; the second asks for the rest only."""
    memo = Memo(spark, _own_folder(spark), "v1")
    keys = _items(spark, sf_dir).select(F.col("item_id").alias("key"), "question")
    marked = lambda by: lambda rows: rows.select("key", F.concat(F.lit(by), F.length("question").cast("string")).alias("answer"))
    memo.answers(keys.filter(F.length("question") % 2 == 0), marked("first "))
    return memo.answers(keys, marked("second ")).select("key", "answer")


def exact_dedup_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return dedup.exact_first(docs, ["text", "lang"], ["doc_id"]).select("doc_id")


def greedy_near_dup(spark, sf_dir):
    return dedup.greedy_keep(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", NEAR).select("vec_id", "label")


def greedy_near_dup_native(spark, sf_dir):
    return dedup.greedy_keep_native(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", NEAR).select("vec_id", "label")


def _terminology(spark, sf_dir):
    """The vectors as a terminology: a binary tree in each label by vec_id."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    own = table(spark, sf_dir, "embeddings").withColumn("rn", rn)
    parent = own.select("label", F.col("rn").alias("up"), F.col("vec_id").alias("parent_code"))
    tree = own.withColumn("up", F.floor(F.col("rn") / 2)).join(parent, ["label", "up"], "left")
    return tree.select(F.col("vec_id").alias("code"), F.col("vec_id").cast("string").alias("display"), "parent_code", F.col("vec_id").alias("pos"), "embedding")


def nearest_root(spark, sf_dir):
    roots = _terminology(spark, sf_dir).filter("parent_code IS NULL")
    return align.nearest(table(spark, sf_dir, "embeddings"), roots).select("vec_id", "code", F.round("score", 6).alias("score"))


def hierarchical_descent(spark, sf_dir):
    found = align.descend(table(spark, sf_dir, "embeddings"), _terminology(spark, sf_dir), "vec_id", threshold=0.3)
    return found.select("vec_id", "code", F.round("score", 6).alias("score"), "steps", "accepted")


def hierarchy_children(spark, sf_dir):
    return align.children(_terminology(spark, sf_dir), limit=1).select("parent_code", "code")


def hierarchy_descendants(spark, sf_dir):
    return align.descendants(_terminology(spark, sf_dir), limit=None).select("ancestor", "code", "depth")


def nearest_descendants(spark, sf_dir):
    """The first five concepts below each one, nearest first."""
    return align.descendants(_terminology(spark, sf_dir), limit=5).select("ancestor", "code", "depth")


def nearest_in_balls(spark, sf_dir):
    """For each vector, turned by one place, the nearest one of all, searched by balls."""
    own = table(spark, sf_dir, "embeddings")
    turned = own.select("vec_id", F.transform(F.slice(F.concat("embedding", "embedding"), 2, 64), lambda x: x.cast("double")).alias("embedding"))
    candidates = own.select(F.col("vec_id").alias("code"), (F.col("vec_id") % 10).alias("pos"), "embedding")
    return align.nearest_in_balls(turned, candidates).select("vec_id", "code", F.round("score", 6).alias("score"))


def greedy_near_dup_cells(spark, sf_dir):
    """The scan of all vectors as one group, by cells where they are too many for a task."""
    own = table(spark, sf_dir, "embeddings").withColumn("all", F.lit("all"))
    return dedup.greedy_keep(own, "all", "vec_id", "embedding", NEAR, group_rows=100).select("vec_id")


def _verified(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    jobs = part.select("p_partkey", "p_size", F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("concept"))
    return align.lexical_match(jobs, part.filter("p_size <= 10").select(F.col("p_name").alias("term")))


def lexical_match(spark, sf_dir):
    return _verified(spark, sf_dir).select("p_partkey", "found")


def _labelled(spark, sf_dir):
    """Lexical lookup of parts; what it misses descends the hierarchy by the vector of its number."""
    found = _verified(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = vectors.agg(F.max("vec_id")).first()[0] + 1
    misses = found.filter("found = 0").withColumn("vec_id", F.col("p_partkey") % size).join(vectors, "vec_id")
    return align.tri_state(found, align.semantic_matches(misses, _terminology(spark, sf_dir), "p_partkey", threshold=0.3), "p_partkey")


def verify_tristate(spark, sf_dir):
    return _labelled(spark, sf_dir).select("p_partkey", "found", "semantic")


def verify_summary(spark, sf_dir):
    return align.summary(_labelled(spark, sf_dir))


def _profile(name, order):
    def query(spark, sf_dir):
        out = profile.profile(table(spark, sf_dir, name), order)
        return out.select("pos", "name", "type", "example", "n_distinct", F.array_join("values", "|").alias("values"), "range")

    query.__name__ = f"profile_{name}"
    return query


PROFILES = {"customer": ["c_custkey"], "part": ["p_partkey"], "lineitem": ["l_orderkey", "l_linenumber"], "nation": ["n_nationkey"], "events": ["event_id"]}


def dataset_ids(spark, sf_dir):
    rows = [(n, profile.dataset_id(table(spark, sf_dir, n).columns)) for n in PROFILES]
    return spark.createDataFrame(rows, "name string, dataset_id string")


def _items(spark, sf_dir):
    """Conversations as questionnaires: a block each, with its turns as items."""
    item = F.struct(F.concat_ws("-", "conv_id", "turn").alias("item_id"), F.col("text").alias("question"))
    own = table(spark, sf_dir, "conversations").select(F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("q"), "turn", item.alias("item"))
    block = F.struct(F.lit("open").alias("response_type"), F.lit("0-3").alias("scale"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "item"))), lambda x: x["item"]).alias("items"))
    blocks = own.groupBy("q").agg(block.alias("b")).select(F.create_map("q", "b").alias("blocks"))
    return readers.flatten_questionnaires(blocks)


def questionnaire_flatten(spark, sf_dir):
    return _items(spark, sf_dir).select("questionnaire", "item_id", "question", "response_type", "scale")


def item_prompts(spark, sf_dir):
    return _items(spark, sf_dir).select("item_id", generation.item_prompt().alias("prompt"), generation.signature(SYSTEM, MODEL, OPTIONS).alias("signature"))


def chat_prompts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", generation.chat_prompt(F.col("text"), "sys", "Read: {txt}.").alias("prompt"))


def verification_jobs(spark, sf_dir):
    row = F.struct(F.col("item_id").cast("string").alias("item_id"), F.concat(F.lit(" "), F.get(text.tokens(F.col("text")), F.lit(0)), F.lit(" ")).alias("concept_proposed"))
    bench = table(spark, sf_dir, "benchmark")
    as_map = bench.select(F.to_json(F.create_map(F.concat(F.lit("set"), F.col("item_id").cast("string")), F.array(row, F.struct(F.lit("x").alias("item_id"), F.lit("  ").alias("concept_proposed"))))).alias("value"))
    return readers.verification_jobs(as_map.union(bench.select(F.to_json(F.array(row)).alias("value"))))


def _cached(spark, sf_dir):
    items = _items(spark, sf_dir).withColumns({"user_prompt": generation.item_prompt(), "signature": generation.signature(SYSTEM, MODEL, OPTIONS)})
    old = items.filter(F.length("question") % 3 != 0)
    changed = F.when(F.length("question") % 3 == 1, F.concat("user_prompt", F.lit("!"))).otherwise(F.col("user_prompt"))
    return items, old.select("signature", "item_id", changed.alias("user_prompt"), F.concat(F.lit("r"), F.col("item_id")).alias("raw"))


def cache_hits(spark, sf_dir):
    return generation.cache_hits(*_cached(spark, sf_dir)).select("item_id", F.coalesce("raw", F.lit("")).alias("raw"), "hit")


def cache_misses(spark, sf_dir):
    return generation.cache_misses(*_cached(spark, sf_dir)).select("item_id")


def _alignments(spark, sf_dir):
    """Parts as alignment rows."""
    p = table(spark, sf_dir, "part")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("p_size") % len(xs) + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("seq"), F.col("p_brand").alias("variable"), F.concat("p_name", F.lit(' "x" \\ '), F.lit("\n")).alias("normalized_concept"), F.col("p_type").alias("semantic_category"),
        pick("is a", "", None).alias("relation"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("evidence"), pick("label", "", None, "").alias("preferred_label"),
        pick("http://example.org/1", "").alias("identifier_uri"), pick("Exact", "Broader", "Narrower", "No Match", None).alias("match"), pick("Correct", "Incorrect", None, "Correct", "Odd").alias("validation_status"),
    )


def triples(spark, sf_dir):
    return ontology.triples(_alignments(spark, sf_dir)).select("seq", "place", "s", "p", "o")


def turtle_blocks(spark, sf_dir):
    return ontology.turtle_blocks(ontology.triples(_alignments(spark, sf_dir)))


def status_histogram(spark, sf_dir):
    return ontology.status_histogram(_alignments(spark, sf_dir))


def enrich(spark, sf_dir):
    rows = spark.createDataFrame([("Age", "age"), ("BMI", "body mass index"), ("Unknown", "x")], "variable string, normalized_concept string")
    return ontology.enrich(rows, readers.declared_variables(spark))


def variables_prompt(spark, sf_dir):
    return generation.variables_prompt(readers.declared_variables(spark))


def _variables(spark, sf_dir):
    """The columns of a table as variables, described by what a profile finds in them."""
    found = profile.profile(table(spark, sf_dir, "customer"), PROFILES["customer"])
    described = F.coalesce("range", F.array_join("values", ", "), F.lit("any"))
    return found.select(F.col("pos").alias("seq"), "name", "type", "example", described.alias("description"))


def table_prompt(spark, sf_dir):
    """The prompt for a table's columns."""
    return generation.variables_prompt(_variables(spark, sf_dir))


class VariableAnswers:
    """A stand-in for a model that is asked for variables: each by its own name in lower case, in a fenced list."""

    def __call__(self, prompts):
        import json
        import re

        out = []
        for prompt in prompts:
            rows = [{"variable": v, "normalized_concept": v.lower(), "semantic_category": "Finding", "relation": "is a"} for v in re.findall(r"(?m)^- (\S+) \| type: ", prompt)]
            out.append(f"```json\n{json.dumps(rows)}\n```")
        return out


def tabular_track(spark, sf_dir):
    """Alignment rows for a table's columns: profile, prompt, answer, evidence."""
    rows = pipelines.tabular_track(_variables(spark, sf_dir), VariableAnswers)
    return rows.select("variable", "normalized_concept", "semantic_category", "relation", "evidence", "validation_status")


def verification_track(spark, sf_dir):
    """Part names looked up among those of small parts; what isn't found descends the vectors' hierarchy by its own embedding."""
    part = table(spark, sf_dir, "part")
    jobs = part.select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("concept"))
    rows = pipelines.verification_track(jobs, part.filter("p_size <= 10").select(F.col("p_name").alias("term")), _terminology(spark, sf_dir), "p_partkey", threshold=0.3)
    return rows.select("p_partkey", "found", "semantic")


def terminology_roots(spark, sf_dir):
    return readers.terminology_roots(spark).select("code", "display", "pos")


def _own_folder(spark) -> str:
    import uuid

    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


def verification_csv(spark, sf_dir):
    """The verification table of all parts, written as CSV with a byte-order mark and read back."""
    folder = _own_folder(spark)
    jobs = _labelled(spark, sf_dir).select(F.lit("part").alias("dataset"), F.col("p_partkey").cast("string").alias("item_id"), "concept", "found", "semantic")
    sinks.write_csv(sinks.verification_csv_rows(jobs), folder)
    back = spark.read.csv(folder, header=True, escape='"')
    names = ["dataset", "item_id", "concept", "found", "semantic"]
    return back.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(back.columns, names)))


def group_result(spark, sf_dir):
    """Concepts by document, written as nested JSON and read back."""
    folder = _own_folder(spark)
    sinks.write_by_source(concepts.parse_concepts(_answers(spark, sf_dir)), folder, "doc_id", "place")
    back = spark.read.schema(f"source long, concepts array<{readers.CONCEPT}>").json(folder)
    return back.select("source", F.array_join("concepts.concept_proposed", "|").alias("members"), F.array_join("concepts.item_id", "|").alias("items"))


def text_files(spark, sf_dir):
    """Benchmark texts as files of their own, read back whole."""
    folder = _own_folder(spark)
    named = F.concat(F.lit("item-"), F.col("item_id").cast("string"), F.lit(".txt"))
    sinks.write_texts(table(spark, sf_dir, "benchmark").select(named.alias("name"), "text"), folder)
    return readers.read_texts(spark, f"{folder}/*.txt").select(F.substring_index("source", "/", -1).alias("source"), "text")


def csv_file(spark, sf_dir):
    """A table as CSV with a byte-order mark, read back with separator and encoding found from the file."""
    folder = _own_folder(spark)
    sinks.write_csv(table(spark, sf_dir, "nation").coalesce(1), folder)
    part = spark.read.text(folder).select(F.col("_metadata.file_path")).first()[0]
    return readers.read_csv(spark, part).select("n_nationkey", "n_name", "n_regionkey")


def turtle_file(spark, sf_dir):
    """The lines of the Turtle file of all triples."""
    folder = _own_folder(spark)
    sinks.write_turtle(ontology.triples(_alignments(spark, sf_dir)), folder)
    return spark.read.text(folder).filter("value <> ''").select(F.col("value").alias("line"))


def results_file(spark, sf_dir):
    """Alignment rows with their prompt, written as results and read back."""
    rows = _alignments(spark, sf_dir).select("seq", "variable", "relation", "match")
    path = sinks.write_results(rows, "p1", _own_folder(spark), prompt="the prompt")
    return spark.read.schema("prompt string, seq long, variable string, relation string, match string").json(path)


def profile_file(spark, sf_dir):
    """The profile document of a table, read back."""
    nation = table(spark, sf_dir, "nation")
    path = sinks.write_profile(profile.profile(nation, ["n_nationkey"]), "nation.parquet", profile.dataset_id(nation.columns), _own_folder(spark))
    back = readers.read_json(spark, path, "dataset string, dataset_id string, variables array<struct<name:string,type:string,n_distinct:bigint>>")
    return back.select("dataset", "dataset_id", F.explode("variables").alias("v")).select("dataset", "dataset_id", "v.name", "v.type", "v.n_distinct")


def triple_counts(spark, sf_dir):
    return ontology.triple_counts(ontology.triples(_alignments(spark, sf_dir)))


def subjects_and_objects(spark, sf_dir):
    """The distinct terms that occur as subject or object of a relation."""
    o = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return ontology.related_terms(o, "n_name", "r_name")


def concept_terms(spark, sf_dir):
    """The different terms of the concepts' relations."""
    return ontology.related_terms(concepts.parse_concepts(_answers(spark, sf_dir)))


def projection(spark, sf_dir):
    """Two coordinates of each vector by principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="c").fit(own)
    xy = model.transform(own).select("vec_id", vector_to_array("c").alias("c"))
    # A component's sign is free; its greatest part counts as positive.
    parts = model.pc.toArray().T
    x, y = (F.col("c")[i] * F.lit(float(1 if max(p, key=abs) > 0 else -1)) for i, p in enumerate(parts))
    return xy.select("vec_id", x.alias("x"), y.alias("y"))


def embedded_terms(spark, sf_dir):
    """The length of each part name's vector, and its product with (1, 2, 3, ...)."""
    own = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    v = F.col("embedding")
    moment = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return dedup.embed(own, dedup.HashedEmbedder, "p_name").select("p_partkey", F.size(v).alias("size"), F.round(dedup.dot(v, v), 6).alias("norm"), (F.round(moment, 6) + 0.0).alias("moment"))


def _token_vectors(spark, sf_dir):
    """Part names as token vectors (length, first character, place), of which every third doesn't count."""
    words = F.split("p_name", " ")
    vector = lambda w, i: F.array(F.length(w).cast("double"), F.ascii(w).cast("double"), (i + 1).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.transform(words, vector).alias("vectors"), F.transform(words, lambda w, i: (i % 3 != 0).cast("int")).alias("mask"))


def pooled_tokens(spark, sf_dir):
    """Unit vectors of part names by both kinds of pooling."""
    own = _token_vectors(spark, sf_dir)
    both = dedup.pooled(own.select("*", F.lit("mean").alias("pooling"))).unionByName(dedup.pooled(own.select("*", F.lit("first").alias("pooling")), pooling="first"))
    return both.select("p_partkey", "pooling", *(F.round(F.get("embedding", F.lit(i)), 6).alias(n) for i, n in enumerate("xyz")))


def input_report(spark, sf_dir):
    """Which of the tables that are asked for are there, and the rows of those."""
    names = [*PROFILES, "documents", "lost", "benchmark"]
    report = readers.input_report(spark, [f"{sf_dir}/{n}.parquet" for n in names])
    rows = [table(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count("*").alias("n_rows")) for n in names if n != "lost"]
    named = report.select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("name"), "found")
    return named.join(functools.reduce(DataFrame.union, rows), "name", "left")


def corpus_stream(spark, sf_dir):
    """Dirty texts in a folder that grows, read as a stream in two runs; each row comes once."""
    from quarry.sources.corpus_source import corpus_stream as stream_of
    from quarry.streaming.text_stream import cleaned_stream, run_once

    folder = _own_folder(spark)
    dirty = F.replace(F.replace("text", F.lit("a"), F.lit("a\u00ad")), F.lit(" "), F.lit(" \t"))
    docs = table(spark, sf_dir, "documents").select("doc_id", dirty.alias("text"), "lang")
    for even in (0, 1):
        docs.filter(F.pmod("doc_id", F.lit(2)) == even).write.mode("append").parquet(f"{folder}/in")
        out = run_once(spark, cleaned_stream(stream_of(spark, f"{folder}/in", "doc_id long, text string")), f"{folder}/out", f"{folder}/state")
    return out.select("doc_id", "text", "n_words")


def text_track(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("doc"), "text")
    found = pipelines.text_track(docs, lambda: semfilter.GazetteerTagger(GAZETTEER), pipelines.KeywordGenerator)
    return found.select("source", "doc", "place", "concept", "category", "evidence")


def questionnaire_track(spark, sf_dir):
    items, cache = _cached(spark, sf_dir)
    out = pipelines.questionnaire_track(items.drop("user_prompt", "signature"), SYSTEM, MODEL, OPTIONS, pipelines.KeywordGenerator, cache)
    return out.concepts.select("item_id", "concept", "category")


def text_stream(spark, sf_dir):
    from quarry.streaming.text_stream import cleaned_stream, run_once
    import uuid

    schema = table(spark, sf_dir, "documents").schema
    # A file source takes folders; the pattern picks the one table.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents*.parquet")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return run_once(spark, cleaned_stream(stream).select("doc_id", "text", "n_words"), f"{folder}/out", f"{folder}/state")


ALL = [
    clean_text, clean_soft_hyphens, concept_terms, pooled_tokens, input_report, corpus_stream, nfc, mojibake, word_counts, semantic_filter, density_by_source, limit_then_filter, junk_flags, truncate_words, concept_parse, concept_csv, answers_without_concept,
    exact_dedup_first, greedy_near_dup, greedy_near_dup_cells, greedy_near_dup_native, nearest_in_balls, nearest_descendants, rejected_answers, token_budget, padded_batches, lookup_statuses, memo_answers, verification_csv, nearest_root, hierarchical_descent, hierarchy_children, hierarchy_descendants, lexical_match, verify_tristate,
    verify_summary, dataset_ids, questionnaire_flatten, item_prompts, chat_prompts, verification_jobs, cache_hits, cache_misses, triples, turtle_blocks, status_histogram, enrich,
    variables_prompt, table_prompt, tabular_track, verification_track, terminology_roots, group_result, text_files, csv_file, turtle_file, results_file, profile_file, triple_counts, subjects_and_objects, projection, embedded_terms, text_track, questionnaire_track, text_stream,
]


def queries() -> dict:
    return {f.__name__: f for f in [*ALL, *(_profile(n, o) for n, o in PROFILES.items())]}
