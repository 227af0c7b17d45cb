"""Contexts for answers, and records of answers and their grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovel.functions.scores import ratio
from trovel.functions.text import document_block, fill_template, without_fence

#: Fields of a grading and their JSON types.
JUDGE_FIELDS = {
    "total_claims": "int", "supported_claims": "int", "unsupported_claims": "int", "relevance": "int", "completeness": "int", "correctness": "int", "context_sufficient": "bool", "response_abstained": "bool", "justification": "struct",
}
CLAIMS, GRADES = ("total_claims", "supported_claims", "unsupported_claims"), ("relevance", "completeness", "correctness")


def assemble(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_docs, total_tokens, doc_ids, chunk_ids, documents (array of struct), context: the rows (rank, doc_id, chunk_id,
    chunk_index, num_tokens, score, text) of each key, in order of rank."""
    one = F.struct("rank", "doc_id", "chunk_id", "chunk_index", "num_tokens", "score", document_block(F.col("doc_id"), F.col("text")).alias("block"))
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("d"))
    return out.select(
        *keys, F.size("d").cast("long").alias("n_docs"), F.aggregate("d", F.lit(0).cast("long"), lambda s, x: s + x["num_tokens"]).alias("total_tokens"), F.col("d.doc_id").alias("doc_ids"), F.col("d.chunk_id").alias("chunk_ids"),
        F.transform("d", lambda x: x.dropFields("block")).alias("documents"), F.array_join("d.block", "\n\n").alias("context"),
    )


def prompts(contexts: DataFrame, template: str) -> DataFrame:
    """contexts (question, context) with prompt and the SHA-256 of both."""
    out = contexts.withColumn("prompt", fill_template(template, pergunta=F.col("question"), contexto=F.col("context")))
    return out.withColumns({"prompt_sha256": F.sha2("prompt", 256), "context_sha256": F.sha2("context", 256)})


def cited(answer: Column) -> Column:
    """Distinct document ids that an answer cites."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"DOC_(\d+)")), lambda x: x.cast("long"))))


def outside_citations(rows: DataFrame) -> DataFrame:
    """rows (answer, doc_ids) with the citations that the context lacks."""
    return rows.withColumn("outside", F.array_except(cited(F.col("answer")), F.col("doc_ids")))


def broken_rules(raw: Column) -> Column:
    """Names of the rules that a grading's JSON text breaks: fields and strict types, sums of claims, nulls of an abstention,
    grades from 1 to 5, the justification's texts. An empty array is a sound grading."""
    text = without_fence(raw)
    v = F.try_parse_json(text)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))
    number = lambda path: F.try_variant_get(v, f"$.{path}", "int")
    whole = lambda path: F.coalesce(kind(path) == "BIGINT", F.lit(False))
    void = lambda path: F.coalesce(kind(path) == "VOID", F.lit(False))
    present = lambda path: kind(path).isNotNull()
    rules = [("json", ~F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)))]
    for f, t in JUDGE_FIELDS.items():
        rules.append((f"missing {f}", ~present(f)))
        if t == "bool":
            rules.append((f"type {f}", present(f) & (kind(f) != "BOOLEAN")))
        elif t == "int":
            rules.append((f"type {f}", present(f) & ~whole(f) & ~(void(f) if f in GRADES else F.lit(False))))
    rules += [(f"negative {f}", whole(f) & (number(f) < 0)) for f in CLAIMS]
    rules.append(("sum of claims", whole("total_claims") & whole("supported_claims") & whole("unsupported_claims") & (number("total_claims") != number("supported_claims") + number("unsupported_claims"))))
    abstained = F.try_variant_get(v, "$.response_abstained", "boolean")
    rules.append(("abstention with claims", abstained & (number("total_claims") != 0)))
    for f in GRADES:
        rules.append((f"abstention with {f}", abstained & whole(f)))
        rules.append((f"grade {f}", ~abstained & present(f) & ~(whole(f) & number(f).between(1, 5))))
    rules += [(f"justification {f}", present("justification") & ~F.coalesce(kind(f"justification.{f}") == "STRING", F.lit(False))) for f in GRADES]
    rules.append(("justification claims", present("justification") & ~F.coalesce(F.startswith(kind("justification.unsupported_claims"), F.lit("ARRAY")), F.lit(False))))
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules]), lambda x: x.isNotNull())


def derived(rows: DataFrame) -> DataFrame:
    """Adds faithfulness, unsupported_rate (null without claims) and appropriate_abstention."""
    total = F.col("total_claims")
    return rows.withColumns({
        "faithfulness": ratio(F.col("supported_claims"), total), "unsupported_rate": ratio(F.col("unsupported_claims"), total), "appropriate_abstention": F.col("context_sufficient") != F.col("response_abstained"),
    })


def audit_cases(rows: DataFrame, system: str = "system", key: str = "query_id") -> DataFrame:
    """Cases worth reading: a grade other than 5, unsupported claims or a wrong abstention; if there is none at all, the first
    case of each system."""
    odd = (F.col("unsupported_claims") > 0) | ~F.col("appropriate_abstention")
    for g in GRADES:
        odd = odd | ~F.col(g).eqNullSafe(5)
    rows = rows.withColumn("audit_odd", F.coalesce(odd, F.lit(True)))
    whole = rows.agg(F.coalesce(F.max(F.col("audit_odd").cast("int")), F.lit(0)).alias("audit_any"))
    first = F.row_number().over(Window.partitionBy(system).orderBy(key))
    picked = rows.withColumn("audit_first", first).crossJoin(F.broadcast(whole))
    return picked.where("audit_odd OR (audit_any = 0 AND audit_first = 1)").drop("audit_odd", "audit_any", "audit_first")


def audit_report(rows: DataFrame, system: str = "system", key: str = "query_id") -> DataFrame:
    """One row of Markdown per case, with its place in the report."""
    line = lambda name: F.concat(F.lit(f"- {name}: "), F.coalesce(F.col(name).cast("string"), F.lit("null")))
    text = F.concat_ws("\n", F.concat(F.lit("## Query "), F.col(key).cast("string"), F.lit(" - "), F.col(system)), *[line(g) for g in (*GRADES, *CLAIMS)])
    return rows.select(key, system, text.alias("markdown"))


def grade_changes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Grades of two versions of a rubric, and their differences."""
    left = a.select(*keys, *[F.col(g).alias(f"{g}_a") for g in GRADES])
    right = b.select(*keys, *[F.col(g).alias(f"{g}_b") for g in GRADES])
    return left.join(right, keys).withColumns({f"{g}_delta": F.col(f"{g}_b") - F.col(f"{g}_a") for g in GRADES})
