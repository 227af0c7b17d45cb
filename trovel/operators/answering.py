"""The answering and grading loop over tables: pending work in seeded order, records of calls, gradings, prompts, regression."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovel import providers
from trovel.operators import contexts, tables
from trovel.sources import files


def answer_pending(work: DataFrame, log_path: str, model: providers.StubGenerator, keys: list[str], *, limit: int | None = None, seed: int = 42, tries: int = 4, wait: float = 15.0) -> int:
    """Answers the work (keys, prompt) that the log at log_path has not as ok, in seeded order and only limit rows if asked, and
    appends a record a row; returns how many. Failed rows are asked again by the next run; what was answered never is. A log
    that is not there is empty; limit below 1 is an error."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    spark, kinds = work.sparkSession, dict(work.dtypes)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log_path)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", status string"
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    log = files.read_jsonl(spark, log_path, schema) if there else spark.createDataFrame([], schema)
    todo = tables.next_work(work, log, keys, order=keys, limit=limit, seed=seed)
    made = providers.generate(todo, model, keys, tries, wait).persist()  # one call a row, not one for each use
    n = made.count()
    if n:
        files.append_jsonl(made, log_path)
    made.unpersist()
    return n


def judge_prompt(instructions: str, question: Column, context: Column, answer: Column) -> Column:
    """The text a judge gets: the rubric, then question, context and answer under their headings; null parts are empty."""
    part = lambda name, c: F.concat(F.lit(f"{name}:\n"), F.coalesce(c, F.lit("")))
    return F.concat_ws("\n\n", F.lit(instructions), part("QUESTION", question), part("CONTEXT", context), part("ANSWER", answer))


def judge(rows: DataFrame, model: providers.StubJudge, keys: list[str], *, tries: int = 3, wait: float = 65.0) -> DataFrame:
    """keys, model, status (ok or erro), raw, tries, error, broken for rows (question, context, answer): each graded, waiting the
    same time before each further try; a grading that breaks a rule has status erro and names the rules, so it comes again."""
    kinds = dict(rows.dtypes)

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            found = [providers.with_retries(lambda q=q, c=c, a=a: model.grade(q or "", c or "", a or ""), tries, wait, growth=1.0) for q, c, a in zip(pdf["question"], pdf["context"], pdf["answer"], strict=True)]
            yield pdf[keys].assign(model=model.name, raw=[r for r, _, _ in found], tries=[n for _, n, _ in found], error=[e for _, _, e in found])

    out = rows.select(*keys, "question", "context", "answer").mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", model string, raw string, tries int, error string")
    out = out.withColumn("broken", F.when(F.col("raw").isNotNull(), contexts.broken_rules(F.col("raw"))).otherwise(F.array().cast("array<string>")))
    return out.withColumn("status", F.when(F.col("raw").isNotNull() & (F.size("broken") == 0), "ok").otherwise("erro")).select(*keys, "model", "status", "raw", "tries", "error", "broken")


def rubric_regression(graded: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, grade, expected, found, passed: gradings (raw) of known cases held against the outcome that each must have
    (grade, least, most). A case without grading, or with a broken one, fails."""
    kinds = F.try_parse_json(F.col("raw"))
    rows = expected.join(graded.select(*keys, "raw"), keys, "left")
    value = F.coalesce(*[F.when(F.col("grade") == g, F.try_variant_get(kinds, f"$.{g}", "int")) for g in contexts.GRADES])
    return rows.withColumn("found", value).select(*keys, "grade", F.col("least"), F.col("most"), "found", F.coalesce(F.col("found").between(F.col("least"), F.col("most")), F.lit(False)).alias("passed"))


def chat_prompt(triples: DataFrame, history: list[tuple[str, str]], question: str, *, most: int = 2_000) -> str:
    """The prompt of a conversation over a small graph: its triples as lines, the turns so far, the question. An error beyond
    most triples, which no prompt holds."""
    lines = [r.triple for r in triples.select("triple").distinct().orderBy("triple").limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"over {most} triples")
    return "\n".join(["GRAPH:", *lines, "", *[f"{who}: {said}" for who, said in history], f"user: {question}", "assistant:"])


def extract_triples(docs: DataFrame, model: providers.PatternTriples, *, id_col: str = "doc_id", text_col: str = "text", types: dict[str, str] | None = None) -> DataFrame:
    """doc_id, origem, destino, tipo, origem_tipo, destino_tipo: triples that the model finds in each text; null texts have none.
    With types (name to type), triples of names without one are left out."""
    kind = dict(docs.dtypes)[id_col]

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            rows = [(i, a, b, r) for i, t in zip(pdf["i"], pdf["t"], strict=True) if t is not None for a, r, b in model.extract(t) if types is None or (a in types and b in types)]
            yield pd.DataFrame([(*x, (types or {}).get(x[1]), (types or {}).get(x[2])) for x in rows], columns=["doc_id", "origem", "destino", "tipo", "origem_tipo", "destino_tipo"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"doc_id {kind}, origem string, destino string, tipo string, origem_tipo string, destino_tipo string")


def embedding_limits(model: providers.HashedEmbedder, tokenizer: providers.Tokenizer, texts: list[str]) -> dict[str, int]:
    """Dimensions of a model's vectors, and the most tokens that one of the texts gives it."""
    return {"dimensions": len(model.encode("probe")), "longest": max((len(tokenizer.encode(t)) for t in texts), default=0)}
