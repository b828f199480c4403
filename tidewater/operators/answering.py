"""Answers of a model to questions with their evidence: bounded calls, strict checks, one repair, and nothing unchecked told."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.conversations import checked_answers, rendered_answers

#: Reasons after which a second call may mend an answer.
MENDABLE = ["schema_error", "unknown_citation", "quote_mismatch"]

#: A model's function: question, evidence as (id, text) pairs, and the reason why its last answer failed, to the payload as JSON text.
Complete = Callable[[str, list[tuple[str, str]], str | None], str]


def _called(asked: DataFrame, complete: Complete) -> DataFrame:
    """answer_id and payload of rows (answer_id, question, evidence, reason); a call that fails gives none."""

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                try:
                    out.append(complete(r.question, [(e["id"], e["text"]) for e in r.evidence], r.reason))
                except Exception:  # whatever a provider fails with, the answer is technical_failure and nothing of it is told
                    out.append(None)
            yield pd.DataFrame({"answer_id": pdf["answer_id"], "payload": out})

    return asked.select("answer_id", "question", "evidence", "reason").mapInPandas(step, "answer_id long, payload string")


def answered(questions: DataFrame, hits: DataFrame, complete: Complete, store: Callable[[DataFrame], DataFrame], repair: bool = True) -> DataFrame:
    """answer_id, reason, calls, text of questions (answer_id, question) with their hits (answer_id, rank, id, text, title, page, url).

    A question without hits is no_hits and not asked. An answer that fails a check is asked for once more with the reason, if repair is on. Only
    answers that pass all checks have a text; a call that fails is technical_failure. A call is made once: its payloads go
    through store, which writes them (to the shared folder) and reads them again.
    """
    evidence = hits.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))), lambda h: F.struct(h["id"].alias("id"), h["text"].alias("text"))).alias("evidence"))
    asked = questions.join(evidence, "answer_id").withColumn("reason", F.lit(None).cast("string"))
    sources = hits.select("answer_id", "id", "text")

    def judged(payloads: DataFrame) -> DataFrame:
        reasons = checked_answers(payloads, sources)
        return payloads.join(reasons, "answer_id").withColumn("reason", F.when(F.col("payload").isNull(), "technical_failure").otherwise(F.col("reason")))

    made = judged(store(_called(asked, complete))).withColumn("calls", F.lit(1))
    if repair:
        made = store(made)
        bad = made.filter(F.col("reason").isin(MENDABLE)).select("answer_id", "reason")
        second = judged(store(_called(asked.drop("reason").join(bad, "answer_id"), complete))).withColumn("calls", F.lit(2))
        made = made.join(bad, "answer_id", "left_anti").unionByName(second)
    made = store(made)
    text = rendered_answers(made.filter("reason = 'ok'").select("answer_id", "payload"), hits.select("answer_id", "id", "text", "title", "page", "url"))
    out = questions.select("answer_id").join(made.drop("payload"), "answer_id", "left").join(text.select("answer_id", "text"), "answer_id", "left")
    return out.select("answer_id", F.coalesce("reason", F.lit("no_hits")).alias("reason"), F.coalesce("calls", F.lit(0)).alias("calls"), "text")
