"""Model answers that are kept: a prompt is only asked once, by any number of runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import literal
from ..sources.catalog import TableFiles
from ..sources.staging import Stage
from .enrich import respond

ANSWER_SCHEMA = "PROMPT_KEY string, RESPONSE string"


class AnswerStore:
    """A folder of answers by prompt.

    The key of an answer is a digest of the model's name and the prompt, so another model,
    or a prompt that a changed finding makes different, is asked anew. Answers are appended
    as files and never changed; a prompt that failed leaves none, and is tried again by the
    next run. Should two runs ask the same at the same time, one of their answers is used.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str) -> None:
        self.spark, self.folder, self.model = spark, folder.rstrip("/"), model

    def keyed(self, prompts: DataFrame) -> DataFrame:
        return prompts.withColumn("PROMPT_KEY", F.expr(f"sha2(concat({literal(self.model)}, char(0), PROMPT), 256)"))

    def answers(self) -> DataFrame:
        """Rows ``ANSWER_SCHEMA``, one per key."""
        runs = TableFiles(self.spark, self.folder).children()
        if not runs:
            return self.spark.createDataFrame([], ANSWER_SCHEMA)
        stored = self.spark.read.schema(ANSWER_SCHEMA).parquet(*[f"{self.folder}/{run}" for run in runs])
        return stored.groupBy("PROMPT_KEY").agg(F.min("RESPONSE").alias("RESPONSE"))

    def unanswered(self, prompts: DataFrame) -> DataFrame:
        """(PROMPT_KEY, PROMPT): what has to be asked, each prompt once."""
        wanted = self.keyed(prompts).groupBy("PROMPT_KEY").agg(F.first("PROMPT").alias("PROMPT"))
        return wanted.join(self.answers(), "PROMPT_KEY", "left_anti")

    def respond(
        self, prompts: DataFrame, fn: Callable[..., list[str]], stage: Stage | None = None, **options
    ) -> DataFrame:
        """Add RESPONSE and ERROR to ``prompts``, asking only what no earlier run was answered.

        The new answers are stored before anything reads them; ``options`` go to ``respond``.
        """
        stage = stage or Stage(self.spark)
        fresh = respond(self.unanswered(prompts), fn, **options).select("PROMPT_KEY", "RESPONSE", "ERROR")
        asked = stage.read(fresh.schema, stage.write(fresh, "asked"))
        answered = asked.where("ERROR IS NULL").select("PROMPT_KEY", "RESPONSE")
        answered.coalesce(1).write.parquet(f"{self.folder}/{uuid.uuid4().hex}")
        errors = asked.where("ERROR IS NOT NULL").select("PROMPT_KEY", "ERROR")
        rows = self.keyed(prompts).join(self.answers(), "PROMPT_KEY", "left").join(errors, "PROMPT_KEY", "left")
        return rows.select(*[F.col(f"`{c}`") for c in prompts.columns], "RESPONSE", "ERROR")
