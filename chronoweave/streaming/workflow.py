"""Workflows that go on where they ended: sessions of stages, stages of batches, each batch committed once.

A stage's rows are dealt to batches by a hash of their key and written once, so that a batch reads its own folder
only. A batch's result is written under a name that nothing else has and then committed by a small file of the batch's
number, which appears whole or not at all; what was written and not committed is never read. A stage is done when all its
batches are committed, and is then read from its commits. Running a session again therefore works on nothing that was
committed, whatever ended it: the driver, an executor, or an error.

    folder/session/stage/dealt-<id>/_batch=<k>/       the stage's rows
    folder/session/stage/made/<k>-<id>/               what a try of batch k made
    folder/session/stage/dealt.json, <k>.json, done.json
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import Files

COMMIT = re.compile(r"(\d+)\.json")


class Workflow:
    """One session's stages. ``folder`` must be one that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, session: str):
        if not re.fullmatch(r"[\w.-]+", session) or session.startswith("."):
            raise ValueError(f"a session's name is of letters, digits, dots and dashes, not {session!r}")
        self.spark, self.files, self.root = spark, Files(spark), f"{folder.rstrip('/')}/{session}"

    def _at(self, stage: str) -> str:
        if not re.fullmatch(r"[\w-]+", stage):
            raise ValueError(f"a stage's name is of letters, digits and dashes, not {stage!r}")
        return f"{self.root}/{stage}"

    def commits(self, stage: str) -> dict[int, dict]:
        """What is committed of a stage: batch -> made (its folder), or error."""
        at = self._at(stage)
        return {int(m[1]): self.files.read(f"{at}/{n}") for n in self.files.names(at) if (m := COMMIT.fullmatch(n))}

    def done(self) -> list[str]:
        """The stages that are done, in the order in which they were."""
        ended = [(x["nth"], stage) for stage in self.files.names(self.root) if (x := self.files.read(f"{self.root}/{stage}/done.json"))]
        return [stage for _, stage in sorted(ended)]

    def result(self, stage: str) -> DataFrame | None:
        """The rows of a stage that is done, else None."""
        done = self.files.read(f"{self._at(stage)}/done.json")
        if not done:
            return None
        return self.spark.read.schema(_schema(done["schema"])).parquet(*done["made"])

    def errors(self, stage: str) -> dict[int, str]:
        """Batches of a stage that failed and were passed over."""
        return {k: c["error"] for k, c in self.commits(stage).items() if "error" in c}

    def run(self, stage: str, rows: Callable[[], DataFrame], key: str, batches: int, work: Callable[[DataFrame], DataFrame], pass_over: bool = True) -> DataFrame:
        """The stage's rows: those of its commits, and of ``work`` on the batches without one. ``rows`` is called only if
        they have not been dealt yet. An error in a batch is committed as such, and the others go on; if not
        ``pass_over`` it is raised, and the next run tries the batch again. The schema of what ``work`` makes must be
        the same for all batches."""
        at = self._at(stage)
        if (found := self.result(stage)) is not None:
            return found
        dealt = self.files.read(f"{at}/dealt.json")
        if not dealt:
            own = f"{at}/dealt-{uuid.uuid4().hex}"
            table = rows()
            numbered = table.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))
            numbered.write.partitionBy("_batch").parquet(own)  # by the table's own tasks: no task gets a batch's share of all rows
            self.files.put(f"{at}/dealt.json", {"at": own, "batches": batches, "schema": table.schema.json()}, over=False)
            dealt = self.files.read(f"{at}/dealt.json")
        schema = _schema(dealt["schema"])
        committed = self.commits(stage)
        for batch in range(dealt["batches"]):
            if batch in committed:
                continue
            folder = f"{dealt['at']}/_batch={batch}"
            own = self.spark.read.schema(schema).parquet(folder) if self.files.exists(folder) else self.spark.createDataFrame([], schema)
            try:
                made, place = work(own), f"{at}/made/{batch}-{uuid.uuid4().hex}"
                made.write.parquet(place)
                commit = {"made": place, "schema": made.schema.json()}
            except Exception as e:
                if not pass_over:
                    raise
                commit = {"error": f"{type(e).__name__}: {e}"[:2000]}
            self.files.put(f"{at}/{batch}.json", commit, over=False)
        ended = self.commits(stage)
        kind = next((c["schema"] for c in ended.values() if "schema" in c), None)
        if kind is None:
            raise RuntimeError(f"all batches of {stage} failed: {ended[0]['error']}")
        made = [ended[k]["made"] for k in sorted(ended) if "made" in ended[k]]
        self.files.put(f"{at}/done.json", {"nth": len(self.done()), "made": made, "schema": kind}, over=False)
        return self.result(stage)

    def clear(self) -> None:
        """Forget the session, its rows too: what should stay is published first."""
        self.files.delete(self.root)


def _schema(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))
