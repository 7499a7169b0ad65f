"""Operator 6: token counts as delta-maintained rollups.

A batch of changes (inserts, deletes, revised counts) becomes signed sums by source, language and tokenizer version. A
batch is committed by the one atomic rename of its log record, so that it counts once, however often it is run; totals add
up what the log names.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of changes (op, source, lang, tokenizer, n_tokens, old_tokens): an insert adds, a delete takes away, a revision of a count adds the difference and no document. Null counts are 0; another op is an error."""
    n, old = F.coalesce("n_tokens", F.lit(0)).cast("bigint"), F.coalesce("old_tokens", F.lit(0)).cast("bigint")
    bad = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null"))))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(bad.cast("int")).cast("bigint")
    tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).otherwise(n - old)
    return changes.select(*KEYS, docs.alias("n_docs"), tokens.alias("n_tokens"))


class TokenRollup:
    """Totals kept under a folder that Spark can write to. Null sources, languages and versions are groups like others."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self._conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._path(f"{self.folder}/log"))

    def _record(self, name: str) -> str:
        return f"{self.folder}/log/{name}.json"

    def _put(self, name: str, record: dict) -> bool:
        """Writes a log record under its name unless there is one: the commit."""
        held = self._path(f"{self.folder}/staging/{uuid.uuid4().hex}.json")
        out = self._fs.create(held)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        try:
            self._files.rename(held, self._path(self._record(name)), self._no_options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._fs.delete(held, False)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes under its name. False, and nothing done, if a batch of that name is there already. A run that dies before its record is in leaves files that no total reads."""
        name = f"batch-{batch}"
        if self._fs.exists(self._path(self._record(name))):
            return False
        folder = f"{self.folder}/deltas/{uuid.uuid4().hex}"
        signed(changes).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).write.parquet(folder)
        return self._put(name, {"name": name, "folder": folder, "covers": []})

    def _log(self) -> list:
        if not any(s.getPath().getName().endswith(".json") for s in self._fs.listStatus(self._path(f"{self.folder}/log"))):
            return []
        return self.spark.read.schema("name string, folder string, covers array<string>").json(f"{self.folder}/log").collect()

    def _live(self) -> list:
        """Records to add up: those that no summary covers."""
        log = self._log()
        covered = {n for r in log for n in r.covers}
        return [r for r in log if r.name not in covered]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups in which nothing is left have no row."""
        live = self._live()
        if not live:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint")
        rows = self.spark.read.parquet(*[r.folder for r in live])
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Sums up the live deltas in one summary. Their names stay in the log, so that none can be committed again."""
        live = self._live()
        folder = f"{self.folder}/deltas/{uuid.uuid4().hex}"
        if len(live) > 1:
            self.totals().write.parquet(folder)
            name = f"summary-{uuid.uuid4().hex}"
            self._put(name, {"name": name, "folder": folder, "covers": [r.name for r in live]})


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' id, source, lang, the text's digest, and its counts by tokenizer version: words between white space, and runs of ASCII letters and digits and other bytes. Null texts are empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        "doc_id", "source", "lang", F.sha2(text, 256).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words_v1"),
        F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint").alias("words_v2"),
    )


def changes(counts: DataFrame, op: str, tokenizer: str, n_tokens, old_tokens=None) -> DataFrame:
    return counts.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), n_tokens.alias("n_tokens"), (F.lit(None).cast("bigint") if old_tokens is None else old_tokens).alias("old_tokens"))
