"""Token counts kept up by deltas: additive totals by source, language and tokenizer version.

A batch of changes holds rows of op, source, lang, tokenizer, tokens and old_tokens. An ``insert`` adds a
document and its tokens, a ``delete`` takes both away, a ``revise`` adds tokens - old_tokens. A batch is summed
before anything is stored, so what is stored, and what later reads shuffle, grows with the number of groups
and not with that of documents; a hot source is summed in every task first.

A batch is committed by renaming the folder of its sums, staged under a name of its own, to its final name, which fails if
that is there; a batch id that is there already is not applied again, so a batch may be sent again after any failure, and of
two writers with the same batch one wins. On stores whose rename isn't atomic, let one writer commit at a time.
compact() folds all committed sums into one and keeps their ids.

Null group keys are a group of their own. Null counts count as 0. Rows with another op make the batch fail,
before anything of it is stored. Groups whose documents and tokens are both 0 are left out of the totals. Repeated rows
count each; there are no ties. An empty batch is committed like others. Texts play no part but in bpe_changes(), which
encodes them whole, null as no tokens. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe

KEYS = ["source", "lang", "tokenizer"]
_SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def bpe_changes(docs: DataFrame, op: str, tokenizer: str, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Changes, of one op, with the documents' numbers of tokens by a byte-level BPE vocabulary. A ``revise`` takes the
    column old_tokens, which it needs."""
    old = ["old_tokens"] if op == "revise" else []
    counted = bpe.encode(docs, path, pattern, text_col, keep=["source", "lang", *old])
    before = F.col("old_tokens") if old else F.lit(None)
    return counted.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.size("ids").cast("long").alias("tokens"), before.cast("long").alias("old_tokens"))


class TokenRollup:
    """Totals under ``path``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in ("batches", "sums"):
            self._fs.mkdirs(self._hadoop(name))

    def _hadoop(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @staticmethod
    def _name(batch_id: str) -> str:
        return hashlib.sha256(batch_id.encode()).hexdigest()[:40]

    def committed(self, batch_id: str) -> bool:
        """Whether the batch is in the totals."""
        name = self._name(batch_id)
        return self._fs.exists(self._hadoop(f"batches/{name}")) or name in self._latest()[1]

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before."""
        if self.committed(batch_id):
            return False
        new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        op = F.col("op")
        known = F.when(op.isin("insert", "delete", "revise"), op).otherwise(F.raise_error(F.concat(F.lit("an unknown op: "), F.coalesce(op, F.lit("null")))))
        signed = changes.select(
            *KEYS,
            F.when(known == "insert", 1).when(op == "delete", -1).otherwise(0).alias("d"),
            F.when(op == "insert", new).when(op == "delete", -new).otherwise(new - old).alias("t"),
        )
        sums = signed.groupBy(*KEYS).agg(F.sum("d").cast("long").alias("n_docs"), F.sum("t").cast("long").alias("n_tokens"))
        staged = f"staged-{uuid.uuid4().hex}"
        sums.write.mode("overwrite").parquet(f"{self.path}/{staged}")
        if self._moved(staged, f"batches/{self._name(batch_id)}"):
            return True
        self._fs.delete(self._hadoop(staged), True)
        return False

    def _moved(self, name: str, to: str) -> bool:
        """Rename a folder; False if the new name is taken."""
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._hadoop("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._hadoop(name), self._hadoop(to), how)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _list(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._hadoop(folder)))

    def _latest(self) -> tuple[str | None, list[str]]:
        """The newest folded sum, if any, and the names of the batches in it."""
        sums = self._list("sums")
        if not sums:
            return None, []
        stream = self._fs.open(self._hadoop(f"sums/{sums[-1]}/_covers"))
        reader = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        names = list(iter(reader.readLine, None))
        reader.close()
        return sums[-1], names

    def _stored(self) -> tuple[list[str], list[str]]:
        """The paths to be summed, and the names of all batches in them."""
        latest, covered = self._latest()
        fresh = [b for b in self._list("batches") if b not in covered]
        return [f"{self.path}/sums/{latest}"] * (latest is not None) + [f"{self.path}/batches/{b}" for b in fresh], sorted({*covered, *fresh})

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all committed batches."""
        stored, _ = self._stored()
        rows = self.spark.read.schema(_SUMS).parquet(*stored) if stored else self.spark.createDataFrame([], _SUMS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold all committed sums into one, which names its batches and takes their place by one rename;
        then delete what it holds. Not to be run beside apply()."""
        stored, names = self._stored()
        if len(stored) < 2:
            return
        number = len(self._list("sums")) and int(self._list("sums")[-1]) + 1
        self.totals().write.mode("overwrite").parquet(f"{self.path}/staged-sum")
        out = self._fs.create(self._hadoop("staged-sum/_covers"))
        out.write(bytearray("\n".join(names).encode()))
        out.close()
        self._fs.rename(self._hadoop("staged-sum"), self._hadoop(f"sums/{number:012d}"))
        for path in stored:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)
