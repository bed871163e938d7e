"""What the corpus operators share: input columns, written stages, joins whose small side is checked first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.session import prepare, scratch_path

# A side is broadcast only if its counted rows times its stated row width stay below this.
BROADCAST_BYTES = 48 << 20
# Rows in one Arrow batch: long texts make large batches.
ARROW_ROWS = 1000
# Has Spark delete the shuffle files of a query when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def begin(spark: SparkSession) -> None:
    """Prepare the session for the operators of this subpackage."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **more: Column) -> DataFrame:
    """Only what an operator needs, under names of its own: ``__id``, ``__text`` (null counts as empty) and ``more``."""
    return docs.select(
        docs[id_column].alias("__id"), F.coalesce(docs[text_column], F.lit("")).alias("__text"), *[c.alias(n) for n, c in more.items()]
    )


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and go on from the files; a lost executor costs a re-read."""
    path = scratch_path(df.sparkSession, label)
    before = df.sparkSession.conf.get(DROP_SHUFFLES, "false")
    # Nothing reads the shuffle files of this write again; the driver's garbage collection would drop them much later.
    df.sparkSession.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(DROP_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(small: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``small`` with a broadcast hint if it was counted to be small; otherwise as it is, for a shuffled join.

    ``small`` should be a written stage, so that the count reads file footers only.
    """
    rows = small.count() if rows is None else rows
    return F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small


def without(docs: DataFrame, id_column: str, lost: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not in the one column of ``lost``, all columns unchanged; rows without an id stay."""
    name = "__lost"
    while name in docs.columns:
        name += "_"
    gone = stage(lost.toDF(name).distinct(), "lost")
    return docs.join(hinted(gone, 32), docs[id_column] == gone[name], "left_anti")


class Memory(dict):
    """Values of words, up to a number of them. A word looked up in vain comes back as itself and is noted."""

    def __init__(self, most: int, known: dict):
        super().__init__(known)
        self.most, self.missing = most, set()

    def __missing__(self, word):
        self.missing.add(word)
        return word

    def learn(self, compute) -> dict:
        """Values of the words noted since, from a function of a list of words; kept too while there is room."""
        new = list(self.missing)
        fresh = dict(zip(new, compute(new), strict=True)) if new else {}
        self.missing.clear()
        if len(self) < self.most:
            self.update(fresh)
        return fresh


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often a lambda inside ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def require(docs: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in docs.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
