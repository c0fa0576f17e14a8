"""Token totals by source, language and tokenizer version, maintained from signed deltas.

A change of the corpus is a set of signed rows: an insert adds a document's counts, a delete takes them away, a revision does both.
A batch of changes is summed to one row a group before anything is stored, and stored in a folder of its own name; a
batch is committed once Spark's success marker is there. Committing a name again does nothing; a batch whose writing was
cut off is overwritten by the next try. Totals are the sums over a snapshot and all batches that it doesn't contain,
so neither order nor retries matter. compact() writes the next snapshot. The ledger is DataFrame operations; a tokenizer
version is whatever counts a text's tokens, and the query's two are public byte-level vocabularies, which count in Arrow batches.

A null source or language is a group like any other. A null text counts as empty, with no tokens. Texts of any length are counted whole. Repeated rows
and equal counts count again. A group whose documents are all gone has a row of zeros. Without batches, or from empty tables, there are no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import delete, hadoop_fs, new_path, written
from gleaner.llm.packing import token_ids

GROUP = ["source", "lang", "tokenizer"]
MEASURES = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
#: Counters within the JVM, for use without a vocabulary: words apart by white space; letters or digits together and other marks one by one.
PATTERNS = {"words-v1": r"[^\x20\x09-\x0D]+", "marks-v2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}
#: The tokenizer versions of the query: files of public byte-level ranks.
RANKS = {"byte-bpe-50k": "byte_bpe_50k.tiktoken", "byte-bpe-multi-50k": "byte_bpe_multi_50k.tiktoken"}


def counted(df: DataFrame, columns: dict[str, str], ranks: dict[str, str]) -> DataFrame:
    """df with, for each version of ranks and each of columns (name: text column), a long column version:name with the text's tokens; the text columns go."""
    kept = [c for c in df.columns if c not in columns.values()]
    made = [f"{v}:{c}" for v in ranks for c in columns]
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [token_ids(path) for path in ranks.values()]
        for b in batches:
            texts = {c: [x.as_py() or "" for x in b.column(t)] for c, t in columns.items()}
            counts = [pa.array([len(encode(t)) for t in texts[c]], pa.int64()) for encode in encoders for c in columns]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *counts], names=[*kept, *made])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"`{m}` long" for m in made)]))


def counted_by_patterns(df: DataFrame, columns: dict[str, str], patterns: dict[str, str]) -> DataFrame:
    """The same by regular expressions."""
    kept = [c for c in df.columns if c not in columns.values()]
    made = [F.coalesce(F.regexp_count(t, F.lit(p)), F.lit(0)).cast("long").alias(f"{v}:{c}") for v, p in patterns.items() for c, t in columns.items()]
    return df.select(*kept, *made)


def signed(rows: DataFrame, tokenizer: str, sign: int, tokens: str = "n_tokens", chars: str = "n_chars") -> DataFrame:
    """Delta rows of documents (source, lang and their counts): sign 1 adds them, -1 takes them away."""
    s = F.lit(sign).cast("long")
    return rows.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), s.alias("n_docs"), (s * F.col(f"`{tokens}`")).alias("n_tokens"), (s * F.col(chars)).alias("n_chars"))


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self, path: str) -> bool:
        fs, p = hadoop_fs(self.spark, f"{path}/_SUCCESS")
        return fs.exists(p)

    def _names(self, kind: str) -> list[str]:
        fs, p = hadoop_fs(self.spark, f"{self.path}/{kind}")
        return sorted(n for s in fs.listStatus(p) if self._committed(f"{self.path}/{kind}/{(n := s.getPath().getName())}")) if fs.exists(p) else []

    def batches(self) -> list[str]:
        return self._names("batches")

    def commit(self, name: str, deltas: DataFrame) -> bool:
        """Stores a batch under its name, once; says whether it was new."""
        at = f"{self.path}/batches/{name}"
        if self._committed(at) or name in self._folded():
            return False
        deltas.groupBy(*GROUP).agg(*(F.sum(m).alias(m) for m in MEASURES)).write.mode("overwrite").parquet(at)
        return True

    def _snapshot(self) -> str | None:
        names = self._names("snapshots")
        return f"{self.path}/snapshots/{names[-1]}" if names else None

    def _folded(self) -> set[str]:
        at = self._snapshot()
        return {r[0] for r in self.spark.read.schema("name string").parquet(f"{at}/names").collect()} if at else set()

    def totals(self) -> DataFrame:
        at, folded = self._snapshot(), self._folded()
        paths = [f"{at}/totals"] * bool(at) + [f"{self.path}/batches/{n}" for n in self.batches() if n not in folded]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*GROUP).agg(*(F.sum(m).alias(m) for m in MEASURES))

    def compact(self) -> None:
        """Folds all committed batches into a new snapshot, which counts from the moment its marker is written."""
        names = sorted(self._folded() | set(self.batches()))
        at = f"{self.path}/snapshots/{len(self._names('snapshots')):09d}"
        self.totals().write.mode("overwrite").parquet(f"{at}/totals")
        self.spark.createDataFrame([(n,) for n in names], "name string").write.mode("overwrite").parquet(f"{at}/names")
        fs, p = hadoop_fs(self.spark, f"{at}/_SUCCESS")
        fs.create(p, True).close()


def with_subtotals(totals: DataFrame) -> DataFrame:
    """Totals of all levels source > lang > tokenizer; level 0 has all three, 7 is the grand total."""
    return totals.rollup(*GROUP).agg(*(F.sum(m).alias(m) for m in MEASURES), F.grouping_id().cast("int").alias("level"))


def kept_totals(docs: DataFrame, labels: DataFrame, count: Callable[[DataFrame, dict[str, str]], DataFrame], versions: tuple[str, str]) -> DataFrame:
    """Loads all documents (twice, the second time without effect), deletes those labelled toxic, revises those labelled of low quality to their first line, and loads what is left by a second tokenizer version. count gives the columns version:text and version:line."""
    spark, (v1, v2), text = docs.sparkSession, versions, F.coalesce(F.col("text").cast("string"), F.lit(""))
    line = F.substring_index(text, "\n", 1)
    measured = docs.select("doc_id", "source", "lang", F.length(text).cast("long").alias("n_chars"), F.length(line).cast("long").alias("line_chars"), text.alias("whole"), line.alias("first"))
    counts, counts_at = written(count(measured, {"text": "whole", "line": "first"}), "counts")
    toxic, low = (labels.where(x).select("doc_id").distinct() for x in ("toxic = 1", "quality = 0"))
    kept = counts.join(toxic, "doc_id", "left_anti")
    revised = kept.join(low, "doc_id", "left_semi")
    ledger = Ledger(spark, new_path(spark, "ledger"))
    ledger.commit("load-1", signed(counts, v1, 1, f"{v1}:text"))
    ledger.commit("load-1", signed(counts, v1, 1, f"{v1}:text"))
    ledger.commit("toxic-2", signed(counts.join(toxic, "doc_id", "left_semi"), v1, -1, f"{v1}:text"))
    ledger.compact()
    ledger.commit("revise-3", signed(revised, v1, -1, f"{v1}:text").union(signed(revised, v1, 1, f"{v1}:line", "line_chars")))
    ledger.commit("load-4", signed(kept, v2, 1, f"{v2}:text"))
    ledger.commit("toxic-2", signed(counts.join(toxic, "doc_id", "left_semi"), v1, -1, f"{v1}:text"))
    delete(spark, counts_at)
    return with_subtotals(ledger.totals())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of documents by two public vocabularies, after deletes and revisions by labels."""
    import public_tokenizers

    ranks = {v: public_tokenizers.path(f) for v, f in RANKS.items()}
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return kept_totals(docs, labels, lambda d, columns: counted(d, columns, ranks), tuple(RANKS))


#: The same of PATTERNS, whose counts SQL can give.
PATTERNS_SQL = r"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), 1) AS line FROM documents
), c AS (
  SELECT doc_id, source, lang, length(text) AS n_chars, length(line) AS line_chars,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS line_words,
    len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) AS marks,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS low
  FROM d
), t AS (
  SELECT source, lang, 'words-v1' AS tokenizer, count(*) FILTER (NOT toxic) AS n_docs,
    coalesce(sum(CASE WHEN toxic THEN 0 WHEN low THEN line_words ELSE words END), 0) AS n_tokens,
    coalesce(sum(CASE WHEN toxic THEN 0 WHEN low THEN line_chars ELSE n_chars END), 0) AS n_chars
  FROM c GROUP BY 1, 2
  UNION ALL
  SELECT source, lang, 'marks-v2', count(*), sum(marks), sum(n_chars) FROM c WHERE NOT toxic GROUP BY 1, 2
)
SELECT source, lang, tokenizer, CAST(sum(n_docs) AS BIGINT) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(n_chars) AS BIGINT) AS n_chars,
  CAST(grouping(source, lang, tokenizer) AS INTEGER) AS level
FROM t GROUP BY ROLLUP (source, lang, tokenizer)
"""
