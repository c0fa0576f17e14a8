"""Queries over the checks of single rows, boards and changes; they register beside those of cases.py."""

from __future__ import annotations


from pyspark.sql import functions as F

from gleaner.functions import checks, text
from gleaner.operators import boards
from gleaner.plans.cases import events, query

@query("SELECT page_id, contains(url, 'mp.weixin.qq.com') OR contains(url, 'zhihu.com') AS verified FROM (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '?from=zhihu.com' ELSE '' END AS url FROM pages)")
def verified_hosts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, "?from=zhihu.com").otherwise(""))
    return pages.select("page_id", checks.is_verified_host(url).alias("verified"))


@query("SELECT coalesce(arg_min('u' || user_id || '_000000', event_id), 'unknown_000000') AS account, 1 AS k FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'unknown_000000', 2")
def default_accounts(spark, sf_dir):
    """The account of the first purchase; other events have no key."""
    e = events(spark, sf_dir)
    key = F.when(F.col("event_type") == "purchase", checks.account_key(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit(None))).otherwise("")
    return boards.default_account(e, key, ["event_id"]).withColumn("k", F.lit(1)).union(boards.default_account(e, F.lit(""), ["event_id"]).withColumn("k", F.lit(2)))


BOARDS = """WITH n AS (SELECT event_id, event_type AS board, CASE WHEN event_id % 13 > 0 THEN user_id % 200 END AS note FROM events),
s AS (SELECT * FROM n WHERE event_id % 40 = 0), f AS (SELECT min(event_id) AS event_id, arg_min(board, event_id) AS board, note FROM n WHERE event_id % 40 <> 0 AND note IS NOT NULL AND note NOT IN (SELECT note FROM s WHERE note IS NOT NULL) GROUP BY note),
u AS (SELECT event_id, board FROM s UNION ALL SELECT event_id, board FROM f)"""


def _united(spark, sf_dir):
    """Events as notes of boards; every fortieth is stored, every thirteenth has no id."""
    n = events(spark, sf_dir).select("event_id", F.col("event_type").alias("board"), F.when(F.col("event_id") % 13 > 0, F.col("user_id") % 200).alias("note"))
    return boards.boards_united(n.where("event_id % 40 = 0"), n.where("event_id % 40 <> 0"), "note", ["event_id"])


@query(BOARDS + " SELECT event_id, board FROM u")
def boards_united(spark, sf_dir):
    return _united(spark, sf_dir).select("event_id", "board")


@query(BOARDS + " SELECT board, count(*) AS n_notes FROM u GROUP BY ROLLUP(board)")
def board_totals(spark, sf_dir):
    return boards.board_totals(_united(spark, sf_dir), "board")


@query("SELECT doc_id, len(s)::INT AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(coalesce(text, ''), '.', '。'), '[。！？!?\\n]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)")
def text_sentences(spark, sf_dir):
    """Whole texts; full stops stand for those of the language that the rule is for."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = checks.sentences(F.replace(text.text_of("text"), F.lit("."), F.lit("。")))
    return docs.select("doc_id", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("digest"))
