"""Comment threads: noise and signal, selection, rendering, and the merge of two readings of the same comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import squeezed, text_of

#: Stock phrases, praise, and what makes a comment worth keeping.
STOCK = r"(?i)^(蹲|dd|mark|来了|确实|好看|不错|厉害|学习了|收藏了|收到)$"
PRAISE = r"^[赞好棒强牛]+$"
SIGNAL = r"(?i)https?://|www\.|\.com\b|工具|网站|链接|网址|提示词|模型|Gemini|gpt|Claude|Vibe|Dribbble|Excalidraw|复刻|截图|配色|字体|图标|资源站|经验|踩坑|纠错|不是|打错|应该|可以用"
MOST, FEWER = 40, 20


def is_noise(content: Column, by_author: Column) -> Column:
    return ~by_author & (content.rlike(STOCK) | content.rlike(PRAISE) | (F.length(content) <= 2))


def has_signal(content: Column, by_author: Column) -> Column:
    return (content != "") & (by_author | content.rlike(SIGNAL) | (F.length(content) >= 18))


def useful(comments: DataFrame, note: str = "note_id", order: str = "seq") -> DataFrame:
    """Of each note's comments (comment_id, author, content, is_author, order) at most MOST that are signal and no noise, authors' first where there are more; if there are none, the first FEWER that are no noise. Adds place."""
    rows = comments.withColumn("content", squeezed("content")).where("content <> ''").withColumn("is_author", F.coalesce("is_author", F.lit(False)))
    rows = rows.withColumn("_key", F.coalesce(F.nullif(text_of("comment_id"), F.lit("")), F.concat_ws("|", text_of("author"), "content")))
    best = F.min_by(F.struct(*(c for c in rows.columns if c not in (note, "_key"))), F.col(order)).alias("r")
    rows = rows.groupBy(note, "_key").agg(best).select(note, "r.*").where(~is_noise(F.col("content"), F.col("is_author")))
    rows = rows.withColumn("_good", has_signal(F.col("content"), F.col("is_author")))
    whole, by_order = Window.partitionBy(note), Window.partitionBy(note, "_good").orderBy(order)
    rows = rows.withColumn("_n", F.sum(F.col("_good").cast("long")).over(whole))
    rows = rows.where(F.col("_good") | (F.col("_n") == 0))
    authors_first = F.when(F.col("_n") > MOST, (~F.col("is_author")).cast("int")).otherwise(0)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(note).orderBy(authors_first, order)))
    return rows.where(F.col("place") <= F.when(F.col("_n") == 0, FEWER).otherwise(MOST)).drop("_good", "_n")


def threads(selected: DataFrame, note: str = "note_id") -> DataFrame:
    """One row a thread of useful(): lines by level, then place, joined; at most MOST lines a note come here."""
    level = F.coalesce(F.col("level"), F.lit(0))
    key = F.coalesce(F.nullif(text_of("root_id"), F.lit("")), F.when(level > 0, F.nullif(text_of("parent_id"), F.lit(""))), F.nullif(text_of("comment_id"), F.lit("")), F.col("content"))
    line = F.concat(F.when(level > 0, "↳ ").otherwise(""), F.replace("content", F.lit("|"), F.lit("\\|")))
    rows = selected.select(note, key.alias("thread"), F.struct(level.alias("level"), "place", line.alias("line")).alias("x"))
    grouped = rows.groupBy(note, "thread").agg(F.min("x.place").alias("first_place"), F.sort_array(F.collect_list("x")).alias("x"), F.count("*").alias("n_lines"))
    return grouped.select(note, "thread", "first_place", "n_lines", F.array_join(F.transform("x", lambda r: r["line"]), "<br>").alias("lines"))


def merged(comments: DataFrame, note: str = "note_id", order: str = "seq", placeholder: str = "[non-text]") -> DataFrame:
    """Readings of the same comments made one row each: by stable id, else by author, content, date, level and parent; a reading without an id joins the first with an id that is otherwise alike. The longest content that is no placeholder stays (the later of equals), the longest date, the greatest counts, the last non-empty author and parent."""
    stable = F.when(text_of("comment_id").rlike(r"(?i)^(comment_\d+)?$"), None).otherwise(F.col("comment_id"))
    rows = comments.withColumns({"_id": stable, "_alike": F.to_json(F.array(text_of("author"), text_of("content"), text_of("date"), F.coalesce("level", F.lit(0)).cast("string"), text_of("parent_id")))})
    known = rows.where("_id is not null").groupBy(note, "_alike").agg(F.min_by("_id", order).alias("_same"))
    rows = rows.join(known, [note, "_alike"], "left").withColumn("_key", F.coalesce(F.concat(F.lit("id:"), F.coalesce("_id", "_same")), F.concat(F.lit("f:"), "_alike")))
    real = (F.col("content") != placeholder).cast("int")
    last = lambda c: F.max_by(c, F.when(text_of(c) != "", F.col(order)))
    return rows.groupBy(note, "_key").agg(
        F.max("_id").alias("comment_id"), last("author").alias("author"), F.max_by("content", F.struct(real, F.length("content"), order)).alias("content"), F.max_by("date", F.struct(F.length("date"), order)).alias("date"), last("parent_id").alias("parent_id"),
        F.max("level").alias("level"), F.max("like_count").alias("like_count"), F.max("reply_count").alias("reply_count"), F.coalesce(F.bool_or("is_author"), F.lit(False)).alias("is_author"), F.count("*").alias("n_readings"),
    ).drop("_key")
