"""Requests from outside: payloads and chat events become rows of one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.links import first_chat_link
from gleaner.functions.notes import request_time
from gleaner.functions.text import first_nonempty, trimmed
from gleaner.functions.urls import host

PAYLOAD = "url string, link string, source string, route string, delivery_mode string, deliveryMode string, requested_at string, requestedAt string, title string, page_title string, pageTitle string, metadata struct<pageTitle:string,page_title:string,title:string>"
EVENT = (
    "url string, text string, content string, route string, requested_at string, token string, header struct<event_type:string,create_time:string,token:string>, "
    "event struct<text_without_at_bot:string,create_time:string,message:struct<content:string,create_time:string>>"
)


def requests(raw: DataFrame, now: Column, source: str = "external", route: str = "local", delivery: str = "immediate") -> DataFrame:
    """(id, url, source, route, delivery_mode, requested_at, title, error) from (id, body: JSON). A body without a good http link has an error."""
    p = raw.select("id", F.from_json("body", PAYLOAD).alias("p"))
    at = lambda *names: first_nonempty(*(f"p.{n}" for n in names))
    url = at("url", "link")
    good = url.rlike("(?i)^https?://") & host(url).isNotNull()
    return p.select(
        "id", F.when(good, url).alias("url"), first_nonempty("p.source", F.lit(source)).alias("source"), first_nonempty("p.route", F.lit(route)).alias("route"), first_nonempty("p.delivery_mode", "p.deliveryMode", F.lit(delivery)).alias("delivery_mode"),
        request_time(at("requested_at", "requestedAt"), now).alias("requested_at"), at("title", "pageTitle", "page_title", "metadata.pageTitle", "metadata.page_title", "metadata.title").alias("title"), F.when(~good, "Invalid url").alias("error"),
    )


def chat_requests(raw: DataFrame, now: Column, token: str = "", route: str = "cloud") -> DataFrame:
    """The same from chat events: the first link of seven texts in order; events without a link, or with a wrong token where one is set, have an error."""
    p = raw.select("id", F.from_json("body", EVENT).alias("p"))
    said = F.coalesce("p.event.message.content", "p.content", "p.text", "p.event.text_without_at_bot")
    inner = F.from_json(said, "text string")["text"]
    texts = ["p.url", "p.text", "p.content", "p.event.text_without_at_bot"]
    url = F.coalesce(F.nullif(trimmed("p.url"), F.lit("")), first_chat_link(*texts, inner, "p.event.message.content", "p.header.event_type"))
    wrong = (F.lit(token) != "") & (first_nonempty("p.token", "p.header.token") != token)
    time = first_nonempty("p.event.message.create_time", "p.event.create_time", "p.header.create_time", "p.requested_at")
    error = F.when(wrong, "Invalid webhook token").when(url.isNull(), "Webhook message does not contain url")
    return p.select("id", F.when(error.isNull(), url).alias("url"), F.lit("feishu").alias("source"), first_nonempty("p.route", F.lit(route)).alias("route"), F.lit("queue").alias("delivery_mode"), request_time(time, now).alias("requested_at"), error.alias("error"))
