"""What a failed row failed at, by ordered rules on its message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import trimmed

#: Stages of failure with the messages that show them; the first that matches counts.
STAGES = [
    ("browser_connection", r"(?i)remote debugging|9222|econnrefused|devtools|调试会话|浏览器连接|未检测到可复用的 chrome|当前浏览器接管失败", r"(?i)connect.*127\.0\.0\.1|connect.*localhost"),
    ("login_gate", r"(?i)验证码|captcha"),
    ("comment_permission", r"(?i)300011|406|账号异常|风控|频率|限流|rate"),
    ("login_gate", r"(?i)登录查看全部评论内容|无登录信息|未登录|请先登录|登录后查看|login required|sign in"),
    ("detail_page", r"(?i)300031|暂时无法浏览|无法打开笔记详情页|current tab is not a xiaohongshu note detail page|no xiaohongshu tab found"),
    ("comment_loading", r"(?i)评论可能未完整加载|评论未完整加载|页面显示共 .*当前抓取 .*条|comment.*incomplete"),
]
#: Errors of tasks: code, messages, and whether to try again; those of PARTIAL allow writing and falling back.
ERRORS = [
    ("chrome_unavailable", r"(?i)ECONNREFUSED|socket hang up|ECONNRESET", True),
    ("login_required", r"(?i)无登录信息|登录已失效|重新登录|login required|not logged in", False),
    ("no_xiaohongshu_tab", r"(?i)No xiaohongshu tab found", False),
    ("not_note_detail", r"(?i)Current tab is not a Xiaohongshu note detail page", False),
    ("account_risk_control", r"(?i)300011|账号存在异常|risk control|风控", False),
    ("note_unavailable", r"(?i)error_code=300031|暂时无法浏览|无法打开笔记详情页", False),
    ("comment_fetch_failed", r"(?i)comment.*(fail|error|failed)", False),
    ("vision_ocr_failed", r"(?i)vision ocr|ocr returned empty|ocr failed", False),
    ("ai_failed", r"(?i)openrouter|ai.*failed|summary.*failed|openrouter empty response", False),
]
PARTIAL = ["comment_fetch_failed", "vision_ocr_failed", "ai_failed"]
#: Reasons and warnings that a row carries itself, and the rule of STAGES that each meets.
REASONS, WARNINGS = {"captcha": 1, "risk_control": 2, "login_required": 3}, {"comment_login_required": 3, "comment_incomplete": 5}


def failure_stage(message: Column, reason: Column, warning: Column) -> Column:
    """The stage of the first rule that the message, reason or warning meets, else unknown. Nulls meet none."""
    message = trimmed(message)
    rules = []
    for k, (stage, *patterns) in enumerate(STAGES):
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | message.rlike(pattern)
        for column, known in ((reason, REASONS), (warning, WARNINGS)):
            hit = hit | F.coalesce(column.isin([n for n, rule in known.items() if rule == k]), F.lit(False))
        rules.append(F.when(hit, stage))
    return F.coalesce(*rules, F.lit("unknown"))


def task_error(message: Column) -> Column:
    """code, retriable, allow_write, allow_fallback of an error's message."""
    message = trimmed(message)
    code = F.coalesce(*(F.when(message.rlike(pattern), name) for name, pattern, _ in ERRORS), F.lit("unknown"))
    partial = code.isin(PARTIAL)
    return F.struct(code.alias("code"), code.isin([n for n, _, again in ERRORS if again]).alias("retriable"), partial.alias("allow_write"), partial.alias("allow_fallback"))
