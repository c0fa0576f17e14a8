"""Checks and names of single rows, in built-in expressions: tasks, fetched pages, comment controls, accounts, notes of other stores. A null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import squeezed, text_of, trimmed

VERIFIED_HOSTS = ("mp.weixin.qq.com", "zhihu.com")  # fixed values
SCENES = ("WB_DFT", "WB_PRV")  # fixed values, best first
NO_ACCOUNT = "unknown_000000"  # a fixed value


class Json:
    """A column of JSON text, asked for the kinds and truth of its fields. Text that is no JSON has no fields."""

    def __init__(self, text: Column | str):
        self.text = text_of(text)
        self.value = F.try_parse_json(self.text)

    def kind(self, path: str) -> Column:
        """Spark's type of a field: VOID for a JSON null, null where the field is missing."""
        return F.schema_of_variant(F.try_variant_get(self.value, path, "variant"))

    def string(self, path: str) -> Column:
        return F.get_json_object(self.text, path)

    def is_object(self, path: str) -> Column:
        return F.coalesce(self.kind(path).startswith("OBJECT"), F.lit(False))

    def truthy(self, path: str) -> Column:
        """Neither missing, null, false, zero nor an empty string."""
        kind, value = self.kind(path), self.string(path)
        none = F.when(kind == "STRING", value == "").when(kind == "BOOLEAN", value == "false").when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), False).otherwise(value.try_cast("double") == 0)
        return kind.isNotNull() & (kind != "VOID") & ~F.coalesce(none, F.lit(False))


def task_fault(task: Column | str) -> Column:
    """What is wrong with a task in JSON, the first fault alone; null if nothing is."""
    t = Json(task)
    given = lambda path: t.kind(path).isNotNull()
    unclear = (t.string("$.type") == "note-save") & ~t.truthy("$.input") & ~F.coalesce(t.string("$.options.mode") == "current", F.lit(False))
    return (
        F.when(~t.is_object("$"), "Invalid task").when(~t.truthy("$.type"), "Task type is required").when(~t.truthy("$.source"), "Task source is required")
        .when(F.coalesce(t.kind("$.input"), F.lit("VOID")) == "VOID", "Task input is required").when(unclear, "Note save task requires input or current mode")
        .when(given("$.route") & (t.kind("$.route") != "STRING"), "Task route must be a string").when(given("$.deliveryMode") & (t.kind("$.deliveryMode") != "STRING"), "Task deliveryMode must be a string")
        .when(given("$.metadata") & ~t.is_object("$.metadata"), "Task metadata must be an object")
    )


def page_fault(source: Column, note_id: Column, title: Column, content: Column) -> Column:
    """Notes need an id, and a title or a text; articles need both; null if they have them."""
    no_title, no_text = trimmed(title) == "", trimmed(content) == ""
    note = F.when(trimmed(note_id) == "", "Fetched Xiaohongshu note is missing noteId").when(no_title & no_text, "Fetched Xiaohongshu note is missing title and content")
    return F.when(source == "xiaohongshu", note).when(no_title, "Fetched article is missing title").when(no_text, "Fetched article is missing content")


def is_verified_host(url: Column | str) -> Column:
    """Whether the link's page is worth a check."""
    return F.exists(F.array(*map(F.lit, VERIFIED_HOSTS)), lambda host: F.contains(text_of(url), host))


#: The longest labels of controls for more comments and for replies, what they say, and what they must not say.
MORE_LENGTH, MORE, NOT_MORE = 12, r"(?i)更多|展开|查看|more|view", ["回复", "登录", "展开全文|阅读全文|收起"]
REPLIES_LENGTH, REPLIES, NOT_REPLIES, ABOUT_REPLIES = 18, r"(?i)展开|查看|全部|更多|more|view", ["登录", "展开全文|阅读全文|收起"], "回复"


def _control(label: Column | str, most: int, wanted: str, refused: list[str]) -> Column:
    value = squeezed(label)
    said = (value != "") & (F.length(value) <= most) & value.rlike(wanted)
    for words in refused:
        said = said & ~value.rlike(words)
    return said


def loads_more(label: Column | str) -> Column:
    """Whether a control's label promises more comments."""
    return _control(label, MORE_LENGTH, MORE, NOT_MORE)


def expands_replies(label: Column | str) -> Column:
    """Whether a control's label promises replies to a comment."""
    return F.contains(text_of(label), F.lit(ABOUT_REPLIES)) & _control(label, REPLIES_LENGTH, REPLIES, NOT_REPLIES)


def has_author_tag(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda tag: F.coalesce(tag, F.lit("")).rlike("(?i)作者|author")), F.lit(False))


def account_key(nickname: Column | str, uid: Column | str) -> Column:
    """Name and number of an account, fit for a file name; a missing one has a stand-in."""
    bare = trimmed(F.regexp_replace(text_of(nickname), "关注$", ""))
    name = squeezed(F.regexp_replace(F.when(bare == "", "unknown").otherwise(bare), r'[\\/:*?"<>|]', "_"))
    number = trimmed(uid)
    return F.concat(F.when(name == "", "unknown").otherwise(name), F.lit("_"), F.when(number == "", "000000").otherwise(number))


def note_file_name(title: Column | str, doc_id: Column | str) -> Column:
    """A note's file name of at most 120 characters; characters that file systems refuse become one hyphen, none at the ends."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(text_of(title), r'[<>:"/\\|?*]', "-"), "-+", "-"), r"\A-|-\z", "")
    name = squeezed(name)
    return F.when(name == "", F.concat(F.lit("untitled-"), text_of(doc_id))).otherwise(F.substring(name, 1, 120))


def basic_info(raw: Column | str, shape: str, field: str) -> Column:
    """A field of a store's row in JSON, which holds its info in one of two places; the first that is there counts, whatever it holds."""
    t, first = Json(raw), f"$.{shape}.basic_info"
    there = F.coalesce(t.kind(first), F.lit("VOID")) != "VOID"
    return F.when(there, t.string(f"{first}.{field}")).otherwise(t.string(f"$.basic_info.basic_info.{field}"))


def scene_links(images: Column) -> Column:
    """Links of one image's variants (imageScene, url): the best scenes first, the rest as they came; links that are missing go."""
    rest = F.filter(images, lambda x: ~F.coalesce(x["imageScene"].isin(*SCENES), F.lit(False)))
    of_scene = lambda scene: F.filter(images, lambda x: x["imageScene"] == scene)
    ordered = F.concat(*map(of_scene, SCENES), rest)
    return F.filter(F.transform(ordered, lambda x: x["url"]), lambda u: text_of(u) != "")


def sentences(text: Column | str) -> Column:
    """The sentences of a text, trimmed; empty ones go."""
    return F.filter(F.transform(F.split(text_of(text), "[。！？!?\n]"), trimmed), lambda s: s != "")
