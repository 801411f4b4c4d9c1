"""Text expressions: mentions, keyword intents, excerpts, edits, versions, addresses, JSON contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that a message may mention, and words that name an intent, the preferred intent first.
MENTIONS = ["pwa", "researcher", "agent[_-]?producer"]
INTENT_KEYWORDS = {
    "pwa": ["项目", "计划", "排期", "里程碑", "风险", "进度", "甘特图", "WBS", "任务分配", "资源", "交付", "项目管理", "评估", "project", "plan", "timeline", "milestone", "risk", "schedule"],
    "researcher": ["研究", "论文", "文献", "综述", "实验", "数据", "统计", "假设", "分析", "分析方法", "期刊", "学术", "科研", "citation", "引用", "research", "paper", "literature", "experiment", "statistics"],
    "agent_producer": ["创建智能体", "新建智能体", "设计智能体", "配置智能体", "生成智能体", "写一个智能体", "做一个智能体", "做一个agent", "create agent", "design agent", "build agent", "创建", "新建", "智能体", "agent"],
}
# What a word in a request asks for, in order, and what is given where no word is found.
CAPABILITIES = {
    "代码": ["代码生成", "代码审查", "重构建议"],
    "文档": ["文档撰写", "内容总结", "格式转换"],
    "数据": ["数据分析", "数据清洗", "报表生成"],
    "测试": ["测试用例生成", "自动化测试", "测试报告"],
    "客服": ["用户咨询响应", "问题分类", "升级判断"],
    "翻译": ["多语种翻译", "本地化建议", "术语一致性检查"],
    "研究": ["文献检索", "论文摘要", "研究方向建议"],
    "设计": ["UI设计建议", "设计系统管理", "可访问性检查"],
    "安全": ["代码安全审计", "漏洞扫描", "合规检查"],
}
CAPABILITIES_DEFAULT = ["通用任务处理", "信息检索", "结构化输出"]
# Patterns of a name in a request, the best first; the name is group 1.
NAME_PATTERNS = ["叫[「「]?(.+?)[」」]?\\s*[，,]", "名为[「「]?(.+?)[」」]?\\s*[，,]", "创建.+?[「「]?(.+?)[」」]?\\s*(智能体|agent)", "智能体[「「]?(.+?)[」」]"]


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def mention(text: Column) -> Column:
    """The first name that is mentioned with an @, in one spelling; null where none is."""
    name = F.lower(F.regexp_extract(text, f"(?i)@({'|'.join(MENTIONS)})", 1))
    return F.when(name.startswith("agent"), "agent_producer").otherwise(F.nullif(name, F.lit("")))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """The keywords that the text contains, in list order, whatever their case."""
    return _held(F.lower(text), lambda low: F.filter(_texts(keywords), lambda k: low.contains(F.lower(k))))


def _held(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is computed once for a row, however often it is used."""
    return F.transform(F.array(value), of)[0]


def intent(text: Column, keywords: dict[str, list[str]] = INTENT_KEYWORDS) -> Column:
    """The intent with most keywords, the first of equals; one keyword counts only in a text of over ten characters."""
    hits = lambda low, ws: sum((low.contains(F.lit(w.lower())).cast("int") for w in ws), F.lit(0))

    def scored(low: Column) -> Column:
        return F.array_max(F.array(*[F.struct(hits(low, ws).alias("n"), F.lit(-k).alias("place"), F.lit(name).alias("name")) for k, (name, ws) in enumerate(keywords.items())]))

    best = _held(F.lower(text), scored)
    return _held(best, lambda b: F.when((b["n"] >= 2) | ((b["n"] == 1) & (F.length(text) > 10)), b["name"]))


def capabilities(text: Column, most: int = 6) -> Column:
    """What the words of a request ask for, at most six."""
    found = F.flatten(F.array(*[F.when(text.contains(k), _texts(v)).otherwise(F.array().cast("array<string>")) for k, v in CAPABILITIES.items()]))
    return F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(_texts(CAPABILITIES_DEFAULT))


def first_match(text: Column, patterns: list[str] = NAME_PATTERNS, length: int = 30) -> Column:
    """Group 1 of the first pattern that matches, trimmed and cut."""
    return F.left(F.trim(F.coalesce(*[F.when(F.regexp_like(text, F.lit(p)), F.regexp_extract(text, p, 1)) for p in patterns])), F.lit(length))


def excerpt(text: Column, keywords: list[str], length: int, beyond: int = -1) -> Column:
    """From the first keyword of the list that the text has (with more than ``beyond`` characters from it on), on one line."""
    at = [F.instr(text, k) for k in keywords]
    return F.coalesce(*[F.when((p > 0) & (F.length(text) > p - 1 + beyond), F.replace(F.substring(text, p, F.lit(length)), F.lit("\n"), F.lit(" "))) for p in at])


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def replace_unique(text: Column, old: str, new: str) -> Column:
    """The text with ``old`` replaced where it stands exactly once, else null."""
    return F.when(occurrences(text, old) == 1, F.replace(text, F.lit(old), F.lit(new)))


def semver_key(version: Column) -> Column:
    """A value that sorts as versions do: numbers, then pre-releases below the release, their numeric
    identifiers below others and shorter lists first. Null where it isn't a version."""
    form = "^v?(\\d+)\\.(\\d+)\\.(\\d+)(?:-([0-9A-Za-z.-]+))?(?:\\+[0-9A-Za-z.-]+)?$"
    number = lambda k: F.regexp_extract(version, form, k).cast("long")
    pre = F.regexp_extract(version, form, 4)
    digits = lambda x: F.regexp_like(x, F.lit("^\\d+$"))
    part = lambda x: F.struct((~digits(x)).cast("int").alias("word"), F.when(digits(x), x.cast("long")).otherwise(F.lit(0)).alias("n"), F.when(digits(x), "").otherwise(x).alias("s"))
    key = F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (pre == "").cast("int").alias("release"), F.transform(F.split(pre, "\\."), part).alias("pre"))
    return F.when(F.regexp_like(version, F.lit(form)), key)


def normalize_email(email: Column) -> Column:
    """Trimmed and in lower case; null where it can't be an address."""
    e = F.lower(F.trim(email))
    return F.when((F.length(e) <= 254) & F.regexp_like(e, F.lit("^[^@]+@[^@]*\\.[^@]*$")), e)


def output_contract(output: Column, expected: str) -> Column:
    """Null where JSON text has the expected type (object, array, number, boolean, null, string), else what is wrong.

    Numbers, booleans and null pass for each other; string takes any text.
    """
    if expected == "string":
        return F.lit(None).cast("string")
    kind = F.regexp_extract(F.schema_of_variant(F.try_parse_json(output)), "^[A-Z]+", 0)
    # JSON types as the message names them.
    names = {"OBJECT": "dict", "ARRAY": "list", "BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "BOOLEAN": "bool", "VOID": "NoneType", "STRING": "str"}
    name = F.coalesce(*[F.when(kind == k, n) for k, n in names.items()])
    right = {"object": ["dict"], "array": ["list"]}.get(expected, ["int", "float", "bool", "NoneType"])
    return F.when(F.try_parse_json(output).isNull(), f"expected {expected}, got non-JSON").when(~name.isin(right), F.concat(F.lit(f"expected {expected}, got "), name))


def routing_reason(text: Column, keywords: list[str], most: int = 5) -> Column:
    """The first keywords that a text has, as the reason for its route; null where it has none."""
    found = keyword_hits(text, keywords)
    return F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, most), ", "))


def within(text: Column, low: int, high: int, form: str | None = None) -> Column:
    """Whether a text has from ``low`` to ``high`` characters, and the whole of it a form; null hasn't."""
    right = F.length(text).between(low, high)
    return F.coalesce(right & F.regexp_like(text, F.lit(f"^(?:{form})$")) if form else right, F.lit(False))


def purpose(text: Column, keywords: list[str], length: int, otherwise: str) -> Column:
    """The text from the first keyword of the list that it has, on one line; a fixed one where it has none or is null."""
    return F.coalesce(F.nullif(F.trim(excerpt(text, keywords, length)), F.lit("")), F.lit(otherwise))
