"""Scalar functions as Column expressions. Nulls: absent strings count as '' where a function compares or joins them."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHUNK, MIN_CHUNK, OVERLAP, LEAST_TEXT = 1500, 350, 200, 30
TOKENS_PER_CHAR, EMBED_TOKENS = 0.7, 7000

# "keyword>result" in the order in which they are tried
DOC_TYPES = "需求分析>需求分析文档 功能概述>功能概述 前端设计>前端设计文档 后端设计>后端设计文档 后台设计>后台设计文档 资源调用>资源调用文档 PRD>PRD"
TAGS = "需求>需求 设计>设计 前端>前端 后端>后端 后台>后台 配置>配置 规范>规范 PRD>需求 功能概述>设计 资源调用>后端"
OTHER = "其他"
GENERIC_DIRS = "doc docs resources 文档资源 美术变动 _converted_xlsx md_file original_file kb-mcp-server tools"
EXCLUDED_DIRS = "images resources _converted_xlsx node_modules .git __pycache__ dist build .next .vscode"
EXCLUDED_PARTS = "动效需求 美术需求 参考方案 埋点 初稿"
RELATION_WORDS = "依赖 调用 关联 关系 哪些模块 什么模块 影响 被调用"
EXPLORE_WORDS = "相关 关于 涉及 有关 包含 有哪些 哪些文档"
COMPARISONS = "对比 区别 vs VS 比较 还是 和 与"
SEPARATORS = "； ; 另外 还有 另一个 以及"
REFERRING, REFERRED = "调用 参考 关联 对接 依赖 参见 详见", "系统 模块 功能 服务"
TRANSLATION_TABLE = r"\|\s*ID\s*\|" + ".*" + "CN（简体中文）"
STOPWORDS = "的 了 在 是 和 与 有 为 等 及 或"
BOUNDARY_WORDS = "上限 下限 不超过 至少 超时 最多 最少 最高 最低"
MANDATORY_WORDS = "必须 禁止 不允许 不得 强制 校验 验证"
LOW_VALUE = "(?i)(筛选|搜索条件|查询条件|支持语言|支持.*简中.*繁中|简中/繁中|列表展示|展示字段|页面展示|默认(显示|展示|范围).*近\\d+天)"
SYNONYMS = "条件为>前置条件为 上限为>最高为 上限为>不超过 分为>包括 分为>类型包括 共有>包含 规则为>要求"


def pairs(table: str) -> list[tuple[str, str]]:
    return [tuple(x.split(">")) for x in table.split()]  # type: ignore[misc]


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_any(c: Column, words: str) -> Column:
    return reduce(or_, (c.contains(w) for w in words.split()))


def parts_of(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(parts_of(path), -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?s)(?<=.)\.[^.]*$", "")


# --- identifiers


def chunk_id(source: Column, index: Column) -> Column:
    return F.concat(F.substring(F.md5(source), 1, 10), F.lit("_"), index.cast("string"))


def fact_id(kind: Column, subject: Column, predicate: Column, value: Column) -> Column:
    return F.concat(F.lit("fact_"), F.substring(F.md5(F.concat_ws("|", text(kind), text(subject), text(predicate), text(value))), 1, 12))


def cache_key(content: Column, *prefix: str | Column) -> Column:
    """16 hex digits of SHA-256 over 'prefix:...:content'."""
    return F.substring(F.sha2(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in prefix), content), 256), 1, 16)


def doc_version(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 8)


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


# --- three normalisers of predicates, which differ on purpose


def dedup_predicate(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[-—?？!！;；:：、。，\s]+", "")


def rule_predicate(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s，。、：:]+", "")


def audit_key(c: Column) -> Column:
    return F.lower(rule_predicate(text(c)))


def synonymous(a: Column, b: Column) -> Column:
    """Whether two normalised predicates hold the two sides of a synonym pair."""
    return reduce(or_, ((a.contains(x) & b.contains(y)) | (a.contains(y) & b.contains(x)) for x, y in pairs(SYNONYMS)))


# --- paths


def relative(path: Column, root: str) -> Column:
    """Forward slashes, and without root in front if it is there as whole path parts."""
    p, r = F.regexp_replace(path, r"\\", "/"), root.replace("\\", "/").rstrip("/")
    return F.when(p.startswith(r + "/"), F.substr(p, F.lit(len(r) + 2))).otherwise(p)


def indexable(path: Column) -> Column:
    """Relative paths that are indexed: no excluded folder, and no excluded phrase in the stem or a folder name."""
    folders = F.slice(parts_of(path), F.lit(1), F.size(parts_of(path)) - 1)
    named = F.exists(folders, lambda d: has_any(d, EXCLUDED_PARTS)) | has_any(stem(path), EXCLUDED_PARTS)
    return ~F.arrays_overlap(parts_of(path), F.array(*map(F.lit, EXCLUDED_DIRS.split()))) & ~named


def module_name(path: Column) -> Column:
    """The part of the stem before -, — or – (tried in this order), else the nearest folder that isn't generic, else the stem."""
    clean = strip(F.regexp_replace(stem(path), r"(?s)\[.*?\]$", ""))
    first = lambda sep: F.when(clean.contains(sep), strip(F.split(clean, sep)[0]))
    folders = F.reverse(F.slice(parts_of(path), F.lit(1), F.size(parts_of(path)) - 1))
    near = F.get(F.filter(folders, lambda d: (d != "") & (d != ".") & ~F.lower(d).isin(*GENERIC_DIRS.split())), F.lit(0))
    return F.coalesce(first("-"), first("—"), first("–"), near, clean)


def doc_type(path: Column) -> Column:
    s = stem(path)
    return F.coalesce(*(F.when(s.contains(k), v) for k, v in pairs(DOC_TYPES)), F.lit(OTHER))


def tags(path: Column) -> Column:
    s = stem(path)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(s.contains(k), v) for k, v in pairs(TAGS))))))


def cross_refs(c: Column) -> Column:
    """Names of systems and modules that a text refers to, at most 20 characters long, sorted."""
    one = lambda names: f"(?:{names.replace(' ', '|')})"
    verbs = F.regexp_extract_all(c, F.lit(f'(?Ud){one(REFERRING)}\\s*[「"]*(.+?{one(REFERRED)})'), 1)
    nouns = F.regexp_extract_all(c, F.lit(f"([一-龥]{{2,8}}{one('系统 模块')})[的，。、）)]"), 1)
    none = F.array().cast("array<string>")
    found = F.concat(F.when(~has_any(c, REFERRING), none).otherwise(verbs), F.when(~has_any(c, "系统 模块"), none).otherwise(nouns))  # most texts have none of the words
    return F.array_sort(F.filter(F.array_distinct(F.transform(found, strip)), lambda x: F.length(x) <= 20))


def short_path(path: Column) -> Column:
    """What comes after md_file, else the last two parts."""
    p = F.regexp_replace(path, r"\\", "/")
    at = F.array_position(parts_of(p), "md_file").cast("int")
    rest = F.array_join(F.slice(parts_of(p), at + 1, F.size(parts_of(p))), "/")
    return F.when((at > 0) & (at < F.size(parts_of(p))), rest).when(F.size(parts_of(p)) >= 2, F.array_join(F.slice(parts_of(p), -2, 2), "/")).otherwise(p)


def remap_prefix(path: Column, old: str, new: str) -> Column:
    """new in place of old where old is the path or whole leading parts of it."""
    old, new = old.rstrip("/"), new.rstrip("/")
    return F.when((path == old) | path.startswith(old + "/"), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def converted_path(path: Column) -> Column:
    """Where a workbook's Markdown goes, <stem>/<stem>[xlsx转换].md; other files keep their path."""
    return F.when(F.lower(path).rlike(r"\.xls[xm]$"), F.concat(stem(path), F.lit("/"), stem(path), F.lit("[xlsx转换].md"))).otherwise(path)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r'(?U)[\s|<>"?*:/\\]+', "_"), "^_+|_+$", "")


# --- Markdown


def first_heading(c: Column) -> Column:
    """The text of the first line that begins with '# ', without leading # and spaces; '' if there is none."""
    lines = F.transform(F.split(c, "\n"), strip)
    found = F.get(F.filter(lines, lambda x: x.startswith("# ")), F.lit(0))
    return text(strip(F.regexp_replace(found, "^[# ]+", "")))


def sections(c: Column, level: int = 2) -> Column:
    """array<struct<title,content>> of a Markdown text, cut before headings of a level; a preface has the title ''."""
    mark = "#" * level
    pieces = F.split(c, rf"(?Udm)(?=^{mark}\s+.+$)")
    head = lambda p: F.regexp_extract(p, rf"(?Ud)^({mark}\s+.+)", 1)

    def section(p: Column) -> Column:
        h = head(p)
        body = strip(F.substr(p, F.length(h) + 1))
        titled = F.struct(strip(F.regexp_replace(h, "^#+", "")).alias("title"), strip(F.concat(h, F.lit("\n\n"), body)).alias("content"))
        return F.when(h != "", titled).otherwise(F.struct(F.lit("").alias("title"), strip(p).alias("content")))

    return F.filter(F.transform(F.filter(pieces, lambda p: strip(p) != ""), section), lambda s: s["content"] != "")


def translated_section(title: Column, content: Column) -> Column:
    """Sections that hold translation tables: by heading, or by a table header in the first ten lines."""
    top = F.slice(F.split(content, "\n"), 1, 10)
    return F.coalesce(title.rlike("(?i)多语言|i18n|国际化"), F.lit(False)) | F.exists(top, lambda x: x.rlike("(?U)" + TRANSLATION_TABLE))


def low_quality(c: Column) -> Column:
    """Fewer than LEAST_TEXT characters outside headings, rules, quotes and blank lines."""
    solid = F.filter(F.split(c, "\n"), lambda x: (strip(x) != "") & ~strip(x).rlike("^(#|---|> )"))
    return F.length(strip(F.array_join(solid, ""))) < LEAST_TEXT


def unfenced(c: Column) -> Column:
    """Model output without a fence of three backticks around it."""
    t = strip(c)
    return F.when(t.startswith("```"), strip(F.regexp_replace(F.regexp_replace(t, "^[^\n]*\n", ""), "(?s)```\\s*$", ""))).otherwise(t)


# --- queries


LETTER = "[A-Za-z]"
CODES = (r"[A-Z]\d{2,4}", "[A-Za-z0-9]"), ("[A-Z]{2,5}" + r"_\d{2,5}", r"\w")


def entities(c: Column, modules: list[str] | None = None) -> Column:
    """Codes (P01, SKL_001) and quoted phrases of a query, then the known modules in it; without repeats, in order."""
    found = [
        *(F.regexp_extract_all(c, F.lit(f"(?<!{LETTER}){code}(?!{after})"), 0) for code, after in CODES),
        F.regexp_extract_all(c, F.lit(r'"([^"]+)"'), 1),
        F.regexp_extract_all(c, F.lit("“([^”]+)”"), 1),
    ]
    known = [F.array_compact(F.array(*(F.when(c.contains(m), m) for m in modules)))] if modules else []
    return F.array_distinct(F.concat(*found, *known))


def query_type(c: Column) -> Column:
    return F.when(has_any(c, RELATION_WORDS), "relation").when(has_any(c, EXPLORE_WORDS), "explore").when(F.length(c) < 10, "precise").otherwise("explore")


def weights(kind: Column) -> Column:
    """struct<v,b>: the weights of vector and lexical scores."""
    v = F.when(kind == "precise", 0.5).when(kind == "relation", 0.7).otherwise(0.8)
    return F.struct(v.alias("v"), (1 - v).alias("b"))


def splits(c: Column) -> Column:
    """Whether a query is taken apart: it compares, or it is long and compound."""
    return has_any(c, COMPARISONS) | ((F.length(c) >= 20) & has_any(c, SEPARATORS))


def sub_queries(c: Column) -> Column:
    """A query's parts: both sides of the first comparison with more than a character on either, else the parts between the first separator that gives two, else the whole."""
    options = []
    for w in COMPARISONS.split():
        at = F.instr(c, w)
        a, b = strip(F.substr(c, F.lit(1), at - 1)), strip(F.substr(c, at + len(w)))
        options.append(F.when((at > 0) & (F.length(a) > 1) & (F.length(b) > 1), F.array(a, b)))
    for w in SEPARATORS.split():
        p = F.filter(F.transform(F.split(c, w), strip), lambda x: F.length(x) > 1)
        options.append(F.when(c.contains(w) & (F.size(p) >= 2), p))
    return F.when(splits(c), F.coalesce(*options, F.array(c))).otherwise(F.array(c))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(r"[\p{L}\p{N}]+"), 0)


def highlight(c: Column, query: Column) -> Column:
    """Sentences that share a word (of several characters) with the query in bold. With no such word in the query, the text as it is."""
    words = F.filter(F.array_distinct(tokens(query)), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS.split()))
    parts = F.filter(F.transform(F.split(F.translate(c, "\n", "。"), "。"), strip), lambda s: s != "")
    bold = F.transform(parts, lambda s: F.when(F.arrays_overlap(tokens(s), words), F.concat(F.lit("**"), s, F.lit("**"))).otherwise(s))
    return F.when(F.size(words) == 0, c).otherwise(F.array_join(bold, "。"))


def citation(source: Column, section: Column, module: Column, version: Column, mtime: Column) -> Column:
    name = F.when(text(source) == "", "未知来源").otherwise(file_name(source))
    day = F.substring(text(mtime.cast("string")), 1, 10)
    label = F.concat(F.lit("[参考自: "), name, F.when(text(section) != "", F.concat(F.lit(" > "), section)).otherwise(""), F.when(day != "", F.concat(F.lit(" ("), day, F.lit(")"))).otherwise(""), F.lit("]"))
    return F.struct(text(source).alias("source"), text(section).alias("section"), text(module).alias("module"), text(version).alias("doc_version"), day.alias("doc_mtime"), label.alias("formatted"))


# --- facts and rules


def fact_text(subject: Column, predicate: Column, value: Column) -> Column:
    return F.concat_ws(" ", text(subject), text(predicate), text(value))


def low_value(c: Column) -> Column:
    return c.rlike(LOW_VALUE)


def fallback_priority(kind: Column, predicate: Column, value: Column) -> Column:
    critical = lambda words: has_any(predicate, words) | has_any(value, words)
    return F.when((kind == "constraint") & critical(BOUNDARY_WORDS), "critical").when((kind == "rule") & critical(MANDATORY_WORDS), "critical").otherwise("normal")


def mergeable_values(old: Column, new: Column) -> Column:
    """One value holds the other, neither is a number, and both have five characters."""
    number = lambda c: strip(c).rlike(r"(?U)^[\d.,\s]+$")
    return (old.contains(new) | new.contains(old)) & ~number(old) & ~number(new) & (F.least(F.length(old), F.length(new)) >= 5)


def is_numeric(c: Column) -> Column:
    s = F.translate(strip(c), ",%¥$", "")
    return F.coalesce(F.try_to_number(s, F.lit("9")).isNotNull() | s.try_cast("double").isNotNull(), F.lit(False))


# --- sizes, images, times


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) * TOKENS_PER_CHAR).cast("int")


def truncated(c: Column, tokens_: int = EMBED_TOKENS) -> Column:
    return F.substring(c, 1, int(tokens_ / TOKENS_PER_CHAR))


def image_kind(data: Column) -> Column:
    """By the first bytes of a binary; png where they are unknown."""
    h = F.hex(F.substring(data, 1, 12))
    known = ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("424D", "bmp")
    webp = F.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
    return F.coalesce(*(F.when(h.startswith(m), k) for m, k in known), webp, F.lit("png"))


def humanized_age(seconds: Column) -> Column:
    s = F.abs(seconds)
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(name))
    return F.when(s < 60, unit(1, "秒")).when(s < 3600, unit(60, "分钟")).when(s < 86400, unit(3600, "小时")).otherwise(unit(86400, "天"))


def drift(status: Column, src_mtime: Column, dst_mtime: Column, indexed_mtime: Column) -> Column:
    """How far a file is behind, in words; '' where nothing can be said."""
    behind = lambda a, b, what: F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit(what), humanized_age(a - b)))
    return text(F.when(status == "outdated_src", behind(src_mtime, dst_mtime, "源文件新于转换结果 ")).when((status == "outdated_index") & indexed_mtime.isNull(), "未索引").when(status == "outdated_index", behind(dst_mtime, indexed_mtime, "索引落后 ")))


# --- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions, F.lit(True))
