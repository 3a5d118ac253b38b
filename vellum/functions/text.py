"""String functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stopwords of the language heuristic.
PT_STOPWORDS = "de a o e do da em para com que os as um uma por no na se não mais ao dos das como mas foi ser ter à ou está são este esta isso também já muito".split()
EN_STOPWORDS = "the of and to a in for is on that by this with i you it not or be are from at as your have more will an but we they which their would there".split()
# Words that alone do not make an n-gram.
NGRAM_STOPWORDS = "the a an to of and in is it be that for on with as this are we i you by from or but if at have has will".split()
# Phrases counted as signs of generated prose.
TELL_PHRASES = (
    "warm regards",
    "I very much value",
    "thoughtful and professional",
    "looking ahead, I remain",
    "I'm excited to",
    "thrilled to announce",
    "I'm reaching out to",
    "delve into",
    "ensure that",
    "leverage our",
)
# Words that open a sign-off.
SIGN_OFFS = "best cheers thanks regards atentamente cumprimentos obg abraço saluda saludos".split()
# Tokens that may trail the stem of a versioned file name, at its end.
VERSION_TAIL = (
    r"(?i)(?:[_\-\s]+(?:v\d+(?:\.\d+)*|ver\d+(?:\.\d+)*|vpreread\d*|preread\d*|rev\d+|draft\d*|final|clean"
    r"|\d{4}[_\-]?\d{2}[_\-]?\d{2}|\d{6,8}|\(\d+\)|copy\d*))+\s*$"
)
WIKILINK = r"\[\[([^\[\]|]+?)(?:\|[^\[\]]*?)?\]\]"


def normalize(text: Column) -> Column:
    """Line ends to LF, runs of blanks to one space, none at a line's end, lower case, trimmed; null stays null."""
    x = F.regexp_replace(text, r"\r\n|\r", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    x = F.lower(x)
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stem(name: Column, passes: int = 3) -> Column:
    """A file name's stem without version, draft, date and copy tokens at its end, lower case.

    Stripping may bare another token, so it is repeated; the pattern takes runs of
    tokens, and a further pass is needed only where separators were trimmed between.
    """
    x = F.regexp_replace(name, r"(?<=.)\.[^./\\]*$", "")
    for _ in range(passes):
        x = F.regexp_replace(F.regexp_replace(x, VERSION_TAIL, ""), r"^[ _\-]+|[ _\-]+$", "")
    return F.lower(x)


def slug(name: Column, longest: int = 80) -> Column:
    x = F.regexp_replace(F.lower(F.regexp_replace(name, r"(?<=.)\.[^./\\]*$", "")), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(x, r"^-+|-+$", ""), 1, longest)


def title(name: Column, longest: int = 120) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^./\\]*$", ""), r"[_\-]+", " ")), 1, longest)


def wikilinks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1))


def link_basename(target: Column) -> Column:
    """Target of a link without section, alias, path and extension."""
    x = F.regexp_replace(F.trim(target), r"^\[\[|\]\]$", "")
    x = F.regexp_replace(x, r"[#|].*$", "")
    x = F.regexp_replace(x, r"^.*/", "")
    return F.trim(F.regexp_replace(x, r"\.md$", ""))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores in any script."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` words, as ``words`` has them; a text is read no further."""
    return words(F.regexp_extract(text, r"\A(?:[^\p{L}\p{N}_]*+[\p{L}\p{N}_]++){1,%d}" % n, 0))


def language(text: Column) -> tuple[Column, Column, Column]:
    """Hits of either stopword list, and the language that they tell: pt, en or unknown."""
    tokens = F.transform(words(text), F.lower)
    hits = lambda stop: F.size(F.filter(tokens, lambda t: t.isin(stop)))
    pt, en = hits(PT_STOPWORDS), hits(EN_STOPWORDS)
    lang = F.when(F.greatest(pt, en) < 3, "unknown").when(pt > en * 1.3, "pt").when(en > pt * 1.3, "en").otherwise("unknown")
    return pt, en, lang


def count_of(text: Column, phrase: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def sentences(text: Column) -> Column:
    """Sentences end in . ! or ? before white space and a capital."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-ZÀ-Þ])")
    return F.filter(F.transform(parts, F.trim), lambda s: F.length(s) > 0)


def contains_any(text: Column, markers: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(F.lower(text), F.lit(m.lower())) for m in markers])


def escape(text: Column, attribute: bool = False) -> Column:
    x = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"),) if attribute else ()):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{{KEY}}``, longer keys first."""
    for key in sorted(values, key=lambda k: (-len(k), k)):
        template = F.replace(template, F.lit("{{" + key + "}}"), values[key])
    return template


def verdict(reply: Column) -> tuple[Column, Column]:
    """YES, PARTIAL or NO at the start of a reply's first line, and what follows; null if there is none."""
    text = F.regexp_replace(F.coalesce(reply, F.lit("")), r"\A\s+|\s+\z", "")
    pattern = r"(?is)\A(YES|PARTIAL|NO)\b[\s.:,\-–—]*(.*)\z"
    found = F.upper(F.regexp_extract(text, pattern, 1))
    return F.when(found != "", found), F.when(found != "", F.regexp_extract(text, pattern, 2)).otherwise(text)


#: Characters that may not stand beside a file name that is mentioned; a slash counts only before a path that is rewritten.
BESIDE = r"A-Za-z0-9_\-"


def quoted(text: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c in "_ ") else c for c in text)


def mentions(text: Column, name: Column) -> Column:
    """Whether a text holds a file name that no letter, digit, dash or underscore stands beside."""
    pattern = F.concat(F.lit(rf"(?<![{BESIDE}])\Q"), name, F.lit(rf"\E(?![{BESIDE}])"))
    return F.regexp_like(text, pattern)


def rewrite_mentions(text: Column, old: str, new: str) -> Column:
    """Every ``old`` that stands on its own, also before no slash, as ``new``."""
    return F.regexp_replace(text, rf"(?<![{BESIDE}/])" + quoted(old) + rf"(?![{BESIDE}])", new.replace("\\", "\\\\").replace("$", "\\$"))


def log_header(ts: Column, verb: Column, path: Column) -> Column:
    """``## [day] verb | name`` above an entry of the log."""
    return F.concat(F.lit("## ["), F.substring(ts, 1, 10), F.lit("] "), verb, F.lit(" | "), F.regexp_extract(path, r"([^/\\]+)$", 1))


def reference_links(text: Column) -> Column:
    """Targets of Markdown links to HTML files; without any, bare names of plans."""
    found = F.regexp_extract_all(text, F.lit(r"\]\(([^)]+\.html)\)"), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.regexp_extract_all(text, F.lit(r"`?(_plan_[^`\s]+\.html)`?"), F.lit(1)))


def articles(html: Column, kind: str) -> Column:
    """How many ``article`` elements have a class."""
    return F.regexp_count(html, F.lit(rf'(?i)<article[^>]*\bclass\s*=\s*"[^"]*\b{kind}\b[^"]*"'))


# Synonyms of the levels of effort.
EFFORT = {"low": "Low", "medium": "Medium", "med": "Medium", "high": "High", "extra": "Extra", "xhigh": "Extra", "x-high": "Extra", "extra high": "Extra", "extrahigh": "Extra", "extra-high": "Extra", "max": "Max", "maximum": "Max"}


def effort(value: Column) -> Column:
    """A level of effort by its synonyms; others trimmed, null as empty."""
    trimmed = F.trim(F.coalesce(value, F.lit("")))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EFFORT.items() for x in kv]), F.lower(trimmed)), trimmed)


def family(label: Column, families: list[str], default: str) -> Column:
    """The first of ``families`` that a label names in any case."""
    return F.coalesce(*[F.when(F.contains(F.lower(label), F.lit(f.lower())), F.lit(f)) for f in families], F.lit(default))


# Suffixes of siblings in a chain of versions, in the order in which they are taken off.
SIBLINGS = ("_galp", "_co_ceo", "_readonly", "_full", "_amazon", "_draft", "_clean", r"_comentada\d*", r"_v\d+(?:\.\d+)*", r"_ver\d+", r"_vcomentada\d+", r"_v\d+_full", r"_v\d+_co_ceo", r"_v\d+_galp", r"_v\d+_readonly")


def chain_key(name: Column) -> Column:
    """What versions and siblings of one document have in common: no suffixes, nothing from an inner version on, no separators."""
    x = reduce(lambda x, suffix: F.regexp_replace(x, suffix + "$", ""), SIBLINGS, F.lower(name))
    inner = F.regexp_extract(x, r"^(.*?)_v\d+_", 1)
    return F.regexp_replace(F.when(x.rlike(r"^.*?_v\d+_"), inner).otherwise(x), r"[_\-\s]+", "")


def first_json(text: Column) -> Column:
    """The first ``{...}`` without an inner brace; empty if there is none."""
    return F.regexp_extract(text, r"\{[^}]+\}", 0)


def unfenced(text: Column) -> Column:
    """A reply without the code fence around it."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\s+|\s+\z", "")
    return F.when(F.startswith(x, F.lit("```")), F.regexp_replace(F.regexp_replace(x, r"\A```[a-zA-Z]*\n", ""), r"\n```\z", "")).otherwise(x)


def table_cells(line: Column) -> Column:
    """Cells of a line of a pipe table, without blanks and code marks; empty if it is none or the rule under a header."""
    x = F.trim(line)
    cells = F.transform(F.split(F.regexp_replace(x, r"^\||\|[^|]*$", ""), r"\|"), lambda c: F.regexp_replace(F.trim(c), "^`+|`+$", ""))
    return F.when(F.startswith(x, F.lit("|")) & ~F.startswith(x, F.lit("|---")), cells).otherwise(F.array().cast("array<string>"))


def safe_file_name(name: Column, sha: Column, taken: Column) -> Column:
    """Keep letters, digits, dot, dash and underscore; add eight digits of the hash where the name is taken."""
    clean = F.regexp_replace(name, r"[^A-Za-z0-9._\-]+", "_")
    return F.when(taken, F.regexp_replace(clean, F.lit(r"^(.*?)(\.[^.]*)?$"), F.concat(F.lit("$1-"), F.substring(sha, 1, 8), F.lit("$2")))).otherwise(clean)
