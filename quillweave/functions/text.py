"""Text analysis as column expressions: tokens, counts, terms, cues and reply parsers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges, patterns and cue lists that results depend on.
CJK = "㐀-䶿一-鿿"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_./\\:-]*"
NUMBER = r"\d+(?:\.\d+)*"
REFUSAL_CUES = (
    "无法回答", "无法确定", "无法判断", "无法据此", "不能确定", "不足以", "没有说明", "没有提到", "没有相关", "没有关于", "未提及", "未讨论",
    "未给出", "不包含", "上下文不足", "cannot answer", "cannot determine", "not enough information", "no information", "does not contain",
    "does not mention", "unable to", "insufficient",
)
RELATION_CUES = (
    ("cross_context", r"应用到|用到|用在|套用|复用|借鉴|迁移到|搬到|结合|关联|同时|两者|三者|cross[- ]?context|apply\b.*?\bto\b|reuse|combine", 0.88),
    ("switch_or_return", r"切换到|转到|换成|换个(?:话题|方向|问题)|switch to|move on to", 0.88),
    ("switch_or_return", r"回到|回头|之前那个|前面那个|return to|go back", 0.88),
    ("new_context", r"全新|新项目|开始研究|另一个项目|new project|start (?:a )?new", 0.86),
    ("continue", r"继续|接着|刚才|(?:这个|那个)(?!尚未|还没|没有|未曾|未讨论|未提到)|它|continue|that one|\bit\b", 0.84),
)
REFUSAL_PREFIX = "说明上下文不足"
VERDICT_OBJECT = r"(\{[^{}]*\})"
VERDICT_CUT_OFF = r"""(?iU)["']?winner["']?\s*[:：]\s*["']?(a|b|tie)\b"""
VERDICT_LABELLED = r"""(?iU)\b(?:winner|verdict)\b\s*[:：]\s*["']?(a|b|tie)\b"""
VERDICT_BARE = r"""(?iU)^\s*["']?(a|b|tie)["']?\s*[.!]?\s*$"""
RELATIONS = ("continue", "switch_or_return", "cross_context", "new_context", "unknown")
UNKNOWN_CONFIDENCE = 0.58


def tokens(text: Column) -> Column:
    """Distinct tokens in order of first appearance: identifiers and numbers whole, their
    parts at separators and case changes, CJK runs and their pairs of characters."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{IDENTIFIER}|[{CJK}]+|{NUMBER}"), F.lit(0))

    def expand(p: Column) -> Column:
        spaced = F.lower(F.regexp_replace(p, "([a-z0-9])([A-Z])", "$1 $2"))
        inner = F.filter(F.split(spaced, r"[\s_./:\\-]+"), lambda x: x != "")
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(2)))
        more = F.when(p.rlike(f"^[{CJK}]"), pairs).when(p.rlike(r"[_./:\\-]|[a-z0-9][A-Z]"), inner).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.lower(p)), more)

    return F.array_distinct(F.flatten(F.transform(F.array_distinct(parts), expand)))


class TokenSets:
    """The same tokens of a text as a set, for tasks in Python; keeps the expansions of `most` parts."""

    part = re.compile(f"{IDENTIFIER}|[{CJK}]+|{NUMBER}", re.ASCII)
    mark, case, cut, han = re.compile(r"[_./:\\-]|[a-z0-9][A-Z]"), re.compile("([a-z0-9])([A-Z])"), re.compile(r"[\s_./:\\-]+", re.ASCII), re.compile(f"[{CJK}]")

    def __init__(self, most: int = 1 << 16):
        self.most, self.known = most, {}

    def expand(self, p: str) -> tuple[str, ...]:
        if self.han.match(p):
            more = [p[i : i + 2] for i in range(max(len(p) - 1, 1))]
        elif self.mark.search(p):
            more = [x for x in self.cut.split(self.case.sub(r"\1 \2", p).lower()) if x]
        else:
            more = []
        out = (p.lower(), *more)
        if len(self.known) < self.most:
            self.known[p] = out
        return out

    def __call__(self, text: str | None) -> set[str]:
        out: set[str] = set()
        for p in set(self.part.findall(text or "")):
            out.update(self.known.get(p) or self.expand(p))
        return out


def token_count(text: Column) -> Column:
    """CJK characters, identifiers, numbers and other non-space characters."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U)[{CJK}]|{IDENTIFIER}|{NUMBER}|\\S"), F.lit(0))).cast("long")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def head(text: Column, n: int) -> Column:
    """The first n characters, with an ellipsis where the text is longer."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def requirement_terms(text: Column) -> Column:
    """Identifiers of two characters or more, then quoted spans."""
    names = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_.\-]*"), F.lit(0)), lambda x: F.length(x) > 1)
    return F.concat(names, F.regexp_extract_all(text, F.lit("「([^」]+)」"), F.lit(1)))


def match_form(text: Column) -> Column:
    """Lower case without emphasis marks and white space, underscores kept."""
    return F.lower(F.regexp_replace(text, r"(?U)[*`\\\s]+", ""))


def is_refusal(answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(F.array(*map(F.lit, REFUSAL_CUES)), lambda c: F.contains(low, c))


def is_refusal_requirement(requirement: Column) -> Column:
    return requirement.startswith(REFUSAL_PREFIX)


def satisfied(requirement: Column, answer: Column) -> Column:
    """All of the requirement's terms are in the answer, false without terms; a requirement to
    refuse is met by a refusal."""
    terms, body = requirement_terms(requirement), match_form(answer)
    held = (F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(body, match_form(t)))
    return F.coalesce(F.when(is_refusal_requirement(requirement), is_refusal(answer)).otherwise(held), F.lit(False))


def coverage(requirements: Column, answer: Column) -> Column:
    """Share of the requirements that an answer satisfies; 1 without any."""
    n = F.size(F.filter(requirements, lambda r: satisfied(r, answer)))
    return F.when(F.size(requirements) == 0, 1.0).otherwise(n / F.size(requirements))


def reachability(requirements: Column, memory: Column) -> Column:
    """The same over what was shown, without requirements to refuse; null if none is left."""
    some = F.filter(requirements, lambda r: ~is_refusal_requirement(r))
    return F.when(F.size(some) > 0, F.size(F.filter(some, lambda r: satisfied(r, memory))) / F.size(some))


def excerpt(content: Column, n: int = 400) -> Column:
    return F.left(content, F.lit(n))


def relation(query: Column) -> Column:
    """The first family of cues that matches."""
    out = F.lit("unknown")
    for name, pattern, _ in reversed(RELATION_CUES):
        out = F.when(query.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def relation_confidence(query: Column) -> Column:
    out = F.lit(UNKNOWN_CONFIDENCE)
    for _, pattern, p in reversed(RELATION_CUES):
        out = F.when(query.rlike(f"(?i){pattern}"), p).otherwise(out)
    return out


def relation_probabilities(query: Column) -> Column:
    """The confidence for the relation found; the others share the rest evenly."""
    name, p = relation(query), relation_confidence(query)
    return F.map_from_arrays(F.array(*map(F.lit, RELATIONS)), F.array(*(F.when(name == r, p).otherwise((1 - p) / 4) for r in RELATIONS)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def verdict(reply: Column) -> Column:
    """a, b or tie: by the first JSON object with such a winner; else by the last `winner:`; else by
    the last `winner:` or `verdict:` label; else by the whole reply; null if none."""
    winner = lambda o: F.lower(stripped(F.from_json(o, "winner string", {"allowSingleQuotes": "false"})["winner"]))
    of_json = F.get(F.filter(F.transform(F.regexp_extract_all(reply, F.lit(VERDICT_OBJECT), F.lit(1)), winner), lambda w: w.isin("a", "b", "tie")), F.lit(0))
    last = lambda pattern: F.lower(F.try_element_at(F.regexp_extract_all(reply, F.lit(pattern), F.lit(1)), F.lit(-1)))
    bare = F.lower(F.nullif(F.regexp_extract(reply, VERDICT_BARE, 1), F.lit("")))
    return F.coalesce(of_json, last(VERDICT_CUT_OFF), last(VERDICT_LABELLED), bare)


def yes_no(reply: Column) -> Column:
    """Whether a reply starts with YES or NO, or has it on a line within 40 characters."""
    up = F.upper(stripped(reply))
    near = F.left(up, F.lit(40))
    return F.when(up.startswith("NO") | F.contains(near, F.lit("\nNO")), F.lit(False)).when(up.startswith("YES") | F.contains(near, F.lit("\nYES")), F.lit(True))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fold5(key: Column) -> Column:
    """sha256 of the key modulo 5: as 16 is 1 modulo 5, the sum of its hex digits modulo 5."""
    digits = F.split(F.sha2(key.cast("string").cast("binary"), 256), "")
    value = lambda c: F.instr(F.lit("123456789abcdef"), c)
    return (F.aggregate(F.filter(digits, lambda c: c != ""), F.lit(0), lambda a, c: a + value(c)) % 5).cast("int")
