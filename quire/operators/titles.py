"""Which lines are chapter titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import SPACE, lstrip

# ---- fixed values: numerals and the default title pattern
NUMERAL = r"[\d〇零一二两三四五六七八九十百千万壹贰叁肆伍陆柒捌玖拾佰仟]"
DEFAULT_PATTERN = (
    r"(?im)^.{0,6}(?:[引楔]子|正文(?!完|结)|[引序前]言|[序终]章|扉页|"
    r"[上中下][部篇卷]|卷首语|后记|尾声|番外|={2,4}|"
    r"第\s{0,4}[\d〇零一二两三四五六七八九十百千万壹贰叁肆伍陆柒捌玖拾佰仟]+?"
    r"\s{0,4}(?:章|节(?!课)|卷|页[、 　]|集(?![合和])|部(?![分是门落])|篇(?!张))"
    r").{0,40}$|"
    r"^.{0,6}[\d〇零一二两三四五六七八九十百千万壹贰叁肆伍陆柒捌玖拾佰仟a-z]{1,8}"
    r"[、. 　].{0,20}$"
)
#: A title line has fewer code points than this, its line end included, leading white space not.
MAX_TITLE = 80
DEFAULT_TITLE = "前言"


def java_pattern(pattern: str, search: bool = False) -> str:
    """Only \\n ends a line for ``.`` and ``$``; classes are Unicode's; anchored at the start unless ``search``."""
    return f"(?dU){'' if search else chr(92) + 'A'}(?:{pattern})"


def is_title(line: Column, ended: Column, pattern: str | None = None, max_title: int = MAX_TITLE, search: bool = False) -> Column:
    """ended: whether the line has a line end (that counts as one character)."""
    size = F.length(line) + ended.cast("int")
    bare = lstrip(line)
    # only a long line that begins with white space must be stripped to be measured
    fits = F.when(size < max_title, ~line.rlike(f"(?U)\\A{SPACE}*\\z")).otherwise(line.rlike(f"(?U)\\A{SPACE}") & (F.length(bare) + ended.cast("int") < max_title) & (bare != ""))
    return F.when(fits, line.rlike(java_pattern(pattern or DEFAULT_PATTERN, search))).otherwise(F.lit(False))


def rule_pattern(rules: DataFrame, name: str) -> str:
    """The expression of the rule that goes by a name; of several the first in order of use."""
    found = order_rules(rules).where(F.col("name") == name).select("rule").head()
    if found is None:
        raise KeyError(f"no rule {name!r} with an expression")
    return found["rule"]


# ---- fixed values: the names that order the rule table
_FIRST = (("目录", "=", -9998), ("目录(去空白)", "in", -9997), ("通用规则", "=", -9996), ("晋江", "in", 9998))


def order_rules(rules: DataFrame) -> DataFrame:
    """Rules that have an expression, in order of use; ``pos`` (the place in the file) breaks ties."""
    rank = None
    for name, how, value in _FIRST:
        hit = F.col("name") == name if how == "=" else F.contains(F.col("name"), F.lit(name))
        rank = F.when(hit, value) if rank is None else rank.when(hit, value)
    rank = rank.otherwise(F.coalesce(F.col("serialNumber"), F.lit(99)))
    return rules.where(F.coalesce(F.col("rule"), F.lit("")) != "").withColumn("rank", rank).orderBy("rank", "pos")
