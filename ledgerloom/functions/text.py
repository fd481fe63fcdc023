"""Text expressions: normalisation, identity, tokens, relevance, block typing, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, markers, patterns and names that results depend on.
CJK = r"㐀-䶿一-鿿豈-﫿"
LEGAL_MARKERS = ("法律主体声明", "版权声明", "分析师声明", "评级说明")
NUMBER = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
TABLE_NUMBER = NUMBER + "%?"
PERIOD = r"\b20\d{2}[AE]?\b"
LOOSE_NUMBER = r"[-+]?\d[\d,.]*(?:%|倍|元|亿|万)?"
WORD_NUMBER = r"(?<![A-Za-z])\d[\d,]*(?:\.\d+)?"
METRIC_NAMES = """营业总收入 营业收入增速 营业收入 同比增长率 同比增长 归母净利润增速 归母净利润 净利润 营业利润增速 营业利润 毛利率 净利率 ROE ROIC
每股经营性现金流 每股净资产 每股收益 市盈率 市销率 市净率 EV/EBITDA EV/EBIT 货币资金 应收款项 存货 流动资产 长期股权投资 固定资产 在建工程 无形资产
非流动资产 资产合计 短期借款 应付款项 流动负债 长期借款 应付债券 非流动负债 负债合计 股本 资本公积 留存收益 归母股东权益 少数股东权益
负债和权益总计 折旧摊销 营运资本变动 经营活动现金流 资本开支 投资变动 投资活动现金流 银行借款 筹资活动现金流 现金净增加额 期初现金 期末现金
营业成本 税金及附加 销售费用 管理费用 研发费用 财务费用 资产减值损失 公允价值变动 投资净收益 营业外收支 利润总额 所得税 少数股东损益 EBITDA
资产负债率 净负债比率 流动比率 速动比率 总资产周转率 应收账款周转率 存货周转率""".split()


#: Steps that repair the spacing of a text, in order; look-around makes the repair of Han text a fix-point in one pass.
NORM_STEPS = (("\u00a0", " "), ("\r\n?", "\n"), (r"[ \t]+", " "), (rf"(?<=[{CJK}])[ \t]+(?=[{CJK}])", ""), (rf"(?<=[{CJK}])[ \t]+(?=[，。；：、！？）】])", ""), (rf"(?<=[（【])[ \t]+(?=[{CJK}])", ""), (" *\n *", "\n"), ("\n{3,}", "\n\n"))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def norm_text(x: Column | str) -> Column:
    """Repaired spacing with line boundaries kept."""
    out = _c(x)
    for pattern, by in NORM_STEPS:
        out = F.regexp_replace(out, pattern, by)
    return strip(out)


def norm_quote(x: Column | str) -> Column:
    """No white space, ASCII commas."""
    return F.translate(F.regexp_replace(_c(x), r"(?U)\s+", ""), "，", ",")


def squeezed(x: Column | str) -> Column:
    """No white space."""
    return F.regexp_replace(_c(x), r"(?U)\s+", "")


def compact(x: Column | str) -> Column:
    """No white space, case folded (sharp s as ss); null gives an empty string."""
    return F.replace(F.lower(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", "")), F.lit("ß"), F.lit("ss"))


def quote_in(quote: Column | str, text: Column | str) -> Column:
    """A non-blank quote that the text holds, white space aside."""
    q = norm_quote(quote)
    return (q != "") & norm_quote(text).contains(q)


def sha256(x: Column | str) -> Column:
    return F.sha2(_c(x).cast("binary"), 256)


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """Content identity; a null part counts as the word None."""
    texts = [strip(F.coalesce(_c(p).cast("string"), F.lit("None"))) for p in parts]
    return F.concat(F.lit(prefix + "_"), F.upper(F.substring(sha256(F.concat_ws("\x1f", *texts)), 1, 16)))


def number_tokens(x: Column | str) -> Column:
    """Distinct numbers without grouping commas, in order of appearance."""
    found = F.regexp_extract_all(_c(x), F.lit(WORD_NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(""))))


def unsupported_numbers(statement, quote, period) -> Column:
    """Numbers of the statement that neither quote nor period holds."""
    return F.array_except(F.array_except(number_tokens(statement), number_tokens(quote)), number_tokens(period))


def glyphs_present(raw: Column | str, corpus: Column | str) -> Column:
    """P10: every numeric literal of raw occurs in the corpus, blanks aside."""
    packed = F.replace(_c(corpus), F.lit(" "), F.lit(""))
    return F.forall(F.regexp_extract_all(_c(raw), F.lit(NUMBER), F.lit(0)), lambda g: packed.contains(g))


def terms(x: Column | str) -> Column:
    """Lower-case Latin words and bigrams of each Han run, distinct."""
    latin = F.regexp_extract_all(F.lower(_c(x)), F.lit("[a-zA-Z][a-zA-Z0-9_]+"), F.lit(0))
    runs = F.filter(F.regexp_extract_all(_c(x), F.lit(r"[一-鿿]+"), F.lit(0)), lambda r: F.length(r) >= 2)
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(grams, latin))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping literal occurrences."""
    return F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term))


def relevance(text: Column | str, words: Column | str) -> Column:
    """Weight of an array of search terms in a text; a table of contents counts a tenth."""
    text, words, low = _c(text), _c(words), F.lower(_c(text))
    usable = F.filter(words, lambda t: F.length(t) >= 2)
    hits = F.aggregate(usable, F.lit(0).cast("long"), lambda a, t: a + (F.length(t) + 3) * F.least(occurrences(low, F.lower(t)), F.lit(4)))
    shared = F.size(F.array_intersect(terms(text), F.array_distinct(F.flatten(F.transform(words, terms)))))
    contents = (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) > 30) & text.contains("目录")
    return (hits + shared * F.lit(0.3)) * F.when(contents, 0.1).otherwise(1.0)


def object_type(x: Column | str) -> Column:
    """Legal, figure_caption, table_like or paragraph."""
    text = norm_text(x)
    lines = F.filter(F.split(text, "\n"), lambda s: strip(s) != "")
    numeric = F.size(F.filter(lines, lambda s: F.regexp_count(s, F.lit(LOOSE_NUMBER)) >= 2))
    n = F.size(lines)
    return F.when(text.rlike("|".join(LEGAL_MARKERS)), "legal").when(text.rlike(r"^(?:图表|图)\s*\d+"), "figure_caption").when((n >= 2) & (numeric >= F.greatest(F.lit(1), F.floor(n / 3))), "table_like").otherwise("paragraph")


def metric_occurrences(x: Column | str) -> Column:
    """Leftmost, longest, non-overlapping metric names of a line (as written)."""
    names = "|".join(sorted(METRIC_NAMES, key=len, reverse=True))
    return F.regexp_extract_all(_c(x), F.lit(f"(?i){names}"), F.lit(0))


def decimal_text(x: Column | str) -> Column:
    """A number's text without an exponent, all its digits kept; null if it is no finite number."""
    text = F.trim(_c(x).cast("string"))
    part = lambda i: F.regexp_extract(text, r"^([-+]?)(\d*)\.?(\d*)(?:[eE]([-+]?\d+))?$", i)
    digits = F.concat(part(2), part(3))
    point = F.length(part(2)) + F.coalesce(F.nullif(part(4), F.lit("")).try_cast("int"), F.lit(0))  # digits before the point
    n = F.length(digits)
    whole = F.when(point <= 0, "0").otherwise(F.rpad(F.substring(digits, F.lit(1), point), point, "0"))
    rest = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), digits)).when(point < n, F.substring(digits, point + 1, n))
    whole = F.coalesce(F.nullif(F.regexp_replace(whole, "^0+(?=.)", ""), F.lit("")), F.lit("0"))
    moved = F.when(n > 0, F.concat(F.when(part(1) == "-", "-").otherwise(""), whole, F.when(F.length(rest) > 0, F.concat(F.lit("."), rest)).otherwise("")))
    return F.when(text.rlike(r"\A-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z"), text).otherwise(moved)  # most numbers are plain: one match instead of dozens


def truncate(x: Column | str, n: int = 88) -> Column:
    """T15."""
    text = strip(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def escape_html(x: Column | str) -> Column:
    """T16."""
    out = F.coalesce(_c(x), F.lit(""))
    for char, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(by))
    return out


def fnv1a(x: Column | str) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text; a character beyond the basic plane is two units."""
    digits = F.hex(F.encode(_c(x), "UTF-16BE"))
    units = F.transform(F.regexp_extract_all(digits, F.lit("[0-9A-F]{4}"), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * 16777619).bitwiseAND(0xFFFFFFFF))
