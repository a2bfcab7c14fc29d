"""Tokens, and what plain texts say about themselves: links, tags, keywords, topic, dates, phone numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
#: Types whose content is text.
TEXT_TYPES = ("text/markdown", "text/plain", "text/x-markdown")
#: Fixed values, which decide what a text says, so that texts say here what they said elsewhere. A link: scheme:, wwwN. or host.tld/ and
#: a run without blanks, with brackets closed in it, and what no link ends with. Every repeat keeps what it took, so a text is read once.
LINK = r"(?i)(?:[a-z][a-z0-9_-]{1,62}:(?:/{1,3}|[a-z0-9%])|www[0-9]{0,3}[.]|[a-z0-9.-]{1,253}[.][a-z]{2,4}/)[^\s()<>]++(?:\([^\s()<>]*+\)[^\s()<>]*+)*+"
LINK_END = "[`!\\[\\]{};:'\".,?«»“”‘’]+$"
#: Bytes of a text that is read for links.
TEXT_LIMIT = 1 << 20
#: Characters of a tag, and the fewest of them; the fewest characters of a keyword and what its line starts with.
TAG, LEAST_TAG = "0-9A-Za-z_-", 3
KEYWORD_LINE, LEAST_KEYWORD = "Keywords: ", 3
#: The longest title; what a line that is no title ends or begins with.
TITLE, SENTENCE_ENDS, QUOTE_OR_HEADING = 40, (".", "?", "!", ":"), (">", "#")
#: A calendar date with one or two dashes after the year; digits of the groups of a phone number and what may stand before it.
DATE = "[0-9]{4}--?[0-9]{2}-[0-9]{2}"
PHONE, COUNTRY = (3, 3, 4), "1-"

# Markdown: an approximation by patterns of our own. A target may hold brackets that are closed in it; link texts hold none.
TARGET = r"<?((?:[^\s()<>]++|\([^\s()<>]*+\))++)>?"
INLINE = r"\[[^\[\]\n]*+\]\(\s*+" + TARGET + r"(?:\s++[^()\n]*+)?\)"
IMAGE, REFERENCE, BRACKETED = "!" + INLINE, r"(?m)^ {0,3}\[[^\[\]\n]++\]:[ \t]++<?([^\s<>]++)>?", r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*+)>"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; only ASCII letters are lowered and only ASCII characters separate."""
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda t: t != "")


def split_tokens(text: str) -> list[str]:
    """The same as tokens(), of a plain string."""
    return [t for t in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if t]


def first_token(text: Column) -> Column:
    return F.get(tokens(text), F.lit(0))


def porter_stem(word: str) -> str:
    """Porter's stemmer as published in 1980; words with other than a-z, and those of one or two letters, stay as they are."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word

    def kinds(s: str) -> str:
        out = ""
        for k, c in enumerate(s):
            out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
        return out

    def measure(s: str) -> int:
        return len(re.findall("v+c+", kinds(s)))

    def ends_short(s: str) -> bool:
        return kinds(s)[-3:] == "cvc" and s[-1] not in "wxy"

    def replaced(w: str, rules: list[tuple[str, str]], least: int) -> str:
        """The longest matching suffix decides, whether its condition holds or not."""
        for old, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(old):
                stem = w[: len(w) - len(old)]
                fits = measure(stem) > least and (old != "ion" or stem[-1:] in ("s", "t"))
                return stem + new if fits else w
        return w

    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and "v" in kinds(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif kinds(word)[-2:] == "cc" and word[-1] == word[-2] and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and ends_short(word):
                word += "e"
    if word.endswith("y") and "v" in kinds(word[:-1]):
        word = word[:-1] + "i"
    # The published suffix rules of steps 2, 3 and 4.
    step2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
    step3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    step4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
    word = replaced(word, list(zip(step2[::2], step2[1::2], strict=True)), 0)
    word = replaced(word, step3, 0)
    word = replaced(word, [(s, "") for s in step4], 1)
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not ends_short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


def is_text_type(kind: Column) -> Column:
    return F.lower(F.trim(F.split(kind, ";")[0])).isin(*TEXT_TYPES)


def links_in_text(body: Column) -> Column:
    """Links of a plain text, end punctuation trimmed; null for bodies over 1 MiB, which are refused."""
    found = F.transform(F.regexp_extract_all(body, F.lit(LINK), 0), lambda x: F.regexp_replace(x, LINK_END, ""))
    return F.when(F.octet_length(body) <= TEXT_LIMIT, F.array_distinct(F.filter(found, lambda x: x != "")))


def links_in_markdown(body: Column) -> Column:
    """Inline, reference and bracketed link targets, and plain links, of any length; images are no links, but may stand for a link's text."""
    text = F.regexp_replace(body, IMAGE, " ")
    marked = F.concat(*(F.regexp_extract_all(text, F.lit(form), 1) for form in (INLINE, REFERENCE, BRACKETED)))
    return F.array_distinct(F.concat(marked, F.coalesce(links_in_text(text), F.array().cast("array<string>"))))


def embeds_in_markdown(body: Column) -> Column:
    """Targets of images, of any length."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(IMAGE), 1))


def lines_of(body: Column) -> Column:
    return F.split(body, "\r\n|\r|\n")


def hashtags(body: Column, least: int = LEAST_TAG) -> Column:
    """Tags of words that start with #, after white space or an opening bracket; numbers are none."""
    words = F.filter(F.split(body, r"[\s(]"), lambda w: w.startswith("#"))
    tags = F.transform(words, lambda w: F.rtrim(F.regexp_extract(w, f"^#([{TAG}]*)", 1), F.lit("-")))
    return F.array_distinct(F.filter(tags, lambda t: (F.length(t) >= least) & t.rlike("[^0-9]")))


def keywords(body: Column, label: str = KEYWORD_LINE, least: int = LEAST_KEYWORD) -> Column:
    """Items of the lists behind a label, parted by commas, short ones left out; a blank belongs to the comma behind an item that counts."""
    lists = F.filter(F.transform(lines_of(body), lambda x: F.rtrim(F.regexp_extract(x, rf"\b{label}(.*)", 1))), lambda x: x != "")
    found = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(f"([^,]{{{least},}})(?:, )?"), 1)))
    return F.array_distinct(found)


def topic(body: Column, longest: int = TITLE) -> Column:
    """The first line as a title: a blank line follows it, it is no quotation, heading, sentence or labelled value, and short enough.

    What stands before a date is the title however long; a line that starts with its date has none.
    """
    lines = lines_of(body)
    line = F.when((F.size(lines) > 2) & (F.get(lines, F.lit(1)) == ""), F.get(lines, F.lit(0)))
    ends = F.right(line, F.lit(1)).isin(*SENTENCE_ENDS)
    marked = F.left(line, F.lit(1)).isin(*QUOTE_OR_HEADING) | F.startswith(line, F.lit("\\#"))
    label = F.regexp_extract(line, r"^([^:]*):\S", 1)
    labelled = label.rlike(f"^[0-9A-Za-z_][{TAG}]*$")
    dated = F.split(line, rf"\b{DATE}[0-9]?\b", 2)
    title = F.when(F.size(dated) > 1, F.get(dated, F.lit(0))).when(F.length(line) <= longest, line)
    return F.when(~ends & ~marked & ~labelled, F.nullif(F.trim(title), F.lit("")))


def iso_time(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def dates(body: Column) -> Column:
    """Dates of a text, with the time of day behind them if there is one, as ISO instants in UTC; impossible ones are left out."""
    clock = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AaPp])[Mm])?"
    found = F.regexp_extract_all(body, F.lit(rf"\b{DATE}(?: {clock})?"), 0)

    def instant(x: Column) -> Column:
        part = lambda n: F.coalesce(F.nullif(F.regexp_extract(x, clock, n), F.lit("")).cast("int"), F.lit(0))
        half = F.upper(F.regexp_extract(x, clock, 4))
        hour = F.when(half == "", part(1)).otherwise(part(1) % 12 + F.when(half == "P", 12).otherwise(0))
        day = F.split(F.replace(F.regexp_extract(x, f"^{DATE}", 0), F.lit("--"), F.lit("-")), "-")
        number = lambda n: F.get(day, F.lit(n)).cast("int")
        return iso_time(F.try_make_timestamp(number(0), number(1), number(2), hour, part(2), part(3).cast("decimal(8,6)")))

    return F.array_distinct(F.filter(F.transform(found, instant), lambda x: x.isNotNull()))


def phones(body: Column, groups: tuple[int, int, int] = PHONE, country: str = COUNTRY) -> Column:
    """Numbers of three groups of digits joined by dashes, the first in brackets or behind the country's digit and a dash."""
    area, middle, last = (f"[0-9]{{{n}}}" for n in groups)
    return F.array_distinct(F.regexp_extract_all(body, F.lit(rf"(?:\({area}\) |\b(?:{country})?{area}-){middle}-{last}\b"), 0))


def tag_edits(body: Column, least: int = LEAST_TAG) -> Column:
    """struct(target, tags) of a file that only adds or removes tags of another; removals are ignored."""
    lines = F.filter(lines_of(body), lambda x: x != "")
    target, edits = F.get(lines, F.lit(0)), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    good = (F.size(edits) > 0) & target.rlike(r"^hash:\S+$") & F.forall(edits, lambda x: x.rlike(f"^[+-] #[{TAG}]{{{least},}}$"))
    tags = F.transform(F.filter(edits, lambda x: x.startswith("+")), lambda x: F.rtrim(F.substring(x, 4, 1 << 20), F.lit("-")))
    return F.when(good, F.struct(target.alias("target"), F.array_distinct(tags).alias("tags")))


def classify_visibility(rows: DataFrame, topics: DataFrame, tags: DataFrame, allowed: DataFrame, blocked: DataFrame, private: tuple[str, ...] = ("private",), body: str = "body", uri: str = "uri") -> DataFrame:
    """`rows` with a column public: its topic, a tag of it or its address is listed, and nothing in it is private.

    The lists are tables: topics(topic), tags(tag), allowed(uri) and blocked(uri); they may be of any size. `private` are tags and
    keywords that, like a phone number, keep a text private.
    """
    column = F.col(body)
    none = F.array().cast("array<string>")
    told = rows.withColumn("row_", F.monotonically_increasing_id()).withColumn("topic_", topic(column)).withColumn("tags_", F.coalesce(hashtags(column), none))
    secret = F.exists("tags_", lambda t: t.isin(*private)) | F.exists(F.coalesce(keywords(column), none), lambda t: t.isin(*private)) | (F.size(F.coalesce(phones(column), none)) > 0)
    told = told.withColumn("secret_", secret)
    listed = lambda df, name, to: df.select(F.col(name).alias(to)).distinct().withColumn(f"in_{to}", F.lit(True))
    tagged = told.select("row_", F.explode("tags_").alias("tag_")).join(listed(tags, "tag", "tag_"), "tag_", "left_semi").select("row_").distinct().withColumn("tagged_", F.lit(True))
    found = told.join(listed(topics, "topic", "topic_"), "topic_", "left").join(tagged, "row_", "left")
    found = found.join(listed(allowed, "uri", uri), uri, "left").withColumnRenamed(f"in_{uri}", "allowed_").join(listed(blocked, "uri", uri), uri, "left").withColumnRenamed(f"in_{uri}", "blocked_")
    public = (F.col("in_topic_").isNotNull() | F.col("tagged_").isNotNull() | F.col("allowed_").isNotNull()) & ~F.col("secret_") & F.col("blocked_").isNull()
    return found.withColumn("public", public).select(*rows.columns, "public")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def render_plain(body: Column, note: str = "hash address") -> Column:
    """A plain text as escaped HTML with its links (those of links_in_text) marked; hash addresses become queries, with the raw one beside them."""

    def marked(x: Column) -> Column:
        safe = escape_html(x)
        asked = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
        hashed = F.concat(F.lit('<a href="?q='), asked, F.lit('">'), safe, F.lit('</a><sup>[<a href="'), safe, F.lit(f'" title="{note}">#</a>]</sup>'))
        return F.when(F.lower(F.substring(x, 1, 5)) == "hash:", hashed).otherwise(F.concat(F.lit('<a href="'), safe, F.lit('">'), safe, F.lit("</a>")))

    def linked(x: Column) -> Column:
        link = F.regexp_replace(x, LINK_END, "")
        return F.when(link == "", escape_html(x)).otherwise(F.concat(marked(link), escape_html(F.right(x, F.length(x) - F.length(link)))))

    # texts and links by turns
    texts, links = F.split(body, LINK, -1), F.regexp_extract_all(body, F.lit(LINK), 0)
    parts = F.zip_with(texts, links, lambda t, x: F.concat(escape_html(t), F.coalesce(linked(x), F.lit(""))))
    return F.concat(F.lit("<pre>"), F.array_join(parts, ""), F.lit("</pre>"))


def human_size(size: Column) -> Column:
    """Bytes to the base 1024: whole bytes, or one decimal (ties to even) in KB to TB."""
    out = F.format_string("%.0f B", size.cast("double"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(size / float(1024**power), 1))).otherwise(out)
    return out


def natural_key(name: Column, width: int = 20) -> Column:
    """Sort key under which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def cdata(text: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))
