"""Column functions: text, hosts, links, names, counts, time buckets, JSON and scores. None needs a UDF but
`unescaped`, which resolves character references of markup in Arrow batches."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Names of the twenty event roots and the four quad classes of the public CAMEO coding scheme.
EVENT_ROOTS = {
    "01": "make public statement", "02": "appeal", "03": "express intent to cooperate", "04": "consult", "05": "engage in diplomatic cooperation",
    "06": "engage in material cooperation", "07": "provide aid", "08": "yield", "09": "investigate", "10": "demand", "11": "disapprove", "12": "reject", "13": "threaten",
    "14": "protest", "15": "exhibit force posture", "16": "reduce relations", "17": "coerce", "18": "assault", "19": "fight", "20": "use unconventional mass violence",
}
QUAD_CLASSES = {1: "verbal cooperation", 2: "material cooperation", 3: "verbal conflict", 4: "material conflict"}


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def norm_title(title: Column) -> Column:
    """A headline's key: lower case, without a trailing ` - Site`, ` | Site` and punctuation, one space between
    words; null if nothing is left."""
    bare = F.regexp_replace(F.lower(title), "(?U)\\s+[-|–—:]\\s+[^-|–—:]{2,40}$", "")
    words = F.regexp_replace(bare, "[^\\p{L}\\p{M}\\p{Nd}\\s]", "")
    return empty_to_null(F.trim(F.regexp_replace(words, "(?U)\\s+", " ")))


def host_suffixes(host: Column) -> Column:
    """The host, in lower case, and each of its parent domains, on label boundaries."""
    parts = F.split(F.lower(host), "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def link_host(url: Column) -> Column:
    """Host of an absolute link as written, null if there is none."""
    return empty_to_null(F.regexp_extract(url, "^[A-Za-z]+://([^/:?#]+)", 1))


def site_of(url: Column) -> Column:
    """Host in lower case, without `www.` and a trailing dot; null for what is no URL."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return empty_to_null(F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), "\\.$", ""))


def links_in(text: Column) -> Column:
    """All links of a text in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(https?://[^\\s<>\"')]+)"), F.lit(1))


@pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references resolved."""
    return text.map(html.unescape, na_action="ignore")


def three_references(text: Column) -> Column:
    """`&lt;`, `&gt;` and `&amp;` resolved, all else as written: other names, and names without a semicolon, which HTML also reads."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def page_title(page: Column, most: int = 300, resolved: Callable[[Column], Column] = unescaped) -> Column:
    """og:title, else the title element, of the part before the body, its character references `resolved`; null if blank."""
    head = F.regexp_extract(page, "(?is)^(.*?)(?:<body\\b|$)", 1)
    meta = F.regexp_extract(head, "(?is)<meta\\b[^>]*\\bproperty\\s*=\\s*[\"']og:title[\"'][^>]*>", 0)
    og = F.coalesce(empty_to_null(F.regexp_extract(meta, '(?is)\\bcontent\\s*=\\s*"([^"]*)"', 1)), F.regexp_extract(meta, "(?is)\\bcontent\\s*=\\s*'([^']*)'", 1))
    plain = F.regexp_extract(head, "(?is)<title[^>]*>(.*?)</title>", 1)
    clean = lambda c: empty_to_null(F.substring(F.trim(F.regexp_replace(resolved(c), "(?U)\\s+", " ")), 1, most))
    return F.coalesce(clean(og), clean(plain))


def plain_text(fragment: Column) -> Column:
    """Text of a piece of markup: line breaks kept, tags dropped, references resolved."""
    return F.trim(unescaped(F.regexp_replace(F.regexp_replace(fragment, "(?i)<br\\s*/?>", "\n"), "<[^>]+>", "")))


def human_count(text: Column) -> Column:
    """`34.9K`, `1.2M`, `871` as a whole number, half to even; null for what is none."""
    bare = F.upper(F.regexp_replace(text, "[\\s,]", ""))
    by = F.when(bare.endswith("K"), 1e3).when(bare.endswith("M"), 1e6).when(bare.endswith("B"), 1e9).otherwise(1.0)
    return F.bround(F.regexp_replace(bare, "[KMB]$", "").try_cast("double") * by, 0).cast("long")


def name_variants(name: Column) -> Column:
    """The full name and, of a name that ends in a parenthesis, what stands before and within it, without repeats."""
    part = lambda i: F.regexp_extract(name, "^(.*?)\\s*\\(([^()]+)\\)\\s*$", i)
    return F.array_distinct(F.filter(F.array(name, part(1), part(2)), lambda x: x != ""))


def name_keys(name: Column) -> Column:
    """Lower-case letters and digits of each variant of a name."""
    return F.array_distinct(F.filter(F.transform(name_variants(name), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")), lambda x: x != ""))


def good_handle(handle: Column) -> Column:
    """A channel's handle, not that of a bot."""
    return handle.rlike("^[A-Za-z][A-Za-z0-9_]{3,31}$") & ~F.lower(handle).endswith("bot")


def good_channel_id(channel: Column) -> Column:
    return channel.rlike("^UC[A-Za-z0-9_-]{22}$")


#: Scripts that are written without spaces between words; in the first, two signs make a name.
UNSPACED = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}"


def usable_name(name: Column, primary: Column) -> Column:
    """Whether a place's name may be looked for in posts: no digits and a letter first. Cased names begin with a capital, have at
    least 3 signs, and all-capital ones of up to 4 count only where they are the place's first name; Han names have 2 signs at
    least, others 3."""
    n, bare = F.length(F.trim(name)), F.trim(name)
    code = (F.upper(bare) == bare) & (n <= 4) & ~primary
    held = F.when(bare.rlike("^\\p{Lu}"), (n >= 3) & ~code).when(bare.rlike("^\\p{Ll}") | ~bare.rlike("^\\p{L}"), False).when(bare.rlike("^\\p{IsHan}"), n >= 2).otherwise(n >= 3)
    return ~bare.rlike("\\p{Nd}") & held


def quarter_hour(ts: Column) -> Column:
    """The start of the quarter of an hour."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / 900) * 900)


def five_minutes(ts: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / 300) * 300)


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    """Deviation with a floor under sd: the square root of the mean (counts), and 1."""
    return (x - mean) / F.greatest(sd, F.sqrt(F.greatest(mean, F.lit(0.0))), F.lit(1.0))


def tint(x: Column) -> Column:
    return 1 + F.log10(1 + x)


def gated(z: Column, mentions: Column, least: int = 50) -> Column:
    """z where there are enough mentions, else 0."""
    return F.when(mentions >= least, z).otherwise(F.lit(0.0))


def legend(code: Column, names: dict) -> Column:
    """Name of a code, null for an unknown one."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code)


def all_fields_json(*columns: str | Column) -> Column:
    """A JSON object that keeps null fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def sphere_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371.0088) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
